"""Language of mixed texts: scripts narrow the candidates, a Viterbi path over words labels spans."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.words import give_back

UNKNOWN = "und"

# First code points of Unicode ranges, and the script from there on.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"),
    (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1780, "khmer"),
    (0x1800, "mongolian"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0x10000, "other"),
    (0x20000, "han"),
)
_STARTS = [start for start, _ in SCRIPTS]

#: Score lost by changing the language between two words.
SWITCH = 6.0
#: Rows of the table of n-grams: their hashes modulo this number share a row.
TABLE_ROWS = 1 << 18
#: Letters scored at once, and letters of all texts whose paths are searched together; divided by
#: the number of languages.
LETTERS = 1 << 21
PATH_LETTERS = 1 << 24

#: Rows whose texts are Python strings at a time.
PART_ROWS = 2_048
_MIX = np.uint32(0x9E3779B1)


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: whether it is a letter, and its lower case."""
    points = range(0x110000)
    letter = np.fromiter((chr(p).isalpha() for p in points), bool, len(points))
    lower = np.arange(len(points), dtype=np.uint32)
    for p in np.flatnonzero(letter).tolist():
        small = chr(p).lower()
        if len(small) == 1:
            lower[p] = ord(small)
    return letter, lower


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of code points, each ended by a 0; where each begins, and the end."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return points, np.concatenate([[0], np.cumsum(sizes)])


def find_words(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters by place, and start and end of every run of letters; the last point is no letter."""
    letter = _letters()[0][points]
    edge = np.flatnonzero(np.diff(letter.astype(np.int8), prepend=0))
    return letter, edge[0::2], edge[1::2]


def gram_rows(points: np.ndarray, letter: np.ndarray) -> Iterator[tuple[np.ndarray | None, np.ndarray]]:
    """Table rows of the n-grams of two to four letters, in the order of the letters.

    What is no letter counts as one mark of a word's end, which an n-gram may begin or end with. A
    letter has a pair that begins with it and a triple around it; where another letter follows also
    four that begin before it: then the first value tells which letters these are.
    """
    at = np.flatnonzero(letter)
    marked = np.where(letter, _letters()[1][points], np.uint32(0))
    padded = np.concatenate([np.zeros(1, np.uint32), marked, np.zeros(2, np.uint32)])
    here, after = padded[at + 1], padded[at + 2]
    pair = (here * _MIX) ^ (after + (after << np.uint32(7)))
    triple = (pair * _MIX) ^ padded[at]
    longer = np.flatnonzero(after)
    four = (triple[longer] * _MIX) ^ padded[at[longer] + 3]
    for n, which, value in ((2, None, pair), (3, None, triple), (4, longer, four)):
        value = (value ^ np.uint32(n)) * _MIX
        yield which, (value ^ (value >> np.uint32(15))) % np.uint32(TABLE_ROWS)


def pieces(points: np.ndarray, step: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``step`` points that end where no word goes on."""
    letter, begin = _letters()[0], 0
    while begin < len(points):
        end = min(begin + step, len(points))
        while end < len(points) and letter[points[end - 1]]:
            rest = np.flatnonzero(~letter[points[end : end + step]])
            end = end + int(rest[0]) + 1 if len(rest) else min(end + step, len(points))
        yield begin, end
        begin = end


@dataclass(frozen=True)
class LanguageModel:
    """Languages, which of them are written in each script, and the worth of every n-gram."""

    languages: tuple[str, ...]
    scripts: np.ndarray  # range of SCRIPTS, language
    table: np.ndarray  # row of an n-gram, language

    def word_scores(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, letters and scores of each word.

        A score is the log-likelihood over the root of the number of n-grams. Languages that are not
        written in the script of a word are out, unless none is.
        """
        starts, sizes, scores = [], [], []
        kinds = len(self.languages)
        for begin, end in pieces(points, max(1 << 12, LETTERS // kinds)):
            part = np.append(points[begin:end], np.uint32(0))
            letter, start, stop = find_words(part)
            if not len(start):
                continue
            worth = np.zeros((int((stop - start).sum()), kinds), np.float32)
            for which, row in gram_rows(part, letter):
                if which is None:
                    worth += self.table.take(row, axis=0)
                else:
                    worth[which] += self.table.take(row, axis=0)
            total = np.add.reduceat(worth, np.cumsum(stop - start) - (stop - start), axis=0)
            total /= np.sqrt(3 * (stop - start) - 1)[:, None]
            where = np.searchsorted(_STARTS, part[start], side="right") - 1
            total += np.where(self.scripts[where], 0.0, -50.0)
            starts.append(start + begin)
            sizes.append(stop - start)
            scores.append(total)
        if not starts:
            return np.zeros(0, int), np.zeros(0, int), np.zeros((0, kinds))
        return np.concatenate(starts), np.concatenate(sizes), np.concatenate(scores)


def fit_language(sample: Sequence[tuple[str, str]], share: float = 0.01) -> LanguageModel:
    """Count n-grams of the words of ``(text, language)`` rows.

    A language is a candidate for a script that at least ``share`` of its words are written in; a
    script that no language has leaves all of them. Without rows there is no language.
    """
    languages = tuple(sorted({lang for _, lang in sample}))
    counts = np.zeros((TABLE_ROWS, len(languages)))
    written = np.zeros((len(SCRIPTS), len(languages)))
    for k, lang in enumerate(languages):
        for text in (t for t, x in sample if x == lang):
            points, _ = code_points([text])
            letter, start, _ = find_words(points)
            for _, row in gram_rows(points, letter):
                counts[:, k] += np.bincount(row, minlength=TABLE_ROWS)
            where = np.searchsorted(_STARTS, points[start], side="right") - 1
            written[:, k] += np.bincount(where, minlength=len(SCRIPTS))
    names = [name for _, name in SCRIPTS]
    same = np.array([[a == b for b in names] for a in names])
    by_script = same @ written
    wanted = by_script >= np.maximum(share * written.sum(0), 1)
    wanted[~wanted.any(1)] = True
    table = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * TABLE_ROWS))
    table -= table.mean(1, keepdims=True) if languages else 0
    return LanguageModel(languages, wanted, table.astype(np.float32))


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The best language of each word, for many texts at once.

    ``scores`` holds a row per word, text after text; ``lengths`` the words of each text, none of
    them 0. One step handles the next word of all texts that still have one.
    """
    total, kinds = scores.shape
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    first = (np.cumsum(lengths) - lengths)[order]
    # How many texts have a word at each step; the longest come first.
    going = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), side="right").tolist()
    back = np.empty((total, kinds), np.min_scalar_type(kinds))
    best = scores[first].astype(float)
    own = np.arange(kinds, dtype=back.dtype)
    last = np.empty((len(lengths), kinds))
    at = first.copy()
    for before, now in zip(going, going[1:], strict=False):
        if now < before:
            last[now:before] = best[now:]
            best, at = best[:now], at[:now]
        at += 1
        top = best.argmax(1)
        jump = best.max(1, keepdims=True) - penalty
        back[at] = np.where(best < jump, top[:, None], own)
        best = np.maximum(best, jump)
        best += scores[at]
    last[: len(best)] = best
    path = np.empty(total, np.int32)
    state = last.argmax(1)
    at = first + sizes - 1
    for now in going:
        path[at[:now]] = state[:now]
        state[:now] = back[at[:now], state[:now]]
        at[:now] -= 1
    return path


def _label(model: LanguageModel, texts: Sequence[str], penalty: float) -> list[tuple[str, float, list[dict]]]:
    """Language, score and spans of each text."""
    results: list[tuple[str, float, list[dict]]] = [(UNKNOWN, 0.0, [])] * len(texts)
    names = model.languages
    if not names or not texts:
        return results
    points, begins = code_points(texts)
    start, size, scores = model.word_scores(points)
    if not len(start):
        return results
    owner = np.searchsorted(begins, start, side="right") - 1
    group, text, lengths = np.unique(owner, return_inverse=True, return_counts=True)
    path = viterbi(scores, lengths, penalty)
    kinds = len(names)
    letters = np.bincount(text * kinds + path, size, len(group) * kinds).reshape(-1, kinds)
    new = np.ones(len(path), bool)
    new[1:] = (path[1:] != path[:-1]) | (text[1:] != text[:-1])
    starts = np.flatnonzero(new)
    span_letters = np.add.reduceat(size, starts)
    span_words = np.diff(np.append(starts, len(path)))
    spans: list[list[dict]] = [[] for _ in group]
    first = (np.cumsum(lengths) - lengths)[text[starts]]
    for t, at, n, chars, lang in zip(
        text[starts].tolist(), (starts - first).tolist(), span_words.tolist(), span_letters.tolist(),
        path[starts].tolist(), strict=True,
    ):
        spans[t].append({"first_word": at, "words": n, "letters": chars, "lang": names[lang]})
    best = letters.argmax(1)
    share = letters[np.arange(len(group)), best] / letters.sum(1)
    for t, i in enumerate(group.tolist()):
        results[i] = (names[best[t]], float(share[t]), spans[t])
    return results


def _groups(texts: Sequence[str], letters: int) -> Iterator[list[str]]:
    """Texts in runs of about so many characters; a longer text stands alone."""
    run: list[str] = []
    held = 0
    for text in texts:
        if run and held + len(text) > letters:
            yield run
            run, held = [], 0
        run.append(text)
        held += len(text)
    if run:
        yield run


SPANS = "array<struct<first_word: long, words: long, letters: long, lang: string>>"


def label_languages(
    docs: DataFrame,
    model: LanguageModel,
    penalty: float = SWITCH,
    id: str = "doc_id",
    text: str = "text",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``id``, ``lang_pred``, ``score`` and the language spans of every whole text.

    The language of a text is the one with the most letters in its spans, ties to the first by
    name; the score is its share of the letters. A text that is null or has no letter is ``und``
    with score 0 and no span. Rows stay one to one; no shuffle. Other columns are not read, unless
    ``keep`` names some: then a struct ``row`` of them follows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    within = keep is not None and text in keep
    span = pa.struct(
        [("first_word", pa.int64()), ("words", pa.int64()), ("letters", pa.int64()), ("lang", pa.string())]
    )

    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pc.struct_field(batch.column(1), text) if within else batch.column(1)
            held = PATH_LETTERS // max(1, len(shared.value.languages))
            # Texts become Python strings, and spans Python lists, for a part of the batch at a time.
            for begin in range(0, len(batch), PART_ROWS):
                part = batch.slice(begin, PART_ROWS)
                texts = [t or "" for t in column.slice(begin, PART_ROWS).to_pylist()]
                found = [x for run in _groups(texts, held) for x in _label(shared.value, run, penalty)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([x[0] for x in found], pa.string()),
                        pa.array([x[1] for x in found], pa.float64()),
                        pa.array([x[2] for x in found], pa.list_(span)),
                        *part.columns[1 if within else 2 :],
                    ],
                    names,
                )
            give_back()

    # Where the kept columns hold the text, it travels once.
    rows = docs.select(
        F.col(id).alias("id"),
        *([] if within else [F.col(text).alias("text")]),
        *([] if keep is None else [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")]),
    )
    found = T.StructType.fromDDL(f"lang_pred string, score double, spans {SPANS}").fields
    kind = T.StructType([rows.schema["id"], *found, *rows.schema.fields[1 if within else 2 :]])
    names = kind.names
    labelled = rows.mapInArrow(labels, kind)
    return labelled.withColumnRenamed("id", id)
