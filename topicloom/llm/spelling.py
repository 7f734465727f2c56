"""Words of a corpus that differ by one letter, by bitsets over blocks of the vocabulary.

For each position and letter a bitset tells which words of a block hold that letter there. A word runs
through its letters once and carries four sets along, of 64 words of the block at a time: those that
agree so far, and those that have one letter replaced, one more or one less so far. The latter two
read the bitsets at positions shifted by one. Many words of one length run together.

Which words meet: words one letter apart agree on their first ``k`` letters or on their last ``k``, for
any ``k`` up to half of the shorter one. So a word is filed under both ends, for the pairs in which it
is the shorter one (or the lengths are equal) and for those in which it is the longer one. Buckets of
ends are blocks, and a bucket of very many words is cut into pieces of which every two meet. What comes
out is a count and a best word per word and block, never pairs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.store import written
from topicloom.operators.skew import frequent_keys, salted_join

#: Code points of a word at least, and how often it must occur.
SHORTEST = 5
LEAST = 3
#: One in so many occurrences is worked on with a letter less.
DROPPED = 97
#: Letters of an end that words are filed by, at most.
END = 3
#: Words of a bucket that are wanted, and words of a piece at most.
BUCKET_WORDS = 2_048
PIECE_WORDS = 4_096
#: 64-bit numbers of the sets that words carry along at a time.
STRIP = 1 << 15

# Letters of a run are A-Z, a-z and U+00C0 to U+00FF, of which A-Z are lowered. In Latin-1
# these are single bytes, and what is no letter parts runs, as does everything that Latin-1 lacks.
_RUNS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256)
)

_COUNTED = "word string, n long"
_FOUND = "word string, n_near long, best long, form string"


def runs_of(text: str) -> list[bytes]:
    """Lowered runs of letters of a text, in Latin-1."""
    return text.encode("latin-1", "replace").translate(_RUNS).split(b" ")


def shortened(id: object, runs: Iterable[bytes], dropped: int = DROPPED) -> Iterator[tuple[bytes, bytes]]:
    """The distinct runs that lose a letter in the text of this id, and what is left of them.

    The crc32 is that of UTF-8 ``id:run``.
    """
    start = zlib.crc32(f"{id}:".encode())
    for run in runs:
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % dropped == 0 and run:
            at = h % len(run)
            yield run, run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n`` over all texts; a null id is written as empty text, null texts hold nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[bytes] = Counter()
            for i, value in zip(*batch.columns, strict=True):
                here = Counter(runs_of(value.as_py() or ""))
                counts.update(here)
                for whole, left in shortened(i.as_py() or "", here):
                    counts[whole] -= here[whole]
                    counts[left] += here[whole]
            del counts[b""]
            words = pa.array([w.decode("latin-1") for w in counts], pa.string())
            yield pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(id).cast("string").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, _COUNTED).groupBy("word").agg(F.sum("n").alias("n"))


class PositionIndex:
    """Bitsets of the words of a block by position and letter.

    The words have ``least`` letters or one more. A set is a row of 64-bit numbers, one bit per word.
    """

    def __init__(self, words: list[str], least: int):
        self.least = least
        letters = _letters(words, least + 1)
        self.alphabet = np.unique(letters)  # 0 stands beyond the end of the shorter words
        codes = np.searchsorted(self.alphabet, letters)
        width = -(-len(words) // 64)
        # The last letter is one that no word holds.
        self.sets = np.zeros((least + 1, len(self.alphabet) + 1, width), np.uint64)
        for at in range(least + 1):
            held = np.zeros((len(self.alphabet) + 1, 64 * width), bool)
            held[codes[:, at], np.arange(len(words))] = True
            self.sets[at] = np.packbits(held, axis=1, bitorder="little").view("<u8")
        end = self._codes(np.zeros((1, 1), letters.dtype))[0, 0]
        self.shorter = self.sets[least, end]
        real = np.packbits(np.arange(64 * width) < len(words), bitorder="little").view("<u8")
        self.longer = real & ~self.shorter

    def _codes(self, letters: np.ndarray) -> np.ndarray:
        code = np.minimum(np.searchsorted(self.alphabet, letters), len(self.alphabet) - 1)
        return np.where(self.alphabet[code] == letters, code, len(self.alphabet))

    def near(self, words: list[str], end: int, first: bool) -> np.ndarray:
        """One set per word (all of one length): the words that are one letter off.

        ``first`` wants pairs that agree on the first ``end`` letters, otherwise those that do not. Pairs
        of two longer words are not found here.
        """
        size = len(words[0])
        letters = self._codes(_letters(words, size))
        agree = np.repeat((self.shorter if size > self.least else self.shorter | self.longer)[None], len(words), 0)
        replaced, more, less = (np.zeros_like(agree) for _ in range(3))
        apart = None
        for i in range(size):
            here = self.sets[i][letters[:, i]]
            if size > self.least:
                # A letter of the word is missing in the other: what follows stands one earlier.
                if i:
                    less &= self.sets[i - 1][letters[:, i]]
                less |= agree
            else:
                # The other has a letter more here, or another one.
                more = (more | agree) & self.sets[i + 1][letters[:, i]]
                replaced = (replaced & here) | (agree & ~here)
            agree &= here
            if i + 1 == end:
                if first:
                    replaced, more, less = (np.zeros_like(agree) for _ in range(3))
                else:
                    apart = ~agree
        if size > self.least:
            found = less & self.shorter
        else:
            found = (replaced & self.shorter) | ((more | agree) & self.longer)
        return found if first else found & apart


def _letters(words: list[str], width: int) -> np.ndarray:
    """Code points of words, one row each, 0 beyond the end."""
    return np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width)


def _lowest(sets: np.ndarray) -> np.ndarray:
    """The lowest place in each set that is not empty."""
    word = (sets != 0).argmax(1)
    bits = sets[np.arange(len(sets)), word]
    return 64 * word + np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1))


def search(
    searched: list[tuple[str, int]], asking: list[str], least: int, end: int, first: bool
) -> Iterator[tuple[str, int, int, str]]:
    """``(word, near words, largest count, its word)`` of the asking words that have near words.

    Words of the block stand in the order of counts and, of equal ones, of code points, so that the
    lowest bit of a set is the best word.
    """
    if not searched:
        return
    searched = sorted(searched, key=lambda x: (-x[1], x[0]))
    index = PositionIndex([w for w, _ in searched], least)
    for size in (least, least + 1):
        words = [w for w in asking if len(w) == size]
        step = max(1, STRIP // index.sets.shape[2])
        for begin in range(0, len(words), step):
            strip = words[begin : begin + step]
            sets = index.near(strip, end, first)
            counts = np.bitwise_count(sets).sum(1, dtype=np.int64)
            for i, at in zip(np.flatnonzero(counts).tolist(), _lowest(sets[counts > 0]).tolist(), strict=True):
                yield strip[i], int(counts[i]), searched[at][1], searched[at][0]


def _filed(words: DataFrame) -> DataFrame:
    """``(least, first, end, word, n)``: each word under both ends, as shorter and as longer word."""
    length = F.length("word")
    # A pair's shorter word has ``least`` letters; the shortest words have no shorter partner.
    least = F.explode(F.when(length > SHORTEST, F.array(length, length - 1)).otherwise(F.array(length)))
    sides = words.select("word", "n", least.alias("least"), F.explode(F.array(F.lit(True), F.lit(False))).alias("first"))
    k = F.least(F.floor(F.col("least") / 2), F.lit(END)).cast("int")
    end = F.when(F.col("first"), F.substring("word", F.lit(1), k)).otherwise(F.substring("word", -k, k))
    return sides.select("least", "first", k.alias("k"), end.alias("end"), "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best, form`` of the words of ``(word, n)`` that have near words.

    ``form`` is the near word of largest ``n`` (``best``), of equal ones the smallest in the order of code
    points. Words come once each and have ``SHORTEST`` letters at least.
    """
    filed = _filed(words)
    # Buckets by a hash of the end, in each length as many as its words fill; few lengths fill several.
    lengths = filed.where("first").groupBy("least").count().where(F.col("count") > BUCKET_WORDS).collect()
    wanted = F.lit(1)
    for r in lengths:
        wanted = F.when(F.col("least") == r.least, F.lit(-(-r["count"] // BUCKET_WORDS))).otherwise(wanted)
    key = ["least", "first", "bucket"]
    filed = filed.withColumn("bucket", F.pmod(F.xxhash64("end"), wanted).cast("int"))
    filed = written(filed.select(*key, "k", "word", "n"), "filed_words")
    # Buckets larger than a piece: at most one in so many filed words.
    large = filed.groupBy(*key).count().where(F.col("count") > PIECE_WORDS)
    pieces = F.ceil(F.col("count") / PIECE_WORDS).cast("int").alias("pieces")
    large = written(large.select(*key, pieces), "large_buckets")
    small_enough = large.count() <= 1_000_000
    cut = filed.join(F.broadcast(large) if small_enough else large, key, "left")
    cut = cut.withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int"))
    other = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    asked = other.select("*", F.col("own").alias("p"), F.col("other").alias("q"))
    # ``p`` is the piece that is searched and ``q`` the one that asks.
    asking = other.where("own <> other").select("*", F.col("other").alias("p"), F.col("own").alias("q"))
    met = asked.unionByName(asking).select(*key, "p", "q", "k", "own", "word", "n")

    def run(table: pa.Table) -> pa.Table:
        own = table.column("own").to_numpy()
        words = list(zip(table.column("word").to_pylist(), table.column("n").to_pylist(), strict=True))
        searched = [words[i] for i in np.flatnonzero(own == table.column("p")[0].as_py())]
        asking = [words[i][0] for i in np.flatnonzero(own == table.column("q")[0].as_py())]
        found = search(searched, asking, *(table.column(c)[0].as_py() for c in ("least", "k", "first")))
        columns = list(zip(*found, strict=True)) or [[]] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        return pa.table(arrays, names=["word", "n_near", "best", "form"])

    found = met.groupBy(*key, "p", "q").applyInArrow(run, _FOUND)
    best = F.min(F.struct((-F.col("best")).alias("less"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("best.less")).alias("best"), F.col("best.form").alias("form")
    )


def _rooted(linked: DataFrame) -> DataFrame:
    """``word, root``: the last word that is reached from each ``(word, form)``.

    Links are doubled, and as a form is at least twice as frequent as its word, ten rounds reach the end
    of any chain of counts that fit a long.
    """
    reached = written(linked.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = salted_join(reached, further, "root", "word", frequent_keys(reached, "root"), "left")
        step = written(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        reached = step.select("word", "root")
        if not step.where("moved").take(1):
            return reached


def group_variants(
    docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST
) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: words of a corpus and the spelling each belongs to.

    Runs of ``A-Z``, ``a-z`` and U+00C0 to U+00FF of whole texts are words, with A-Z lowered; where
    ``DROPPED`` divides the crc32 of ``id:run``, the run lacks one letter, at the place ``crc32 % length``.
    Words of ``SHORTEST`` letters that occur ``least`` times at least are the vocabulary. Two are near if one
    letter more, less or replaced makes one the other. ``form`` is the most frequent near word (the
    smaller one in the order of code points where counts are equal) if it is at least twice as frequent
    as the word; ``root`` follows the forms to the last one and is the word itself where there is none.
    ``n_near`` is 0 and ``form``, ``form_n`` are null where nothing is near or frequent enough.

    Null texts hold no words; the id of a null is empty text; repeated rows count each. Other columns
    are not read. An empty table or one without words gives no rows.
    """
    words = count_words(docs, id, text).where((F.col("n") >= least) & (F.length("word") >= SHORTEST))
    words = written(words, "vocabulary")
    near = written(near_words(words), "near_words")
    joined = words.join(near, "word", "left")
    good = F.col("best") >= 2 * F.col("n")
    joined = written(
        joined.select(
            "word",
            F.when(good, F.col("form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(good, F.col("best")).alias("form_n"),
        ),
        "forms",
    )
    roots = _rooted(joined.where("form IS NOT NULL"))
    return joined.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
