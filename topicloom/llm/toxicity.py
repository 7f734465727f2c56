"""Toxicity by weak supervision: voters, a generative model of them, a linear classifier."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.sample import logistic, row_weights

WORD = re.compile(r"[^\W\d_]+")

#: Lexicons drawn from the labelled texts, entries of one at most, texts an entry must occur in,
#: and its least log-odds.
LEXICONS = 6
LEXICON_ENTRIES = 200
LEAST_TEXTS = 3
LEXICON_ODDS = 2.5
#: Beginnings of words that serve as patterns, by length.
PREFIXES = (5, 6, 7, 8)
#: Numbers of words that share a beginning from which that counts as a key of its own.
SHARED_BY = (2, 4)
#: Votes of a voter: for, against, none.
FOR, AGAINST, NONE = 1, -1, 0
#: Rounds of the label model, and the correlation from which two voters count as one source.
ROUNDS = 60
CORRELATED = 0.3
#: Features of the classifier at most, how many standard deviations apart from chance they must
#: lie, and what holds their weights down.
FEATURES = 5_000
BEYOND_CHANCE = 4.0
RIDGE = 2.0
STEPS = 150
CACHE_WORDS = 500_000

# Plain insults and words of threat that any English list holds.
INSULTS = frozenset(
    "idiot moron stupid dumb loser scum trash pathetic worthless disgusting clown imbecile fool "
    "jerk bastard filth vermin garbage ugly hate".split()
)
SHOUTING = re.compile(r"\b[A-Z]{3,}\b(?:\W+\b[A-Z]{3,}\b)+\W*!")
ADDRESSED = re.compile(r"\b(?:you|your|you're|u)\b(?:\W+\w+){0,3}?\W+(\w+)", re.IGNORECASE)


def word_keys(word: str) -> Iterator[str]:
    """The word and its beginnings, each as a key of a lexicon or of the classifier."""
    yield word
    for n in PREFIXES:
        if len(word) >= n:
            yield word[:n] + "*"


def with_numbers(counts: Counter) -> set[str]:
    """The keys, and beginnings once more where several words share them."""
    return set(counts) | {
        f"{key}{n}" for key, count in counts.items() if key[-1] == "*" for n in SHARED_BY if count >= n
    }


def text_keys(words: set[str]) -> set[str]:
    return with_numbers(Counter(key for word in words for key in word_keys(word)))


def _length(words: int) -> float:
    """A long text holds listed words by chance; a few words are all the same short."""
    return math.log1p(words / 100)


@dataclass(frozen=True)
class LabelModel:
    """What a voter says given the truth: ``p(vote | class)``, with a weight per voter."""

    prior: float
    tables: np.ndarray  # voter, class, vote + 1
    weights: np.ndarray
    correlations: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        evidence = np.zeros(len(votes))
        for j, weight in enumerate(self.weights):
            table = self.tables[j]
            evidence += weight * np.log(table[1] / table[0])[votes[:, j] + 1]
        return 1 / (1 + np.exp(-np.clip(evidence + math.log(self.prior / (1 - self.prior)), -30, 30)))


def fit_label_model(votes: np.ndarray, prior: float) -> LabelModel:
    """Estimate the accuracies and correlations of voters without a label, by EM.

    Voters are independent given the truth, but for those that agree more than their accuracies
    explain: the correlation of two voters is taken between their residuals, the vote less its mean
    given the truth. Correlated voters share their weight, so that two copies of a voter count as
    one. ``prior`` is the share of positive rows; it fixes which class is which.
    """
    n, voters = votes.shape
    weights = np.ones(voters)
    correlations = np.eye(voters)
    posterior = np.where((votes == FOR).any(1), 0.9, prior / 2)
    for _ in range(ROUNDS):
        tables = np.empty((voters, 2, 3))
        for j in range(voters):
            for vote in (AGAINST, NONE, FOR):
                said = votes[:, j] == vote
                tables[j, 1, vote + 1] = posterior[said].sum() + 0.1
                tables[j, 0, vote + 1] = (1 - posterior[said]).sum() + 0.1
        tables /= tables.sum(2, keepdims=True)
        expected = tables @ np.array([AGAINST, NONE, FOR])  # voter, class
        residual = votes - (posterior[:, None] * expected[:, 1] + (1 - posterior)[:, None] * expected[:, 0])
        spread = np.sqrt((residual**2).mean(0)) + 1e-9
        correlations = (residual.T @ residual) / max(n, 1) / np.outer(spread, spread)
        shared = np.where(np.abs(correlations) > CORRELATED, np.abs(correlations), 0.0)
        np.fill_diagonal(shared, 1.0)
        weights = 1 / shared.sum(1)
        model = LabelModel(prior, tables, weights, correlations)
        before, posterior = posterior, model.posterior(votes)
        if np.abs(before - posterior).max(initial=0.0) < 1e-6:
            break
    return LabelModel(prior, tables, weights, correlations)


@dataclass(frozen=True)
class ToxicityModel:
    """Lexicons of the voters, the label model, and the weights of the linear classifier."""

    lexicons: tuple[frozenset[str], ...]
    label_model: LabelModel | None
    weights: dict[str, float] = field(default_factory=dict)
    length: float = 0.0
    bias: float = 0.0

    def margin(self, found: Iterable[str], words: int) -> float:
        """What the classifier says of a text with these keys and so many different words."""
        known = sorted(self.weights[k] for k in found if k in self.weights)
        return self.bias + self.length * _length(words) + sum(known)


@dataclass(frozen=True)
class _Corpus:
    """Texts as numbers of their keys; keys of fewer than ``LEAST_TEXTS`` texts are left out."""

    names: list[str]
    keys: list[np.ndarray]
    words: list[int]
    pattern_votes: np.ndarray


def _read(texts: Sequence[str]) -> _Corpus:
    """Two passes, so that memory holds frequent keys only: the first counts hashes of keys."""
    counts = np.zeros(1 << 22, np.int32)
    slot = len(counts) - 1
    for text in texts:
        keys = text_keys(set(WORD.findall(text.lower())))
        counts[np.unique(np.fromiter((hash(k) & slot for k in keys), np.int64, len(keys)))] += 1
    often = (counts >= LEAST_TEXTS).tobytes()
    places: dict[str, int] = {}
    rows, sizes, votes = [], [], []
    for text in texts:
        words = set(WORD.findall(text.lower()))
        kept = sorted(k for k in text_keys(words) if often[hash(k) & slot])
        rows.append(np.array([places.setdefault(k, len(places)) for k in kept], np.int32))
        sizes.append(len(words))
        insults = words & INSULTS
        spoken = {m.lower() for m in ADDRESSED.findall(text)} if insults else set()
        said = (insults, insults and SHOUTING.search(text), spoken & INSULTS)
        votes.append([FOR if x else NONE for x in said])
    return _Corpus(list(places), rows, sizes, np.array(votes))


def _votes(corpus: _Corpus, rows: Sequence[int], lexicons: Sequence[np.ndarray]) -> np.ndarray:
    """Votes of the lexicons, of the patterns, and of a voter against what nothing speaks for."""
    member = np.zeros((len(lexicons), len(corpus.names)), bool)
    for i, lexicon in enumerate(lexicons):
        member[i, lexicon] = True
    listed = np.array([member[:, corpus.keys[r]].any(1) for r in rows])
    cast = np.concatenate([np.where(listed, FOR, NONE), corpus.pattern_votes[rows]], axis=1)
    return np.concatenate([cast, np.where((cast == FOR).any(1), NONE, AGAINST)[:, None]], axis=1)


def _count(keys: Sequence[np.ndarray], kinds: int, weights=None) -> np.ndarray:
    where = np.concatenate(keys) if keys else np.zeros(0, np.int32)
    each = None if weights is None else np.repeat(weights, [len(k) for k in keys])
    return np.bincount(where, each, kinds).astype(float)


def _draw_lexicons(corpus: _Corpus, rows: Sequence[int], labels: np.ndarray) -> list[np.ndarray]:
    """Keys that toxic texts hold much more often than others, dealt to lexicons in turn.

    Strong keys come first, so every lexicon gets strong and weak ones.
    """
    found = [corpus.keys[r] for r in rows]
    toxic = _count(found, len(corpus.names), labels)
    other = _count(found, len(corpus.names), 1 - labels)
    t, o = max(1.0, labels.sum()), max(1.0, (1 - labels).sum())
    odds = np.log((toxic + 0.5) / (t + 1)) - np.log((other + 0.5) / (o + 1))
    good = np.flatnonzero((toxic >= LEAST_TEXTS) & (odds > LEXICON_ODDS))
    order = sorted(good.tolist(), key=lambda k: (-odds[k] * math.sqrt(toxic[k]), corpus.names[k]))
    best = order[: LEXICONS * LEXICON_ENTRIES]
    return [np.array(best[i::LEXICONS], int) for i in range(LEXICONS)]


def fit_toxicity(
    sample: Sequence[tuple[str, int]], class_weights: Mapping[object, float] | None = None
) -> ToxicityModel:
    """Fit on ``(text, label)`` rows; label 1 is toxic.

    Labels serve to draw the lexicons, to know the share of toxic texts and to place the threshold.
    What each voter is worth comes from the label model, which sees votes only; the classifier is
    trained on its posterior labels. Every third row is kept from both and only calibrates. Without
    rows of both classes every score is that of the share.

    ``class_weights`` tells how many rows of the table a row of each class stands for. What a voter or
    a word says given the truth is the same in any mix of labels, so it is learned in that of the
    sample; the prior and the calibration, which place the threshold, have the share of the table.
    """
    labels = np.array([label for _, label in sample], float)
    if len(set(labels.tolist())) < 2:
        return ToxicityModel((), None, bias=4.0 if labels.any() else -4.0)
    corpus = _read([text for text, _ in sample])
    fitted = [i for i in range(len(sample)) if i % 3] or [0]
    held = [i for i in range(len(sample)) if i % 3 == 0]
    lexicons = _draw_lexicons(corpus, fitted, labels[fitted])
    votes = _votes(corpus, fitted, lexicons)
    label_model = fit_label_model(votes, float(labels.mean()))
    share = float((row_weights(labels.tolist(), class_weights) * labels).mean())
    weights, bias = _fit_linear(corpus, fitted, label_model.posterior(votes))
    margins = [bias + weights[corpus.keys[i]].sum() for i in held]
    features = np.array([[m, _length(corpus.words[i]), 1.0] for m, i in zip(margins, held, strict=True)])
    each = row_weights(labels[held].tolist(), class_weights)
    scale, length, shift = logistic(features, labels[held], ridge=1e-2, each=each)
    return ToxicityModel(
        tuple(frozenset(corpus.names[k] for k in lexicon) for lexicon in lexicons),
        replace(label_model, prior=share),
        {corpus.names[k]: float(weights[k] * scale) for k in np.flatnonzero(weights)},
        float(length),
        float(bias * scale + shift),
    )


def _fit_linear(corpus: _Corpus, rows: Sequence[int], target: np.ndarray) -> tuple[np.ndarray, float]:
    """A logistic regression on the presence of keys, by gradient steps."""
    found = [corpus.keys[r] for r in rows]
    counts = _count(found, len(corpus.names))
    lift = _count(found, len(corpus.names), target)
    mean = float(np.clip(target.mean(), 1e-6, 1 - 1e-6))
    apart = np.abs(lift - mean * counts) / np.sqrt(np.maximum(counts, 1) * mean * (1 - mean))
    chosen = np.flatnonzero((counts >= LEAST_TEXTS) & (apart >= BEYOND_CHANCE)).tolist()
    chosen = sorted(chosen, key=lambda k: (-apart[k], corpus.names[k]))[:FEATURES]
    place = np.full(len(corpus.names), -1)
    place[chosen] = np.arange(len(chosen))
    col = place[np.concatenate(found)] if found else np.zeros(0, int)
    row = np.repeat(np.arange(len(found)), [len(f) for f in found])[col >= 0]
    col = col[col >= 0]
    weights, bias = np.zeros(len(chosen)), math.log(mean / (1 - mean))
    square, bias_square = np.full(len(chosen), 1e-3), 1e-3
    for _ in range(STEPS):
        margin = bias + np.bincount(row, weights[col], len(found))
        error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target
        gradient = np.bincount(col, error[row], len(chosen)) + RIDGE * weights
        square += gradient**2
        weights -= 0.5 * gradient / np.sqrt(square)
        bias_square += error.sum() ** 2
        bias -= 0.5 * error.sum() / math.sqrt(bias_square)
    every = np.zeros(len(corpus.names))
    every[chosen] = np.where(np.abs(weights) > 1e-3, weights, 0)
    return every, float(bias)


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``id``, ``score`` (0 to 1) and the words that weigh most for it, of every whole text.

    A null or empty text has no words and gets the score of the bias alone. Rows stay one to one;
    other columns are not read; no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weight = model.weights
        wanted = {k.rstrip("0123456789") if "*" in k else k for k in weight}
        known: dict[str, tuple[str, ...]] = {}
        none: tuple[str, ...] = ()
        for batch in batches:
            values, reasons = [], []
            for text in batch.column(1).to_pylist():
                counts: Counter = Counter()
                words = set(WORD.findall((text or "").lower()))
                for word in words:
                    keys = known.get(word)
                    if keys is None:
                        if len(known) > CACHE_WORDS:
                            known.clear()
                        keys = known[word] = tuple(k for k in word_keys(word) if k in wanted) or none
                    if keys:
                        counts.update(keys)
                found = [k for k in with_numbers(counts) if k in weight]
                margin = model.margin(found, len(words))
                values.append(1 / (1 + math.exp(-max(-30.0, min(30.0, margin)))))
                strongest = sorted(found, key=lambda k: (-weight[k], k))[:5]
                reasons.append([k for k in strongest if weight[k] > 0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values, pa.float64()), pa.array(reasons, pa.list_(pa.string()))],
                ["id", "score", "reasons"],
            )

    kind = docs.schema[id].dataType.simpleString()
    scored = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(
        scores, f"id {kind}, score double, reasons array<string>"
    )
    return scored.withColumnRenamed("id", id)
