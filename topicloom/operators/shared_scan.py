"""K-means and Gaussian mixtures for many numbers of clusters in the same scans.

An iteration sends the models of all ``k`` that still move along with every task. A task adds up what
its rows give to each cluster of each ``k`` and returns one row per cluster, which Spark sums. So as many
scans are made as the slowest ``k`` has iterations, whatever the number of ``k``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that the starts are drawn from, those of the smallest hashes.
START_ROWS = 4_096

#: Numbers in all models that travel with the tasks.
MAX_NUMBERS = 10_000_000

ITERATIONS = 30
#: Squared distance that no centre moves any more, and gain of the mean log-likelihood, at the end.
CENTRE_TOLERANCE = 1e-8
GAIN_TOLERANCE = 1e-3

#: What is added to the variances of a mixture, in parts of the mean variance of the data.
RIDGE = 1e-6

_PARTS = "k int, cluster int, n double, score double, sums array<double>"


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors of an Arrow column as rows; all have ``width`` numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def usable(df: DataFrame, vector: str, width: int, *also: Column) -> DataFrame:
    """``v``: the vectors of this width without missing or non-finite numbers, as doubles."""
    double = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where((F.size(vector) == width) & finite).select(double.alias("v"), *also)


def width_of(df: DataFrame, vector: str) -> int:
    """Numbers of a vector: those of the first one there is."""
    first = df.where(F.size(vector) > 0).select(F.size(vector).alias("n")).first()
    if first is None:
        raise ValueError("no vectors")
    return first.n


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest centre of each row and the distance; equal distances go to the lower place.

    Distances come from products of matrices first, about the mean of the centres; where rounding could
    hide the nearest one, those in question are measured by differences.
    """
    pivot = centres.mean(0)
    moved, about = x - pivot, centres - pivot
    squares = (about * about).sum(1)
    rough = squares - 2.0 * (moved @ about.T)
    best, least = rough.argmin(1), rough.min(1)
    slack = 4 * (x.shape[1] + 4) * np.finfo(float).eps * ((moved * moved).sum(1) + squares.max(initial=0.0))
    close = rough <= (least + slack)[:, None]
    for i in np.flatnonzero(close.sum(1) > 1):
        among = np.flatnonzero(close[i])
        best[i] = among[((x[i] - centres[among]) ** 2).sum(1).argmin()]
    return best, np.sqrt(((x - centres[best]) ** 2).sum(1))


def start_rows(df: DataFrame, id: str, vector: str, width: int, seed: int) -> np.ndarray:
    """At most ``START_ROWS`` vectors, those whose ids have the smallest hashes."""
    some = usable(df, vector, width, F.xxhash64(F.lit(seed), F.col(id)).alias("h"))
    found = some.orderBy("h", "v").limit(START_ROWS).collect()
    if not found:
        raise ValueError("no vectors")
    return np.array([r.v for r in found], float)


def spread_starts(rows: np.ndarray, k: int, seed: int, steps: int = 10) -> np.ndarray:
    """``k`` centres: rows far apart (greedy k-means++), moved by a few of Lloyd's steps on these rows.

    Each next row is the best of some that are drawn with the square of their distance from those taken.
    """
    noise = np.random.default_rng((seed, k))
    taken = [int(noise.integers(len(rows)))]
    apart = ((rows - rows[taken[0]]) ** 2).sum(1)
    while len(taken) < k:
        total = apart.sum()
        # Fewer different rows than clusters: the rest repeat one, and stay empty.
        drawn = noise.choice(len(rows), 2 + int(np.log(k)), p=apart / total) if total > 0 else taken[:1]
        left = [np.minimum(apart, ((rows - rows[i]) ** 2).sum(1)) for i in drawn]
        best = int(np.argmin([x.sum() for x in left]))
        taken.append(int(drawn[best]))
        apart = left[best]
    centres = rows[taken]
    for _ in range(steps):
        _, n, _, sums = next(mean_parts(rows, {k: centres}))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


#: From vectors and the models of all open ``k`` to ``(k, n, score, sums)`` with a row per cluster.
Parts = Callable[[np.ndarray, Mapping[int, object]], Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]


def scan(vectors: DataFrame, width: int, models: Mapping[int, object], parts: Parts) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``n``, ``score`` and ``sums`` of every cluster of every ``k``, in one scan of the vectors.

    A task adds its batches up before it returns them. The driver receives one row per cluster.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(dict(models))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, *found in parts(matrix(batch.column(0), width), shared.value):
                before = held.get(k)
                held[k] = found if before is None else [a + b for a, b in zip(before, found, strict=True)]
        for k, (n, score, sums) in held.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(n), k), pa.int32()),
                    pa.array(np.arange(len(n)), pa.int32()),
                    pa.array(n),
                    pa.array(score),
                    pa.array(list(sums), pa.list_(pa.float64())),
                ],
                names=["k", "cluster", "n", "score", "sums"],
            )

    rows = vectors.mapInArrow(run, _PARTS).groupBy("k", "cluster").agg(
        F.sum("n").alias("n"),
        F.sum("score").alias("score"),
        vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"),
    )
    found: dict[int, list] = {}
    # Few rows: put in order here, as a sort would be a job of its own.
    for r in sorted(rows.collect(), key=lambda r: (r.k, r.cluster)):
        found.setdefault(r.k, []).append(r)
    shared.unpersist()
    return {
        k: (np.array([r.n for r in rs]), np.array([r.score for r in rs]), np.array([r.sums for r in rs]))
        for k, rs in found.items()
    }


def _checked(ks: Iterable[int], numbers: Callable[[int], int]) -> list[int]:
    ks = sorted(set(ks))
    if not ks or ks[0] < 1:
        raise ValueError("numbers of clusters from 1 on are needed")
    if sum(map(numbers, ks)) > MAX_NUMBERS:
        raise ValueError("too many clusters to send to every task")
    return ks


@dataclass
class Fits:
    """Models by ``k``, their scores, seconds until each settled, and what went wrong with the others.

    ``scans`` of the data were made.
    """

    models: dict[int, object] = field(default_factory=dict)
    scores: dict[int, float] = field(default_factory=dict)
    seconds: dict[int, float] = field(default_factory=dict)
    problems: dict[int, str] = field(default_factory=dict)
    scans: int = 0

    def settled(self, k: int, begun: float) -> None:
        self.seconds[k] = time.time() - begun


# --- k-means ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Means:
    """Centres of a k-means."""

    centres: np.ndarray

    def clusterCenters(self) -> list[np.ndarray]:  # noqa: N802, as Spark's model names it
        return list(self.centres)


def mean_parts(x: np.ndarray, models: Mapping[int, object]):
    """Rows, squared distances and sums of the vectors nearest to each centre, for :func:`scan`."""
    for k, centres in models.items():
        best, distance = nearest(x, centres)
        sums = np.zeros(centres.shape)
        np.add.at(sums, best, x)
        n = np.bincount(best, minlength=len(centres)).astype(float)
        yield k, n, np.bincount(best, distance**2, len(centres)), sums


def kmeans_range(
    vectors: DataFrame, width: int, starts: Mapping[int, np.ndarray], iterations: int = ITERATIONS
) -> Fits:
    """Lloyd's iterations from given centres, for all ``k`` together; the score is the inertia.

    ``vectors`` has one column ``v``. A cluster without rows keeps its centre. A ``k`` whose centres stay
    where they are takes no part any more; one that still moves after ``iterations`` is used as it is. A last
    scan measures the inertia of the final centres.
    """
    centres = {k: np.array(starts[k], float) for k in _checked(starts, lambda k: k * width)}
    fits, still, begun = Fits(), list(centres), time.time()
    for _ in range(iterations):
        if not still:
            break
        found = scan(vectors, width, {k: centres[k] for k in still}, mean_parts)
        fits.scans += 1
        if not found:
            raise ValueError("no vectors")
        for k in list(still):
            n, _, sums = found[k]
            moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres[k])
            if ((moved - centres[k]) ** 2).sum(1).max() <= CENTRE_TOLERANCE:
                still.remove(k)
                fits.settled(k, begun)
            centres[k] = moved
    last = scan(vectors, width, centres, mean_parts)
    fits.scans += 1
    for k in still:
        fits.settled(k, begun)
    fits.models = {k: Means(c) for k, c in centres.items()}
    fits.scores = {k: float(last[k][1].sum()) for k in centres}
    return fits


# --- Gaussian mixtures -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Mixture:
    """Weights, means and covariances of the components of a mixture."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def logs(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density of each component (columns) at each row."""
        found = np.empty((len(x), len(self.weights)))
        for j, (weight, mean, covariance) in enumerate(zip(self.weights, self.means, self.covariances, strict=True)):
            root = np.linalg.cholesky(covariance)
            apart = np.linalg.solve(root, (x - mean).T)
            size = 2 * np.log(np.diag(root)).sum() + len(mean) * np.log(2 * np.pi)
            with np.errstate(divide="ignore"):
                found[:, j] = np.log(weight) - 0.5 * ((apart**2).sum(0) + size)
        return found

    def shares(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each component at each row, and the log-likelihood of each row."""
        logs = self.logs(x)
        top = logs.max(1, keepdims=True)
        whole = np.exp(logs - top)
        total = whole.sum(1, keepdims=True)
        return whole / total, (top + np.log(total))[:, 0]

    def column(self, vector: Column) -> Column:
        """Probabilities of the components as an array; null where there is no vector of the right width."""
        width = self.means.shape[1]

        @F.pandas_udf("array<double>")
        def shares(column: pd.Series) -> pd.Series:
            there = np.flatnonzero(column.notna())
            found: list[np.ndarray | None] = [None] * len(column)
            if len(there):
                rows = np.array([np.asarray(v, float) for v in column.iloc[there]])
                for place, share in zip(there, self.shares(rows)[0], strict=True):
                    found[place] = share
            return pd.Series(found, dtype=object)

        return shares(F.when(F.size(vector) == width, vector.cast("array<double>")))


def _mixture_parts(x: np.ndarray, models: Mapping[int, object]):
    width = x.shape[1]
    upper = np.triu_indices(width)
    products = x[:, upper[0]] * x[:, upper[1]]
    for k, mixture in models.items():
        shares, logs = mixture.shares(x)
        score = np.zeros(k)
        score[0] = logs.sum()
        yield k, shares.sum(0), score, np.hstack([shares.T @ x, shares.T @ products])


def _from_sums(n: np.ndarray, sums: np.ndarray, width: int, ridge: float) -> Mixture:
    """The most likely mixture of weighted sums of vectors and of their products."""
    held = np.maximum(n, 1e-12)
    means = sums[:, :width] / held[:, None]
    upper = np.triu_indices(width)
    square = np.zeros((len(n), width, width))
    square[:, upper[0], upper[1]] = sums[:, width:] / held[:, None]
    square[:, upper[1], upper[0]] = square[:, upper[0], upper[1]]
    covariances = square - means[:, :, None] * means[:, None, :] + ridge * np.eye(width)
    return Mixture(n / n.sum(), means, covariances)


def _moments(x: np.ndarray, models: Mapping[int, object]):
    upper = np.triu_indices(x.shape[1])
    yield 1, np.array([float(len(x))]), np.zeros(1), np.hstack([x.sum(0), (x[:, upper[0]] * x[:, upper[1]]).sum(0)])[None]


def mixture_range(
    vectors: DataFrame, width: int, starts: Mapping[int, np.ndarray], iterations: int = 4 * ITERATIONS
) -> Fits:
    """Expectation and maximisation from given means, for all ``k`` together; the score is the log-likelihood.

    ``vectors`` has one column ``v``. Components start with equal weights and the variances of the data.
    A ``k`` whose mean log-likelihood gains too little takes no part any more. Sums are about the mean of the
    data, so that variances do not vanish in them. A ``k`` whose covariances stop being positive is
    left out, with its message.
    """
    ks = _checked(starts, lambda k: k * (1 + width + width * width))
    begun = time.time()
    n, _, sums = scan(vectors, width, {1: None}, _moments).get(1, (None, None, None))
    if n is None:
        raise ValueError("no vectors")
    pivot = sums[0, :width] / n[0]
    whole = _from_sums(n, sums, width, 0.0).covariances[0]
    variances = np.maximum(np.diag(whole), 0.0)
    ridge = RIDGE * (float(variances.mean()) or 1.0)
    fits = Fits(scans=1)
    spread = np.diag(variances + ridge)
    models = {
        k: Mixture(np.full(k, 1 / k), np.asarray(starts[k], float) - pivot, np.array([spread] * k)) for k in ks
    }
    before: dict[int, float] = {}
    still = list(ks)

    def parts(x: np.ndarray, open_: Mapping[int, object]):
        return _mixture_parts(x - pivot, open_)

    for _ in range(iterations):
        if not still:
            break
        found = scan(vectors, width, {k: models[k] for k in still}, parts)
        fits.scans += 1
        for k in list(still):
            held, score, sums = found[k]
            fits.scores[k] = float(score.sum())
            gain = (fits.scores[k] - before.get(k, -np.inf)) / n[0]
            before[k] = fits.scores[k]
            if gain <= GAIN_TOLERANCE:
                still.remove(k)
                fits.settled(k, begun)
                continue
            new = _from_sums(held, sums, width, ridge)
            if not np.isfinite(new.means).all() or np.linalg.eigvalsh(new.covariances).min() <= 0:
                still.remove(k)
                fits.problems[k] = "a covariance is not positive"
                fits.scores.pop(k)
                models.pop(k)
                continue
            models[k] = new
    if still:
        # The last step was not measured.
        found = scan(vectors, width, {k: models[k] for k in still}, parts)
        fits.scans += 1
        fits.scores |= {k: float(found[k][1].sum()) for k in still}
    for k in still:
        fits.settled(k, begun)
    fits.models = {k: Mixture(m.weights, m.means + pivot, m.covariances) for k, m in models.items()}
    return fits
