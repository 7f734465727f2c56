"""Clustering of vectors with the number of clusters chosen by an elbow."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions.binding import computed
from topicloom.operators import shared_scan
from topicloom.operators.embedding import embed, reduce
from topicloom.session import checkpoint

log = logging.getLogger(__name__)

#: Centroids, and numbers in all of them, that may be sent along with every task.
MAX_CENTROIDS, MAX_CENTROID_NUMBERS = 10_000, 10_000_000

FEATURES = "__features"

#: Cluster numbers with their centres, as a table or a list.
Centroids = DataFrame | Sequence[tuple[int, Sequence[float]]]


def assign(
    df: DataFrame,
    centroids: Centroids,
    vector: str = "embedding",
    out: str = "cluster",
    distance: str = "distance",
) -> DataFrame:
    """Nearest centroid of each row and the distance to it; equal distances go to the lower number.

    Centroids are a model: a few rows, checked, that travel with the tasks. No join, no shuffle.
    """
    names, centres = _model(centroids)

    @F.pandas_udf("cluster int, distance double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        best, exact = _nearest(vectors, centres)
        missing = vectors.isna().to_numpy()
        cluster = pd.Series(names[best], dtype="Int32").mask(missing)
        return pd.DataFrame({"cluster": cluster, "distance": pd.Series(exact).mask(missing)})

    sized = computed(df, "__sized", _sized(vector, centres))
    found = sized.withColumn("__near", nearest("__sized"))
    return found.select(
        *df.columns, F.col("__near.cluster").alias(out), F.col("__near.distance").alias(distance)
    )


def _model(centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """Cluster numbers in order and the matrix of centres, checked for size."""
    if isinstance(centroids, DataFrame):
        centroids = [(r[0], r[1]) for r in centroids.limit(MAX_CENTROIDS + 1).collect()]
    ordered = sorted((int(c), list(v)) for c, v in centroids)
    if not ordered:
        raise ValueError("no centroids")
    numbers = len(ordered) * len(ordered[0][1])
    if len(ordered) > MAX_CENTROIDS or numbers > MAX_CENTROID_NUMBERS:
        raise ValueError("too many centroids to send to every task")
    names = np.array([c for c, _ in ordered], dtype="int32")
    return names, np.array([v for _, v in ordered], dtype=float)


def _sized(vector: str, centres: np.ndarray) -> Column:
    """The vector if it has the right length, else null."""
    return F.when(F.size(vector) == centres.shape[1], F.col(vector))


def _nearest(vectors: pd.Series, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest centre and the distance to it; missing vectors count as zero."""
    zero = np.zeros(centres.shape[1])
    x = np.array([zero if v is None else v for v in vectors], dtype=float)
    return shared_scan.nearest(x.reshape(-1, centres.shape[1]), centres)


def inertia(df: DataFrame, centroids: Centroids, vector: str = "embedding") -> DataFrame:
    """One row: the sum of squared distances to the nearest centroid."""
    near = assign(df, centroids, vector, "__c", "__d")
    return near.agg(F.sum(F.col("__d") * F.col("__d")).alias("inertia"))


def inertias(
    df: DataFrame, models: dict[int, Centroids], vector: str = "embedding"
) -> DataFrame:
    """``(k, inertia)`` for several sets of centroids in one pass over the rows."""
    ks = sorted(models)
    centres = [_model(models[k])[1] for k in ks]

    @F.pandas_udf("array<double>")
    def squares(vectors: pd.Series) -> pd.Series:
        columns = [_nearest(vectors, c)[1] ** 2 for c in centres]
        return pd.Series(list(np.stack(columns, axis=1).reshape(-1, len(centres))))

    sized = computed(df.select(vector), "__v", _sized(vector, centres[0]))
    rows = sized.where(F.col("__v").isNotNull()).select(F.posexplode(squares("__v")).alias("__at", "__x"))
    k = F.array(*[F.lit(k) for k in ks])[F.col("__at")]
    return rows.groupBy(k.alias("k")).agg(F.sum("__x").alias("inertia"))


def elbow(points: DataFrame, k: str = "k", score: str = "score") -> DataFrame:
    """``(k, score, chord, chosen)``: signed distance to the chord from the first to the last point.

    The chosen ``k`` lies farthest below the chord, the smallest such one on ties. ``points`` has
    one row per tried ``k`` and is read several times, so it should be at rest.
    """
    ends = points.agg(
        F.min(F.struct(k, score)).alias("a"), F.max(F.struct(k, score)).alias("b")
    )
    k0, s0 = ends.select(F.col("a")[k]).scalar(), ends.select(F.col("a")[score]).scalar()
    k1, s1 = ends.select(F.col("b")[k]).scalar(), ends.select(F.col("b")[score]).scalar()
    dx, dy = k1 - k0, s1 - s0
    chord = (dx * (F.col(score) - s0) - dy * (F.col(k) - k0)) / F.sqrt(dx * dx + dy * dy)
    scored = points.withColumn("chord", chord)
    best = scored.agg(F.min_by(k, F.struct("chord", k)).alias("k")).scalar()
    return scored.withColumn("chosen", F.col(k) == best)


def choose_k(spark: SparkSession, points: Iterable[tuple[int, float]]) -> int:
    """The elbow of ``(k, score)`` pairs, of which there is one per fit."""
    rows = [(int(k), float(s)) for k, s in points]
    if not rows:
        raise ValueError("no fit succeeded")
    if len(rows) == 1:
        return rows[0][0]
    table = spark.createDataFrame(rows, "k int, score double")
    return elbow(table).where("chosen").first().k


@dataclass
class Chosen:
    """The model for the chosen ``k``, the ``(k, score, fit_seconds)`` of all fits, why others failed.

    ``scans`` of the data served all fits together, so ``fit_seconds`` of them overlap.
    """

    k: int
    model: Any
    tried: list[tuple[int, float, float]]
    problems: dict[int, str] = field(default_factory=dict)
    scans: int = 0

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, s, t, k == self.k) for k, s, t in self.tried]
        return spark.createDataFrame(rows, "k int, score double, fit_seconds double, chosen boolean")


def vectors(df: DataFrame, id: str, vector: str) -> DataFrame:
    """Ids and ML vectors, spread and ordered by id, so that a seed gives the same fit again."""
    # No number of partitions: small tables are joined into few by their measured size.
    return (
        df.select(id, array_to_vector(vector).alias(FEATURES))
        .repartition(F.col(id))
        .sortWithinPartitions(id)
    )


def _chosen(
    spark: SparkSession, fits: shared_scan.Fits, scores: dict[int, float], wanted: Iterable[int]
) -> Chosen:
    fits.problems.update({k: "not a number of clusters" for k in wanted if k < 1})
    for k, problem in fits.problems.items():
        log.error("no fit with k=%s: %s", k, problem)
    best = choose_k(spark, scores.items())
    tried = [(k, scores[k], fits.seconds[k]) for k in sorted(scores)]
    return Chosen(best, fits.models[best], tried, fits.problems, fits.scans)


def _starts(
    df: DataFrame, ks: Iterable[int], id: str, vector: str, seed: int
) -> tuple[DataFrame, int, dict[int, np.ndarray]]:
    """The vectors, kept in memory and on disk, their width, and starts for every ``k``."""
    width = shared_scan.width_of(df, vector)
    rows = shared_scan.start_rows(df, id, vector, width, seed)
    kept = checkpoint(shared_scan.usable(df, vector, width)).persist(StorageLevel.MEMORY_AND_DISK)
    return kept, width, {k: shared_scan.spread_starts(rows, k, seed) for k in ks if k > 0}


def kmeans(df: DataFrame, k: int, id: str = "id", vector: str = "embedding", seed: int = 42):
    """Spark's k-means on an array column."""
    return KMeans(k=k, seed=seed, featuresCol=FEATURES).fit(vectors(df, id, vector))


def auto_kmeans(
    df: DataFrame,
    k_range: Iterable[int] = range(2, 15),
    id: str = "id",
    vector: str = "embedding",
    seed: int = 42,
) -> Chosen:
    """K-means for every ``k`` in the same scans, the elbow of the inertia decides. The best fit is kept.

    The starts are drawn from a bounded number of rows, always the same for a seed.
    """
    k_range = list(k_range)
    kept, width, starts = _starts(df, k_range, id, vector, seed)
    try:
        fits = shared_scan.kmeans_range(kept, width, starts)
    finally:
        kept.unpersist()
    return _chosen(df.sparkSession, fits, fits.scores, k_range)


def centroids(model: Any) -> list[tuple[int, list[float]]]:
    """Centres of a fitted k-means model, to be used with :func:`assign`."""
    return [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]


def gaussian_mixture(
    df: DataFrame, k: int, id: str = "id", vector: str = "embedding", seed: int = 42
):
    """Spark's Gaussian mixture on an array column."""
    return GaussianMixture(k=k, seed=seed, featuresCol=FEATURES).fit(vectors(df, id, vector))


def aic(log_likelihood: float, k: int, dimensions: int) -> float:
    """Akaike's criterion of a mixture with full covariances."""
    free = k * dimensions * (dimensions + 1) // 2 + k * dimensions + k - 1
    return 2.0 * free - 2.0 * log_likelihood


def auto_gaussian_mixture(
    df: DataFrame,
    k_range: Iterable[int] = range(2, 15),
    id: str = "id",
    vector: str = "embedding",
    seed: int = 42,
) -> Chosen:
    """A mixture for every ``k`` in the same scans, the elbow of AIC decides.

    The means start where those of a k-means would. A ``k`` that has no proper covariances is left out and
    told of in ``problems``.
    """
    k_range = list(k_range)
    kept, width, starts = _starts(df, k_range, id, vector, seed)
    try:
        fits = shared_scan.mixture_range(kept, width, starts)
    finally:
        kept.unpersist()
    return _chosen(df.sparkSession, fits, {k: aic(x, k, width) for k, x in fits.scores.items()}, k_range)


def mixture_shares(
    df: DataFrame, model: Any, vector: str = "embedding", out: str = "shares"
) -> DataFrame:
    """Add the probability of every component, of our own mixtures or Spark's, as an array.

    Rows without a vector have none.
    """
    if isinstance(model, shared_scan.Mixture):
        return computed(df, out, model.column(F.col(vector)))
    there = df.where(F.col(vector).isNotNull()).withColumn(FEATURES, array_to_vector(vector))
    found = model.transform(there).select(*df.columns, F.col(model.getProbabilityCol()).alias("__p"))
    found = computed(found, out, vector_to_array("__p")).drop("__p")
    return found.unionByName(df.where(F.col(vector).isNull()), allowMissingColumns=True)


def mixture_labels(
    df: DataFrame, model: Any, vector: str = "embedding", out: str = "cluster"
) -> DataFrame:
    """Most probable component of each row, the first of equal ones."""
    best = F.array_position("__shares", F.array_max("__shares")).cast("int") - 1
    return mixture_shares(df, model, vector, "__shares").withColumn(out, best).drop("__shares")


def soft_topics(
    df: DataFrame, model: Any, id: str = "id", vector: str = "embedding"
) -> DataFrame:
    """``(id, topic, p)``: probability of every component for every row that has a vector."""
    shares = mixture_shares(df.select(id, vector), model, vector, "__shares")
    return shares.select(id, F.posexplode("__shares").alias("topic", "p"))


@dataclass
class TextClusters:
    """A chosen k-means on embedded text, ready for new text."""

    chosen: Chosen
    options: dict[str, Any]

    def predict(self, df: DataFrame, text: str = "text", out: str = "cluster") -> DataFrame:
        embedded = embed(df, text, "__e", **self.options)
        return assign(embedded, centroids(self.chosen.model), "__e", out, "__d").drop("__e", "__d")


def auto_kmeans_text(
    df: DataFrame,
    id: str,
    text: str = "text",
    k_range: Iterable[int] = range(2, 15),
    seed: int = 42,
    **options: Any,
) -> TextClusters:
    """Embed text at length one and choose a k-means for it."""
    embedded = embed(df.select(id, text), text, **options)
    return TextClusters(auto_kmeans(embedded, k_range, id, seed=seed), options)


@dataclass
class Experiment:
    """What an experiment leaves: labelled rows and the fitted model."""

    labelled: DataFrame
    model: Any


def run_experiment(
    df: DataFrame,
    id: str,
    text: str,
    encode: Callable[[DataFrame], DataFrame],
    cluster: Callable[[DataFrame], Any],
    components: int | None = None,
    track: Callable[[DataFrame], DataFrame] = lambda d: d,
) -> Experiment:
    """Embed, reduce if asked for, let ``track`` look on, cluster.

    ``encode`` adds ``embedding``; ``cluster`` takes ``(id, embedding)`` and returns a
    :class:`Chosen` or a fitted k-means or mixture.
    """
    if encode is None:
        raise ValueError("an encoder is needed")
    if cluster is None:
        raise ValueError("a clusterer is needed")
    # Written once: the components, the clusters and the labels all read the vectors.
    embedded = checkpoint(encode(df))
    if components is not None:
        embedded = checkpoint(reduce(embedded, "embedding", "pca", components, "embedding"))
    embedded = track(embedded)
    fitted = cluster(embedded.select(id, "embedding"))
    model = fitted.model if isinstance(fitted, Chosen) else fitted
    if hasattr(model, "clusterCenters"):
        labelled = assign(embedded, centroids(model))
    else:
        labelled = mixture_labels(embedded, model)
    return Experiment(labelled, fitted)
