"""Queries on vectors: centroids, the elbow, neighbours, affinities, clusterings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions.vectors import l2_normalize
from topicloom.operators import clustering, density, neighbours, projections, shared_scan, spectral
from topicloom.operators.embedding import embed, project_2d, reduce
from topicloom.plans.base import Query, text_table
from topicloom.session import checkpoint
from topicloom.sources.tables import load

NEIGHBOURS = 10
EPS, MIN_SAMPLES = 1.15, 5


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "embeddings")


def normalized(spark: SparkSession, folder: str) -> DataFrame:
    doubled = F.transform("embedding", lambda x: x.cast("double") * 3 + 0.25)
    moved = _vectors(spark, folder).select("vec_id", doubled.alias("v"))
    rows = moved.select("vec_id", F.posexplode(l2_normalize(F.col("v"))).alias("place", "value"))
    return rows.withColumn("value", F.round("value", 6) + 0.0)


NORMALIZED_SQL = """
WITH moved AS (
  SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS place,
         unnest(embedding)::DOUBLE * 3 + 0.25 AS v
  FROM embeddings
)
SELECT vec_id, place, round(v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 6) + 0.0 AS value FROM moved"""


def label_means(df: DataFrame) -> list[tuple[int, list[float]]]:
    """Mean vector of each label: one row per label, partly aggregated in every task."""
    rows = (
        df.select("label", F.posexplode("embedding").alias("place", "x"))
        .groupBy("label", "place")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("label")
        .agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("v"))
        .collect()
    )
    return sorted((r.label, [p.x for p in r.v]) for r in rows)


MEANS_SQL = """
coordinates AS (
  SELECT vec_id, label, generate_subscripts(embedding, 1) AS place, unnest(embedding)::DOUBLE AS x
  FROM embeddings
), averages AS (
  SELECT label, place, avg(x) AS x FROM coordinates GROUP BY label, place
), means AS (
  SELECT label, list(x ORDER BY place) AS mean FROM averages GROUP BY label
)"""


def nearest_mean(spark: SparkSession, folder: str) -> DataFrame:
    df = _vectors(spark, folder)
    found = clustering.assign(df, label_means(df))
    return found.select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


NEAREST_MEAN_SQL = f"""
WITH {MEANS_SQL}, distances AS (
  SELECT vec_id, m.label, list_distance(embedding::DOUBLE[], mean) AS d FROM embeddings, means m
)
SELECT vec_id, arg_min(label, (round(d, 12), label)) AS cluster, round(min(d), 6) AS distance
FROM distances GROUP BY vec_id"""


def inertia(spark: SparkSession, folder: str) -> DataFrame:
    df = _vectors(spark, folder)
    return clustering.inertia(df, label_means(df)).select(F.round("inertia", 5).alias("inertia"))


INERTIA_SQL = f"""
WITH {MEANS_SQL}, distances AS (
  SELECT vec_id, min(list_distance(embedding::DOUBLE[], mean)) AS d FROM embeddings, means GROUP BY vec_id
)
SELECT round(sum(d * d), 5) AS inertia FROM distances"""


def elbow(spark: SparkSession, folder: str) -> DataFrame:
    """Inertia around the means of the labels below 2, 3, ... and the elbow of that curve."""
    df = _vectors(spark, folder)
    means = label_means(df)
    tried = {k: [m for m in means if m[0] < k] for k in range(2, means[-1][0] + 2)}
    points = checkpoint(clustering.inertias(df, tried).withColumnRenamed("inertia", "score"))
    found = clustering.elbow(points)
    return found.select("k", F.round("score", 5).alias("score"), F.round("chord", 5).alias("chord"), "chosen")


ELBOW_SQL = f"""
WITH {MEANS_SQL}, distances AS (
  SELECT vec_id, m.label, list_distance(embedding::DOUBLE[], mean) AS d FROM embeddings, means m
), ks AS (SELECT unnest(range(2, (SELECT max(label) + 2 FROM embeddings)))::INTEGER AS k), nearest AS (
  SELECT k, vec_id, min(d) AS d FROM distances JOIN ks ON label < k GROUP BY k, vec_id
), points AS (
  SELECT k, sum(d * d) AS score FROM nearest GROUP BY k
), ends AS (
  SELECT min(k) AS k0, arg_min(score, k) AS s0, max(k) AS k1, arg_max(score, k) AS s1 FROM points
), chords AS (
  SELECT k, score, ((k1 - k0) * (score - s0) - (s1 - s0) * (k - k0))
           / sqrt((k1 - k0) ** 2 + (s1 - s0) ** 2) AS chord
  FROM points, ends
)
SELECT k, round(score, 5) AS score, round(chord, 5) AS chord,
       k = (SELECT arg_min(k, (chord, k)) FROM chords) AS chosen
FROM chords"""


def _knn(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.knn(_vectors(spark, folder), NEIGHBOURS, "vec_id", "embedding")


def nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return _knn(spark, folder).withColumn("distance", F.round("distance", 6))


#: Vectors made from each given one, neighbours of these, and points of a block.
VARIANTS, NEAR_VARIANTS, VARIANT_BLOCK = 10, 5, 512


def variants(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, v)``: ten vectors close to each given one, so that there are blocks to leave out."""
    def moved_by(i: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.col("vec_id"), F.col("t"), i).cast("binary"))
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296 / 50

    moved = F.transform("embedding", lambda x, i: x.cast("double") + moved_by(i))
    made = _vectors(spark, folder).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
    return made.select((F.col("vec_id") * VARIANTS + F.col("t")).alias("id"), moved.alias("v"))


def variant_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbours among the variants, block by block."""
    found = neighbours.knn(variants(spark, folder), NEAR_VARIANTS, "id", "v", VARIANT_BLOCK)
    return found.withColumn("distance", F.round("distance", 6))


VARIANT_NEIGHBOURS_SQL = f"""
WITH made AS (
  SELECT vec_id * {VARIANTS} + t AS id,
         list_transform(range(1, len(embedding) + 1), lambda p: embedding[p]::DOUBLE
           + ('0x' || substr(md5(vec_id || ':' || t || ':' || (p - 1)), 1, 8))::BIGINT / 4294967296 / 50) AS v
  FROM embeddings, (SELECT unnest(range({VARIANTS})) AS t)
), pairs AS (
  SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) AS distance FROM made a JOIN made b ON a.id <> b.id
)
SELECT i, j, round(distance, 6) AS distance,
       (row_number() OVER (PARTITION BY i ORDER BY distance, j))::INTEGER AS rank
FROM pairs QUALIFY rank <= {NEAR_VARIANTS}"""


def approximate_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Near vectors by random projections; distances are exact."""
    found = projections.approximate_knn(_vectors(spark, folder), NEIGHBOURS, "vec_id", "embedding")
    return found.withColumn("distance", F.round("distance", 6))


KNN_CTE = f"""
pairs AS (
  SELECT a.vec_id AS i, b.vec_id AS j, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
), knn AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY distance, j) AS rank FROM pairs
  QUALIFY rank <= {NEIGHBOURS}
), edges AS (
  SELECT i, j, min(distance) AS distance
  FROM (SELECT i, j, distance FROM knn UNION ALL SELECT j, i, distance FROM knn) GROUP BY i, j
)"""


def nn_affinity(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nn_affinity(_knn(spark, folder)).withColumn("w", F.col("w").cast("double"))


def rbf_affinity(spark: SparkSession, folder: str) -> DataFrame:
    """The kernel of all pairs."""
    pairs = neighbours.all_pairs(_vectors(spark, folder), "vec_id", "embedding")
    return neighbours.rbf_affinity(pairs, both_ways=True).withColumn("w", F.round("w", 6))


RBF_SQL = """
WITH pairs AS (
  SELECT a.vec_id AS i, b.vec_id AS j, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
)
SELECT i, j, round(exp(-(min(distance) ** 2)), 6) AS w FROM pairs WHERE distance IS NOT NULL GROUP BY i, j"""


def self_tuning_affinity(spark: SparkSession, folder: str) -> DataFrame:
    found = neighbours.self_tuning_affinity(_knn(spark, folder))
    return found.withColumn("w", F.round("w", 6))


SELF_TUNING_SQL = f"""
WITH {KNN_CTE}, scales AS (SELECT i, distance AS s FROM knn WHERE rank = 7)
SELECT e.i, e.j, round(exp(-(distance ** 2) / (a.s * b.s)), 6) AS w
FROM edges e JOIN scales a ON e.i = a.i JOIN scales b ON e.j = b.i"""


def dbscan(spark: SparkSession, folder: str) -> DataFrame:
    found = density.dbscan(_vectors(spark, folder), EPS, MIN_SAMPLES, "vec_id")
    return found.select("vec_id", "core", "cluster")


DBSCAN_SQL = f"""
WITH RECURSIVE near AS (
  SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a, embeddings b
  WHERE list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= {EPS}
), cores AS (
  SELECT i FROM near GROUP BY i HAVING count(*) >= {MIN_SAMPLES}
), links AS (
  SELECT i, j FROM near WHERE i IN (FROM cores) AND j IN (FROM cores)
), reach AS (
  SELECT i, i AS c FROM cores
  UNION
  SELECT l.j, r.c FROM reach r JOIN links l ON l.i = r.i
), labels AS (
  SELECT i, min(c) AS c FROM reach GROUP BY i
), borders AS (
  SELECT n.i, min(l.c) AS c FROM near n JOIN labels l ON n.j = l.i GROUP BY n.i
)
SELECT vec_id, vec_id IN (FROM cores) AS core,
       coalesce(l.c, b.c, -1)::BIGINT AS cluster
FROM embeddings LEFT JOIN labels l ON vec_id = l.i LEFT JOIN borders b ON vec_id = b.i"""


def kmeans_labels(spark: SparkSession, folder: str) -> DataFrame:
    df = _vectors(spark, folder)
    model = clustering.kmeans(df, 4, "vec_id")
    return clustering.assign(df, clustering.centroids(model)).select("vec_id", "cluster")


def auto_kmeans(spark: SparkSession, folder: str) -> DataFrame:
    """What each number of clusters gave, and which one was chosen."""
    chosen = clustering.auto_kmeans(_vectors(spark, folder), range(2, 6), "vec_id")
    return chosen.table(spark).select("k", F.round("score", 3).alias("score"), "chosen")


#: Numbers of clusters and steps that SQL follows too, from the vectors of the smallest ids.
RANGE, STEPS = (2, 3, 5), 3


def kmeans_range(spark: SparkSession, folder: str) -> DataFrame:
    """Three of Lloyd's steps for several numbers of clusters, and the clusters that they end in."""
    df = _vectors(spark, folder)
    first = df.orderBy("vec_id").limit(max(RANGE)).select("embedding").collect()
    starts = {k: np.array([r.embedding for r in first[:k]], float) for k in RANGE}
    width = shared_scan.width_of(df, "embedding")
    vectors = checkpoint(shared_scan.usable(df, "embedding", width))
    fits = shared_scan.kmeans_range(vectors, width, starts, STEPS)
    found = shared_scan.scan(
        vectors, width, {k: m.centres for k, m in fits.models.items()}, shared_scan.mean_parts
    )
    rows = [
        (k, j, int(n[j]), float(cost[j]), float(fits.models[k].centres[j, 0]), fits.scores[k])
        for k, (n, cost, _) in found.items()
        for j in range(k)
    ]
    table = spark.createDataFrame(rows, "k int, cluster int, n long, cost double, first double, inertia double")
    return table.select("k", "cluster", "n", *[F.round(c, 5).alias(c) for c in ("cost", "first", "inertia")])


def _steps_sql() -> str:
    """One pair of subqueries per step: who is nearest, and the means of these."""
    parts = [
        """rows AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings
), centres0 AS (
  SELECT k::INTEGER AS k, place::INTEGER AS cluster, v AS mean FROM rows, (SELECT unnest(%s) AS k) WHERE place < k
)""" % list(RANGE)
    ]
    for step in range(STEPS + 1):
        parts.append(f"""near{step} AS (
  SELECT k, vec_id, any_value(v) AS v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d
  FROM (SELECT k, cluster, vec_id, v, list_distance(v, mean) AS d FROM rows, centres{step}) GROUP BY k, vec_id
)""")
        if step < STEPS:
            parts.append(f"""moved{step} AS (
  SELECT k, cluster, list(x ORDER BY place) AS mean
  FROM (
    SELECT k, cluster, place, avg(x) AS x
    FROM (SELECT k, cluster, generate_subscripts(v, 1) AS place, unnest(v) AS x FROM near{step})
    GROUP BY k, cluster, place
  ) GROUP BY k, cluster
), centres{step + 1} AS (
  SELECT k, cluster, coalesce(m.mean, c.mean) AS mean FROM centres{step} c LEFT JOIN moved{step} m USING (k, cluster)
)""")
    return ", ".join(parts)


KMEANS_RANGE_SQL = f"""
WITH {_steps_sql()}, costs AS (
  SELECT k, cluster, count(*) AS n, sum(d * d) AS cost FROM near{STEPS} GROUP BY k, cluster
)
SELECT k, cluster, coalesce(n, 0) AS n, round(coalesce(cost, 0), 5) AS cost, round(mean[1], 5) AS first,
       round(sum(cost) OVER (PARTITION BY k), 5) AS inertia
FROM centres{STEPS} LEFT JOIN costs USING (k, cluster)"""


def _components(spark: SparkSession, folder: str, k: int = 4) -> DataFrame:
    return reduce(_vectors(spark, folder), "embedding", "pca", k, "reduced")


def auto_gaussian_mixture(spark: SparkSession, folder: str) -> DataFrame:
    chosen = clustering.auto_gaussian_mixture(
        _components(spark, folder), range(2, 5), "vec_id", "reduced"
    )
    return chosen.table(spark).select("k", F.round("score", 3).alias("score"), "chosen")


def soft_topics(spark: SparkSession, folder: str) -> DataFrame:
    reduced = _components(spark, folder)
    model = clustering.gaussian_mixture(reduced, 3, "vec_id", "reduced")
    found = clustering.soft_topics(reduced, model, "vec_id", "reduced")
    return found.withColumn("p", F.round("p", 4))


def principal_components(spark: SparkSession, folder: str) -> DataFrame:
    rows = _components(spark, folder).select("vec_id", F.posexplode("reduced").alias("place", "value"))
    return rows.withColumn("value", F.round("value", 5))


def plane(spark: SparkSession, folder: str) -> DataFrame:
    found = project_2d(_vectors(spark, folder), "vec_id", "label")
    return found.withColumn("x", F.round("x", 5)).withColumn("y", F.round("y", 5))


def spectral_labels(spark: SparkSession, folder: str) -> DataFrame:
    edges = neighbours.self_tuning_affinity(_knn(spark, folder))
    found, _ = spectral.spectral_clustering(edges, m=6)
    return found.withColumnRenamed("i", "vec_id")


def text_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """K-means chosen on the documents, then used on the benchmark texts."""
    docs = text_table(spark, folder)
    fitted = clustering.auto_kmeans_text(docs, "doc_id", k_range=range(2, 6))
    return fitted.predict(load(spark, folder, "benchmark")).select("item_id", "cluster")


def experiment(spark: SparkSession, folder: str) -> DataFrame:
    """Embed, reduce to eight components, cluster: the chain that compares set-ups."""
    done = clustering.run_experiment(
        text_table(spark, folder),
        "doc_id",
        "text",
        lambda d: embed(d, "text"),
        lambda d: clustering.auto_kmeans(d, range(2, 5), "doc_id"),
        components=8,
    )
    return done.labelled.select("doc_id", "cluster")


QUERIES = {
    "normalize": Query(normalized, NORMALIZED_SQL),
    "nearest_mean": Query(nearest_mean, NEAREST_MEAN_SQL),
    "inertia": Query(inertia, INERTIA_SQL),
    "elbow": Query(elbow, ELBOW_SQL),
    "nearest_neighbours": Query(
        nearest_neighbours,
        f"WITH {KNN_CTE} SELECT i, j, round(distance, 6) AS distance, rank::INTEGER AS rank FROM knn",
    ),
    "variant_neighbours": Query(variant_neighbours, VARIANT_NEIGHBOURS_SQL),
    "approximate_neighbours": Query(approximate_neighbours),
    "nn_affinity": Query(
        nn_affinity,
        f"WITH {KNN_CTE} SELECT i, j, count(*) * 0.5::DOUBLE AS w"
        " FROM (SELECT i, j FROM knn UNION ALL SELECT j, i FROM knn) GROUP BY i, j",
    ),
    "rbf_affinity": Query(rbf_affinity, RBF_SQL),
    "self_tuning_affinity": Query(self_tuning_affinity, SELF_TUNING_SQL),
    "dbscan": Query(dbscan, DBSCAN_SQL),
    "kmeans": Query(kmeans_labels),
    "kmeans_range": Query(kmeans_range, KMEANS_RANGE_SQL),
    "auto_kmeans": Query(auto_kmeans),
    "auto_gaussian_mixture": Query(auto_gaussian_mixture),
    "soft_topics": Query(soft_topics),
    "principal_components": Query(principal_components),
    "project_2d": Query(plane),
    "spectral_clustering": Query(spectral_labels),
    "auto_kmeans_text": Query(text_clusters),
    "experiment": Query(experiment),
}
