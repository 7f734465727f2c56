import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from topicloom.operators import clustering, neighbours, spectral
from topicloom.operators.embedding import embed, project_2d, reduce


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(2)
    centres = np.array([[6.0, 0, 0], [0, 6, 0], [0, 0, 6], [-6, -6, 0]])
    return np.concatenate([c + rng.normal(scale=0.3, size=(40, 3)) for c in centres])


@pytest.fixture(scope="module")
def table(spark, blobs):
    data = [(i, [float(x) for x in p], i // 40) for i, p in enumerate(blobs)]
    return spark.createDataFrame(data, "id long, embedding array<double>, blob int").cache()


def same_partition(df, cluster="cluster"):
    pairs = df.select("blob", cluster).distinct().collect()
    return len(pairs) == 4 and len({r[1] for r in pairs}) == 4


def test_auto_kmeans_finds_the_blobs(spark, table, blobs):
    chosen = clustering.auto_kmeans(table, range(2, 9))
    assert chosen.k == 4
    scores = [s for _, s, _ in chosen.tried]
    assert scores[0] > scores[1] > scores[2]
    assert chosen.table(spark).where("chosen").count() == 1
    found = clustering.assign(table, clustering.centroids(chosen.model))
    assert same_partition(found)
    total = clustering.inertia(table, clustering.centroids(chosen.model)).first().inertia
    assert math.isclose(total, dict((k, s) for k, s, _ in chosen.tried)[4], rel_tol=1e-6)


def test_same_seed_same_fit(table):
    first = clustering.centroids(clustering.kmeans(table, 3, seed=7))
    again = clustering.centroids(clustering.kmeans(table.repartition(3), 3, seed=7))
    assert np.allclose([c for _, c in first], [c for _, c in again])


def test_failed_k_is_left_out(spark, table):
    chosen = clustering.auto_kmeans(table, [1, 2, 3, 4, 5, 6, -1])
    assert [k for k, _, _ in chosen.tried] == [1, 2, 3, 4, 5, 6] or [k for k, _, _ in chosen.tried] == [2, 3, 4, 5, 6]
    assert chosen.k in [k for k, _, _ in chosen.tried]
    with pytest.raises(ValueError):
        clustering.auto_kmeans(table, [-1, -2])


def test_assign_nearest(spark, table, blobs):
    centres = [(5, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (9, [0.0, 1.0, 0.0])]
    for given in (centres, spark.createDataFrame(centres, "c int, v array<double>")):
        found = clustering.assign(table, given).orderBy("id").collect()
        d = np.sqrt(((blobs[:, None] - np.array([c for _, c in centres])[None]) ** 2).sum(-1))
        for r, row in zip(found, d, strict=True):
            # Equal distances go to the lower number.
            assert r.cluster == (2 if row[1] < row[0] else 5)
            assert math.isclose(r.distance, row.min())


def test_missing_vector_has_no_cluster(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0])], "id int, embedding array<double>")
    found = clustering.assign(df, [(0, [0.0, 0.0])])
    assert [r.cluster for r in found.orderBy("id").collect()] == [0, None, None]


def test_elbow(spark):
    scores = {2: 100.0, 3: 60.0, 5: 20.0, 6: 18.0, 9: 10.0}
    points = np.array(sorted(scores.items()))
    a, b = points[0], points[-1]
    line = b - a
    cross = line[0] * (points[:, 1] - a[1]) - line[1] * (points[:, 0] - a[0])
    expected = cross / np.hypot(*line)
    found = clustering.elbow(spark.createDataFrame(sorted(scores.items()), "k int, score double")).orderBy("k").collect()
    assert np.allclose([r.chord for r in found], expected)
    # The chosen k is the one of that row, though 4, 7 and 8 are missing.
    assert [r.k for r in found if r.chosen] == [int(points[expected.argmin()][0])] == [5]
    assert clustering.choose_k(spark, [(3, 1.0)]) == 3
    assert clustering.choose_k(spark, [(2, 4.0), (3, 3.0), (4, 2.0)]) == 2


def test_mixture(spark, table):
    chosen = clustering.auto_gaussian_mixture(table, range(2, 6))
    # A k whose fit does not converge is left out.
    assert 2 <= len(chosen.tried) <= 4
    assert chosen.k == clustering.choose_k(spark, [(k, s) for k, s, _ in chosen.tried])
    soft = clustering.soft_topics(table, chosen.model)
    sums = soft.groupBy("id").agg(
        F.sum("p").alias("p"), F.count("*").alias("n"), F.max_by("topic", "p").alias("best")
    )
    assert sums.where(f"abs(p - 1) > 1e-9 or n <> {chosen.k}").count() == 0
    labels = clustering.mixture_labels(table, chosen.model).select("id", "cluster")
    assert labels.join(sums, "id").where("cluster <> best").count() == 0


def test_aic():
    assert clustering.aic(-100.0, 2, 3) == 2 * (2 * 6 + 2 * 3 + 1) + 200.0


def test_components_are_centred(table, blobs):
    found = reduce(table, k=3).orderBy("id").collect()
    x = np.array([r.reduced for r in found])
    assert np.allclose(x.mean(0), 0, atol=1e-9)
    assert (np.diff(x.var(0)) <= 1e-9).all()
    values = np.sort(np.linalg.eigvalsh(np.cov(blobs.T)))[::-1]
    assert np.allclose(x.var(0, ddof=1), values)
    same = reduce(table, method="identity").orderBy("id").collect()
    assert np.allclose([r.reduced for r in same], blobs)
    with pytest.raises(ValueError):
        reduce(table, method="other")


def test_plane(spark, table):
    found = project_2d(table, "id", "blob")
    assert found.columns == ["id", "x", "y", "blob"] and found.count() == 160
    flat = spark.createDataFrame([(1, [3.0, 4.0], 0)], "id int, embedding array<double>, blob int")
    assert rows(project_2d(flat, "id", "blob")) == [(1, 3.0, 4.0, 0)]


def test_spectral_on_two_triangles(spark):
    links = [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5)]
    data = [(i, j, 1.0) for i, j in links] + [(j, i, 1.0) for i, j in links] + [(2, 3, 0.01), (3, 2, 0.01)]
    edges = spark.createDataFrame(data, "i long, j long, w double")
    found = spectral.spectrum(edges, 4)
    w = np.zeros((6, 6))
    for i, j, x in data:
        w[i, j] = x
    d = w.sum(1)
    expected = np.linalg.eigvalsh(np.eye(6) - w / np.sqrt(np.outer(d, d)))
    assert np.allclose(found.eigenvalues, expected[:4], atol=1e-8)
    assert spectral.eigengap_k(found.eigenvalues) == 2
    labels, k = spectral.spectral_clustering(edges, m=4)
    at = {r.i: r.cluster for r in labels.collect()}
    assert k == 2 and at[0] == at[1] == at[2] != at[3] == at[4] == at[5]


@pytest.mark.parametrize("apart", [0.0, 50.0], ids=["one sheet", "four strips"])
def test_spectrum_like_a_dense_solver(spark, apart):
    rng = np.random.default_rng(1)
    n = 120
    x = rng.random((n, 2)) * [4, 1] + np.stack([apart * (np.arange(n) // (n // 4)), np.zeros(n)], 1)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, 1)[:, :10]
    w = np.zeros((n, n))
    for i in range(n):
        for j in near[i]:
            w[i, j] = w[j, i] = np.exp(-d[i, j] / 0.1)
    degree = w.sum(1)
    expected = np.linalg.eigvalsh(np.eye(n) - w / np.sqrt(np.outer(degree, degree)))[:8]
    data = [(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)]
    found = spectral.spectrum(spark.createDataFrame(data, "i long, j long, w double"), 8, columns=60)
    assert np.allclose(found.eigenvalues, expected, atol=1e-6)
    assert max(found.residuals) <= spectral.TOLERANCE


def test_spectrum_of_many_vectors(spark):
    # A ring of nodes with weights at random; a round has 134 columns, more than half of ``COLUMNS``.
    rng = np.random.default_rng(3)
    n, m = 400, 130
    w = np.zeros((n, n))
    for step in (1, 2):
        at = np.arange(n)
        w[at, (at + step) % n] = w[(at + step) % n, at] = rng.random(n) + 0.1
    degree = w.sum(1)
    expected = np.linalg.eigvalsh(np.eye(n) - w / np.sqrt(np.outer(degree, degree)))[:m]
    data = [(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)]
    found = spectral.spectrum(spark.createDataFrame(data, "i long, j long, w double"), m, max_rounds=10)
    assert np.allclose(found.eigenvalues, expected, atol=1e-6)
    assert max(found.residuals) <= spectral.TOLERANCE


def test_spectral_on_blobs(table):
    edges = neighbours.self_tuning_affinity(neighbours.knn(table, 10, "id", "embedding"))
    labels, k = spectral.spectral_clustering(edges, k=4)
    assert k == 4
    assert same_partition(labels.join(table.withColumnRenamed("id", "i"), "i"))


def test_eigengap():
    assert spectral.eigengap_k([0.0, 0.01, 0.02, 0.9, 1.0]) == 3
    with pytest.raises(ValueError):
        spectral.eigengap_k([0.0, 1.0])


def test_text_clusters(spark):
    data = [(i, f"alpha beta gamma {i % 2}") for i in range(20)] + [(i, f"one two three {i % 2}") for i in range(20, 40)]
    df = spark.createDataFrame(data, "id long, text string")
    fitted = clustering.auto_kmeans_text(df, "id", k_range=range(2, 5))
    found = fitted.predict(df)
    groups = {frozenset(r.id // 20 for r in found.where(F.col("cluster") == c).collect()) for c in range(fitted.chosen.k)}
    assert groups <= {frozenset({0}), frozenset({1}), frozenset()}


def test_experiment(table):
    with pytest.raises(ValueError):
        clustering.run_experiment(table, "id", "t", None, clustering.auto_kmeans)
    with pytest.raises(ValueError):
        clustering.run_experiment(table, "id", "t", lambda d: d, None)
    seen = []
    done = clustering.run_experiment(
        table, "id", "t", lambda d: d, lambda d: clustering.gaussian_mixture(d, 4), 2,
        track=lambda d: seen.append(d.columns) or d,
    )
    assert done.labelled.count() == 160 and seen


def test_embedded_text_can_be_assigned(spark):
    df = spark.createDataFrame([(1, "some words"), (2, "other words")], "id int, text string")
    found = clustering.assign(embed(df, "text"), [(0, [0.1] * 64), (1, [-0.1] * 64)]).drop("embedding", "distance")
    assert found.count() == 2 and found.where("cluster is null").count() == 0


def test_experiment_makes_vectors_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def vector(n):
        made.add(1)
        return [float(n % 7), float(n % 5), float(n % 3)]

    df = spark.range(200)
    done = clustering.run_experiment(
        df, "id", "id", lambda d: d.withColumn("embedding", vector("id")),
        lambda d: clustering.auto_kmeans(d, range(2, 4)), components=2,
    )
    assert done.labelled.count() == 200
    assert made.value == 200
