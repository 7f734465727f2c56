"""Fits of many numbers of clusters in the same scans, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.operators import clustering, shared_scan


@pytest.fixture(scope="module")
def points():
    noise = np.random.default_rng(5)
    return np.concatenate([c + noise.normal(size=(60, 4)) for c in noise.normal(scale=6, size=(3, 4))])


@pytest.fixture(scope="module")
def vectors(spark, points):
    rows = [([float(x) for x in p],) for p in points]
    return spark.createDataFrame(rows, "v array<double>").repartition(4).cache()


def lloyd(x, centres, iterations):
    for _ in range(iterations):
        near = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        centres = np.array([x[near == j].mean(0) if (near == j).any() else centres[j] for j in range(len(centres))])
    return centres, ((x[:, None] - centres[None]) ** 2).sum(-1).min(1).sum()


@pytest.mark.parametrize("iterations", [1, 3])
def test_steps_are_those_of_lloyd(vectors, points, iterations):
    starts = {k: points[: 40 * k : 40] for k in (1, 2, 4)}
    # A centre that no row is nearest to stays where it is.
    starts[3] = np.vstack([points[:2], np.full(4, 1e3)])
    fits = shared_scan.kmeans_range(vectors, 4, starts, iterations)
    for k, start in starts.items():
        centres, inertia = lloyd(points, start, iterations)
        assert np.allclose(fits.models[k].centres, centres) and np.isclose(fits.scores[k], inertia)
    assert fits.scans == iterations + 1


def test_scans_do_not_grow_with_the_ks(vectors, points):
    starts = {k: shared_scan.spread_starts(points, k, 0) for k in range(1, 8)}
    one = {k: shared_scan.kmeans_range(vectors, 4, {k: s}).scans for k, s in starts.items()}
    fits = shared_scan.kmeans_range(vectors, 4, starts)
    assert fits.scans == max(one.values()) and set(fits.seconds) == set(starts)
    for k in starts:
        best = lloyd(points, starts[k], 100)[1]
        assert np.isclose(fits.scores[k], best)


def em(x, mixture, ridge):
    shares, logs = mixture.shares(x)
    n = shares.sum(0)
    means = (shares.T @ x) / n[:, None]
    covariances = []
    for j in range(len(n)):
        apart = x - means[j]
        covariances.append((shares[:, j, None] * apart).T @ apart / n[j] + ridge * np.eye(x.shape[1]))
    return shared_scan.Mixture(n / n.sum(), means, np.array(covariances)), logs.sum()


def test_steps_are_those_of_expectation_and_maximisation(vectors, points):
    far = 1e4  # about another place, where products of raw numbers would lose the variances
    moved = vectors.select(F.transform("v", lambda x: x + far).alias("v"))
    ks = (1, 2, 3)
    starts = {k: points[: 60 * k : 60] + far for k in ks}
    fits = shared_scan.mixture_range(moved, 4, starts, iterations=4)
    variances = points.var(0)
    ridge = shared_scan.RIDGE * variances.mean()
    for k in ks:
        mine = shared_scan.Mixture(np.full(k, 1 / k), starts[k] - far, np.array([np.diag(variances + ridge)] * k))
        logs = []
        for _ in range(4):
            step, likely = em(points, mine, ridge)
            logs.append(likely)
            if len(logs) > 1 and (logs[-1] - logs[-2]) / len(points) <= shared_scan.GAIN_TOLERANCE:
                break
            mine = step
        else:
            logs.append(em(points, mine, ridge)[1])
        assert np.isclose(fits.scores[k], logs[-1])
        assert np.allclose(fits.models[k].means - far, mine.means, atol=1e-6)
        assert np.allclose(fits.models[k].covariances, mine.covariances, atol=1e-6)
    assert fits.scans <= 1 + 4 + 1


def test_components_that_hold_one_point_are_kept_apart_by_the_ridge(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, embedding array<double>")
    chosen = clustering.auto_gaussian_mixture(df, [1, 2, 0])
    assert [k for k, _, _ in chosen.tried] == [1, 2] and chosen.problems == {0: "not a number of clusters"}


def test_shares_of_rows(spark, points):
    mixture = shared_scan.Mixture(np.array([0.3, 0.7]), points[[0, 90]], np.array([np.eye(4)] * 2))
    rows = [(0, [float(x) for x in points[0]]), (1, [float(x) for x in points[90]]), (2, None), (3, [1.0])]
    df = spark.createDataFrame(rows, "id int, embedding array<double>")
    assert [r.cluster for r in clustering.mixture_labels(df, mixture).orderBy("id").collect()] == [0, 1, None, None]
    found = clustering.mixture_shares(df, mixture).orderBy("id").collect()
    assert np.allclose(found[0].shares, mixture.shares(points[:1])[0][0])
    assert found[2].shares is None and clustering.soft_topics(df, mixture).count() == 4
    # Spark's own model is used in the same way.
    own = clustering.gaussian_mixture(df.where("id < 2"), 2)
    assert [r.cluster is None for r in clustering.mixture_labels(df.where("id < 3"), own).orderBy("id").collect()] == [
        False, False, True
    ]


def test_odd_vectors_take_no_part(spark):
    rows = [(i, [float(i % 3 * 10), 1.0]) for i in range(30)]
    odd = [(90, None), (91, []), (92, [1.0]), (93, [float("nan"), 0.0]), (94, [None, 0.0]), (95, [float("inf"), 0.0])]
    clean = clustering.auto_kmeans(spark.createDataFrame(rows, "id int, embedding array<double>"), range(1, 5))
    mixed = clustering.auto_kmeans(spark.createDataFrame(rows + odd, "id int, embedding array<double>"), range(1, 5))
    assert clean.k == mixed.k == 3 or clean.k == mixed.k
    assert np.allclose([s for _, s, _ in clean.tried], [s for _, s, _ in mixed.tried])
    assert dict((k, s) for k, s, _ in clean.tried)[3] < 1e-9
    with pytest.raises(ValueError, match="no vectors"):
        clustering.auto_kmeans(spark.createDataFrame(odd[:2], "id int, embedding array<double>"), [2])


def test_nearest_far_from_the_origin():
    """Squares of 1e8 leave no room for differences of 1e-4 in a product form."""
    noise = np.random.default_rng(0)
    centres = 1e8 + noise.normal(scale=1e-3, size=(20, 8))
    x = 1e8 + noise.normal(scale=1e-3, size=(500, 8))
    best, distance = shared_scan.nearest(x, centres)
    exact = ((x[:, None] - centres[None]) ** 2).sum(-1)
    assert (best == exact.argmin(1)).all() and np.allclose(distance, np.sqrt(exact.min(1)))
    same = np.array([[1.0, 2.0], [1.0, 2.0]])
    assert shared_scan.nearest(np.zeros((3, 2)), same)[0].tolist() == [0, 0, 0]
