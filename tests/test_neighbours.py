import numpy as np
import pytest
from conftest import rows

from topicloom.operators import blocks, density, neighbours, projections
from topicloom.operators.components import connected_components
from topicloom.operators.density import dbscan
from topicloom.operators.neighbours import Cells
from topicloom.plans import vectors as plans


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 3)) * 3
    x = np.concatenate([c + rng.normal(scale=0.25, size=(30, 3)) for c in centres] + [rng.normal(size=(20, 3)) * 4])
    # A third of all rows are copies of one point.
    return np.concatenate([x, np.repeat(x[:1], 70, axis=0)])


@pytest.fixture(scope="module")
def table(spark, points):
    data = [(1000 - 3 * i, [float(v) for v in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(data, "id long, embedding array<double>").cache()


def ids(points):
    return 1000 - 3 * np.arange(len(points))


def distances(points):
    return np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))


def brute_knn(points, k):
    names, found = ids(points), []
    for i, row in enumerate(distances(points)):
        near = sorted((d, names[j]) for j, d in enumerate(row) if j != i)[:k]
        found += [(int(names[i]), int(j), r) for r, (_, j) in enumerate(near, 1)]
    return sorted(found)


@pytest.mark.parametrize("block_rows", [16, 10_000])
def test_knn(table, points, block_rows):
    found = neighbours.knn(table, 7, "id", "embedding", block_rows)
    assert sorted(rows(found, "i", "j", "rank")) == brute_knn(points, 7)


def test_knn_with_few_points(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [3.0])], "id long, vector array<double>")
    assert rows(neighbours.knn(df, 5), "i", "j") == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)]


def test_affinities(table, points):
    near = neighbours.knn(table, 9, "id", "embedding").cache()
    d, names = distances(points), ids(points)
    at = {int(n): i for i, n in enumerate(names)}
    scale = np.sort(d, axis=0)[7]
    tuned = neighbours.self_tuning_affinity(near).collect()
    assert len(tuned) > 9 * len(points)
    for r in tuned:
        i, j = at[r.i], at[r.j]
        product = scale[i] * scale[j]
        expected = np.exp(-d[i, j] ** 2 / product) if product > 0 else float(d[i, j] == 0)
        assert abs(r.w - expected) < 1e-9
    for r in neighbours.rbf_affinity(near, gamma=0.5).collect():
        assert abs(r.w - np.exp(-0.5 * d[at[r.i], at[r.j]] ** 2)) < 1e-9
    linked = {(i, j) for i, j, _ in brute_knn(points, 9)}
    for r in neighbours.nn_affinity(near).collect():
        assert r.w == 0.5 * (((r.i, r.j) in linked) + ((r.j, r.i) in linked))


def test_cells_leave_out_only_distant_pairs(table, points):
    radius = 0.8
    cells = Cells(table, "id", "embedding", 16)
    assert len(cells.pivots) == len(points) // 16
    assert max(cells.first) < len(points) // 8
    sizes = cells.points.groupBy("__block").count().agg({"count": "max"}).first()[0]
    assert sizes <= 40
    asking, given = {}, {}
    for r in cells.pairs(radius).select("id", "__probe", "__data", "__asks").collect():
        side = asking if r["__asks"] else given
        side.setdefault((r["__probe"], r["__data"]), set()).add(r["id"])
    met = {(a, b) for pair, group in asking.items() for a in group for b in given[pair]}
    names = ids(points)
    for i, j in np.argwhere(distances(points) <= radius):
        assert (names[i], names[j]) in met
    assert len(met) < len(points) ** 2 / 2


def brute_dbscan(points, eps, least):
    names = ids(points)
    near = distances(points) <= eps
    core = near.sum(1) >= least
    label = {}
    for i in sorted(np.flatnonzero(core), key=lambda i: names[i]):
        if i in label:
            continue
        label[i], todo = int(names[i]), [i]
        while todo:
            a = todo.pop()
            for b in np.flatnonzero(near[a] & core):
                if b not in label:
                    label[b] = int(names[i])
                    todo.append(b)
    found = []
    for i in range(len(points)):
        hits = [label[j] for j in np.flatnonzero(near[i] & core)]
        found.append((int(names[i]), bool(core[i]), label[i] if core[i] else min(hits, default=-1)))
    return sorted(found)


@pytest.mark.parametrize(("eps", "least", "block_rows"), [(0.4, 5, 16), (0.25, 4, 2048), (3.0, 5, 16)])
def test_dbscan(table, points, eps, least, block_rows):
    found = dbscan(table, eps, least, block_rows=block_rows)
    assert sorted(rows(found, "id", "core", "cluster")) == brute_dbscan(points, eps, least)


def test_copies_alone_make_a_cluster(spark):
    df = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(5)] + [(9, [5.0, 5.0])], "id long, embedding array<double>")
    assert rows(dbscan(df, 0.5, 5)) == sorted([(i, True, 0) for i in range(5)] + [(9, False, -1)], key=repr)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 102), (102, 101), (200, 200)]
    edges += [(500, 500 + i) for i in range(1, 40)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"))
    expected = [(i, 0) for i in range(61)] + [(i, 100) for i in (100, 101, 102, 103)]
    assert rows(found) == sorted(expected + [(i, 500) for i in range(500, 540)], key=repr)


def test_no_points(spark):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    assert neighbours.knn(none, 3, "id", "embedding").count() == 0
    assert dbscan(none, 1.0, 2).count() == 0


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("shuffled", [False, True])
def test_long_paths_settle_in_few_rounds(spark, shuffled):
    names = np.arange(1000)
    if shuffled:
        np.random.default_rng(0).shuffle(names)
    edges = [(int(a), int(b)) for a, b in zip(names, names[1:], strict=False)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), max_rounds=12)
    assert found.count() == 1000 and [r[0] for r in found.select("component").distinct().collect()] == [0]


def test_block_links_reach_whole_chains():
    names = np.array([5, 3, 9, 1, 7, 3])
    near = np.zeros((6, 6), bool)
    for a, b in ((0, 1), (2, 5), (3, 3)):
        near[a, b] = near[b, a] = True
    assert density._roots(near, names).tolist() == [3, 3, 3, 1, 7, 3]


def test_chain_is_one_cluster(spark):
    data = [(i, [0.4 * i, 0.0]) for i in range(300)]
    df = spark.createDataFrame(data, "id long, embedding array<double>")
    found = dbscan(df, 0.5, 2, block_rows=16)
    assert [tuple(r) for r in found.select("cluster", "core").distinct().collect()] == [(0, True)]


def test_search_reports_its_work(spark):
    """Clustered points: few of the pairs of blocks are compared, and nothing is missed."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 4)) * 50
    x = np.concatenate([c + rng.normal(size=(50, 4)) for c in centres])
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, vector array<double>")
    found, report = neighbours.knn_with_report(df, 3, block_rows=50)
    assert report.points == 2000 and report.blocks >= 40 and report.rounds >= 1
    assert report.pairs < report.blocks**2 / 3
    d = distances(x)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :3]
    want = sorted((i, int(order[i, r]), r + 1) for i in range(2000) for r in range(3))
    assert sorted(rows(found, "i", "j", "rank")) == want


@pytest.mark.parametrize("far", [0.0, 1e7])
def test_distances_far_from_the_origin(spark, far):
    """Where products of raw numbers are of no use: neighbours 1e-4 apart at 1e7."""
    rng = np.random.default_rng(1)
    x = far + rng.normal(scale=1e-3, size=(150, 3))
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, embedding array<double>")
    d = distances(x)
    found = neighbours.knn(df, 2, "id", "embedding", 20)
    want = [(i, int(j)) for i in range(150) for j in np.argsort(np.where(np.arange(150) == i, np.inf, d[i]), kind="stable")[:2]]
    assert sorted(rows(found, "i", "j")) == sorted(want)
    eps = float(np.quantile(d, 0.02))
    core = (d <= eps).sum(1) >= 3
    assert {r.id for r in dbscan(df, eps, 3, block_rows=20).where("core").collect()} == set(np.flatnonzero(core).tolist())


def test_ids_of_any_kind_and_rows_without_vectors(spark):
    data = [("a", [0.0]), ("b", [1.0]), ("c", None), ("d", [3.0]), ("e", [])]
    df = spark.createDataFrame(data, "id string, vector array<float>")
    assert rows(neighbours.knn(df, 1), "i", "j") == [("a", "b"), ("b", "a"), ("d", "b")]


def recall(found, x, k):
    """Share of the true neighbours that were found; distances must be those of the vectors."""
    d = distances(x)
    np.fill_diagonal(d, np.inf)
    pairs = {}
    for r in found.collect():
        assert abs(d[r.i, r.j] - r.distance) < 1e-9
        pairs.setdefault(r.i, {})[r["rank"]] = r.j
    assert all(sorted(v) == list(range(1, len(v) + 1)) and len(set(v.values())) == len(v) for v in pairs.values())
    true = np.argsort(d, axis=1, kind="stable")[:, :k]
    return np.mean([len(set(true[i].tolist()) & set(pairs.get(i, {}).values())) / k for i in range(len(x))])


def test_approximate_neighbours_of_planted_blobs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16)) * 5
    x = np.concatenate([c + rng.normal(size=(50, 16)) for c in centres])
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, vector array<double>")
    found = projections.approximate_knn(df, 5, bucket_rows=100)
    assert recall(found, x, 5) >= 0.9
    # More probes find more, and pieces of a bucket leave nothing out.
    few = projections.approximate_knn(df, 5, tables=2, probes=0, bucket_rows=100)
    monkeypatch.setattr(projections, "PIECE_ROWS", 40)
    cut = projections.approximate_knn(df, 5, tables=2, probes=0, bucket_rows=100)
    assert rows(few) == rows(cut) and recall(few, x, 5) < recall(found, x, 5)


def test_approximate_with_one_bucket_is_exact(table, points, spark):
    found = projections.approximate_knn(table, 7, "id", "embedding", tables=1, probes=3)
    assert sorted(rows(found, "i", "j", "rank")) == brute_knn(points, 7)
    none = spark.createDataFrame([], "id long, vector array<double>")
    assert projections.approximate_knn(none, 3).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [1.0]), (4, [1.0])], "id long, vector array<double>")
    assert rows(projections.approximate_knn(odd, 3), "i", "j", "distance") == [(3, 4, 0.0), (4, 3, 0.0)]


def test_probes_are_the_nearest_buckets():
    planes, medians = np.eye(3), np.array([0.0, 1.0, 2.0])
    found = projections.buckets(np.array([[0.1, 3.0, 1.5]]), planes, medians, 4)[0].tolist()
    # Distances from the medians are 0.1, 2 and 0.5: the first bit turns first, then the third, then both.
    assert found == [0b011, 0b010, 0b111, 0b110, 0b001]


def test_blocks_are_sent_to_few_groups():
    """What is sent is the points times the groups, whose number does not follow that of the blocks."""
    noise = np.random.default_rng(3)
    pivots = noise.normal(size=(900, 8))
    directory = blocks.Directory(pivots, np.arange(900), np.ones(900))
    groups = blocks.block_groups(directory, 200_000)
    assert len(groups) == blocks.GROUPS
    assert sorted(b for g in groups for b in g) == list(range(900))


def test_points_ask_where_something_may_be_near():
    noise = np.random.default_rng(4)
    x, pivots = noise.normal(size=(600, 3)), noise.normal(size=(12, 3))
    away = np.sqrt(((x[:, None] - pivots[None]) ** 2).sum(2))
    cell = away.argmin(1)
    directory = blocks.Directory(pivots, np.arange(12), np.array([away[cell == c, c].max() for c in range(12)]))
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    left_out = 0
    for own in range(12):
        mine = np.flatnonzero(cell == own)
        for target in set(range(12)) - {own}:
            asks = directory.asking(x[mine], own, target, np.full(len(mine), 0.2))
            silent = np.delete(mine, asks)
            left_out += len(silent)
            assert not (apart[np.ix_(silent, cell == target)] <= 0.2).any()
    assert left_out > 600 * 11 / 2


def test_density_sends_a_block_once_per_group(spark):
    """Points without structure: every block meets every other, and is sent to 12 tiles, not to all blocks."""
    x = np.random.default_rng(3).normal(size=(640, 8))
    df = spark.createDataFrame([(i, [float(v) for v in p], 1) for i, p in enumerate(x)], "p long, v array<double>, n long")
    packed, directory, n = density.pack_blocks(df, 8)
    groups = density.block_groups(directory, n)

    def sent(tile):
        met = sum(1 for _ in tile.pairs())
        return density.pa.table({"blocks": [len(tile.vectors)], "pairs": [met]})

    found = density._tiles(packed, directory, groups, 100.0, sent, "blocks long, pairs long").collect()
    blocks = packed.count()
    assert blocks > 50 and len(groups) == 12 and len(found) == 78
    assert sum(r.blocks for r in found) == 12 * blocks
    assert sum(r.pairs for r in found) == blocks * (blocks + 1) // 2


def test_broken_vectors_are_noise(spark):
    data = [(i, [0.1 * i, 0.0]) for i in range(6)] + [(7, None), (8, [float("nan"), 0.0]), (9, [None, 0.0])]
    df = spark.createDataFrame(data, "id long, embedding array<double>")
    found = rows(dbscan(df, 0.25, 3))
    assert found == sorted([(i, True, 0) for i in range(6)] + [(i, False, -1) for i in (7, 8, 9)], key=repr)


@pytest.mark.parametrize("block_rows", [16, 10_000])
def test_all_pairs(table, points, block_rows):
    d, names = distances(points), ids(points)
    found = neighbours.all_pairs(table, "id", "embedding", block_rows).collect()
    assert len(found) == len({(r.i, r.j) for r in found}) == len(points) * (len(points) - 1)
    at = {int(n): i for i, n in enumerate(names)}
    assert all(abs(r.distance - d[at[r.i], at[r.j]]) < 1e-9 for r in found)


def test_all_pairs_of_odd_rows(spark):
    """Of several vectors of an id the nearest counts; numbers without end or sense spoil their own pairs only."""
    odd = [("a", [0.0]), ("a", [4.0]), ("a", [4.0]), ("b", [5.0]), ("c", [float("inf")]), ("d", None), (None, [1.0]), ("e", [])]
    df = spark.createDataFrame(odd, "id string, vector array<double>")
    far = float("inf")
    expected = [("a", "b", 1.0), ("a", "c", far), ("b", "a", 1.0), ("b", "c", far), ("c", "a", far), ("c", "b", far)]
    assert rows(neighbours.all_pairs(df)) == expected
    assert neighbours.all_pairs(df.where("id = 'z'")).count() == 0
    close = [(i, [1e7 + 1e-4 * i, 1e7]) for i in range(30)]
    found = neighbours.all_pairs(spark.createDataFrame(close, "id long, vector array<double>")).collect()
    assert all(abs(r.distance - abs(close[r.i][1][0] - close[r.j][1][0])) < 1e-12 for r in found)


def test_kernel_holds_all_pairs(spark, tmp_path):
    """More points than a neighbour list has places: no pair is left out."""
    x = np.random.default_rng(2).normal(size=(40, 4))
    data = [(i, [float(v) for v in p], 0) for i, p in enumerate(x)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    found = plans.rbf_affinity(spark, str(tmp_path)).collect()
    assert len(found) == 40 * 39
    d = distances(x.astype(np.float32).astype(float))
    assert all(abs(r.w - np.exp(-d[r.i, r.j] ** 2)) < 1e-6 for r in found)


def test_points_of_a_group_ask_together():
    noise = np.random.default_rng(4)
    x, pivots = noise.normal(size=(600, 3)), noise.normal(size=(12, 3))
    away = np.sqrt(((x[:, None] - pivots[None]) ** 2).sum(2))
    cell = away.argmin(1)
    directory = blocks.Directory(pivots, np.arange(12), np.array([away[cell == c, c].max() for c in range(12)]))
    limit = np.where(np.arange(600) % 7 == 0, np.inf, 0.2)
    found = directory.asked(x, cell, np.arange(12), limit)
    assert found[limit == np.inf].all() and not found.all()
    for own in range(12):
        mine = np.flatnonzero(cell == own)
        for target in set(range(12)) - {own}:
            alone = mine[directory.asking(x[mine], own, target, limit[mine])]
            assert alone.tolist() == mine[found[mine, target]].tolist()


def test_vectors_without_copies_are_not_joined(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "id long, vector array<double>")
    found = neighbours.knn(df, 2)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert len(rows(found)) == 40
    copied = df.union(df.where("id < 3").withColumn("id", df["id"] + 100))
    assert (0, 100, 0.0, 1) in rows(neighbours.knn(copied, 2))
