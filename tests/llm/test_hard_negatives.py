"""Hard negatives against plain Python, products against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector long, rank int"


def brute(rows, wanted, positives=5, negatives=5):
    real = [
        (i, lab, tuple(math.floor(256 * x) for x in v))
        for i, v, lab in rows
        if None not in (i, v, lab) and all(x is not None and math.isfinite(x) for x in v)
    ]

    def best(anchor, same, keep):
        scored = [
            (-sum(a * b for a, b in zip(anchor[2], r[2], strict=True)), r[0])
            for r in real
            if r[0] != anchor[0] and len(r[2]) == len(anchor[2]) and (r[1] == anchor[1]) == same
        ]
        return sorted(x for x in scored if keep(-x[0]))

    found = []
    for anchor in sorted({r for r in real if wanted(r[0])}):
        for p, i in best(anchor, True, lambda s: True)[:positives]:
            near = best(anchor, False, lambda s, p=-p: 80 * p <= 100 * s <= 100 * p)
            found += [(anchor[0], i, k, j, -p, -s) for k, (s, j) in enumerate(near[:negatives], 1)]
    return sorted(found)


def table(spark, rows, parts=4):
    return spark.createDataFrame([(i, v, lab, "x", 1, 2) for i, v, lab in rows], SCHEMA).repartition(parts)


def mined(spark, rows, parts=4):
    found = hard_negatives.mine(table(spark, rows, parts), F.col("vec_id") % 10 == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 0, 4), (33, 17, 65), (64, 64, 64), (100, 300, 50), (1, 200, 129)])
def test_strassen(shape):
    m, d, n = shape
    noise = np.random.default_rng(m)
    a, b = noise.integers(-(1 << 20), 1 << 20, (m, d)), noise.integers(-(1 << 20), 1 << 20, (d, n))
    assert (hard_negatives.strassen(a, b, 8) == a @ b).all()
    assert (hard_negatives.strassen(a, b) == a @ b).all()


def test_strassen_wraps_in_between():
    a = np.full((4, 4), (1 << 62) - 1)
    b = np.eye(4, dtype=np.int64)
    assert (hard_negatives.strassen(a, b, 1) == a).all()


def test_heaps_merge_like_one(spark):
    noise = np.random.default_rng(0)
    scores, ids = noise.integers(0, 5, (7, 60)), np.arange(60)
    wanted = noise.random((7, 60)) < 0.3
    whole = hard_negatives.best(scores, ids, wanted, 6)
    parts = [hard_negatives.best(scores[:, a : a + 20], ids[a : a + 20], wanted[:, a : a + 20], 6) for a in (0, 20, 40)]
    merged = parts[2].merged(parts[0]).merged(parts[1])
    for x, y in ((whole.scores, merged.scores), (whole.ids, merged.ids), (whole.sizes, merged.sizes)):
        assert (x == y).all()


@pytest.mark.parametrize("sizes", [(4096, 4, 1024, 256), (7, 2, 3, 2)])
def test_against_plain_python(spark, monkeypatch, sizes):
    for name, value in zip(("BLOCK_ROWS", "TASK_BLOCKS", "GROUP_ANCHORS", "STRIP_ANCHORS"), sizes, strict=True):
        monkeypatch.setattr(hard_negatives, name, value)
    noise = np.random.default_rng(1)
    # Few values, so that scores tie; a third of the rows are copies of one vector.
    rows = [(i, [float(x) for x in noise.choice([-0.5, 0.1, 0.5], 20)], int(noise.integers(0, 3))) for i in range(200)]
    rows += [(i, rows[0][1], i % 3) for i in range(200, 300)]
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 100 and mined(spark, rows) == want


ODD = [
    (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.5], 2), (3, None, 1),
    (4, [1.0, None], 2), (5, [float("nan"), 1.0], 2), (6, [float("inf"), 1.0], 2), (7, [1.0, 0.4], None), (8, [], 1),
    (10, [], 1), (11, [], 2), (12, [1.0, 2.0, 3.0], 1), (20, [1.0, 2.0, 3.0], 1), (21, [1.0, 2.0, 2.9], 4),
    (None, [1.0, 0.5], 2), (30, [0.0, 0.0], 1), (30, [0.9, 0.5], 1), (40, [-1.0, -0.5], 2), (41, [-1.0, -0.5], 2),
    (42, [-1.0, -0.5], 7), (50, [1.0, 0.5], 9), (13, [0.95, 0.45], 2), (14, [0.95, 0.45], 2),
]


def test_odd_rows(spark):
    assert mined(spark, ODD) == brute(ODD, lambda i: i % 10 == 0)


def test_empty_tables(spark):
    assert mined(spark, [(3, [1.0], 1), (4, [1.0], 2)]) == []
    found = hard_negatives.mine(table(spark, ODD).where("vec_id > 99"), F.col("vec_id") % 10 == 0)
    assert found.collect() == []


def test_scores_beyond_64_bits_are_an_error(spark):
    rows = [(0, [1e18, 1e18], 1), (1, [1e18, 1e18], 1)]
    with pytest.raises(Exception, match="do not fit 64 bits"):
        mined(spark, rows)
