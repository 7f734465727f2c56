"""Near-duplicates against all pairs in plain Python."""

import random
import re

import brute
import numpy as np
import pytest

from topicloom.llm import minhash, words


def variants(seed):
    rng = random.Random(seed)
    rows, ids = [], iter(rng.sample(range(10_000), 400))
    for _ in range(6):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 120, 300]))]
        for _ in range(12):
            text = list(base)
            for _ in range(rng.randrange(8)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(1000)}"
            rows.append((next(ids), " ".join(text) if rng.random() < 0.8 else "\n".join(text).upper()))
    # A chain: every text is like the next one only.
    chain = [f"c{k}" for k in range(400)]
    for k in range(12):
        rows.append((next(ids), " ".join(chain[10 * k : 10 * k + 150])))
    for text in (None, None, "", " \n", "one", "ONE", "two words", "a b c d", "A b c d", "a b c d e"):
        rows.append((next(ids), text))
    return rows


def check(spark, rows):
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, id int, n int, a int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df.repartition(3)).collect()}
    want = brute.near_duplicates(rows)
    assert got == want
    return want


@pytest.mark.parametrize("seed", [1, 2])
def test_like_all_pairs(spark, seed):
    found = check(spark, variants(seed))
    assert len({c for _, c in found.values()}) < len(found) - 30


def test_pieces_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PIECE", 3)
    check(spark, variants(3))


def test_bands_follow_the_similarity(spark):
    # Pairs of similarity 0.50, 0.51, 0.32 and 0.29, each with words of its own.
    rows = []
    for k in range(60):
        shift = (32, 31, 49, 53)[k % 4]
        words = [f"p{k}w{i}" for i in range(100 + shift)]
        rows += [(2 * k, " ".join(words[:100])), (2 * k + 1, " ".join(words[shift:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (50, 30):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, percent).collect()}
        assert got == brute.near_duplicates(rows, percent)
    assert [minhash.band_rows(p) for p in (100, 85, 80, 70, 50, 30, 10)] == [6, 6, 6, 4, 2, 2, 1]
    for percent in (0, 3):
        with pytest.raises(ValueError):
            minhash.near_duplicates(df, percent)


def test_kept_and_odd_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    other = " ".join(f"v{i}" for i in range(30))
    rows = [(4, text), (2, text), (2, other), (9, other), (None, text), (None, None), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted(
        [(4, 26, 2, False), (2, 26, 2, True), (2, 26, 2, True), (9, 26, 2, False),
         (None, 26, None, True), (None, 0, None, True), (7, 0, 7, True)], key=repr,
    )


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(none).collect() == []


def test_signatures_estimate_similarity():
    texts = [" ".join(f"w{i}" for i in range(a, a + 400)) for a in (0, 40, 200)]
    raw = [t.encode() for t in texts]
    split = words.Words(
        np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    )
    values, counts = minhash.shingle_sets(split)
    signed = minhash.signatures(values, counts)
    sets = np.split(values, np.cumsum(counts)[:-1])
    for a, b in ((0, 1), (0, 2), (1, 2)):
        truth = len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
        assert abs((signed[a] == signed[b]).mean() - truth) < 0.13
    assert len(np.unique(minhash._scattered(np.arange(1 << 22, dtype=np.uint64) << np.uint64(42)))) == 1 << 22


def test_pieces_of_a_group_are_dealt_to_tasks(spark):
    """The join on the group brings its rows together; its pieces must not stay there."""
    members = spark.range(50).selectExpr("id", "id % 3 AS cluster")
    found = minhash._piecewise(members, "cluster", lambda table, left, right: [(left[0], right[0])])
    text = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(cluster#\d+L, p#\d+, q#\d+", text)
