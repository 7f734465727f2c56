"""Nearest neighbours, archives and benchmark passages."""

import math
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.llm import nearest, spaced_seeds, warc
from topicloom.session import scratch_path

VECTORS = "vec_id long, embedding array<double>, id int, v int, block int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], VECTORS)


def all_pairs(rows, k):
    found = {}
    for q, x in rows:
        if q % 100 == 0:
            near = sorted((math.dist(x, y), i) for i, y in rows if i != q)[:k]
            found[q] = [(n + 1, i, d) for n, (d, i) in enumerate(near)]
    return found


@pytest.mark.parametrize("spread", [1.0, 1e-6])
def test_like_all_pairs(spark, monkeypatch, spread):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 300)
    monkeypatch.setattr(nearest, "QUERY_ROWS", 4)
    rng = np.random.default_rng(5)
    points = 1000.0 + spread * rng.normal(size=(1200, 24))
    points[700:760] = points[100]  # ties
    rows = [(i, x.tolist()) for i, x in enumerate(points)]
    got = {}
    for r in nearest.nearest(vectors(spark, rows).repartition(3), F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = all_pairs(rows, 10)
    assert got.keys() == want.keys()
    hits = 0
    for q, near in want.items():
        hits += len({i for _, i, _ in near} & {i for _, i, _ in got[q]})
        for rank, i, score in got[q]:
            assert score == pytest.approx(math.dist(points[q], points[i]), rel=1e-12, abs=1e-15)
    assert hits >= 0.99 * 10 * len(want)


def test_odd_vectors(spark):
    good = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0])]
    bad = [(200, None), (300, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
           (7, []), (None, [1.0, 2.0])]
    got = nearest.nearest(vectors(spark, good + bad), F.col("vec_id") % 100 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [
        (0, 1, 3), (0, 2, 3), (0, 3, 100), (100, 1, 3), (100, 2, 3), (100, 3, 0)
    ]
    none = nearest.nearest(vectors(spark, bad), F.col("vec_id") % 100 == 0)
    assert none.collect() == [] and none.columns == ["query_id", "rank", "vec_id", "score"]


PAGES = "page_id long, url string, html string, id int, file string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "f", "d") for r in rows], PAGES)


ROWS = [
    (1, "http://www.Example.org/a?b#c", "x" * 1000), (2, "http://example.org/z", "x" * 1000),
    (3, "http://example.org/z", "x" * 999), (4, "http://example.org/z", "x" * 999), (5, None, None),
    (6, "", ""), (7, "not a url", "\r\n\r\nWARC/1.1\r\n\r\n" * 100), (8, "http://[bad", "é" * 700),
    (9, "http://example.org/z", "é" * 700), (None, "http://a.b/", "x" * 1000), (9, "http://example.org/z", "é" * 700),
]


def test_round_trip(spark):
    got = warc.round_trip(spark, pages(spark, ROWS).repartition(3)).collect()
    found = sorted(((r.id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=repr)
    want = [(1, 1000, "revisit", 2), (2, 1000, "response", None), (3, 999, "response", None),
            (4, 999, "response", None), (5, 0, "response", None), (6, 0, "response", None),
            (7, 1600, "response", None), (8, 1400, "revisit", 9), (9, 1400, "response", None),
            (None, 1000, "revisit", 2), (9, 1400, "response", None)]
    assert found == sorted(want, key=repr)


def test_lookup_finds_by_binary_search(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    rng = random.Random(2)
    rows = [(i, f"http://{rng.choice('abc')}.org/{rng.randrange(20)}", f"page {i}") for i in range(300)]
    rows += [(1000 + i, "http://hot.com/", "p") for i in range(200)]
    folder = scratch_path(spark, "warc-test")
    captures = warc.write_archives(pages(spark, rows).repartition(4), f"{folder}/a", archive_bytes=2000)
    index = warc.write_index(captures, f"{folder}/a", f"{folder}/i", files=5)
    assert 1 < len(index.files) <= 5
    asked = ["http://a.org/3", "https://A.org:443/3#x", "http://hot.com/", "http://zzz.org/", "", None]
    found = warc.lookup(spark.createDataFrame([(u,) for u in asked], "url string"), index)
    keys = {warc.url_key(u) for u in asked}
    want = sorted((warc.url_key(u), i) for i, u, _ in rows if warc.url_key(u) in keys)
    assert sorted((r.key, r.id) for r in found.collect()) == want
    payloads = {r.id: bytes(r.payload) for r in warc.read_records(found, f"{folder}/a").collect()}
    assert all(payloads[i] == p.encode() for i, u, p in rows if warc.url_key(u) in keys)


def test_damage_is_seen():
    raw = warc.record(1, "u", b"abc", "a9993e364706816aba3e25717850c26c9cd0d89d", None)
    assert warc.parse(raw)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"abc", b"abd"))


def test_keys():
    assert warc.url_key("http://user@WWW.example.org:80/a/b?c=d#e") == "org,example,www)/a/b?c=d"
    assert warc.url_key("https://example.org:8443") == "org,example:8443)/"
    assert [warc.url_key(u) for u in (None, "", "plain")] == ["", "", "plain"]


def test_empty_pages(spark):
    assert warc.round_trip(spark, pages(spark, ROWS).where("page_id > 99")).collect() == []


def passages():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)] + ["the", "of"] * 100
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 5, 7, 8, 12, 13, 20, 40])))) for i in range(30)]
    items += [(None, items[0][1]), (50, None), (51, ""), (52, items[1][1]), (5, items[5][1])]
    rows = []
    for k in range(150):
        text = [rng.choice(words) for _ in range(rng.randrange(60))]
        passage = items[rng.randrange(30)][1].upper().split()
        for _ in range(rng.randrange(5)):
            passage[rng.randrange(len(passage))] = "changed"
        if rng.random() < 0.3:
            passage = passage[rng.randrange(6) :]
        at = rng.randrange(len(text) + 1)
        rows.append((k, (rng.choice([" ", ", ", "\n"])).join(text[:at] + passage + text[at:])))
    return rows + [(500, None), (501, ""), (502, "w1"), (503, items[0][1]), (503, items[0][1])], items


@pytest.mark.parametrize("seeds", [10**6, 0], ids=["broadcast", "shuffle"])
def test_passages_like_all_places(spark, monkeypatch, seeds):
    monkeypatch.setattr(spaced_seeds, "BROADCAST_SEEDS", seeds)
    rows, items = passages()
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, words int, item int, place int")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, id int")
    found = spaced_seeds.find_passages(docs.repartition(3), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == brute.leaks(rows, items)
    assert len(found) == len({(r.doc_id, r.item_id) for r in found})
    assert all(0 < r.matched <= r.aligned for r in found)


def test_masks_miss_nothing():
    from itertools import combinations

    for changed in combinations(range(spaced_seeds.WINDOW), spaced_seeds.SUBSTITUTED):
        assert any(
            not {at + p for p in mask} & set(changed)
            for mask in spaced_seeds.MASKS
            for at in range(spaced_seeds.WINDOW - mask[-1])
        )


def test_passages_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert len(spaced_seeds.find_passages(docs, bench).collect()) == 1
    assert spaced_seeds.find_passages(docs, bench.where("item_id > 1")).collect() == []
    assert spaced_seeds.find_passages(docs.where("doc_id > 1"), bench).collect() == []


def test_passages_need_no_python(spark):
    rows, items = passages()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plan = spaced_seeds.find_passages(docs, spark.createDataFrame(items, "item_id long, text string"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop") if x in text]


def test_very_long_items_and_texts(spark):
    """The time of a comparison grows with its words: 20,000 of them are a matter of seconds."""
    words = [f"w{i}" for i in range(20_000)]
    changed = [w if i % 40 else "changed" for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, "before " + " ".join(changed)), (3, " ".join(words[5000:5013])), (4, "w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words)), (8, "w1 w2")], "item_id long, text string")
    found = spaced_seeds.find_passages(docs, bench)
    text = found._jdf.queryExecution().optimizedPlan().toString()
    # What agrees is made once; were it written into the windows, they would make it at every place.
    assert text.count("zip_with(") == 1
    got = {(r.doc_id, r.item_id): (r.start, r.matched, r.aligned) for r in found.collect()}
    assert got[1, 7] == (0, 20_000, 20_000) and got[2, 7] == (1, 19_500, 20_000)
    assert got[3, 7] == (0, 13, 13) and got[1, 8] == (1, 2, 2) and (4, 7) not in got and (4, 8) not in got


@pytest.mark.parametrize("seeds", [10**6, 0], ids=["broadcast", "shuffle"])
def test_rows_without_an_id_meet_their_own_hits_only(spark, monkeypatch, seeds):
    monkeypatch.setattr(spaced_seeds, "BROADCAST_SEEDS", seeds)
    passage = " ".join(f"p{i}" for i in range(15))
    rows = [(None, f"{passage} {i}") for i in range(300)] + [(None, "clean"), (5, passage), (5, "clean too")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, passage), (2, "p3 p4")], "item_id long, text string")
    found = spaced_seeds.find_passages(docs, bench).collect()
    assert sorted(((r.doc_id, r.item_id, r.start) for r in found), key=repr) == [
        (5, 1, 0), (5, 2, 3), (None, 1, 0), (None, 2, 3)
    ]
