import random
from functools import partial

import pytest
from conftest import rows
from pyspark.sql import functions as F

from topicloom.functions.intervals import literal_intervals
from topicloom.operators.content import chapters_content
from topicloom.operators import intervals as intervals_module
from topicloom.operators import skew
from topicloom.operators.intervals import augment_captions, interval_label, interval_table_label

CHAPTERS = [(0.0, 5.0, "one"), (3.0, 10.0, "two"), (12.0, 20.0, "one")]


@pytest.fixture(scope="module")
def captions(spark):
    spans = [(-2, -1), (0, 2), (3, 4), (4, 6), (9, 11), (12, 13), (19, 21), (21, 22)]
    data = [(v, i, float(a), float(b), f"t{i}") for v in (1, 2, 3) for i, (a, b) in enumerate(spans)]
    return spark.createDataFrame(data, "video_id int, run int, start double, end double, text string")


@pytest.fixture(scope="module")
def info(spark):
    heat = [(0.0, 3.0, 0.5), (3.0, 6.0, None)]
    data = [(1, CHAPTERS, heat), (2, [], []), (3, None, None)]
    kind = "array<struct<start_time:double,end_time:double,"
    return spark.createDataFrame(data, f"video_id int, chapters {kind}title:string>>, heatmap {kind}value:double>>")


def test_augment(captions, info):
    found = augment_captions(captions, info).orderBy("run")
    one = found.where("video_id = 1").collect()
    # Before the first chapter: null. First in the list wins. A straddler keeps the one before it.
    assert [r.chapters for r in one] == [None, "one", "one", "two", "two", "one", "one", "one"]
    # Outside all heat spans 0, a null heat value takes the one before it.
    assert [r.heatmap for r in one] == [0.0, 0.5, 0.5, 0.5, 0.0, 0.0, 0.0, 0.0]
    rest = found.where("video_id > 1")
    assert rest.where("chapters is not null or heatmap <> 0").count() == 0
    assert rest.count() == 16


def test_chapter_text(captions, info):
    found = chapters_content(augment_captions(captions, info)).where("video_id = 1")
    assert rows(found, "chapters", "content") == [
        ("one", "t1 t2 t5 t6 t7"), ("two", "t3 t4"), (None, "t0"),
    ]


def test_existing_column(captions):
    intervals = literal_intervals([], "title")
    with pytest.raises(ValueError):
        interval_label(captions, intervals, "text", "title")
    found = interval_label(captions, intervals, "text", "title", override=True)
    assert found.where("text is not null").count() == 0


def test_default_is_a_literal(captions):
    intervals = literal_intervals([{"start_time": 0, "end_time": 2, "title": "x"}], "title")
    found = interval_label(captions, intervals, "c", "title", default="text")
    assert {r.c for r in found.select("c").distinct().collect()} == {"x", "text"}


def test_table_equals_brute_force(spark):
    rng = random.Random(3)
    spans = [(k, i, rng.uniform(0, 100), rng.choice([0.0, 0.5, 3.0])) for k in range(3) for i in range(150)]
    spans += [(7, 0, 1.0, 1.0)]
    intervals = [
        (k, p, rng.uniform(-5, 100), rng.choice([0.0, 0.25, 1.0, 4.0, 64.0, 70.0]), None if p == 4 else f"v{p}")
        for k in range(3) for p in range(60)
    ]
    intervals += [(0, 60, spans[0][2], 0.0, "point")] + [(1, 61 + i, 10.0, 50.0, "copy") for i in range(20)]
    rows_df = spark.createDataFrame([(k, i, s, s + d) for k, i, s, d in spans], "k int, id int, start double, end double")
    iv_df = spark.createDataFrame(
        [(k, p, s, s + d, v) for k, p, s, d, v in intervals],
        "k int, p int, start_time double, end_time double, v string",
    )
    for default in (None, "none"):
        expected = []
        for k, i, s, d in spans:
            hits = [(p, v) for kk, p, a, w, v in intervals if kk == k and s >= a and s + d <= a + w]
            expected.append((k, i, min(hits, key=lambda h: h[0])[1] if hits else default))
        found = interval_table_label(rows_df, iv_df, "k", "id", "c", "v", "p", default=default)
        assert rows(found, "k", "id", "c") == sorted(expected, key=repr)
        assert found.columns == ["k", "id", "start", "end", "c"]


def test_table_without_intervals(spark, captions):
    empty = spark.createDataFrame([], "video_id int, p int, start_time double, end_time double, v string")
    found = interval_table_label(captions, empty, "video_id", "run", "c", "v", "p", default="d")
    assert found.where(F.col("c") == "d").count() == captions.count()


def label_brute(spans, intervals):
    return sorted(
        (i, min(((p, v) for p, a, b, v in intervals if a <= s and e <= b), default=(0, None))[1]) for i, s, e in spans
    )


SPAN = "k int, id int, start double, end double"
INTERVAL = "k int, p int, start_time double, end_time double, v string"


@pytest.mark.parametrize("rows_per_task", [1_000_000, 40], ids=["plain", "sliced"])
@pytest.mark.parametrize("shape", ["random", "nested", "growing", "equal ends"])
def test_busy_keys_in_slices(spark, monkeypatch, rows_per_task, shape):
    monkeypatch.setattr(intervals_module, "find_slices", partial(skew.find_slices, rows=rows_per_task))
    rng = random.Random(shape)
    n = 200
    ends = {
        "random": lambda i: sorted(rng.uniform(0, 50) for _ in range(2)),
        "nested": lambda i: (50 - i / 10, 50 + i / 10),  # later ones hold all earlier ones
        "growing": lambda i: (i / 10, 60 - i / 10),  # earlier ones hold all later ones
        "equal ends": lambda i: (float(rng.randrange(5)), float(40 + rng.randrange(5))),
    }[shape]
    held = [(p, *map(float, ends(p)), f"v{p}") for p in range(n)]
    spans = [(i, s, s + rng.choice([0.0, 0.5, 5.0])) for i, s in enumerate(rng.uniform(0, 60) for _ in range(300))]
    rows_df = spark.createDataFrame([(1, *s) for s in spans] + [(2, 0, 1.0, 2.0)], SPAN)
    iv_df = spark.createDataFrame([(1, *i) for i in held] + [(2, 0, 0.0, 9.0, "other")], INTERVAL)
    found = interval_table_label(rows_df, iv_df, "k", "id", "c", "v", "p")
    assert rows(found.where("k = 1"), "id", "c") == sorted(label_brute(spans, held), key=repr)
    assert rows(found.where("k = 2"), "c") == [("other",)]


def test_rows_without_key_or_ends(spark):
    rows_df = spark.createDataFrame(
        [(None, 1, 1.0, 2.0), (1, 2, None, 2.0), (1, 3, 1.0, None), (1, 4, 1.0, 2.0), (1, 5, 9.0, 1.0)], SPAN
    )
    iv_df = spark.createDataFrame([(None, 0, 0.0, 9.0, "null"), (1, 0, 0.0, 9.0, "x"), (1, 1, 5.0, 2.0, "no")], INTERVAL)
    found = interval_table_label(rows_df, iv_df, "k", "id", "c", "v", "p", default="none")
    assert rows(found, "id", "c") == [(1, "none"), (2, "none"), (3, "none"), (4, "x"), (5, "x")]


def test_every_interval_holds_every_row_of_one_key(spark):
    """100,000 rows in the same 100,000 intervals: pairs would be 1e10."""
    n = 100_000
    iv_df = spark.range(n).selectExpr(
        "1 AS k", f"CAST({n} - id AS int) AS p", "CAST(id AS double) AS start_time",
        f"CAST({4 * n} - id AS double) AS end_time", "concat('v', id) AS v",
    )
    rows_df = spark.range(n).selectExpr(
        "1 AS k", "CAST(id AS int) AS id", f"CAST({n} + id AS double) AS start", f"CAST({n} + id AS double) AS end"
    )
    found = interval_table_label(rows_df, iv_df, "k", "id", "c", "v", "p")
    # Earlier positions are shorter: the one of position 1 starts last and ends first, and holds all.
    assert found.where(F.col("c") == f"v{n - 1}").count() == n
