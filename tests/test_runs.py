import pytest
from conftest import rows
from pyspark.sql import functions as F

from topicloom.operators import runs
from topicloom.operators.conversations import histories
from topicloom.operators.content import content, group_captions
from topicloom.operators.skew import WHOLE, Slices, find_slices, frequent_keys, salted_join


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with most rows, with runs that cross any cut and long stretches of nulls."""
    hot = [("hot", i, "a" if i // 37 % 2 else None if i // 50 % 3 else "b") for i in range(1000)]
    cold = [(f"k{i % 40}", i, "xyz"[i // 40 % 3]) for i in range(400)]
    return spark.createDataFrame(hot + cold, "key string, at int, v string").cache()


@pytest.fixture(scope="module")
def slices(skewed):
    found = find_slices(skewed, "key", "at", rows=50, parts=8)
    assert len(found.hot) == 1 and len(found.limits) == 7
    return found


def test_slices_balance(skewed, slices):
    sizes = skewed.where("key = 'hot'").groupBy(slices.column("key", "at")).count().collect()
    assert len(sizes) == 8
    assert max(r["count"] for r in sizes) <= 2 * 1000 / 8
    assert skewed.where("key <> 'hot'").where(slices.column("key", "at") != 0).count() == 0


def test_slices_by_time(spark):
    df = spark.range(500).select(
        F.lit(1).alias("key"), F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,0,id)").alias("ts")
    )
    found = find_slices(df, "key", "ts", rows=10, parts=4)
    assert found.timed
    assert df.groupBy(found.column("key", "ts")).count().count() == 4


def test_no_slices_without_frequent_keys(skewed):
    assert find_slices(skewed, "key", "at") == WHOLE


def test_run_id_with_slices(skewed, slices):
    plain = runs.run_id(skewed, "key", "at", "v", slices=WHOLE)
    cut = runs.run_id(skewed, "key", "at", "v", slices=slices)
    assert rows(cut) == rows(plain)
    first = plain.where("at = 0 and key = 'hot'").first()
    assert first.run == 0


def test_null_equals_null(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, None, "a", "a", None])], "k int, at int, v string")
    found = runs.run_id(df, "k", "at", "v")
    assert [r.run for r in found.orderBy("at").collect()] == [0, 0, 1, 1, 2]


def test_collapse_runs_with_slices(skewed, slices):
    df = skewed.withColumn("start", F.col("at") * 1.0).withColumn("end", F.col("at") + 1.5)
    plain = runs.collapse_runs(df, "key", "at", "v", slices=WHOLE)
    assert rows(runs.collapse_runs(df, "key", "at", "v", slices=slices)) == rows(plain)


@pytest.mark.parametrize("backward", [False, True])
def test_fill_with_slices(skewed, slices, backward):
    plain = runs.forward_fill(skewed, "key", "at", "v", "f", backward, slices=WHOLE)
    cut = runs.forward_fill(skewed, "key", "at", "v", "f", backward, slices=slices)
    assert rows(cut) == rows(plain)


def test_fill_across_empty_slices(spark):
    values = ["a"] + [None] * 98 + ["b"]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, at int, v string")
    cut = find_slices(df, "k", "at", rows=5, parts=10)
    forward = runs.forward_fill(df, "k", "at", "v", "f", slices=cut)
    assert [r.f for r in forward.orderBy("at").collect()] == ["a"] * 99 + ["b"]
    backward = runs.forward_fill(df, "k", "at", "v", "f", backward=True, slices=cut)
    assert [r.f for r in backward.orderBy("at").collect()] == ["a"] + ["b"] * 99


def test_leading_nulls_stay(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, "a"), (1, 2, None)], "k int, at int, v string")
    assert [r.v for r in runs.forward_fill(df, "k", "at", "v").orderBy("at").collect()] == [None, "a", "a"]


def test_content_with_slices(skewed, slices):
    plain = content(skewed, "key", "at", "v", first_seen="s", slices=WHOLE)
    assert rows(content(skewed, "key", "at", "v", first_seen="s", slices=slices)) == rows(plain)


def test_histories_with_slices(skewed, slices):
    turns = skewed.withColumn("role", F.lit("user"))
    plain = histories(turns, "key", "at", text="v", slices=WHOLE)
    cut = histories(turns, "key", "at", text="v", slices=slices)
    assert rows(cut) == rows(plain)


def test_salted_join(skewed):
    dim = skewed.select("key").distinct().withColumn("n", F.length("key"))
    hot = frequent_keys(skewed, "key", rows=50)
    assert len(hot) == 1
    assert rows(salted_join(skewed, dim, "key", "at", hot)) == rows(skewed.join(dim, "key"))
    partitions = salted_join(skewed, dim, "key", "at", hot)
    assert partitions.count() == skewed.count()


def test_rolling_captions(spark):
    cues = [
        (1, 0, 0.0, 2.0, "first line"),
        (1, 1, 2.0, 4.5, "first line\nsecond line"),
        (1, 2, 4.5, 7.0, "second line\nthird line"),
        (2, 0, 1.0, 2.0, "first line"),
        (2, 1, 2.0, 3.0, "\n other "),
        (2, 2, 3.0, 4.0, "first line"),
    ]
    df = spark.createDataFrame(cues, "video_id int, cue_ix int, start double, end double, text string")
    assert rows(runs.clean_captions(df), "video_id", "run", "start", "end", "text") == [
        (1, 0, 0.0, 4.5, "first line"),
        (1, 1, 2.0, 7.0, "second line"),
        (1, 2, 4.5, 7.0, "third line"),
        (2, 0, 1.0, 2.0, "first line"),
        (2, 1, 2.0, 3.0, ""),
        (2, 2, 2.0, 3.0, " other "),
        (2, 3, 3.0, 4.0, "first line"),
    ]


def test_groups_that_do_not_follow_each_other(spark):
    data = [(1, 0, "intro", "a"), (1, 1, "main", "b"), (1, 2, "intro", "c"), (1, 3, None, "d")]
    df = spark.createDataFrame(data, "video_id int, run int, chapters string, text string")
    found = group_captions(df, "chapters").orderBy("first_seen")
    assert [(r.chapters, r.content) for r in found.collect()] == [("intro", "a c"), ("main", "b"), (None, "d")]


def test_split_lines_keeps_empty_parts(spark):
    df = spark.createDataFrame([("a.b..",)], "t string")
    found = runs.split_lines(df, "t", ".")
    assert [r.sentences for r in found.orderBy("line_ix").collect()] == ["a", "b", "", ""]
    assert runs.split_lines(df, "t", ".", explode=False).first().sentences == ["a", "b", "", ""]


def test_slice_search_is_exact(spark):
    limits = tuple(float(x) for x in (3, 7, 7.5, 20))
    df = spark.range(30).withColumn("k", F.lit(1))
    hot = df.select(F.xxhash64("k")).first()[0]
    found = df.select("id", Slices((hot,), limits).column("k", "id").alias("s")).collect()
    assert all(r.s == 1 + sum(x <= r.id for x in limits) for r in found)


def test_more_frequent_keys_than_partitions(spark):
    df = spark.range(4000).select((F.col("id") % 40).alias("k"), "id")
    assert len(frequent_keys(df, "k", rows=50)) == 40
