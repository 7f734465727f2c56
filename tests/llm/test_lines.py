"""Dropping the lines that many documents share, against plain Python."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.llm import lines

SCHEMA = "doc_id long, text string, place string, n long, kept int"


def key(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(
        {c: c + 32 for c in range(65, 91)}
    )


def brute(rows, least):
    split = [(i, (t or "").split("\n")) for i, t in rows]
    held = Counter(k for _, found in split for k in {key(x) for x in found} if k)
    result = []
    for i, found in split:
        stay = [x for x in found if held[key(x)] < least]
        result.append((i, len(found), len(found) - len(stay), "\n".join(stay)))
    return sorted(result, key=repr)


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "p", 1, 2) for i, t in rows], SCHEMA).repartition(parts)


ODD = [
    (1, "Home\n\nfirst text\nHOME \n"), (2, "\thome\r\nsecond\ntext\n"), (3, " home \nthird"), (4, None), (5, ""),
    (6, "\n"), (None, "home\nno id"), (None, "home\nno id"), (7, "home"), (7, "home"), (8, "Ärger\nhome"),
    (9, "ärger\nx"), (10, "home\n" + "unique words " * 20_000 + "\nhome"), (11, " \t\n \n"), (12, "a" * 200_000),
]


@pytest.mark.parametrize("least", [1, 2, 3, 9, 10])
def test_odd_rows(spark, least):
    found = lines.drop_frequent_lines(table(spark, ODD), least)
    assert found.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(ODD, least)


def test_empty_table(spark):
    assert lines.drop_frequent_lines(table(spark, ODD).where("doc_id > 99")).collect() == []


def test_a_line_in_every_text_and_many_shards(spark, monkeypatch):
    rows = [(i, f"menu\nline {i % 50}\nown {i}\nfooter {i % 3}\n{'long ' * (i % 7) * 2000}") for i in range(1500)]
    for name, value in {"SHARD_LINES": 7, "SHARDS": 5, "ASKED_AT_ONCE": 40, "PLACE_TEXTS": 20}.items():
        monkeypatch.setattr(lines, name, value)
    found = lines.drop_frequent_lines(table(spark, rows))
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, 10)


def test_a_busy_shard_is_asked_in_slices(spark, monkeypatch):
    monkeypatch.setattr(lines, "ASKED_AT_ONCE", 10)
    entries = spark.range(400).select(F.col("id").alias("place"), *[F.lit(v).cast("long").alias(h) for h, v in (("h1", 5), ("h2", 6))])
    index = lines.index_lines(spark.createDataFrame([(5, 6, 400)], "h1 long, h2 long, n long"), 1)
    found = lines._asked(entries.withColumn("n", F.lit(1)), index, 1, 10)
    assert sorted(r.place for r in found.collect()) == list(range(400))
    text = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(shard#\d+L?, slice#\d+", text)


@pytest.mark.parametrize("size", [0, 1, 2, 63, 1000, 50_000])
def test_perfect_hash(size):
    noise = np.random.default_rng(size)
    h1, h2 = noise.integers(0, 1 << 64, (2, size), np.uint64)
    h1[: size // 2] = 7  # equal halves are parted by the other half
    counts = noise.integers(1, 1 << 20, size)
    shard = lines.Shard.unpack(*lines.Shard.of(h1, h2, counts).pack())
    assert sorted(shard.places(h1, h2).tolist()) == list(range(size))
    assert (shard.count(h1, h2) == counts).all()
    assert (shard.count(h1, h2 + np.uint64(1)) == 0).all()
    assert 8 * shard.places.words.nbytes <= 6 * size + 1000
