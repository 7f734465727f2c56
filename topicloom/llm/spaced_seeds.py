"""Benchmark passages in texts, found by spaced seeds; SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.binding import computed
from topicloom.llm.store import written
from topicloom.operators.skew import frequent_keys, salted_join

#: Words of a window that is compared, and substituted words that it may hold.
WINDOW = 13
SUBSTITUTED = 2

# Places of a window that a mask reads; it ignores the others. Whatever two words of
# thirteen are substituted, one of these masks fits somewhere between them.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
SHORTEST = min(mask[-1] for mask in MASKS) + 1

FOUND = ("start", "matched", "aligned")

#: Seeds of the benchmark that every task may hold. Beyond, texts and seeds meet in a shuffle.
BROADCAST_SEEDS = 1_000_000


def _total(marks: Column) -> Column:
    return F.aggregate(marks, F.lit(0), lambda total, x: total + x)


def word_hashes(text: str) -> Column:
    """A hash of every word, a word being letters and digits in a row, in lower case."""
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda word: F.xxhash64(word))


def _seeds(rows: DataFrame, *kept: str) -> DataFrame:
    """``(seed, place)`` for every place of every mask in the array ``words``.

    Seeds are made inside the row; the words themselves go no further.
    """

    def hashes(place: Column) -> Column:
        # A place beyond the end gives null, and the hash leaves it out: what such a seed meets by
        # that is compared like any other hit.
        return F.array(
            *[
                F.xxhash64(F.lit(number), *[F.get("words", place + at) for at in mask])
                for number, mask in enumerate(MASKS)
            ]
        )

    places = F.sequence(F.lit(0), F.size("words") - SHORTEST)
    long_enough = rows.where(F.size("words") >= SHORTEST)
    placed = long_enough.select(*kept, F.posexplode(F.transform(places, hashes)).alias("place", "seeds"))
    return placed.select(*kept, "place", F.explode("seeds").alias("seed"))


def _whole(words: Column, place: Column, size: int) -> Column:
    """A hash of so many words in a row, for items that have no more."""
    return F.xxhash64(F.lit(-size), *[F.get(words, place + at) for at in range(size)])


def _short_hits(texts: DataFrame, short: DataFrame) -> DataFrame:
    """``(id, item, start, matched, aligned)`` of items of fewer than ``SHORTEST`` words.

    Such an item has no seed. It is hashed whole and met with the runs of as many words of each text, of the
    lengths that items have.
    """
    sizes = sorted(r[0] for r in short.select(F.size("words")).distinct().collect())
    whole = F.lit(None).cast("long")
    for size in sizes:
        whole = F.when(F.size("words") == size, _whole(F.col("words"), F.lit(0), size)).otherwise(whole)
    wanted = written(short.select(whole.alias("seed"), "item", F.size("words").alias("size")), "short_items")
    if not sizes or not wanted.take(1):
        return texts.where("false").select("id", F.lit(None).alias("item"), *[F.lit(0).alias(c) for c in FOUND])

    def runs(place: Column) -> Column:
        return F.array(
            *[F.when(place + size <= F.size("words"), _whole(F.col("words"), place, size)) for size in sizes]
        )

    held = texts.where(F.size("words") > 0)
    places = F.sequence(F.lit(0), F.size("words") - 1)
    placed = held.select("id", F.posexplode(F.transform(places, runs)).alias("place", "seeds"))
    probes = placed.select("id", "place", F.explode("seeds").alias("seed")).where("seed IS NOT NULL")
    # The first place of a run in a text is enough, and is found before anything is shuffled.
    hits = _met(probes, wanted, "place").groupBy("id", "item", "size").agg(F.min("place").alias("start"))
    size = F.col("size").cast("long")
    return hits.select("id", "item", F.col("start").cast("long").alias("start"), size.alias("matched"), size.alias("aligned"))


def _met(probes: DataFrame, seeds: DataFrame, spread_by: str) -> DataFrame:
    """Probes with the seeds they meet; few seeds are broadcast, frequent ones of many are salted."""
    if seeds.count() <= BROADCAST_SEEDS:
        return probes.join(F.broadcast(seeds), "seed")
    held = seeds.select("seed").distinct()
    found = written(salted_join(probes, held, "seed", spread_by, frequent_keys(probes, "seed")), "met")
    return salted_join(found, seeds, "seed", spread_by, frequent_keys(found, "seed"))


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Texts that hold passages of benchmark items: ``id``, ``item``, ``start``, ``matched``, ``aligned``.

    A text leaks an item if somewhere ``WINDOW`` words of the text agree with as many words of the
    item, in place, but for at most ``SUBSTITUTED`` of them. An item of fewer words must stand in the
    text as a whole and unchanged, however short it is. One row comes out per text and item: ``start`` is the
    first word of the text in such a window, ``matched`` and ``aligned`` how many words agree, and lie
    opposite each other, where most agree. A null text or item, or one without words, leaks nothing.
    Repeated rows and ids are looked at one by one and reported once; a null id is reported as null.
    Other columns are not read.

    Every place of every text gives a seed per mask, inside the scan; seeds of the benchmark are
    broadcast after a count, or else met in a shuffle with frequent seeds salted. Hits of one
    alignment become one, and only texts with hits are compared word by word, each with its own hits.
    Comparing takes time in proportion to the words that lie opposite each other.
    """
    items = computed(
        benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text")),
        "words",
        word_hashes("text"),
    ).select("item", "words")
    items = items.distinct()
    numbered = items.where(F.size("words") >= SHORTEST).withColumn("key", F.xxhash64("item", "words"))
    seeds = written(
        _seeds(numbered, "key").select("seed", "key", F.col("place").alias("item_place")), "seeds"
    )
    # A row is known by id and text: rows without an id, or with one that repeats, are told apart.
    texts = computed(
        docs.select(F.col(id).alias("id"), F.xxhash64(F.col(id), F.col(text)).alias("row"), F.col(text).alias("text")),
        "words",
        word_hashes("text"),
    ).select("id", "row", "words")
    shift = (F.col("place") - F.col("item_place")).alias("shift")
    hits = _met(_seeds(texts, "row"), seeds, "row").select("row", "key", shift)
    aligned = written(hits.distinct(), "hits")

    known = numbered.select("key", F.col("item"), F.col("words").alias("item_words"))
    pairs = aligned.join(known, "key").join(texts, "row")
    first = F.greatest(F.lit(0), -F.col("shift"))
    last = F.least(F.size("item_words"), F.size("words") - F.col("shift"))
    opposite = pairs.select(
        "id",
        "item",
        "shift",
        first.alias("first"),
        F.slice("item_words", first + 1, last - first).alias("item_part"),
        F.slice("words", first + F.col("shift") + 1, last - first).alias("part"),
        F.size("item_words").alias("item_size"),
    )
    agree = F.zip_with("part", "item_part", lambda x, y: (x == y).cast("int"))
    width = F.least(F.lit(WINDOW), F.col("item_size"))
    needed = F.when(F.col("item_size") < WINDOW, F.col("item_size")).otherwise(WINDOW - SUBSTITUTED)
    windows = F.filter(
        F.sequence(F.lit(0), F.size("agree") - width),
        lambda at: _total(F.slice("agree", at + 1, width)) >= needed,
    )
    # ``agree`` is made once: the windows read it at every place.
    marked = computed(opposite.select("id", "item", "shift", "first", "item_size", "part", "item_part"), "agree", agree)
    compared = (
        marked.where(F.size("agree") >= width)
        .withColumn("windows", windows)
        .where(F.size("windows") > 0)
        .select(
            "id",
            "item",
            (F.get("windows", F.lit(0)) + F.col("first") + F.col("shift")).cast("long").alias("start"),
            _total(F.col("agree")).cast("long").alias("matched"),
            F.size("agree").cast("long").alias("aligned"),
        )
    )
    short = items.where((F.size("words") > 0) & (F.size("words") < SHORTEST))
    compared = compared.unionByName(_short_hits(texts, short))
    return compared.groupBy(F.col("id").alias(id), F.col("item").alias(item)).agg(
        F.min("start").alias("start"),
        F.max("matched").alias("matched"),
        F.max_by("aligned", F.struct("matched", "aligned")).alias("aligned"),
    )
