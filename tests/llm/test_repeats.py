"""Repeated words and bytes, and what carries them."""

import random
import tracemalloc

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from topicloom.llm import packed, substring, suffixes, words

SCHEMA = "doc_id long, text string, id long, place int, block string, kept string, n_words long, row string"


def frame(spark, rows):
    """Texts beside columns whose names the operators use themselves."""
    return spark.createDataFrame(
        [(i, t, 5, 1, "x", "y", 7, "z") for i, t in rows], SCHEMA
    ).repartition(3)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["ä", "Wort", "the", "of", "a", "ß.", "x y", "Ünder", "in,", "　"]
    passage = [rng.choice(vocabulary) + str(rng.randrange(50)) for _ in range(60)]
    texts = []
    for _ in range(60):
        text = [rng.choice(vocabulary) + str(rng.randrange(40)) for _ in range(rng.randrange(120))]
        cut = rng.randrange(60)
        text += passage[cut : cut + rng.randrange(40)]
        texts.append(rng.choice([" ", "\n", "  \t"]).join(text))
    texts += [texts[3], texts[3], texts[5] + " more", None, "", " ", "\n\n", "a " * 200, "a " * 300, "b" * 5000]
    texts += ["b" * 99, "b" * 100, "b" * 101, "same words here " * 30, texts[7] * 3]
    ids = rng.sample(range(-1000, 1000), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("seed", [1, 2])
def test_words(spark, seed):
    rows = corpus(seed) + [(None, "c d e f g h i j k l m n o p"), (None, None)]
    rows += [(r[0], r[1]) for r in rows[:3]]  # repeated rows
    got = substring.remove_repeats(frame(spark, rows))
    found = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(brute.repeated_words(rows), key=repr)


def test_spans_are_the_removed_words(spark):
    rows = corpus(4)
    for r in substring.remove_repeats(frame(spark, rows)).collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        ends = [s.end for s in r.spans]
        assert all(s.start > e for s, e in zip(r.spans[1:], ends, strict=False))


def test_rows_are_carried(spark):
    got = substring.remove_repeats(frame(spark, corpus(5)), keep=["row", "block"])
    assert {(r.row.row, r.row.block) for r in got.collect()} == {("z", "x")}
    assert sorted(r.text or "" for r in got.collect()) == sorted(t or "" for _, t in corpus(5))


@pytest.mark.parametrize("seed", [1, 3])
def test_bytes(spark, seed):
    rows = corpus(seed) + [(None, "q" * 300), (None, None)]
    got = suffixes.remove_repeated_bytes(frame(spark, rows))
    found = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(brute.repeated_bytes(rows), key=repr)


def test_long_texts_are_cut_into_segments(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SLICE_BYTES", 257)
    monkeypatch.setattr(words, "SLICE_BYTES", 100)
    rows = corpus(6)
    data = b"".join((t or "").encode() for _, t in rows)
    offsets = np.cumsum([0, *(len((t or "").encode()) for _, t in rows)])
    runs = suffixes.find_runs(np.frombuffer(data, np.uint8), offsets, 100, 32)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(runs.first, runs.last, strict=True)])
    valid = [p for a, b in zip(offsets, offsets[1:], strict=False) for p in range(a, b - 99)]
    assert covered.tolist() == valid
    split = words.Words(np.frombuffer(data, np.uint8), offsets)
    monkeypatch.setattr(words, "SLICE_BYTES", 1 << 20)
    assert (split.hashes() == words.Words(np.frombuffer(data, np.uint8), offsets).hashes()).all()


def test_repeated_ids_do_not_lose_words(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (1, "other"), (2, text)]
    got = sorted((r.doc_id, r.n_removed) for r in substring.remove_repeats(frame(spark, rows)).collect())
    assert got == [(1, 0), (1, 0), (1, 0), (2, 40)]
    got = suffixes.remove_repeated_bytes(frame(spark, rows)).select("doc_id", "n_removed").collect()
    assert sorted(map(tuple, got)) == [(1, 0), (1, 0), (1, 0), (2, len(text))]


def test_empty_tables(spark):
    none = frame(spark, [(1, "a")]).where("doc_id > 1")
    assert substring.remove_repeats(none).collect() == []
    assert suffixes.remove_repeated_bytes(none).collect() == []


def test_packing():
    rng = np.random.default_rng(0)
    for size in (0, 1, 1000):
        keys = np.sort(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
        e = packed.Entries.of(
            keys, rng.integers(-(1 << 62), 1 << 62, size), rng.random(size) < 0.5, keys + np.uint64(1)
        )
        back = packed.unpack(packed.pack(e))
        for a, b in ((e.keys, back.keys), (e.docs, back.docs), (e.values, back.values), (e.marks, back.marks)):
            assert (a == b).all()


def test_places_are_those_of_spark(spark):
    df = spark.createDataFrame([(x,) for x in [0, -1, 5, 1 << 62, -(1 << 63), 12345]], "id long")
    found = df.select("id", F.pmod(F.xxhash64("id"), F.lit(17)).alias("p")).collect()
    mine = packed.place_of(np.array([r.id for r in found]), 17)
    assert mine.tolist() == [r.p for r in found]


def peak_of(work):
    """Bytes held at most while ``work`` runs, and what it returns."""
    tracemalloc.start()
    try:
        result = work()
        return tracemalloc.get_traced_memory()[1], result
    finally:
        tracemalloc.stop()


def some_entries(size, seed=0):
    rng = np.random.default_rng(seed)
    keys = rng.integers(0, 1 << 20, size).astype(np.uint64) << np.uint64(44)
    return packed.Entries.of(keys, rng.integers(0, 1000, size), rng.random(size) < 0.2)


def test_a_sender_holds_few_copies_of_its_entries():
    size = 1 << 18
    layout = packed.Layout(16, 4, 50)
    # Each entry takes 25 bytes, which are made while memory is watched.
    peak, blocks = peak_of(lambda: list(packed.blocks_of(layout, some_entries(size))))
    assert peak < 3 * 25 * size
    back = packed.Entries.joined([packed.unpack(b) for _, b in blocks])
    pairs = {}
    all_entries = some_entries(size)
    for key, doc, mark in zip(
        layout.shorten(all_entries.keys).tolist(), all_entries.docs.tolist(), all_entries.marks.tolist(), strict=True
    ):
        pairs[key, doc] = pairs.get((key, doc), False) or mark
    assert set(zip(back.keys.tolist(), back.docs.tolist(), strict=True)) == set(pairs)
    # Neighbouring entries of one key and text became one, marked where any of them was.
    marked = set(zip(back.keys[back.marks].tolist(), back.docs[back.marks].tolist(), strict=True))
    assert marked == {pair for pair, mark in pairs.items() if mark}


@pytest.mark.parametrize("choose", [packed.shared_keys, packed.later_keys])
def test_a_bucket_holds_few_copies_of_its_entries(choose):
    parts = [some_entries(1 << 15, seed) for seed in range(16)]
    blocks = pa.chunked_array([[packed.pack(p[np.argsort(p.keys, kind="stable")]) for p in parts]], pa.binary())
    peak, found = peak_of(lambda: packed.chosen(blocks, choose))
    assert peak < 2.8 * 25 * (16 << 15)
    e = packed.Entries.joined(parts)
    wanted = choose(e[np.argsort(e.keys, kind="stable")])
    assert len(found) and sorted(zip(found.keys.tolist(), found.docs.tolist(), strict=True)) == sorted(
        zip(wanted.keys.tolist(), wanted.docs.tolist(), strict=True)
    )


def test_words_are_hashed_in_small_pieces():
    data = np.frombuffer(b"some words of a text " * 40_000, np.uint8)
    split = words.Words(data, np.array([0, len(data)]))
    split.hashes()  # the table of multipliers stays
    peak, _ = peak_of(split.hashes)
    assert peak < 16 * len(data)
