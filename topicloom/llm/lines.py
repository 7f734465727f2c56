"""Lines of many documents, found by a sharded minimal perfect hash.

    texts -> (place, line hash) -> counts by hash -> shards of perfect hash, fingerprints and counts
    (place, line hash) -> its shard's arrays -> (place, hits) -> texts of the place

A line is known by 128 bits of BLAKE2b of its key, so that no input can be made to collide at will.
A shard holds three arrays: the bits of the perfect hash, one fingerprint of 64 bits and one count per
line. Lines below the threshold are never dropped and therefore not filed; the fingerprint tells them
from filed ones. What documents send to the shards is one entry per place and line, and a shard that
very many places ask is asked in slices, each with its own copy of the arrays.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.store import written
from topicloom.llm.words import mix

#: Documents that a line must stand in to be dropped.
LEAST = 10
#: Texts of a place, and bytes from which a text has a place of its own: 16 MB of text at most.
PLACE_TEXTS = 512
LONG_TEXT = 32_768
#: Lines filed in a shard, shards at most (a shard grows beyond that), entries that ask one copy of a shard.
SHARD_LINES = 500_000
SHARDS = 10_000
ASKED_AT_ONCE = 500_000
#: Bits per line on each level of the perfect hash.
SPREAD = 1.5

_ENTRIES = "place long, h1 long, h2 long, n long"
_ARRAYS = "shard long, bits binary, fingerprints binary, counts binary"
_HITS = "place long, h1 long, h2 long"


class PerfectHash:
    """A minimal perfect hash of 128-bit keys: ``n`` keys have the places 0 to ``n - 1``.

    On each level the keys left are spread over bits; a key alone on its bit stays there, the others
    go on to the next level. The place of a key is the number of bits set before its own.
    """

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @staticmethod
    def _bit(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
        turned = mix(h1 + mix(h2 + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1)))
        return (turned % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        """The hash of distinct keys."""
        sizes, parts = [], []
        while len(h1):
            size = -(-int(SPREAD * len(h1) + 1) // 64) * 64
            bit = cls._bit(h1, h2, len(sizes), size)
            held = np.bincount(bit, minlength=size)
            parts.append(np.packbits(held == 1, bitorder="little").view("<u8"))
            sizes.append(size)
            left = held[bit] > 1
            h1, h2 = h1[left], h2[left]
        return cls(sizes, np.concatenate([*parts, np.zeros(0, "<u8")]))

    def __call__(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Places of keys; a key that was not filed has any place, or -1."""
        found = np.full(len(h1), -1, np.int64)
        open_, first = np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes):
            bit = first + self._bit(h1[open_], h2[open_], level, size)
            word, shift = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            here = (word >> shift) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << shift) - np.uint64(1))
            place = self.before[bit >> 6] + np.bitwise_count(below)
            found[open_[here]] = place[here]
            open_, first = open_[~here], first + size
        return found

    def pack(self) -> bytes:
        head = np.array([len(self.sizes), *self.sizes], "<u8")
        return head.tobytes() + self.words.astype("<u8").tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> PerfectHash:
        values = np.frombuffer(raw, "<u8")
        levels = int(values[0])
        return cls([int(x) for x in values[1 : levels + 1]], values[levels + 1 :])


@dataclass(frozen=True)
class Shard:
    """Fingerprints and counts of filed lines, at the places that the perfect hash gives them."""

    places: PerfectHash
    fingerprints: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray) -> Shard:
        places = PerfectHash.of(h1, h2)
        order = np.argsort(places(h1, h2))
        # Counts take as many bytes as the largest of the shard needs.
        return cls(places, h2[order], counts[order].astype(np.min_scalar_type(int(counts.max(initial=0)))))

    def count(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Documents of each line, 0 for a line that is not filed."""
        if not len(self.counts):
            return np.zeros(len(h1), np.int64)
        place = self.places(h1, h2)
        known = (place >= 0) & (self.fingerprints[place] == h2)
        return np.where(known, self.counts[place].astype(np.int64), 0)

    def pack(self) -> tuple[bytes, bytes, bytes]:
        counts = self.counts.astype(self.counts.dtype.newbyteorder("<"))
        head = bytes([counts.dtype.itemsize])
        return self.places.pack(), self.fingerprints.astype("<u8").tobytes(), head + counts.tobytes()

    @classmethod
    def unpack(cls, bits: bytes, fingerprints: bytes, counts: bytes) -> Shard:
        return cls(
            PerfectHash.unpack(bits),
            np.frombuffer(fingerprints, "<u8"),
            np.frombuffer(counts[1:], f"<u{counts[0]}"),
        )


def line_digests(text: bytes) -> tuple[list[bytes], list[bytes | None]]:
    """Lines of a text, and of each line the digest of its key; a blank line has none."""
    lines = text.split(b"\n")
    # Bytes strip exactly U+0020 and U+0009 to U+000D, and lower exactly A-Z.
    keys = [line.strip().lower() for line in lines]
    return lines, [hashlib.blake2b(k, digest_size=16).digest() if k else None for k in keys]


def _texts(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``(place, id, text)``, written once so that places stay what they are."""
    row = F.monotonically_increasing_id()
    place = F.when(F.octet_length(F.col(text)) > LONG_TEXT, -1 - row).otherwise(F.floor(row / PLACE_TEXTS))
    return written(
        docs.select(place.cast("long").alias("place"), F.col(id).alias("id"), F.col(text).alias("text")),
        "line_texts",
    )


def _entries(texts: DataFrame) -> DataFrame:
    """``(place, h1, h2, n)``: lines that are not blank and how many texts of the batch and place hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: Counter[tuple[int, bytes]] = Counter()
            for place, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                where = place.as_py()
                held.update((where, d) for d in set(line_digests(text.as_py() or b"")[1]) if d)
            halves = np.frombuffer(b"".join(d for _, d in held), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p for p, _ in held], pa.int64()),
                    pa.array(halves[:, 0]),
                    pa.array(halves[:, 1]),
                    pa.array(list(held.values()), pa.int64()),
                ],
                names=["place", "h1", "h2", "n"],
            )

    return texts.select("place", "text").mapInArrow(run, _ENTRIES)


def _shard(shards: int) -> Column:
    return F.pmod(F.col("h1"), F.lit(shards)).alias("shard")


def _unsigned(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy().view(np.uint64) for n in names]


def index_lines(counted: DataFrame, shards: int) -> DataFrame:
    """``(shard, bits, fingerprints, counts)`` of lines ``(h1, h2, n)``, each line once."""

    def run(table: pa.Table) -> pa.Table:
        h1, h2 = _unsigned(table, "h1", "h2")
        packed = Shard.of(h1, h2, table.column("n").to_numpy()).pack()
        columns = [pa.array([table.column("shard")[0].as_py()], pa.int64())]
        columns += [pa.array([raw], pa.binary()) for raw in packed]
        return pa.table(columns, names=["shard", "bits", "fingerprints", "counts"])

    return counted.select(_shard(shards), "h1", "h2", "n").groupBy("shard").applyInArrow(run, _ARRAYS)


def _asked(entries: DataFrame, index: DataFrame, shards: int, least: int) -> DataFrame:
    """``(place, h1, h2)``: the lines of each place that their shards count often enough."""
    asked = entries.select("place", "h1", "h2", _shard(shards))
    # One row per shard, at most SHARDS.
    sizes = asked.groupBy("shard").agg(F.ceil(F.count("*") / ASKED_AT_ONCE).cast("int").alias("slices"))
    sizes = written(sizes, "line_slices")
    dealt = asked.join(F.broadcast(sizes), "shard").withColumn(
        "slice", F.pmod(F.xxhash64("place"), F.col("slices")).cast("int")
    )
    copies = index.join(F.broadcast(sizes), "shard").withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = np.zeros(len(left), bool)
        if len(left) and len(right):
            shard = Shard.unpack(*[right.column(n)[0].as_py() for n in ("bits", "fingerprints", "counts")])
            found = shard.count(*_unsigned(left, "h1", "h2")) >= least
        return left.select(["place", "h1", "h2"]).filter(pa.array(found))

    return (
        dealt.select("shard", "slice", "place", "h1", "h2")
        .groupBy("shard", "slice")
        .cogroup(copies.select("shard", "slice", "bits", "fingerprints", "counts").groupBy("shard", "slice"))
        .applyInArrow(run, _HITS)
    )


def drop_frequent_lines(
    docs: DataFrame, least: int = LEAST, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    r"""``id, n_lines, n_dropped, kept`` of every row, less the lines that many documents share.

    A text is split at ``\n``. A line's key is the line without U+0020 and U+0009 to U+000D at both
    ends, with A-Z lowered. Lines whose key is not empty and stands in at least ``least`` rows go from
    every row; a line that a row holds twice counts once. The others stay as they are, joined by
    ``\n`` in ``kept``; ``n_lines`` counts the lines before. A null or empty text is one empty line and
    stays. Each row is a document of its own, whatever its id: repeated and null ids do no harm. Other
    columns are not read. ``least`` below 1 is 1.
    """
    least = max(1, least)
    texts = _texts(docs, id, text)
    entries = written(_entries(texts), "line_entries")
    counted = entries.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    counted = written(counted, "frequent_lines")
    shards = min(SHARDS, 1 + counted.count() // SHARD_LINES)
    index = written(index_lines(counted, shards), "line_index")
    hits = _asked(entries, index, shards, least)
    kind = texts.schema["id"].dataType

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        halves = np.stack([right.column(n).to_numpy() for n in ("h1", "h2")], axis=1)
        raw = np.ascontiguousarray(halves).astype("<i8").tobytes()
        gone = {raw[i : i + 16] for i in range(0, len(raw), 16)}
        sizes, dropped, kept = [], [], []
        for value in left.column("text").cast(pa.binary()):
            lines, digests = line_digests(value.as_py() or b"")
            stay = [line for line, d in zip(lines, digests, strict=True) if d not in gone]
            sizes.append(len(lines))
            dropped.append(len(lines) - len(stay))
            kept.append(b"\n".join(stay))
        return pa.table(
            [
                left.column("id"),
                pa.array(sizes, pa.int64()),
                pa.array(dropped, pa.int64()),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ],
            names=["id", "n_lines", "n_dropped", "kept"],
        )

    return (
        texts.groupBy("place")
        .cogroup(hits.groupBy("place"))
        .applyInArrow(run, f"id {kind.simpleString()}, n_lines long, n_dropped long, kept string")
        .withColumnRenamed("id", id)
    )
