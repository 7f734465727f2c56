"""Meeting equal keys of many texts at little cost.

Windows of a corpus are as many as its words or bytes. As rows they would weigh ten times the text.
Here a task sorts the keys of some megabytes of text and sends, per range of keys, one compressed
block of differences between neighbouring keys: a few bytes per key. Each range is then worked on
by itself, and what it finds goes back to the texts in blocks again.

    texts -> ``send`` -> (bucket, block) -> ``meet`` -> (place, block) -> ``receive`` with the texts

``place`` is a group of texts, chosen by the hash of the id. Buckets and places grow in number with
the corpus, so that neither outgrows a task. A key that very many texts share has one entry per
text in its bucket, and is never joined with itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.words import flat, give_back, mix, slices
from topicloom.operators.skew import partitions

#: Keys that a task sorts and sends together, keys of a bucket, bytes of text of a place.
KEYS_SENT = 1 << 20
KEYS_PER_BUCKET = 1 << 21
BYTES_PER_PLACE = 1 << 22

BLOCKS = "bucket int, block binary"
REPLIES = "place int, block binary"
BLOCK_SCHEMA = pa.schema([("bucket", pa.int32()), ("block", pa.binary())])
REPLY_SCHEMA = pa.schema([("place", pa.int32()), ("block", pa.binary())])

_MASK = (1 << 64) - 1


@dataclass(frozen=True)
class Entries:
    """Entries in a row: their keys, the ids of their texts, a value and a mark of each."""

    keys: np.ndarray
    docs: np.ndarray
    values: np.ndarray
    marks: np.ndarray

    @classmethod
    def of(cls, keys, docs, marks=None, values=None) -> Entries:
        """``docs`` as longs; without marks none is marked, without values they are 0."""
        size = len(keys)
        return cls(
            keys,
            docs.astype(np.int64, copy=False),
            np.zeros(size, np.uint64) if values is None else values,
            np.zeros(size, bool) if marks is None else marks,
        )

    @classmethod
    def joined(cls, parts: list[Entries]) -> Entries:
        if not parts:
            return cls.of(np.zeros(0, np.uint64), np.zeros(0, np.int64))
        columns = zip(*((p.keys, p.docs, p.values, p.marks) for p in parts), strict=True)
        return cls(*(np.concatenate(c) for c in columns))

    def __len__(self) -> int:
        return len(self.keys)

    def __getitem__(self, which) -> Entries:
        return Entries(self.keys[which], self.docs[which], self.values[which], self.marks[which])


def pack(entries: Entries) -> bytes:
    """One compressed block of entries, which is smallest in the order of the keys."""
    count = len(entries)
    planes = [np.array([count], "<u8").tobytes()]
    for column in (np.diff(entries.keys, prepend=np.uint64(0)), entries.docs, entries.values):
        planes.append(np.ascontiguousarray(column.view(np.uint8).reshape(-1, 8).T).tobytes())
    planes.append(np.packbits(entries.marks).tobytes())
    return zstandard.compress(b"".join(planes), 1)


def unpack(block: bytes) -> Entries:
    raw = np.frombuffer(zstandard.decompress(block), np.uint8)
    count = int(raw[:8].view("<u8")[0])
    columns = []
    for i in range(3):
        planes = raw[8 + 8 * count * i : 8 + 8 * count * (i + 1)].reshape(8, count)
        columns.append(np.ascontiguousarray(planes.T).view(np.uint64).ravel())
    marks = np.unpackbits(raw[8 + 24 * count :], count=count).astype(bool)
    return Entries(np.cumsum(columns[0], dtype=np.uint64), columns[1].view(np.int64), columns[2], marks)


def unpack_all(blocks: pa.ChunkedArray) -> Entries:
    return taken([unpack(b.as_py()) for b in blocks])


def taken(parts: list[Entries]) -> Entries:
    """The entries of all parts, which are let go column by column: ``parts`` is empty then."""
    if not parts:
        return Entries.joined(parts)
    columns = [list(c) for c in zip(*((p.keys, p.docs, p.values, p.marks) for p in parts), strict=True)]
    parts.clear()
    return Entries(*(_joined_column(c) for c in columns))


def _joined_column(pieces: list[np.ndarray]) -> np.ndarray:
    column = np.concatenate(pieces)
    pieces.clear()
    return column


@dataclass(frozen=True)
class Layout:
    """How many buckets and places there are, and how many bits of a key are sent."""

    buckets: int
    places: int
    bits: int = 64

    def shorten(self, keys: np.ndarray) -> np.ndarray:
        return keys >> np.uint64(64 - self.bits)

    def bucket(self, short: np.ndarray) -> np.ndarray:
        """Ranges of the shortened keys, in their order."""
        top = (short << np.uint64(64 - self.bits)) >> np.uint64(32)
        return ((top * np.uint64(self.buckets)) >> np.uint64(32)).astype(np.int64)


def text_bytes(docs: DataFrame, text: str) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0


def plan_layout(docs: DataFrame, size: int, keys: int, bits: int = 64) -> Layout:
    """Buckets and places for texts of ``size`` bytes with ``keys`` keys."""
    least = partitions(docs)
    return Layout(max(least, -(-keys // KEYS_PER_BUCKET)), max(least, -(-size // BYTES_PER_PLACE)), bits)


def _rotate(x: int, r: int) -> int:
    return ((x << r) | (x >> (64 - r))) & _MASK


def place_of(docs: np.ndarray, places: int) -> np.ndarray:
    """``pmod(xxhash64(id), places)`` as Spark computes it for a long."""
    p1, p2, p3 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
    p4, p5 = 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    u = np.uint64

    def turned(x, r):
        return (x << u(r)) | (x >> u(64 - r))

    value = docs.astype(np.int64).view(np.uint64)
    h = u((42 + p5 + 8) & _MASK) ^ (turned(value * u(p2), 31) * u(p1))
    h = turned(h, 27) * u(p1) + u(p4)
    h ^= h >> u(33)
    h *= u(p2)
    h ^= h >> u(29)
    h *= u(p3)
    h ^= h >> u(32)
    return np.mod(h.view(np.int64), places).astype(np.int32)


def blocks_of(layout: Layout, entries: Entries) -> Iterator[tuple[int, bytes]]:
    """Blocks by bucket. Entries of one key, text and value that come together become one."""
    if not len(entries):
        return
    # Columns that are done with are let go: a worker holds little more than the entries twice.
    short = layout.shorten(entries.keys)
    order = np.argsort(short, kind="stable")
    short, docs, values, marks = short[order], entries.docs[order], entries.values[order], entries.marks[order]
    del entries, order
    new = np.ones(len(short), bool)
    new[1:] = (short[1:] != short[:-1]) | (docs[1:] != docs[:-1]) | (values[1:] != values[:-1])
    at = np.flatnonzero(new)
    if len(at) < len(short):
        short, docs, values = short[at], docs[at], values[at]
        marks = np.logical_or.reduceat(marks, at)
    e = Entries(short, docs, values, marks)
    del new, short, docs, values, marks
    bucket = layout.bucket(e.keys)
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(at)]
    for begin, end in zip(cuts, cuts[1:], strict=False):
        yield int(bucket[begin]), pack(e[begin:end])


def block_rows(found: Iterator[tuple[int, bytes]], schema: pa.Schema) -> pa.RecordBatch:
    rows = list(found)
    columns = [[n for n, _ in rows], [x for _, x in rows]]
    arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


#: From bytes, offsets and ids of some texts to their entries.
Enter = Callable[[np.ndarray, np.ndarray, np.ndarray], Entries]


def send(docs: DataFrame, id: str, text: str, enter: Enter, layout: Layout) -> DataFrame:
    """``(bucket, block)`` of the entries of all texts that have an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[Entries] = []
        for batch in batches:
            data, offsets = flat(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for begin, end in slices(offsets):
                cut = offsets[begin : end + 1]
                parts.append(enter(data[cut[0] : cut[-1]], cut - cut[0], ids[begin:end]))
                if sum(map(len, parts)) >= KEYS_SENT:
                    yield block_rows(blocks_of(layout, taken(parts)), BLOCK_SCHEMA)
                    give_back()
        if parts:
            yield block_rows(blocks_of(layout, taken(parts)), BLOCK_SCHEMA)
        give_back()

    return (
        docs.where(F.col(id).isNotNull())
        .select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
        .mapInArrow(run, BLOCKS)
    )


#: From the entries of a bucket, in the order of their keys, to those that are sent back.
Choose = Callable[[Entries], Entries]


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return starts, np.diff(np.append(starts, len(keys)))


def shared_keys(e: Entries) -> Entries:
    """Entries of keys that a text holds marked and a later one holds at all, from the first on."""
    starts, sizes = _groups(e.keys)
    first = np.minimum.reduceat(np.where(e.marks, e.docs, np.iinfo(np.int64).max), starts)
    shared = np.repeat(first < np.maximum.reduceat(e.docs, starts), sizes)
    shared &= e.docs >= np.repeat(first, sizes)
    return e[shared]


def later_keys(e: Entries) -> Entries:
    """Entries of keys that a smaller id holds too."""
    starts, sizes = _groups(e.keys)
    return e[e.docs > np.repeat(np.minimum.reduceat(e.docs, starts), sizes)]


def repeated_keys(e: Entries) -> Entries:
    """Entries of keys that stand in several entries or are marked."""
    starts, sizes = _groups(e.keys)
    return e[np.repeat((sizes > 1) | np.logical_or.reduceat(e.marks, starts), sizes)]


def chosen(blocks: pa.ChunkedArray, choose: Choose) -> Entries:
    """What ``choose`` makes of the entries of a bucket; of these one copy is held meanwhile."""
    entries = unpack_all(blocks)
    if len(entries):
        entries = entries[np.argsort(entries.keys, kind="stable")]
        entries = choose(entries)
    return entries


def meet(blocks: DataFrame, choose: Choose, layout: Layout) -> DataFrame:
    """``(place, block)``: the entries that ``choose`` makes of each bucket, sent to their texts."""

    def run(table: pa.Table) -> pa.Table:
        entries = chosen(table.column("block"), choose)
        place = place_of(entries.docs, layout.places)
        order = np.argsort(place, kind="stable")
        place, entries = place[order], entries[order]
        cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)] if len(place) else []
        found = ((int(place[a]), pack(entries[a:b])) for a, b in zip(cuts, cuts[1:], strict=False))
        result = pa.Table.from_batches([block_rows(found, REPLY_SCHEMA)])
        give_back()
        return result

    return blocks.groupBy("bucket").applyInArrow(run, REPLIES)


def texts_by_place(
    docs: DataFrame, id: str, text: str, layout: Layout, keep: Sequence[str] | None = None
) -> DataFrame:
    """``(place, id, text)``, and ``row`` with other columns to keep; rows without an id are spread."""
    by_id, by_text = F.xxhash64(F.col(id).cast("long")), F.xxhash64(F.col(text))
    key = F.when(F.col(id).isNull(), by_text).otherwise(by_id)
    return docs.select(
        F.pmod(key, F.lit(layout.places)).cast("int").alias("place"),
        F.col(id).cast("long").alias("id"),
        F.col(text).alias("text"),
        *([] if keep is None else [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")]),
    )


#: From texts of a place (ids, bytes, offsets) and a test of entries to tables of results.
Receive = Callable[[pa.Array, np.ndarray, np.ndarray, "Entered"], Iterator[pa.Table]]


class Entered:
    """Tells which (key, id) pairs were sent to a place, all of them or the marked or other ones."""

    def __init__(self, entries: Entries, layout: Layout):
        self.layout, self.entries = layout, entries
        self.known: dict[bool | None, np.ndarray] = {}

    def __call__(self, keys: np.ndarray, docs: np.ndarray, marked: bool | None = None) -> np.ndarray:
        known = self.known.get(marked)
        if known is None:
            which = slice(None) if marked is None else self.entries.marks == marked
            known = self.known[marked] = np.unique(_joined(self.entries.keys[which], self.entries.docs[which]))
        if not len(known):
            return np.zeros(len(keys), bool)
        wanted = _joined(self.layout.shorten(keys), docs)
        return known[np.minimum(np.searchsorted(known, wanted), len(known) - 1)] == wanted


def _joined(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    return mix(keys + mix(docs.view(np.uint64) + np.uint64(0x632BE59BD9B4E019)))


def receive(
    texts: DataFrame, replies: DataFrame, work: Receive, layout: Layout, schema: pa.Schema, kind: str
) -> DataFrame:
    """Rows that ``work`` makes of the texts of each place and what was sent to them.

    Where the texts carry a ``row``, ``work`` must give one result per text: text and row follow it.
    """
    return _received(texts, [replies], work, layout, schema, kind)


def receive_both(
    texts: DataFrame,
    replies: DataFrame,
    others: DataFrame,
    work: Callable[..., Iterator[pa.Table]],
    layout: Layout,
    schema: pa.Schema,
    kind: str,
) -> DataFrame:
    """As ``receive``, with two kinds of replies that ``work`` can tell apart."""
    return _received(texts, [replies, others], work, layout, schema, kind)


def _received(texts, replies: list[DataFrame], work, layout, schema, kind) -> DataFrame:
    kinds = len(replies)
    carried = [f for f in texts.schema.fields if f.name == "row"]
    carried = [texts.schema["text"], *carried] if carried else []
    names = [f.name for f in carried]
    kind = T.StructType([*T.StructType.fromDDL(kind).fields, *carried])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sort = right.column("sort").to_numpy()
        tests = [
            Entered(unpack_all(right.filter(pa.array(sort == i)).column("block")), layout)
            for i in range(kinds)
        ]
        data, offsets = flat(left.column("text"))
        ids = left.column("id")
        ids = pa.concat_arrays(ids.chunks) if ids.num_chunks else pa.array([], pa.int64())
        parts = []
        for begin, end in slices(offsets):
            cut = offsets[begin : end + 1]
            parts.extend(work(ids.slice(begin, end - begin), data[cut[0] : cut[-1]], cut - cut[0], *tests))
        result = pa.concat_tables(parts) if parts else schema.empty_table()
        for name in names:
            result = result.append_column(name, left.column(name))
        give_back()
        return result

    sent = replies[0].withColumn("sort", F.lit(0))
    for i, more in enumerate(replies[1:], 1):
        sent = sent.unionByName(more.withColumn("sort", F.lit(i)))
    return texts.groupBy("place").cogroup(sent.groupBy("place")).applyInArrow(run, kind)
