"""Hard negatives: for an anchor and each of its positives, other rows that score nearly as high.

Scores are integer inner products. Rows are packed into blocks and anchors into groups; a tile is a block
against a strip of anchors and is multiplied by Strassen's recursion on 64-bit integers, padded with
zeros. Every sum is exact, so scores and ties are. What a tile finds goes into heaps of bounded size, one per
anchor (positives) or per anchor and positive (negatives in its window). Heaps of several tiles merge
into one: within a task first, then by a ranked window whose limit Spark applies before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.store import written

#: Positives of an anchor, and negatives of a positive.
POSITIVES = 5
NEGATIVES = 5
#: A negative's score in hundredths of the positive's, from and to.
FROM, TO = 80, 100
#: What a component is multiplied with before it is rounded down.
SCALE = 256
#: Rows of a block, blocks of a task, anchors of a group and of a strip.
BLOCK_ROWS = 4_096
TASK_BLOCKS = 4
GROUP_ANCHORS = 1_024
STRIP_ANCHORS = 256
#: Sides at or below which a product is computed directly.
LEAF = 16

_LEAST, _LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_BLOCK = "dimension int, number long, rows int, largest long, ids binary, labels binary, values binary"
_BLOCK_NAMES = ["dimension", "number", "rows", "largest", "ids", "labels", "values"]


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two matrices of 64-bit integers by seven products of their quarters.

    Sides that are no multiple of what the recursion halves are padded with zeros. Sums wrap around, so
    that the result is exact wherever it fits 64 bits, whatever stands in between.
    """
    m, d, n = *a.shape, b.shape[1]
    levels = 0
    while min(m, d, n) >> levels > leaf:
        levels += 1
    step = 1 << levels
    rows, inner, columns = (-(-x // step) * step for x in (m, d, n))
    a = np.pad(a, ((0, rows - m), (0, inner - d)))
    b = np.pad(b, ((0, inner - d), (0, columns - n)))
    return _product(a, b, levels)[:m, :n]


def _product(a: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
    if not levels:
        return a @ b
    m, d, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :d], a[:m, d:], a[m:, :d], a[m:, d:]
    b11, b12, b21, b22 = b[:d, :n], b[:d, n:], b[d:, :n], b[d:, n:]
    result = np.empty((2 * m, 2 * n), np.int64)
    c11, c12, c21, c22 = result[:m, :n], result[:m, n:], result[m:, :n], result[m:, n:]
    both = _product(a11 + a22, b11 + b22, levels - 1)
    c11[:] = both
    c22[:] = both
    lower = _product(a21 + a22, b11, levels - 1)
    c21[:] = lower
    c22 -= lower
    right = _product(a11, b12 - b22, levels - 1)
    c12[:] = right
    c22 += right
    left = _product(a22, b21 - b11, levels - 1)
    c11 += left
    c21 += left
    upper = _product(a11 + a12, b22, levels - 1)
    c11 -= upper
    c12 += upper
    c22 += _product(a21 - a11, b11 + b12, levels - 1)
    c11 += _product(a12 - a22, b21 + b22, levels - 1)
    return result


@dataclass(frozen=True)
class Heaps:
    """The best entries of many lists, best first: higher scores, of equal ones smaller ids.

    ``scores`` and ``ids`` have one row per list; ``sizes`` tells how many entries of it are real.
    """

    scores: np.ndarray
    ids: np.ndarray
    sizes: np.ndarray

    @classmethod
    def empty(cls, lists: int, size: int) -> Heaps:
        return cls(
            np.full((lists, size), _LEAST), np.full((lists, size), _LAST), np.zeros(lists, np.int64)
        )

    def merged(self, other: Heaps) -> Heaps:
        """The best of both, as many as a list of these holds."""
        keep = self.scores.shape[1]
        real = np.concatenate([_real(self), _real(other)], axis=1)
        scores = np.concatenate([self.scores, other.scores], axis=1)
        ids = np.concatenate([self.ids, other.ids], axis=1)
        order = np.lexsort((ids, -1 - scores, ~real), axis=1)[:, :keep]
        scores, ids = (np.take_along_axis(x, order, axis=1) for x in (scores, ids))
        return Heaps(scores, ids, np.minimum(self.sizes + other.sizes, keep))


def _real(heaps: Heaps) -> np.ndarray:
    return np.arange(heaps.scores.shape[1]) < heaps.sizes[:, None]


def best(scores: np.ndarray, ids: np.ndarray, wanted: np.ndarray, size: int) -> Heaps:
    """Heaps of the wanted entries of each row of ``scores``."""
    heaps = Heaps.empty(len(scores), size)
    for i in range(len(scores)):
        at = np.flatnonzero(wanted[i])
        if len(at) > size:
            limit = np.partition(scores[i, at], len(at) - size)[len(at) - size]
            at = at[scores[i, at] >= limit]
        at = at[np.lexsort((ids[at], -1 - scores[i, at]))][:size]
        heaps.scores[i, : len(at)], heaps.ids[i, : len(at)], heaps.sizes[i] = scores[i, at], ids[at], len(at)
    return heaps


@dataclass(frozen=True)
class Block:
    """Some rows: ids, labels and integer vectors."""

    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray
    largest: int

    @classmethod
    def unpack(cls, dimension: int, rows: int, largest: int, ids: bytes, labels: bytes, values: bytes) -> Block:
        kind = np.frombuffer(values, np.uint8, 1)[0]
        matrix = np.frombuffer(values, f"<i{kind}", offset=1).reshape(rows, dimension)
        return cls(np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8"), matrix.astype(np.int64), largest)

    @classmethod
    def of(cls, row: dict) -> Block:
        return cls.unpack(*(row[c] for c in ("dimension", "rows", "largest", "ids", "labels", "values")))


def _packed(dimension: int, number: int, ids: np.ndarray, labels: np.ndarray, values: np.ndarray) -> dict:
    """A block as a row; components take as many bytes as the largest needs."""
    low, high = int(values.min(initial=0)), int(values.max(initial=0))
    largest = max(-low, high)
    kind = next(k for k in (1, 2, 4, 8) if largest < 1 << (8 * k - 1) or k == 8)
    return {
        "dimension": dimension,
        "number": number,
        "rows": len(ids),
        "largest": min(largest, _LAST),
        "ids": ids.astype("<i8").tobytes(),
        "labels": labels.astype("<i8").tobytes(),
        "values": bytes([kind]) + values.astype(f"<i{kind}").tobytes(),
    }


def _matrices(
    ids: pa.Array, labels: pa.Array, vectors: pa.Array
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of each dimension: dimension, ids, labels and a matrix."""
    offsets = vectors.offsets.to_numpy()
    flat = vectors.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    ids, labels = ids.to_numpy(), labels.to_numpy()
    for dimension in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dimension)
        places = offsets[at][:, None] + np.arange(dimension)
        yield dimension, ids[at], labels[at], flat[places] if dimension else np.zeros((len(at), 0), np.int64)


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows packed into blocks where they lie, ``number`` counting within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for dimension, ids, labels, matrix in _matrices(*batch.columns):
                for i, at in enumerate(range(0, len(ids), BLOCK_ROWS)):
                    part = slice(at, at + BLOCK_ROWS)
                    found.append(_packed(dimension, i, ids[part], labels[part], matrix[part]))
            if found:
                yield pa.RecordBatch.from_pylist(found).select(_BLOCK_NAMES).cast(_ARROW)

    return rows.select("id", "label", "vector").mapInArrow(run, _BLOCK)


_ARROW = pa.schema(
    [
        ("dimension", pa.int32()),
        ("number", pa.int64()),
        ("rows", pa.int32()),
        ("largest", pa.int64()),
        ("ids", pa.binary()),
        ("labels", pa.binary()),
        ("values", pa.binary()),
    ]
)


def _groups(anchors: DataFrame) -> DataFrame:
    """Anchors of a group packed into one row; ``number`` is the group."""

    def run(table: pa.Table) -> pa.Table:
        columns = [pa.concat_arrays(table.column(c).chunks) for c in ("id", "label", "vector")]
        number = table.column("number")[0].as_py()
        found = [_packed(d, number, *rest) for d, *rest in _matrices(*columns)]
        return pa.Table.from_pylist(found).select(_BLOCK_NAMES).cast(_ARROW)

    return anchors.groupBy("dimension", "number").applyInArrow(run, _BLOCK)


def _tiles(anchors: Block, blocks: Iterator[Block]) -> Iterator[tuple[slice, Block, np.ndarray]]:
    """Strips of anchors, blocks and the scores of every anchor with every row."""
    for block in blocks:
        if anchors.largest * block.largest * max(1, anchors.values.shape[1]) > _LAST:
            raise ValueError("scores of these vectors do not fit 64 bits")
        across = block.values.T
        for at in range(0, len(anchors.ids), STRIP_ANCHORS):
            strip = slice(at, at + STRIP_ANCHORS)
            yield strip, block, strassen(anchors.values[strip], across)


def positive_heaps(anchors: Block, blocks: Iterator[Block], size: int) -> Heaps:
    """The best rows of the same label and another id, one list per anchor."""
    found = Heaps.empty(len(anchors.ids), size)
    for strip, block, scores in _tiles(anchors, blocks):
        wanted = anchors.labels[strip, None] == block.labels
        wanted &= anchors.ids[strip, None] != block.ids
        _put(found, strip, best(scores, block.ids, wanted, size))
    return found


def window_heaps(
    anchors: Block, positives: np.ndarray, real: np.ndarray, blocks: Iterator[Block], size: int, window: tuple[int, int]
) -> Heaps:
    """The best rows of another label within each positive's window, one list per anchor and positive.

    ``positives`` holds the scores of each anchor's positives, of which ``real`` are there.
    """
    lists = positives.shape[1]
    found = Heaps.empty(positives.size, size)
    # 100 * score >= least * positive and <= most * positive, as whole numbers.
    low = np.array([-(-window[0] * int(p) // 100) for p in positives.ravel()], np.int64).reshape(positives.shape)
    high = np.array([window[1] * int(p) // 100 for p in positives.ravel()], np.int64).reshape(positives.shape)
    for strip, block, scores in _tiles(anchors, blocks):
        other = anchors.labels[strip, None] != block.labels
        other &= anchors.ids[strip, None] != block.ids
        for j in range(lists):
            wanted = other & (scores >= low[strip, j, None]) & (scores <= high[strip, j, None])
            wanted &= real[strip, j, None]
            rows = np.arange(strip.start, strip.start + len(scores)) * lists + j
            _put(found, rows, best(scores, block.ids, wanted, size))
    return found


def _put(found: Heaps, rows, more: Heaps) -> None:
    """Merge ``more`` into some lists."""
    merged = Heaps(found.scores[rows], found.ids[rows], found.sizes[rows]).merged(more)
    found.scores[rows], found.ids[rows], found.sizes[rows] = merged.scores, merged.ids, merged.sizes


def _entries(heaps: Heaps, first: dict[str, np.ndarray]) -> pa.Table:
    """The real entries of all lists, with columns that tell the list."""
    real = _real(heaps)
    which = np.repeat(np.arange(len(heaps.sizes)), heaps.sizes)
    columns = {name: values[which] for name, values in first.items()}
    columns |= {"id": heaps.ids[real], "score": heaps.scores[real]}
    return pa.table({name: pa.array(values) for name, values in columns.items()})


def mine(
    vectors: DataFrame,
    anchors: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    window: tuple[int, int] = (FROM, TO),
    id: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A component ``x`` becomes ``floor(256 * x)``; scores are the integer inner products. The positives of a
    row that ``anchors`` marks are the first rows of its label, by score downwards and id upwards. For each of
    them the first rows of other labels with ``window[0] * positive_score <= 100 * negative_score <=
    window[1] * positive_score`` come out with ranks from 1. Fewer than asked for are all there are; an
    anchor without positives, or a positive without such rows, has no row.

    ``label`` is a whole number. Rows whose id, label or vector is null, or whose vector holds a null or
    non-finite component, take no part; zero and empty vectors do. Vectors meet those of their own
    dimension only. Rows of an anchor's id are never its positives or negatives. Repeated rows are
    candidates each; wholly equal anchors are one. Rows that share an id but not the rest are anchors each, and
    their answers stand side by side. Other columns are not read. Scores that may not fit 64 bits
    are an error.

    The stated anchors meet all rows: blocks of rows are dealt to the groups of anchors, a few blocks per
    task, once for the positives and once more for the windows, which the positives set. A task returns
    its merged heaps only.
    """
    double = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    labels = F.col(label) if isinstance(label, str) else label
    # Null components are ruled out, for which the type must not allow for them either.
    whole = F.transform(double, lambda x: F.coalesce(F.floor(x * SCALE), F.lit(0)).cast("long"))
    rows = vectors.where(F.col(id).isNotNull() & labels.isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.col(id).cast("long").alias("id"),
        labels.cast("long").alias("label"),
        whole.alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("asked"),
    )
    blocks = _blocks(rows).withColumn("serial", F.monotonically_increasing_id())
    blocks = written(blocks, "candidate_blocks")
    asked = rows.where("asked").select("id", "label", "vector").distinct()
    count = -(-asked.count() // GROUP_ANCHORS)
    number = F.pmod(F.xxhash64("id", "label", "vector"), F.lit(max(1, count)))
    groups = written(
        _groups(asked.select(F.size("vector").alias("dimension"), number.alias("number"), "id", "label", "vector")),
        "anchor_groups",
    )
    slices = max(1, -(-blocks.count() // TASK_BLOCKS))
    tile = ["dimension", "number", "slice"]
    every = F.sequence(F.lit(0), F.lit(max(0, count - 1))).cast("array<long>")
    spread = blocks.withColumn("slice", F.pmod(F.xxhash64("serial"), F.lit(slices))).withColumn(
        "number", F.explode(every)
    )

    def met(groups: DataFrame, run, kind: str) -> DataFrame:
        asking = groups.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<long>")))
        return spread.groupBy(*tile).cogroup(asking.groupBy(*tile)).applyInArrow(run, kind)

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        for group in right.to_pylist():
            asking = Block.of(group)
            heaps = positive_heaps(asking, map(Block.of, left.to_pylist()), positives)
            lists = np.arange(len(asking.ids))
            tag = {"dimension": lists * 0 + group["dimension"], "number": lists * 0 + group["number"], "place": lists}
            return _entries(heaps, tag)
        return _entries(Heaps.empty(0, 1), {c: np.zeros(0, np.int64) for c in ("dimension", "number", "place")})

    order = Window.partitionBy("dimension", "number", "place").orderBy(F.desc("score"), "id")
    found = met(groups, first, "dimension long, number long, place long, id long, score long")
    ranked = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives)
    # A group's list is bounded: its anchors times their positives.
    listed = ranked.groupBy(F.col("dimension").cast("int").alias("dimension"), "number").agg(
        F.collect_list(F.struct("place", F.col("nth").cast("long").alias("nth"), "id", "score")).alias("positives")
    )
    known = written(groups.join(listed, ["dimension", "number"]), "anchor_positives")

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("dimension", "number", "place", "anchor_id", "nth", "positive_id", "positive_score")
        for group in right.to_pylist():
            asking = Block.of(group)
            shape = len(asking.ids), positives
            scores, ids, real = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, bool)
            for p in group["positives"]:
                at = p["place"], p["nth"] - 1
                scores[at], ids[at], real[at] = p["score"], p["id"], True
            heaps = window_heaps(asking, scores, real, map(Block.of, left.to_pylist()), negatives, window)
            place, nth = np.divmod(np.arange(scores.size), positives)
            columns = place * 0 + group["dimension"], place * 0 + group["number"], place, asking.ids[place], nth
            columns += ids.ravel(), scores.ravel()
            return _entries(heaps, dict(zip(names, columns, strict=True)))
        return _entries(Heaps.empty(0, 1), {c: np.zeros(0, np.int64) for c in names})

    kind = "dimension long, number long, place long, anchor_id long, nth long, positive_id long, "
    kind += "positive_score long, id long, score long"
    order = Window.partitionBy("dimension", "number", "place", "nth").orderBy(F.desc("score"), "id")
    ranked = met(known, second, kind).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= negatives).select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
