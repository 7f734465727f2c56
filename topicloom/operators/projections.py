"""Approximate neighbours by bucketed random projections with several probes, measured exactly.

In each of some tables a vector has a bit per random direction: on which side of the median it lies. Points
of one bucket are compared with each other; a point also asks in the buckets that it misses by least,
those of the bits whose median it is nearest to. Distances are exact, only candidates may be missed.
A bucket that very many points share is cut into pieces of which every two meet, so that none is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.operators.blocks import product_slack
from topicloom.operators.neighbours import by_vector, distinct_vectors, listed
from topicloom.session import checkpoint

#: Tables, further buckets that a point asks in each of them, points of a bucket that are wanted.
TABLES = 6
PROBES = 4
BUCKET_ROWS = 512
#: Points of a piece.
PIECE_ROWS = 4_096


def directions(width: int, tables: int, bits: int, seed: int) -> np.ndarray:
    """Unit vectors, ``bits`` for each table; within a table at right angles as far as the width allows."""
    noise = np.random.default_rng(seed)
    found = []
    for _ in range(tables):
        rows = noise.normal(size=(max(bits, 1), width))
        for at in range(0, bits, width):
            basis, _ = np.linalg.qr(rows[at : at + width].T)
            rows[at : at + width] = basis.T
        found.append(rows / np.sqrt((rows**2).sum(1, keepdims=True)))
    return np.array(found)


def buckets(x: np.ndarray, planes: np.ndarray, medians: np.ndarray, probes: int) -> np.ndarray:
    """``(points, 1 + probes)`` bucket numbers of one table: a point's own one first, then the nearest others.

    A probe turns one bit or two, those whose sum of squared distances from the medians is least.
    """
    margin = x @ planes.T - medians
    bits = margin > 0
    bits_worth = (1 << np.arange(planes.shape[0], dtype=np.int64))
    own = bits @ bits_worth
    cost = margin**2
    turns = [(i,) for i in range(planes.shape[0])]
    turns += [(i, j) for i in range(planes.shape[0]) for j in range(i)]
    flips = np.array([sum(int(bits_worth[i]) for i in t) for t in turns], np.int64)
    costs = np.stack([cost[:, list(t)].sum(1) for t in turns], axis=1) if turns else np.zeros((len(x), 0))
    best = np.argsort(costs, axis=1, kind="stable")[:, :probes]
    return np.concatenate([own[:, None], own[:, None] ^ flips[best]], axis=1)


def approximate_knn(
    df: DataFrame,
    k: int,
    id: str = "id",
    vector: str = "vector",
    tables: int = TABLES,
    probes: int = PROBES,
    bucket_rows: int = BUCKET_ROWS,
    seed: int = 7,
) -> DataFrame:
    """``(i, j, distance, rank)``: ``k`` near other points of each point, most of them the nearest.

    Distances are exact and ranks those among what was found; equal distances go by ``j``. More ``tables`` and
    ``probes`` find more. Copies of one vector are worked on once and always find each other. Rows
    without a vector are no points; all vectors have one width. A point alone in all of its buckets has no row.
    """
    points, groups, kind = distinct_vectors(df, k, id, vector)
    n = groups.count()
    first = groups.select(F.size("v").alias("w")).first()
    width = first.w if first else 1
    bits = max(0, math.ceil(math.log2(max(1, n) / bucket_rows)))
    planes = directions(width, tables, bits, seed)[:, :bits]
    medians = _medians(groups, planes)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            for table in range(tables):
                found = buckets(x, planes[table], medians[table], probes)
                for place in range(found.shape[1]):
                    # Only the own bucket holds a point; in the others it asks.
                    extra = [np.full(len(x), table, np.int32), found[:, place], np.full(len(x), place == 0)]
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns, *map(pa.array, extra)], names=["p", "v", "ids", "table", "bucket", "held"]
                    )

    kinds = f"p {kind}, v array<double>, ids array<{kind}>, table int, bucket bigint, held boolean"
    filed = checkpoint(groups.select("p", "v", "ids").mapInArrow(file, kinds))
    key = ["table", "bucket"]
    # At most one bucket in so many filed rows is as large as a piece.
    large = filed.groupBy(*key).count().where(F.col("count") > PIECE_ROWS)
    large = checkpoint(large.select(*key, F.ceil(F.col("count") / PIECE_ROWS).cast("int").alias("pieces")))
    cut = filed.join(F.broadcast(large) if large.count() <= 1_000_000 else large, key, "left")
    cut = cut.withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    own = F.pmod(F.xxhash64("p"), F.col("pieces")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    # ``a`` is the piece that is searched and ``b`` the one that asks.
    searched = cut.where("held").select(*key, own.alias("a"), every.alias("b"), "p", "v", "ids")
    asking = cut.select(*key, every.alias("a"), own.alias("b"), "p", "v")
    asking = asking.toDF(*asking.columns)  # columns of its own: both sides come from one table
    tile = [*key, "a", "b"]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            y, x = (
                pa.concat_arrays(t.column("v").chunks).flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
                for t in (left, right)
            )
            ids = [np.asarray(found) for found in left.column("ids").to_pylist()]
            middle = y.mean(0)
            b, names = y - middle, right.column("p").to_pylist()
            for at in range(0, len(x), PIECE_ROWS // 4):
                a = x[at : at + PIECE_ROWS // 4] - middle
                squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
                slack = product_slack(a, b)
                kept = min(k + 1, len(b))
                edge = np.partition(squares + slack, kept - 1, axis=1)[:, kept - 1]
                for row in range(len(a)):
                    near = np.flatnonzero(squares[row] - slack[row] <= edge[row])
                    exact = np.sqrt(((y[near] - x[at + row]) ** 2).sum(1))
                    found = np.concatenate([ids[i] for i in near])
                    away = np.repeat(exact, [len(ids[i]) for i in near])
                    order = np.lexsort((found, away))[: k + 1]
                    out.append((names[at + row], found[order].tolist(), away[order].tolist()))
        p = left.schema.field("p").type
        return pa.table(
            {
                "p": pa.array([n for n, found, _ in out for _ in found], p),
                "j": pa.array([j for _, found, _ in out for j in found], p),
                "distance": pa.array([d for _, _, away in out for d in away], pa.float64()),
            }
        )

    found = searched.groupBy(*tile).cogroup(asking.groupBy(*tile)).applyInArrow(
        compare, f"p {kind}, j {kind}, distance double"
    )
    # Several buckets may give the same neighbour; the k + 1 best of each are enough.
    once = found.groupBy("p", "j").agg(F.min("distance").alias("distance"))
    best = Window.partitionBy("p").orderBy("distance", "j")
    ranked = once.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= k + 1)
    lists = ranked.groupBy("p").agg(F.sort_array(F.collect_list(F.struct("distance", "j"))).alias("near"))
    return listed(by_vector(points, groups, lists), k)


def _medians(groups: DataFrame, planes: np.ndarray) -> np.ndarray:
    """Median of the points along each direction; the driver receives one number for each."""
    tables, bits = planes.shape[:2]
    if not bits:
        return np.zeros((tables, 0))
    flat = planes.reshape(tables * bits, -1)

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            names = [f"c{i}" for i in range(len(flat))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.ascontiguousarray((x @ flat.T).T)], names=names)

    kinds = ", ".join(f"c{i} double" for i in range(len(flat)))
    sides = groups.select("v").mapInArrow(along, kinds)
    found = sides.agg(*[F.percentile_approx(f"c{i}", 0.5, 1000).alias(f"c{i}") for i in range(len(flat))]).first()
    return np.array(list(found), float).reshape(tables, bits)
