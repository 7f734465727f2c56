"""Nearest neighbours by randomly rotated one-bit codes with error bounds."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bits of a code; a shorter vector is rotated into so many dimensions.
BITS = 256
#: How many standard errors of an estimate a bound allows for.
BOUND = 4.0
#: Vectors that a task codes and searches at once, and queries that visit them together.
BLOCK_ROWS = 32_768
QUERY_ROWS = 8_192
#: Queries whose estimates are held at once.
STRIP = 64


@functools.cache
def rotation(dimension: int, bits: int) -> np.ndarray:
    """Orthonormal rows: a random rotation of ``bits`` dimensions, of which a vector fills the first."""
    noise = np.random.default_rng(11).standard_normal((max(bits, dimension), max(bits, dimension)))
    basis, upper = np.linalg.qr(noise)
    return (basis * np.sign(np.diag(upper)))[:dimension]


@dataclass(frozen=True)
class Codes:
    """Packed signs of rotated vectors, with what corrects an inner product with them.

    A vector ``x`` less the centre has the length ``norm``; its direction has the inner product
    ``fit`` with its signs, taken as a unit vector.
    """

    signs: np.ndarray
    norm: np.ndarray
    fit: np.ndarray
    width: int


def encode(vectors: np.ndarray, centre: np.ndarray, bits: int = BITS) -> Codes:
    turn = rotation(vectors.shape[1], bits)
    turned = (vectors - centre) @ turn
    norm = np.sqrt((turned**2).sum(1))
    width = turn.shape[1]
    fit = np.abs(turned).sum(1) / np.sqrt(width) / np.where(norm > 0, norm, 1.0)
    return Codes(np.packbits(turned > 0, axis=1), norm, np.where(norm > 0, fit, 1.0), width)


def estimate(codes: Codes, queries: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of queries (rows) from coded vectors (columns), and how far off they may be.

    The inner product of a rotated query with the signs, over ``fit``, estimates the one with the
    direction without bias; its standard error is ``sqrt((1 - fit^2) / fit^2 / (width - 1))`` times
    the query's length.
    """
    turned = (queries - centre) @ rotation(queries.shape[1], codes.width)
    length = np.sqrt((turned**2).sum(1))
    signs = np.unpackbits(codes.signs, axis=1, count=codes.width).astype(np.float32)
    # Signs are 2 b - 1 over the root of the width.
    products = 2 * (turned.astype(np.float32) @ signs.T) - turned.sum(1, keepdims=True)
    along = products / np.sqrt(codes.width) / codes.fit
    spread = np.sqrt(np.maximum(1 - codes.fit**2, 0)) / codes.fit / np.sqrt(max(codes.width - 1, 1))
    squared = length[:, None] ** 2 + codes.norm**2 - 2 * codes.norm * along
    return squared, 2 * BOUND * np.outer(length, codes.norm * spread) + 1e-4


def search_block(
    ids: np.ndarray, vectors: np.ndarray, codes: Codes, centre: np.ndarray, query_ids, queries, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The ``k`` nearest of a block to each query, by exact distance, ties to the smaller id.

    The ``k`` least upper bounds give a radius; vectors whose lower bound lies within are measured
    exactly, in the order of their estimates, and the radius shrinks to the ``k``-th distance found.
    """
    for begin in range(0, len(queries), STRIP):
        strip = queries[begin : begin + STRIP]
        squared, error = estimate(codes, strip, centre)
        for i, query in enumerate(strip):
            own = ids == query_ids[begin + i]
            low = squared[i] - error[i]
            low[own] = np.inf
            if len(ids) > k:
                high = np.where(own, np.inf, squared[i] + error[i])
                near = np.flatnonzero(low <= np.partition(high, k - 1)[k - 1])
            else:
                near = np.flatnonzero(~own)
            near = near[np.argsort(low[near], kind="stable")]
            best_ids, best = np.zeros(0, np.int64), np.zeros(0)
            for at in range(0, len(near), 256):
                part = near[at : at + 256]
                if len(best) == k and low[part[0]] > best[-1] ** 2 + 1e-9:
                    break
                exact = np.sqrt(np.cumsum((vectors[part] - query) ** 2, axis=1)[:, -1])
                best_ids = np.concatenate([best_ids, ids[part]])
                best = np.concatenate([best, exact])
                order = np.lexsort((best_ids, best))[:k]
                best_ids, best = best_ids[order], best[order]
            yield int(query_ids[begin + i]), best_ids, best


def usable(vector: str) -> Column:
    """Whether a vector can be searched: not null, nothing null or non-finite in it, not zero."""
    double = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall(
        double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    return F.col(vector).isNotNull() & finite & F.exists(double, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = [np.asarray(v.as_py(), float) for v in column]
    return np.array(values) if values else np.zeros((0, 0))


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 10,
    id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` nearest rows of each row that ``queries`` marks.

    The score is the Euclidean distance of the vectors as they are, in double precision; ranks go
    from 1 by distance and id. All rows but the query's own id are candidates. Vectors that are
    null, zero or hold a null or non-finite component take no part, nor do rows without an id or of
    another dimension than most. Repeated rows are candidates each; a query id that is repeated is
    searched once. Other columns are not read.

    Rows are dealt to blocks by a hash of their id, each block codes its vectors once per group of
    queries, and queries visit every block: the stated queries against all rows. A block answers
    with ``k`` rows a query. Bounds hold for all but a few in a hundred thousand estimates, and what
    they leave in is measured exactly.
    """
    real = vectors.where(F.col(id).isNotNull() & usable(vector)).select(
        F.col(id).cast("long").alias("id"),
        F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"),
        queries.alias("asked"),
    )
    sizes = real.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], f"query_id long, rank int, {id} long, score double")
    dimension = sizes.d
    real = real.where(F.size("v") == dimension)
    centre = np.array(real.agg(*[F.avg(F.get("v", F.lit(i))) for i in range(dimension)]).first(), float)
    blocks = -(-real.count() // BLOCK_ROWS)
    asked = real.where("asked").select("id", "v").dropDuplicates(["id"])
    groups = max(1, -(-asked.count() // QUERY_ROWS))

    rows = real.select(
        F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
        "id",
        "v",
    )
    visits = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("group"),
        "id",
        "v",
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        block, query = _matrix(left.column("v")), _matrix(right.column("v"))
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        if len(ids) and len(query):
            ids, block = ids[order], block[order]
            codes = encode(block, centre)
            found = list(
                search_block(ids, block, codes, centre, right.column("id").to_numpy(), query, k)
            )
        sizes = [len(x) for _, x, _ in found]
        none = [np.zeros(0)]
        return pa.table(
            {
                "query_id": pa.array(np.repeat([q for q, _, _ in found], sizes).astype(np.int64)),
                "id": pa.array(np.concatenate([*(x for _, x, _ in found), *none]).astype(np.int64)),
                "score": pa.array(np.concatenate([*(s for _, _, s in found), *none])),
            }
        )

    answers = (
        rows.groupBy("block", "group")
        .cogroup(visits.groupBy("block", "group"))
        .applyInArrow(run, "query_id long, id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy("score", "id")
    ranked = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id), "score")
