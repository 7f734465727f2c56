"""Density clustering (DBSCAN) of vectors, exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.operators.blocks import Directory, block_groups, pack_blocks, product_slack
from topicloom.operators.components import connected_components
from topicloom.operators.neighbours import BLOCK_ROWS, about_middle
from topicloom.operators.skew import frequent_keys, salted_join
from topicloom.session import checkpoint

NOISE = -1
#: What a point is: without others near it, with some, or a core point.
ALONE, NEAR, CORE = 0, 1, 2
#: Pairs near the edge that are measured at a time, and partitions of tiles at most.
EDGE_PAIRS, MAX_PARTS = 10_000, 4_096


def _within(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """Which points of ``y`` lie within ``eps`` of each point of ``x``, exact at the edge."""
    a, b = about_middle(x, y)
    from_a, from_b = (a * a).sum(1), (b * b).sum(1)
    squares = a @ b.T
    squares *= -2.0
    squares += from_a[:, None]
    squares += from_b
    near = squares <= eps * eps
    # The largest slack of all pairs: what lies this near to the edge is measured by differences.
    slack = product_slack(a[[from_a.argmax()]], b[[from_b.argmax()]])[0, 0]
    squares -= eps * eps
    i, j = np.nonzero(np.abs(squares, out=squares) <= slack)
    for at in range(0, len(i), EDGE_PAIRS):
        k, m = i[at : at + EDGE_PAIRS], j[at : at + EDGE_PAIRS]
        near[k, m] = np.sqrt(((x[k] - y[m]) ** 2).sum(1)) <= eps
    return near


def _roots(near: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Smallest name each point reaches through the links of one block pair.

    From the smallest names on, every point is reached and looked at once.
    """
    # A name may stand on both sides; its places are linked.
    _, place = np.unique(names, return_inverse=True)
    firsts = np.full(place.max() + 1, -1)
    label = np.full(len(names), -1, np.int64)
    left = np.ones(len(names), bool)
    for at in range(len(names)):
        if firsts[place[at]] < 0:
            firsts[place[at]] = at
    twins = np.flatnonzero(firsts[place] != np.arange(len(names)))
    near = near.copy()
    near[twins, firsts[place[twins]]] = near[firsts[place[twins]], twins] = True
    for start in np.argsort(names, kind="stable").tolist():
        if not left[start]:
            continue
        reached = np.array([start])
        while len(reached):
            label[reached] = names[start]
            left[reached] = False
            reached = np.flatnonzero(near[reached].any(0) & left)
    return label


@dataclass
class Tile:
    """The blocks of two groups that meet, as one task holds them."""

    directory: Directory
    place: np.ndarray
    eps: float
    number: int
    columns: dict[int, dict[str, np.ndarray]]
    vectors: dict[int, np.ndarray]

    def pairs(self) -> Iterator[tuple[int, int]]:
        """Blocks that may hold points within the radius of each other, every two once."""
        size = len(set(self.place.tolist()))
        first, second = divmod(self.number, size)
        for a in sorted(self.vectors):
            if self.place[a] == first:
                bound = self.directory.bounds(a)
                for b in sorted(self.vectors):
                    if self.place[b] == second and (first != second or a <= b) and bound[b] <= self.eps:
                        yield a, b

    def meet(self, a: int, mine: np.ndarray, b: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the places ``mine`` in a block those that ask in another, and which of ``others`` are near them."""
        x = self.vectors[a][mine]
        if len(mine) and len(others) and a != b:
            mine = mine[self.directory.asking(x, a, b, np.full(len(x), self.eps))]
        if not len(mine) or not len(others):
            return mine[:0], np.zeros((0, len(others)), bool)
        return mine, _within(self.vectors[a][mine], self.vectors[b][others], self.eps)


def _tiles(packed: DataFrame, directory: Directory, groups: list[list[int]], eps: float, work, schema: str) -> DataFrame:
    """Run ``work`` on every two groups of blocks of which some may be near each other.

    A block is sent to a tile if something of the other group may be within the radius, so at most once
    per group. ``packed`` has ``(block, v)`` and lists.
    """
    place = np.full(len(directory.reach), -1)
    for g, blocks in enumerate(groups):
        place[blocks] = g
    size = max(1, len(groups))
    shared = packed.sparkSession.sparkContext.broadcast((directory, np.array(place)))

    @F.pandas_udf("array<int>")
    def tiles_of(block):
        known, place = shared.value
        found = []
        for b in block.to_numpy():
            met = np.unique(place[(known.bounds(b) <= eps) & (place >= 0)])
            found.append((np.minimum(met, place[b]) * size + np.maximum(met, place[b])).astype(np.int32))
        return type(block)(found)

    def run(table: pa.Table) -> pa.Table:
        known, place = shared.value
        names = [c for c in table.schema.names if c not in ("tile", "block", "v")]
        columns, vectors = {}, {}
        for i, block in enumerate(table.column("block").to_pylist()):
            columns[block] = {c: table.column(c)[i].values for c in names}
            count = len(columns[block]["p"])
            flat = np.frombuffer(table.column("v")[i].as_buffer())
            vectors[block] = flat.reshape(count, len(flat) // count)
        tile = Tile(known, place, eps, table.column("tile")[0].as_py(), columns, vectors)
        return work(tile)

    # As many partitions as tiles, as one of them is work enough for a task.
    parts = min(MAX_PARTS, size * (size + 1) // 2)
    sent = packed.withColumn("tile", F.explode(tiles_of("block"))).repartition(parts, "tile")
    return sent.groupBy("tile").applyInArrow(run, schema)


def _counts(tile: Tile) -> pa.Table:
    """``(p, near)``: how many points of the tile lie within the radius, copies counted."""
    copies = {b: c["n"].to_numpy() for b, c in tile.columns.items()}
    near = {b: np.zeros(len(n), np.int64) for b, n in copies.items()}

    def weighed(hits: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.count_nonzero(hits, axis=1) if (n == 1).all() else (hits @ n.astype(float)).astype(np.int64)

    for a, b in tile.pairs():
        asks, hits = tile.meet(a, np.arange(len(copies[a])), b, np.arange(len(copies[b])))
        near[a][asks] += weighed(hits, copies[b])
        if a != b:
            near[b] += weighed(hits.T, copies[a][asks])
    blocks = list(near)
    return pa.table(
        {
            "p": pa.concat_arrays([tile.columns[b]["p"] for b in blocks]),
            "near": np.concatenate([near[b] for b in blocks]),
        }
    )


def _links(tile: Tile) -> pa.Table:
    """``(a, b, border)``: core points with a core point they are joined to, and others with one near them."""
    state = {b: c["state"].to_numpy() for b, c in tile.columns.items()}
    cores = {b: np.flatnonzero(s == CORE) for b, s in state.items()}
    others = {b: np.flatnonzero(s == NEAR) for b, s in state.items()}
    p = {b: c["p"].fill_null(0).to_numpy() for b, c in tile.columns.items()}
    names, place = np.unique(np.concatenate([p[b][at] for b, at in cores.items()]), return_inverse=True)
    ends = np.cumsum([len(at) for at in cores.values()])
    own = dict(zip(cores, np.split(place, ends[:-1]), strict=True))
    root = np.arange(len(names))
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def border(a: int, b: int) -> None:
        asks, hits = tile.meet(a, others[a], b, cores[b])
        i, j = np.nonzero(hits)
        if len(i):
            # One row for each point and what its neighbours are joined to so far.
            pair = np.unique(np.stack([asks[i], root[own[b][j]]]), axis=1)
            found.append((p[a][pair[0]], pair[1]))

    for a, b in tile.pairs():
        both = np.concatenate([root[own[a]], root[own[b]]])
        if len(both) and (both != both[0]).any():
            asks, hits = tile.meet(a, cores[a], b, cores[b])
            mine, theirs = root[own[a][np.searchsorted(cores[a], asks)]], root[own[b]]
            hits &= mine[:, None] != theirs
            rows, columns = np.flatnonzero(hits.any(1)), np.flatnonzero(hits.any(0))
            if len(rows):
                labels = np.concatenate([mine[rows], theirs[columns]])
                near = np.zeros((len(labels), len(labels)), bool)
                near[: len(rows), len(rows) :] = hits[np.ix_(rows, columns)]
                near |= near.T
                least = np.arange(len(names))
                least[labels] = _roots(near, labels)
                root = least[root]
        border(a, b)
        if a != b:
            border(b, a)
    joined = np.flatnonzero(root != np.arange(len(names)))
    ends_a = [names[joined], *[x for x, _ in found]]
    ends_b = [names[root[joined]], *[names[root[r]] for _, r in found]]
    marks = np.arange(sum(map(len, ends_a))) >= len(joined)
    return pa.table({"a": np.concatenate(ends_a), "b": np.concatenate(ends_b), "border": marks})


def dbscan(
    df: DataFrame,
    eps: float = 0.5,
    min_samples: int = 5,
    id: str = "id",
    vector: str = "embedding",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(id, core, cluster)``: the cluster is its smallest core id, -1 is noise.

    A core point has ``min_samples`` points within ``eps``, itself counted; a point near core
    points of several clusters goes to the one with the smallest id. Equal vectors are worked on
    once, with their number as weight. Every two groups of blocks meet in one task, which returns counts
    and one link per point, so a dense region costs as many rows as it has points, and a block is sent
    once per group. A vector that is null or holds null or non-finite numbers is noise. Ids are integers.
    """
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v"))
    sound = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    # Copies of one vector meet under its hash and value; only the smallest id and a count go on.
    distinct = checkpoint(
        rows.where(sound).groupBy("v").agg(F.min("id").alias("p"), F.count("*").alias("n"))
    )
    packed, directory, n = pack_blocks(distinct.withColumn("v", F.col("v").cast("array<double>")), block_rows)
    groups = block_groups(directory, n)
    crowd = _tiles(packed, directory, groups, eps, _counts, "p long, near long").groupBy("p").agg(
        F.sum("near").alias("near")
    )
    state = F.when(F.col("near") >= min_samples, CORE).when(F.col("near") > 1, NEAR).otherwise(ALONE)
    cores = checkpoint(crowd.where("p IS NOT NULL").select("p", state.alias("state")))
    # The state of each point beside its block, in the order of its points.
    places = packed.select("block", F.posexplode("p").alias("at", "p")).join(cores, "p", "left")
    states = places.groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("at", F.coalesce("state", F.lit(ALONE)).alias("state"))))["state"].alias("state")
    )
    links = checkpoint(
        _tiles(packed.drop("n").join(states, "block"), directory, groups, eps, _links, "a long, b long, border boolean")
    )
    joined = connected_components(links.where("NOT border"))
    lone = cores.where(F.col("state") == CORE).select(F.col("p").alias("node"), F.col("p").alias("own"))
    labels = checkpoint(
        lone.join(joined, "node", "left").select(
            F.col("node").alias("p"), F.coalesce("component", "own").alias("c")
        )
    )
    borders = links.where("border").select(F.col("a").alias("own"), F.col("b").alias("p"))
    borders = salted_join(borders, labels, "p", "own", frequent_keys(borders, "p"))
    borders = borders.groupBy(F.col("own").alias("p")).agg(F.min("c").alias("c"))
    cluster = labels.union(borders)
    outcome = (
        distinct.join(cores, "p")
        .join(cluster, "p", "left")
        .select(
            "v", (F.col("state") == CORE).alias("core"), F.coalesce("c", F.lit(NOISE).cast("long")).alias("cluster")
        )
    )
    # Copies take the outcome of their vector.
    copies = frequent_keys(rows, "v")
    found = salted_join(rows.where(sound), outcome, "v", "id", copies).select("id", "core", "cluster")
    apart = rows.where(~sound).select("id", F.lit(False).alias("core"), F.lit(NOISE).cast("long").alias("cluster"))
    return found.unionByName(apart).withColumnRenamed("id", id)
