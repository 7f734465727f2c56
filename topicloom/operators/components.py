"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.operators.skew import ROWS_PER_TASK, frequent_keys, salted_join
from topicloom.session import checkpoint


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for undirected edges ``(a, b)``; the component is its smallest node.

    Each round works on a graph of components. A component hooks to its smallest neighbour, pointers
    are doubled until every component points to a root, and the edges are drawn between roots anew,
    without loops and repeats. Only components smaller than all their neighbours stay, at most half
    of them, so rounds grow with the logarithm of the number of nodes: a path needs one round if its
    nodes are in order, a dozen if a thousand of them are shuffled. Smallest neighbours are found by
    partial aggregation; components with very many edges are salted.
    """
    left = checkpoint(edges.select("a", "b").where("a <> b").distinct())
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    labels = checkpoint(nodes.withColumn("component", F.col("node")))
    size = left.count()
    named = labels.count()
    for _ in range(max_rounds):
        if not size:
            return labels
        roots = _flat(checkpoint(_hooks(left)), size)
        labels = checkpoint(_renamed(labels, roots, "component", "node", named))
        ends = _renamed(_renamed(left, roots, "a", "b", size), roots, "b", "a", size)
        ordered = ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        left = checkpoint(ordered.distinct())
        size = left.count()
    if size:
        raise RuntimeError(f"components not settled in {max_rounds} rounds")
    return labels


def _hot(rows: DataFrame, column: str, size: int) -> list[int]:
    """Frequent values of a column; none in a table that is no larger than one task's share."""
    return frequent_keys(rows, column) if size > ROWS_PER_TASK else []


def _hooks(edges: DataFrame) -> DataFrame:
    """``(u, c)``: every component and the smallest of itself and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    return both.groupBy("u").agg(F.min("v").alias("c")).select("u", F.least("u", "c").alias("c"))


def _flat(pointers: DataFrame, edges: int) -> DataFrame:
    """Follow pointers to their ends: twice as far each time."""
    while True:
        hop = pointers.select(F.col("u").alias("c"), F.col("c").alias("e"))
        joined = salted_join(pointers, hop, "c", "u", _hot(pointers, "c", 2 * edges))
        far = checkpoint(joined.selectExpr("u", "e AS c", "c <> e AS moved"))
        pointers = far.select("u", "c")
        if not far.where("moved").take(1):
            return pointers


def _renamed(rows: DataFrame, roots: DataFrame, column: str, spread_by: str, size: int) -> DataFrame:
    """Replace a component by its root."""
    found = roots.select(F.col("u").alias(column), F.col("c").alias("__root"))
    joined = salted_join(rows, found, column, spread_by, _hot(rows, column, size), "left")
    return joined.withColumn(column, F.coalesce("__root", column)).select(*rows.columns)
