"""Labelling time spans from interval lists: the first interval that holds the span wins."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.binding import computed
from topicloom.functions.intervals import first_containing
from topicloom.operators.runs import forward_fill
from topicloom.operators.skew import SLICE, Slices, as_list, attach, find_slices, salted_join
from topicloom.session import checkpoint


def interval_label(
    rows: DataFrame,
    intervals: Column,
    target: str,
    value: str,
    default: Any = None,
    start: str = "start",
    end: str = "end",
    info_start: str = "start_time",
    info_end: str = "end_time",
    fill: str | None = None,
    key: str | Sequence[str] | None = None,
    order: str | Sequence[str] | None = None,
    slices: Slices | None = None,
    override: bool = False,
) -> DataFrame:
    """Label each row from an array of intervals that lies beside it, or from a literal list.

    A projection: no join and no shuffle, whatever the number of intervals. ``fill`` ("forward" or
    "backward") then fills what is still null along ``order`` within ``key``.
    """
    if target in rows.columns and not override:
        raise ValueError(f"column {target!r} exists")
    if fill not in (None, "forward", "backward"):
        raise ValueError(f"unknown fill {fill!r}")
    label = first_containing(
        intervals, F.col(start), F.col(end), value, default, info_start, info_end
    )
    labelled = rows.withColumn(target, label)
    if fill is None:
        return labelled
    return forward_fill(
        labelled, key, order, target, backward=(fill == "backward"), slices=slices
    )


def interval_table_label(
    rows: DataFrame,
    intervals: DataFrame,
    key: str | Sequence[str],
    row_id: str | Sequence[str],
    target: str,
    value: str,
    position: str,
    default: Any = None,
    start: str = "start",
    end: str = "end",
    info_start: str = "start_time",
    info_end: str = "end_time",
) -> DataFrame:
    """The same label from a table of intervals ``(key, position, start, end, value)``.

    Equal intervals of a key are reduced to the first one. The intervals of a key are ranked by their start,
    and what starts no later than a row is a run of first ranks. That run falls into as many blocks
    as its length has binary ones, each a power of two long, and every interval is filed under the
    blocks it is in. Within a block only the ends count: along falling ends, the least position so far is
    a staircase, and a row reads one step of it. So ``n`` rows and ``m`` intervals of a key cost
    ``(n + m) log m`` rows, however many intervals hold a row, and no row ever meets an interval.

    Keys of very many rows or intervals are cut into slices along starts, for the ranks, and along
    ends, for the staircases; each slice hands on a count or a position. ``(key, row_id)`` must identify a row.
    Rows without key, start or end lie in no interval.
    """
    key, row_id = as_list(key), as_list(row_id)
    empty = intervals.schema[value].dataType
    firsts = (
        intervals.where(F.col(info_end) >= F.col(info_start))
        .groupBy(*key, F.col(info_start).alias("__at"), F.col(info_end).alias("__reach"))
        .agg(F.min(F.struct(F.col(position), F.col(value))).alias("__hit"))
    )
    marks = firsts.select("*", F.lit(False).alias("__probe"), *_nothing(rows, row_id))
    spans = rows.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(
        *key, F.col(start).alias("__at"), F.col(end).alias("__reach"), *_nothing(firsts, ["__hit"]),
        F.lit(True).alias("__probe"), *row_id,
    )
    both = marks.unionByName(spans)
    for column in key:
        both = both.where(F.col(column).isNotNull())
    both = checkpoint(both)
    ranked = checkpoint(_ranked(both, key, find_slices(both, key, "__at")))
    most = ranked.agg(F.max("__total")).first()[0] or 0
    hits = _first_hits(_filed(ranked, most.bit_length()), key, find_slices(both, key, "__reach"))
    hits = hits.groupBy(*key, *row_id).agg(F.min("__hit").alias("__hit"))
    found = F.col(f"__hit.{value}")
    if default is not None:
        found = F.when(F.col("__hit").isNotNull(), found).otherwise(F.lit(default).cast(empty))
    return attach(rows, hits, [*key, *row_id]).withColumn(target, found).drop("__hit")


def _nothing(like: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Null columns of the types of others."""
    return [F.lit(None).cast(like.schema[c].dataType).alias(c) for c in columns]


def _ranked(both: DataFrame, key: list[str], slices: Slices) -> DataFrame:
    """Add how many intervals of the key start no later (``__rank``), and how many it has (``__total``)."""
    cut = both.withColumn(SLICE, slices.column(key, "__at"))
    one = (~F.col("__probe")).cast("long")
    within = Window.partitionBy(*key, SLICE)
    upto = within.orderBy("__at", "__probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.withColumn("__rank", F.sum(one).over(upto)).withColumn("__total", F.sum(one).over(within))
    if not slices.hot:
        return local.drop(SLICE)
    counts = cut.where(F.col(SLICE) > 0).groupBy(*key, SLICE).agg(F.sum(one).alias("__n"))
    along = Window.partitionBy(*key).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    summed = counts.select(
        *key, SLICE, F.sum("__n").over(along).alias("__before"),
        F.sum("__n").over(Window.partitionBy(*key)).alias("__all"),
    )
    joined = attach(local, summed, [*key, SLICE])
    return (
        joined.withColumn("__rank", F.col("__rank") + F.coalesce("__before", F.lit(0)))
        .withColumn("__total", F.coalesce("__all", "__total"))
        .drop(SLICE, "__before", "__all")
    )


def _filed(ranked: DataFrame, levels: int) -> DataFrame:
    """Every interval under the full blocks of ranks it is in, every row under the blocks it reads.

    On level ``l`` the ranks fall into blocks of ``2 ** l``. A row reads the last whole block before its
    rank where that bit of the rank is set, which is always a block of even number.
    """
    # Ranks count from 1: an interval's own place is one less.
    place = F.when(F.col("__probe"), F.col("__rank")).otherwise(F.col("__rank") - 1)

    def shifted(level: Column) -> Column:
        return F.call_function("shiftright", F.col("__place"), level)

    def wanted(level: Column) -> Column:
        end = F.call_function("shiftleft", shifted(level) + 1, level)
        full = (shifted(level) % 2 == 0) & (end <= F.col("__total"))
        return F.when(F.col("__probe"), shifted(level) % 2 == 1).otherwise(full)

    every = F.sequence(F.lit(0), F.lit(max(0, levels - 1)))
    placed = ranked.withColumn("__place", place)
    filed = placed.withColumn("__level", F.explode(F.filter(every, wanted)))
    block = shifted(F.col("__level")) - F.col("__probe").cast("long")
    return filed.withColumn("__block", block).drop("__place", "__rank", "__total")


def _first_hits(filed: DataFrame, key: list[str], slices: Slices) -> DataFrame:
    """Rows with the least ``__hit`` of their block among the intervals that end no earlier."""
    cut = filed.withColumn(SLICE, slices.column(key, "__reach"))
    block = [*key, "__level", "__block"]
    within = Window.partitionBy(*block, SLICE).orderBy(F.desc("__reach"), "__probe")
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.withColumn("__hit", F.min("__hit").over(upto))
    if not slices.hot:
        return local.where("__probe")
    sliced = cut.where(F.col(SLICE) > 0)
    least = sliced.groupBy(*block, SLICE).agg(F.min("__hit").alias("__least"))
    along = Window.partitionBy(*block).orderBy(F.desc(SLICE)).rowsBetween(Window.unboundedPreceding, -1)
    carried = least.select(*block, SLICE, F.min("__least").over(along).alias("__later"))
    joined = attach(local.where("__probe"), carried, [*block, SLICE])
    # ``least`` passes over nulls, but does not take structures.
    earlier = F.array_min(F.array_compact(F.array("__hit", "__later")))
    return joined.withColumn("__hit", earlier).drop("__later")


def augment_captions(
    captions: DataFrame,
    info: DataFrame,
    key: str = "video_id",
    order: str | Sequence[str] = "run",
    slices: Slices | None = None,
) -> DataFrame:
    """Chapter title and heat value for every caption of the videos in ``info``.

    A caption that straddles a chapter end keeps the chapter before it; one outside all heat spans
    gets 0. Videos without chapters get null chapters. ``info`` has one row per video, which
    carries its lists with it.
    """
    order = as_list(order)
    slices = find_slices(captions, key, order[0]) if slices is None else slices
    lists = info.select(key, F.col("chapters").alias("__chapters"), F.col("heatmap").alias("__heat"))
    joined = salted_join(captions, lists, key, order, slices.hot, "left")
    labelled = interval_label(joined, F.col("__chapters"), "chapters", "title")
    labelled = interval_label(labelled, F.col("__heat"), "heatmap", "value", default=0.0)
    # Captions go on without the lists: each value is computed in this place, once.
    for column in ("chapters", "heatmap"):
        labelled = computed(labelled, column, F.col(column))
    labelled = labelled.drop("__chapters", "__heat")
    # A matching heat span may itself hold null, which takes the value before it.
    filled = forward_fill(labelled, key, order, "chapters", slices=slices)
    return forward_fill(filled, key, order, "heatmap", slices=slices)
