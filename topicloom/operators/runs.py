"""Runs of equal neighbours, and filling gaps along an order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.text import collapse_repeats, split_text
from topicloom.operators.skew import SLICE, Slices, as_list, attach, find_slices


def run_id(
    df: DataFrame,
    key: str | Sequence[str],
    order: str | Sequence[str],
    column: str,
    out: str = "run",
    slices: Slices | None = None,
) -> DataFrame:
    """Number the runs of equal values of ``column`` along ``order``, from 0 within each key.

    Null equals null. The order must be total within a key.
    """
    key, order = as_list(key), as_list(order)
    slices = find_slices(df, key, order[0]) if slices is None else slices
    cut = df.withColumn(SLICE, slices.column(key, order[0]))
    within = Window.partitionBy(*key, SLICE).orderBy(*order)
    step = (F.row_number().over(within) > 1) & ~F.col(column).eqNullSafe(
        F.lag(column).over(within)
    )
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.withColumn("__step", step.cast("long")).withColumn(
        out, F.sum("__step").over(upto)
    ).drop("__step")
    if not slices.hot:
        return local.drop(SLICE)

    place = F.struct(*order)
    summary = (
        local.where(F.col(SLICE) > 0)
        .groupBy(*key, SLICE)
        .agg(
            F.min_by(F.struct(column), place).alias("__head"),
            F.max_by(F.struct(column), place).alias("__tail"),
            F.max(out).alias("__last"),
        )
    )
    # At most one row per slice under each key.
    along = Window.partitionBy(*key).orderBy(SLICE)
    broken = ~F.col("__head").eqNullSafe(F.lag("__tail").over(along))
    jump = F.when(F.row_number().over(along) > 1, F.lag("__last").over(along) + broken.cast("long"))
    summary = summary.withColumn("__jump", F.coalesce(jump, F.lit(0))).withColumn(
        "__before", F.sum("__jump").over(along.rowsBetween(Window.unboundedPreceding, 0))
    )
    joined = attach(local, summary.select(*key, SLICE, "__before"), [*key, SLICE])
    return joined.withColumn(out, F.col(out) + F.coalesce("__before", F.lit(0))).drop(
        SLICE, "__before"
    )


def collapse_runs(
    df: DataFrame,
    key: str | Sequence[str],
    order: str | Sequence[str],
    column: str = "text",
    start: str = "start",
    end: str = "end",
    slices: Slices | None = None,
) -> DataFrame:
    """One row per run: smallest start, largest end, the value. ``run`` is the order column."""
    key = as_list(key)
    numbered = run_id(df, key, order, column, "run", slices)
    return numbered.groupBy(*key, "run").agg(
        F.min(start).alias(start), F.max(end).alias(end), F.first(column).alias(column)
    )


def split_lines(
    df: DataFrame,
    column: str,
    separator: str = "\n",
    explode: bool = True,
    out: str = "sentences",
    index: str = "line_ix",
) -> DataFrame:
    """Split a text column; with ``explode`` one row per part, numbered in ``index``."""
    parts = split_text(F.col(column), separator)
    if not explode:
        return df.withColumn(out, parts)
    return df.select("*", F.posexplode(parts).alias(index, out))


def clean_captions(
    captions: DataFrame,
    key: str | Sequence[str] = "video_id",
    order: str = "cue_ix",
    separator: str = "\n",
    slices: Slices | None = None,
) -> DataFrame:
    """Rolling captions as one row per line: ``(key, run, start, end, text)``.

    Each cue is split into lines; a line that repeats the one before it, in the same cue or in the
    next, is merged with it. Lines are not trimmed and empty lines count. Repeats inside a cue go
    before the shuffle.
    """
    key = as_list(key)
    # Frequent keys are looked for among the cues: a cue is one row, so it has few lines.
    slices = find_slices(captions, key, order) if slices is None else slices
    lines = captions.select(
        *key,
        order,
        "start",
        "end",
        F.explode(collapse_repeats(split_text(F.col("text"), separator))).alias("__line"),
    ).select(*key, order, "start", "end", F.col("__line.first").alias("line_ix"), F.col("__line.value").alias("text"))
    return collapse_runs(lines, key, [order, "line_ix"], slices=slices)


def collapse_lines(
    df: DataFrame, key: str | Sequence[str], column: str = "text", separator: str = "\n"
) -> DataFrame:
    """Runs of equal lines within each text, with their first and last line; no shuffle."""
    runs = collapse_repeats(split_text(F.col(column), separator))
    exploded = df.select(*as_list(key), F.explode(runs).alias("__run"))
    return exploded.select(
        *as_list(key),
        F.col("__run.run").cast("long").alias("run"),
        F.col("__run.first").alias("first_line"),
        F.col("__run.last").alias("last_line"),
        F.col("__run.value").alias(column),
    )


def forward_fill(
    df: DataFrame,
    key: str | Sequence[str],
    order: str | Sequence[str],
    column: str,
    out: str | None = None,
    backward: bool = False,
    slices: Slices | None = None,
) -> DataFrame:
    """Replace nulls by the last value before them (``backward``: the first one after them)."""
    key, order, out = as_list(key), as_list(order), out or column
    slices = find_slices(df, key, order[0]) if slices is None else slices
    cut = df.withColumn(SLICE, slices.column(key, order[0]))

    def ordered(columns: Sequence[str]) -> list[Column]:
        return [F.desc(c) if backward else F.asc(c) for c in columns]

    within = Window.partitionBy(*key, SLICE).orderBy(*ordered(order))
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.withColumn(out, F.last(column, ignorenulls=True).over(upto))
    if not slices.hot:
        return local.drop(SLICE)

    pick = F.min_by if backward else F.max_by
    summary = (
        cut.where((F.col(SLICE) > 0) & F.col(column).isNotNull())
        .groupBy(*key, SLICE)
        .agg(pick(column, F.struct(*order)).alias("__tail"))
    )
    # Every slice needs the value of the nearest slice before it that has one.
    present = cut.where(F.col(SLICE) > 0).select(*key, SLICE).distinct()
    both = attach(present, summary, [*key, SLICE])
    along = Window.partitionBy(*key).orderBy(*ordered([SLICE]))
    before = F.last("__tail", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    carried = both.select(*key, SLICE, before.alias("__before"))
    joined = attach(local, carried, [*key, SLICE])
    return joined.withColumn(out, F.coalesce(out, "__before")).drop(SLICE, "__before")
