"""Text of a video, a chapter, a conversation: ordered concatenation within groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.operators.skew import SLICE, Slices, as_list, find_slices


def _joined(text: str, separator: str, order: Sequence[str]) -> Column:
    quoted = separator.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    by = ", ".join(f"`{c}`" for c in order)
    return F.expr(f"listagg(`{text}`, '{quoted}') WITHIN GROUP (ORDER BY {by})")


def content(
    df: DataFrame,
    key: str | Sequence[str],
    order: str | Sequence[str],
    text: str = "text",
    separator: str = " ",
    out: str = "content",
    first_seen: str | None = None,
    slices: Slices | None = None,
) -> DataFrame:
    """Texts of each key joined in order; ``first_seen`` adds the smallest first order value.

    Rows of frequent keys are joined slice by slice, then the slices; a task that builds the final
    cell sees one string per slice and no rows. Give a total order, ties are joined in any order.
    """
    key, order = as_list(key), as_list(order)
    slices = find_slices(df, key, order[0]) if slices is None else slices
    seen = [F.min(order[0]).alias(first_seen)] if first_seen else []
    if not slices.hot:
        return df.groupBy(*key).agg(_joined(text, separator, order).alias(out), *seen)
    cut = df.withColumn(SLICE, slices.column(key, order[0]))
    parts = cut.groupBy(*key, SLICE).agg(_joined(text, separator, order).alias(out), *seen)
    again = [F.min(first_seen).alias(first_seen)] if first_seen else []
    return parts.groupBy(*key).agg(_joined(out, separator, [SLICE]).alias(out), *again)


def group_captions(
    df: DataFrame,
    by: str,
    key: str | Sequence[str] = "video_id",
    order: str | Sequence[str] = "run",
    separator: str = " ",
    slices: Slices | None = None,
) -> DataFrame:
    """Text per value of ``by`` within a key, in order of first appearance (``first_seen``).

    Rows of one value form one group even when they do not follow each other; null is a group.
    """
    return content(
        df, [*as_list(key), by], order, separator=separator, first_seen="first_seen", slices=slices
    )


def chapters_content(captions: DataFrame, separator: str = " ", **options) -> DataFrame:
    """Text of each chapter of each video."""
    return group_captions(captions, "chapters", separator=separator, **options)
