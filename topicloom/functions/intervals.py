"""Looking up a time span in the list of intervals a row carries."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_intervals(
    intervals: list[dict[str, Any]],
    value: str,
    start: str = "start_time",
    end: str = "end_time",
    value_type: str = "string",
) -> Column:
    """A list written in the program as an array column."""
    rows = [
        F.struct(
            F.lit(float(i[start])).alias(start),
            F.lit(float(i[end])).alias(end),
            F.lit(i[value]).cast(value_type).alias(value),
        )
        for i in intervals
    ]
    kind = f"array<struct<{start}:double,{end}:double,{value}:{value_type}>>"
    return F.array(*rows).cast(kind)


def first_containing(
    intervals: Column,
    row_start: Column,
    row_end: Column,
    value: str,
    default: Any = None,
    start: str = "start_time",
    end: str = "end_time",
) -> Column:
    """Value of the first interval in list order that holds the whole span, ends included.

    The default stands in only where no interval matches: a null value of the matching one stays.
    """
    matching = F.filter(
        intervals, lambda i: (row_start >= i[start]) & (row_end <= i[end])
    )
    found = F.get(matching, F.lit(0))[value]
    if default is None:
        return found
    return F.when(F.coalesce(F.size(matching), F.lit(0)) > 0, found).otherwise(F.lit(default))
