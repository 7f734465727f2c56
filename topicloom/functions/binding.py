"""Naming an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row.

    The body of a higher-order function is evaluated for every array element, together with all
    expressions written in it. A lambda variable is read instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row, in this place.

    The optimizer writes the expression of a column into whatever uses it, also into filters and
    into the arguments of Python functions. It does not look through the explode of one element.
    """
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.explode(F.array(value)).alias(name))
