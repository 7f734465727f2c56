"""Keeping frequent keys out of single tasks.

A window or an ordered collection over ``key`` puts all rows of one key into one task. Here the
rows of keys that hold a large share of the table are cut into slices along their order, so that
work is grouped by ``(key, slice)`` and only one summary row per slice meets again under the key.
What the driver receives is bounded: at most ``FREQUENT_KEYS`` key hashes and as many slice limits
as there are partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a single task sorts without trouble.
ROWS_PER_TASK = 1_000_000

#: Frequent keys that are split at most. The next one holds less than a 10,000th of the table.
FREQUENT_KEYS = 10_000

SLICE = "__slice"
SALT = "__salt"


def as_list(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def attach(df: DataFrame, other: DataFrame, on: str | Sequence[str], how: str = "left") -> DataFrame:
    """Add the remaining columns of ``other`` to the rows of ``df``; null matches null."""
    on = as_list(on)
    renamed = other.select(
        *[F.col(c).alias(f"__on_{c}") for c in on], *[c for c in other.columns if c not in on]
    )
    condition = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__on_{c}")) for c in on])
    return df.join(renamed, condition, how).drop(*[f"__on_{c}" for c in on])


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def frequent_keys(
    df: DataFrame,
    key: str | Sequence[str],
    rows: int = ROWS_PER_TASK,
    weight: str | None = None,
) -> list[int]:
    """Hashes of the keys with more than ``rows`` rows, the most frequent ones if there are very many.

    ``weight`` names a column that holds the number of rows, for a table counted before.

    However many partitions there are, every such key is split. Two keys with one hash are
    sliced or salted together, which changes where rows are worked on and not what comes out.
    """
    size = F.count("*") if weight is None else F.sum(weight)
    counted = df.groupBy(F.xxhash64(*as_list(key)).alias("h")).agg(size.alias("n"))
    found = counted.where(F.col("n") > rows).orderBy(F.desc("n")).limit(FREQUENT_KEYS)
    return [r.h for r in found.collect()]


@dataclass(frozen=True)
class Slices:
    """Which keys are cut, and at which values of the order column."""

    hot: tuple[int, ...] = ()
    limits: tuple[float, ...] = ()
    timed: bool = False

    def column(self, key: str | Sequence[str], order: str) -> Column:
        """0 for rows of ordinary keys, the slice number from 1 on for rows of frequent ones."""
        if not self.hot:
            return F.lit(0)
        value = _number(order, self.timed)
        limits = F.array(*[F.lit(x) for x in self.limits])
        # Binary search: add each power of two that still lies at or below the value.
        powers = [1 << p for p in reversed(range(len(self.limits).bit_length()))]
        place = F.aggregate(
            F.array(*[F.lit(p) for p in powers]),
            F.lit(0),
            lambda at, step: F.when(F.get(limits, at + step - 1) <= value, at + step).otherwise(at),
        )
        return F.when(F.xxhash64(*as_list(key)).isin(list(self.hot)), place + 1).otherwise(0)


def _number(order: str, timed: bool) -> Column:
    return (F.col(order).cast("timestamp") if timed else F.col(order)).cast("double")


#: For keys whose rows all come out of one input row (lines of a text): nothing to cut.
WHOLE = Slices()


def find_slices(
    df: DataFrame,
    key: str | Sequence[str],
    order: str,
    rows: int = ROWS_PER_TASK,
    parts: int | None = None,
) -> Slices:
    """Look for frequent keys and choose limits that split their rows evenly.

    One scan of the key columns; only if frequent keys exist, a second one of key and order. The
    limits are quantiles of the order over all frequent rows, so a slice of a key has at most
    about ``1 / parts`` of these rows. The order column is a number or a time.
    """
    parts = parts or partitions(df)
    hot = frequent_keys(df, key, rows)
    if not hot:
        return WHOLE
    timed = df.schema[order].dataType.typeName() in ("timestamp", "timestamp_ntz", "date")
    shares = [i / parts for i in range(1, parts)]
    limits = (
        df.where(F.xxhash64(*as_list(key)).isin(hot))
        .agg(F.percentile_approx(_number(order, timed), shares, 20 * parts).alias("v"))
        .first()
        .v
    )
    return Slices(tuple(hot), tuple(sorted(set(limits or []))), timed)


def salted_join(
    big: DataFrame,
    dim: DataFrame,
    on: str | Sequence[str],
    spread_by: str | Sequence[str],
    hot: Sequence[int] = (),
    how: str = "inner",
) -> DataFrame:
    """Join a large table with one that has one row per key, splitting the frequent keys.

    Rows of the ``hot`` keys are spread over salts by the hash of ``spread_by`` and their partner
    row is repeated once per salt. Without frequent keys this is the plain join.
    """
    on = as_list(on)
    if not hot:
        return big.join(dim, on, how)
    salts = partitions(big)
    is_hot = F.xxhash64(*on).isin(list(hot))
    salt = F.when(is_hot, F.pmod(F.xxhash64(*as_list(spread_by)), F.lit(salts))).otherwise(0)
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = big.withColumn(SALT, salt.cast("int"))
    right = dim.withColumn(SALT, F.explode(copies))
    return left.join(right, [*on, SALT], how).drop(SALT)
