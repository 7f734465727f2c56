"""Scalar functions on ``array<double>`` vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from topicloom.functions.binding import let


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """The vector at length one; a zero vector stays as it is."""

    def scaled(length: Column) -> Column:
        divisor = F.when(length > 0, length).otherwise(1.0)
        return F.transform(v, lambda x: x.cast("double") / divisor)

    return let(norm(v), scaled)


def cosine(a: Column, b: Column) -> Column:
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def hash_bucket(digest: Column, size: int) -> Column:
    """Bucket of a term from the first eight hex digits of its md5."""
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % size).cast("int")


def hash_sign(digest: Column) -> Column:
    """+1 or -1 from the ninth hex digit of a term's md5."""
    return F.when(F.substring(digest, 9, 1) < "8", 1).otherwise(-1)
