"""Bounded labelled samples for fitting models on the driver."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_remainder(doc_id: str, divisor: int) -> Column:
    """``crc32`` of the id as text, modulo ``divisor``: what holds rows out of training."""
    return F.crc32(F.col(doc_id).cast("string")) % divisor


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    per_class: int,
    max_chars: int,
    id: str = "doc_id",
    text: str = "text",
) -> list[tuple[str, object]]:
    """At most ``per_class`` texts of each value of ``label``, chosen by the hash of the id.

    The driver receives no more than ``classes * per_class`` texts of ``max_chars`` characters.
    Rows without id, label or text take no part. The order is fixed by the hash. The mix of labels is
    that of the limits, not that of the table: see ``class_weights``.
    """
    known = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull()).select(
        F.col(id).alias("__id"), F.col(label).alias("__label")
    )
    classes = [r[0] for r in known.select("__label").distinct().collect()]
    rank = F.xxhash64("__id")
    texts = docs.where(F.length(text) <= max_chars).select(
        F.col(id).alias("__id"), F.col(text).alias("__text")
    )
    found = []
    for value in sorted(classes, key=str):
        # Bounded by the limit, so the broadcast is.
        chosen = known.where(F.col("__label") == value).orderBy(rank, "__id").limit(per_class)
        rows = texts.join(F.broadcast(chosen.distinct()), "__id").select("__id", "__text").collect()
        found += [(r[1], value) for r in sorted(rows)]
    return found


def class_weights(labels: DataFrame, label: str, per_class: int, id: str = "doc_id") -> dict[object, float]:
    """How many labelled rows each row of a class in ``labelled_sample`` stands for.

    All rows with an id and a label are counted, whatever the sample holds of them.
    """
    known = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull())
    counts = known.groupBy(F.col(label).alias("__label")).count().collect()
    return {r[0]: r[1] / min(r[1], per_class) for r in counts}


def row_weights(labels: Sequence[object], weights: Mapping[object, float] | None) -> np.ndarray:
    """The weight of each row by its label, 1 on average; without ``weights`` all rows weigh the same."""
    found = np.array([1.0 if weights is None else weights[x] for x in labels], float)
    return found / found.mean()


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """Texts of an Arrow column as UTF-8, null as empty text."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def logistic(
    features: np.ndarray,
    target: np.ndarray,
    ridge: float = 1e-3,
    rounds: int = 30,
    each: np.ndarray | None = None,
):
    """Weights of a logistic regression by Newton steps; ``target`` may be probabilities.

    ``each`` is how much a row counts.
    """
    each = np.ones(len(features)) if each is None else each
    weights = np.zeros(features.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
        gradient = features.T @ (each * (p - target)) + ridge * weights
        curvature = (features * (each * p * (1 - p))[:, None]).T @ features
        step = np.linalg.solve(curvature + ridge * np.eye(len(weights)), gradient)
        weights -= step
        if np.abs(step).max() < 1e-9:
            break
    return weights
