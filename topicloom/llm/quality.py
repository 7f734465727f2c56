"""Quality scores from compression with dictionaries of good and of bad texts."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.sample import logistic, row_weights, texts_of

#: Bytes of a dictionary, of a piece it is trained on, and the compression level.
DICTIONARY_BYTES = 64 * 1024
PIECE_BYTES = 2048
LEVEL = 3


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries and the weights that turn their size difference into a probability."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def measure(self):
        """A function from text to the features; compressors are made once per task."""
        pair = [
            zstandard.ZstdCompressor(
                level=LEVEL,
                dict_data=zstandard.ZstdCompressionDict(d),
                write_checksum=False,
                write_content_size=False,
                write_dict_id=False,
            )
            for d in (self.good, self.bad)
        ]
        return lambda text: _features(len(pair[0].compress(text)), len(pair[1].compress(text)), len(text))


def _features(good: int, bad: int, size: int) -> tuple[float, ...]:
    difference = (bad - good) / (bad + good)
    length = math.log1p(size)
    density = math.log((bad + good) / (2 * size + 16))
    return difference, difference * length, density, density * length, length, 1.0


def _dictionary(texts: Sequence[bytes]) -> bytes:
    pieces = [t[i : i + PIECE_BYTES] for t in texts for i in range(0, len(t), PIECE_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too few pieces to train on: they are the dictionary themselves
        return b"".join(pieces)[-DICTIONARY_BYTES:] or b" " * 8


def fit_quality(
    sample: Sequence[tuple[str, int]], class_weights: Mapping[object, float] | None = None
) -> QualityModel:
    """Fit on ``(text, label)`` rows; label 1 is good.

    Every other text of a class goes into its dictionary, the rest calibrate: a logistic regression
    of the label on the normalised difference ``(bad - good) / (bad + good)`` of the compressed
    sizes. What a difference says depends on the length of the text and on how far it shrinks at all
    (a line said a thousand times shrinks to nothing with either dictionary), so both enter the
    calibration. ``class_weights`` tells how many rows of the table a row of each class stands for: with
    them the calibration has the table's share of good texts, and not that of a limited sample. With one
    class only the score leans to that class; without any row it is 0.5.
    """
    by = {label: [t.encode() for t, x in sample if x == label] for label in (0, 1)}
    good, bad = (_dictionary(by[label][::2]) for label in (1, 0))
    model = QualityModel(good, bad, ())
    measure = model.measure()
    rows = [(measure(t), label) for label in (0, 1) for t in by[label][1::2] or by[label]]
    if not rows:
        return QualityModel(good, bad, (0.0,) * len(_features(1, 1, 1)))
    features, target = np.array([f for f, _ in rows]), np.array([x for _, x in rows], float)
    each = row_weights([x for _, x in rows], class_weights)
    weights = logistic(features, target, ridge=1e-2, each=each)
    return QualityModel(good, bad, tuple(float(w) for w in weights))


def score_quality(
    docs: DataFrame, model: QualityModel, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``id``, ``score`` (0 to 1, higher is better) and both compressed sizes of every whole text.

    A null text counts as empty. Rows stay one to one, repeated ids included; other columns are not
    read. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.array(shared.value.weights)
        measure = shared.value.measure()
        for batch in batches:
            rows = [measure(t) for t in texts_of(batch.column(1))]
            features = np.array(rows, float).reshape(len(rows), len(weights))
            value = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(value), pa.array(features[:, 0])],
                ["id", "score", "difference"],
            )

    kind = docs.schema[id].dataType.simpleString()
    scored = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(
        scores, f"id {kind}, score double, difference double"
    )
    return scored.withColumnRenamed("id", id)
