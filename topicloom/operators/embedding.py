"""Text to vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA, PCAModel, StandardScaler, StandardScalerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.binding import computed
from topicloom.functions.text import tokens
from topicloom.functions.vectors import l2_normalize

#: Makes an encoder: called once per worker, returns a function from texts to a matrix.
EncoderFactory = Callable[[], Callable[[Sequence[str]], np.ndarray]]

DIMENSIONS = 64


def hashed_words(words: Column, dimensions: int) -> Column:
    """:func:`topicloom.functions.text.hash_vector` of lists of words, with one digest for each word of a batch."""

    @F.arrow_udf("array<double>")
    def hashed(lists: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        encoded = lists.flatten().dictionary_encode()
        digests = [hashlib.md5(w.encode(), usedforsecurity=False).hexdigest() for w in encoded.dictionary.to_pylist()]
        bucket = np.array([int(d[:8], 16) % dimensions for d in digests], np.int64)
        sign = np.array([1.0 if d[8] < "8" else -1.0 for d in digests])
        codes = encoded.indices.to_numpy()
        place = np.repeat(np.arange(len(lists)), lengths) * dimensions + bucket[codes]
        sums = np.bincount(place, sign[codes], len(lists) * dimensions)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * dimensions), pa.array(sums))

    return hashed(words)


def embedding(
    text: Column,
    encoder: EncoderFactory | None = None,
    dimensions: int = DIMENSIONS,
    normalize: bool = True,
) -> Column:
    """Vector of a text. Without an encoder: signed hash counts of its tokens."""
    if encoder is None:
        vector = hashed_words(tokens(text), dimensions)
    else:

        @F.pandas_udf("array<double>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = encoder()
            for batch in batches:
                matrix = np.asarray(model(batch.fillna("").tolist()), dtype=float)
                yield pd.Series(list(matrix), index=batch.index)

        vector = encode(text)
    return l2_normalize(vector) if normalize else vector


def embed(df: DataFrame, text: str, out: str = "embedding", normalize: bool = True, **options) -> DataFrame:
    """Add the vector of a text column, at length one if ``normalize``."""
    raw = computed(df, out, embedding(F.col(text), normalize=False, **options))
    return computed(raw, out, l2_normalize(F.col(out))) if normalize else raw


@dataclass(frozen=True)
class Components:
    """Principal components of some vectors, to be applied to these and to others."""

    centred: StandardScalerModel
    model: PCAModel
    signs: tuple[float, ...]

    def transform(self, df: DataFrame, column: str = "embedding", out: str = "reduced") -> DataFrame:
        """Add the coordinates of each row along the components."""
        raw = self.model.transform(self.centred.transform(df.withColumn("__v", array_to_vector(column))))
        raw = raw.withColumn("__p", vector_to_array("__p"))
        flipped = F.zip_with("__p", F.array(*[F.lit(s) for s in self.signs]), lambda x, s: x * s)
        return computed(raw, out, flipped).drop("__v", "__centred", "__p")


def fit_components(df: DataFrame, column: str = "embedding", k: int = 2) -> Components:
    """Principal components of the centred vectors.

    The driver holds one matrix of dimensions squared. The sign of a component is chosen so that
    its largest loading is positive.
    """
    vectors = df.withColumn("__v", array_to_vector(column))
    centred = StandardScaler(
        inputCol="__v", outputCol="__centred", withMean=True, withStd=False
    ).fit(vectors)
    model = PCA(k=k, inputCol="__centred", outputCol="__p").fit(centred.transform(vectors))
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])])
    return Components(centred, model, tuple(float(s) for s in signs))


def reduce(
    df: DataFrame,
    column: str = "embedding",
    method: str = "pca",
    k: int = 2,
    out: str = "reduced",
) -> DataFrame:
    """Coordinates along the principal components, or the vectors themselves ("identity")."""
    if method == "identity":
        return df.withColumn(out, F.col(column))
    if method != "pca":
        raise ValueError(f"unknown method {method!r}")
    return fit_components(df, column, k).transform(df, column, out)


def project_2d(
    df: DataFrame, id: str, label: str, column: str = "embedding", dimensions: int | None = None
) -> DataFrame:
    """``(id, x, y, label)`` for a scatter drawing; vectors of two numbers are taken as they are."""
    if dimensions is None:
        dimensions = df.agg(F.max(F.size(column))).first()[0] or 0
    flat = reduce(df, column, "pca" if dimensions > 2 else "identity", 2, "__xy")
    return flat.select(id, F.col("__xy")[0].alias("x"), F.col("__xy")[1].alias("y"), label)
