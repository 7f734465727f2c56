"""Word lists."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import SparkSession


def english(spark: SparkSession) -> list[str]:
    """Spark's own English list. Needs a running session."""
    return sorted(set(StopWordsRemover.loadDefaultStopWords("english")))
