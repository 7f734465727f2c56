"""What a registered query is."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from topicloom.sources.tables import load, spread

Run = Callable[[SparkSession, str], DataFrame]

# Word lists of the registered queries.
STOP_WORDS = ("the", "and", "of", "to", "in", "is", "la", "le", "der", "die")
EXTRA_STOP_WORDS = ("que", "un")


@dataclass(frozen=True)
class Query:
    """A run over the given tables and, where there is one, the same in SQL."""

    run: Run
    sql: str | None = None


def text_table(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    """A table whose texts are worked on at length, spread over all cores."""
    return spread(load(spark, folder, name))


def quoted(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)
