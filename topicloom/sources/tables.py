"""Content tables, JSON documents and conversation histories on disk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.operators.skew import as_list

# The columns of content files.
CONTENT_SCHEMA = "video_id string, video_title string, chapter string, content string"
MESSAGES = "array<struct<role: string, content: string>>"

# Texts hold line ends and quotes: quotes are doubled, and empty text is told from null.
_NULL = "\\N"
_CSV = {"header": True, "escape": '"'}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table that is read in fewer tasks than there are cores, on all cores.

    A table is left as it is as soon as its scan keeps all cores busy: large files are split by
    ``spark.sql.files.maxPartitionBytes``, so what is dealt anew is less than that for each core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def write_content(df: DataFrame, path: str, format: str = "csv") -> None:
    """Write a content table; CSV for exchange, parquet for later jobs."""
    if format == "csv":
        df.write.csv(path, quoteAll=True, emptyValue='""', nullValue=_NULL, **_CSV)
    else:
        df.write.format(format).save(path)


def read_content(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: str = CONTENT_SCHEMA,
    format: str = "csv",
) -> DataFrame:
    """Read content tables without inferring anything. The CSV keeps null and empty text apart."""
    if format == "csv":
        # A record may span lines, so a CSV file is one task: write many of them.
        return spark.read.schema(schema).csv(
            paths, multiLine=True, emptyValue="", nullValue=_NULL, **_CSV
        )
    return spark.read.schema(schema).format(format).load(paths)


def read_json_documents(
    spark: SparkSession, paths: str | Sequence[str], schema: str | T.StructType
) -> DataFrame:
    """Documents dumped as JSON lines, read back under their schema."""
    return spark.read.schema(schema).json(paths)


def write_histories(df: DataFrame, path: str, key: str | Sequence[str] = "conv_id") -> None:
    """One JSON document per conversation, ``history`` as a list of role and content."""
    history = F.col("history").cast(MESSAGES).alias("history")
    df.select(*as_list(key), history).write.json(path)


def read_histories(
    spark: SparkSession, path: str | Sequence[str], key: str = "conv_id bigint"
) -> DataFrame:
    return read_json_documents(spark, path, f"{key}, history {MESSAGES}")
