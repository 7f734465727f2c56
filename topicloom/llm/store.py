"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from topicloom.session import scratch_path

#: Spark's setting that drops the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Spark's setting of the bytes of an Arrow batch, and the most that texts need.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on texts of this session go to Python in batches of ``BATCH_BYTES``, unless less is set.

    By default a batch may take 64 MB, which both the executor and its workers hold several times.
    """
    said = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get(BATCH).lower())
    size = int(said[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[said[2]] if said else 0
    if not 0 < size < BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from the copy.

    A lost executor then costs its own tasks only, and the shuffle files of what came before are
    dropped at once, so that a job of several steps needs the disk of its largest step.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
