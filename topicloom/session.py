"""Session set-up and the shared folder that jobs cut their lineage in."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_spark(app: str = "topicloom", cores: str | None = None) -> SparkSession:
    """The running session, or a new one.

    ``cores`` asks for local mode (tests, bench). On a cluster leave it out: master, memory,
    partition numbers and the checkpoint folder then come from ``spark-submit``.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if cores:
        builder = (
            builder.master(f"local[{cores}]")
            .config("spark.sql.shuffle.partitions", "8")
            .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
            .config("spark.ui.enabled", "false")
        )
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session, where all tasks run on this machine, gets a temporary folder instead.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    return tempfile.mkdtemp(prefix="topicloom-")


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written copy."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def at_rest(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder by columns, compressed, and go on from the written copy.

    For tables of many rows that are read several times, a few columns each time.
    """
    path = scratch_path(df.sparkSession, "rest")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, never used before."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
