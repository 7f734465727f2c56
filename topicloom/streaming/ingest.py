"""Folders that keep filling: the same readers and models on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from topicloom.sources.captions import parse_cues


def stream_captions(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Cues of subtitle files as they arrive under ``path/<video>/<file>``. Stateless."""
    files = (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.vtt")
        .text(path, wholetext=True)
    )
    parts = F.split(F.col("_metadata.file_path"), "/")
    return parse_cues(
        files.select(
            F.element_at(parts, -2).alias("video_id"),
            F.element_at(parts, -1).alias("file_name"),
            "value",
        )
    )


def append_batches(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    step: Callable[[DataFrame], DataFrame] = lambda d: d,
) -> StreamingQuery:
    """Run a table operator on each batch of arrivals and append the result as parquet.

    Whole files arrive together, so operators that work per video see all of its cues. The folder
    of a batch is named by its number and replaced when a batch is run again after a failure.
    """

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
