"""Subtitle folders and video records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.functions.text import strip, to_seconds

# The fields of a video record.


def _spans(value: str, kind: T.DataType) -> T.ArrayType:
    return T.ArrayType(
        T.StructType()
        .add("start_time", T.DoubleType())
        .add("end_time", T.DoubleType())
        .add(value, kind)
    )


_STRING, _STRINGS = T.StringType(), T.ArrayType(T.StringType())
VIDEO_SCHEMA = (
    T.StructType()
    .add("title", _STRING)
    .add("fulltitle", _STRING)
    .add("description", _STRING)
    .add("duration", T.IntegerType())
    .add("categories", _STRINGS)
    .add("tags", _STRINGS)
    .add("chapters", _spans("title", _STRING))
    .add("heatmap", _spans("value", T.DoubleType()))
    .add("playlist_title", _STRING)
    .add("language", _STRING)
    .add("upload_date", _STRING)
    .add("availability", _STRING)
    .add("playlist_index", T.IntegerType())
    .add("playable_in_embed", T.BooleanType())
    .add("filesize_approx", T.LongType())
    .add("formats", _STRING)
    .add("automatic_captions", _STRING)
    .add("subtitles", _STRING)
)
REQUIRED = (
    "title", "fulltitle", "description", "duration",
    "categories", "tags", "playlist_title", "language",
)

# Fixed value: the line that gives a cue its times.
_TIMES = r"(?m)^\s*((?:\d+:)?\d+:\d+[.,]\d+)[ \t]+-->[ \t]+((?:\d+:)?\d+:\d+[.,]\d+)"
_TEXT = r"(?s)^.*?-->[^\n]*\n?(.*)$"


def parse_cues(files: DataFrame, text: str = "value") -> DataFrame:
    """Explode whole subtitle files into cues, all in JVM expressions.

    Blocks are divided by empty lines; a line of white space belongs to its cue. Blocks without a
    time line (header, notes, styles) are dropped. Tags are taken out of the text and white space off
    its ends.
    """
    clean = F.regexp_replace(F.col(text), "\r\n?", "\n")
    blocks = F.filter(F.split(clean, r"\n{2,}", -1), lambda b: b.rlike(_TIMES))
    others = [c for c in files.columns if c != text]
    cues = files.select(*others, F.posexplode(blocks).alias("cue_ix", "__block"))

    def seconds(group: int) -> Column:
        return to_seconds(F.translate(F.regexp_extract("__block", _TIMES, group), ",", "."))

    body = F.regexp_replace(F.regexp_extract("__block", _TEXT, 1), "<[^>]*>", "")
    return cues.select(
        *others,
        "cue_ix",
        seconds(1).alias("start"),
        seconds(2).alias("end"),
        strip(body).alias("text"),
    )


def _folder(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def _file(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _whole_files(spark: SparkSession, paths: str | Sequence[str], pattern: str) -> DataFrame:
    """Files of these names in the folders and all folders below."""
    return spark.read.text(paths, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)


def read_captions(
    spark: SparkSession, paths: str | Sequence[str], pattern: str = "*.vtt"
) -> DataFrame:
    """Cues of all subtitle files in a folder of video folders, their names as ``video_id``."""
    files = _whole_files(spark, paths, pattern).select(
        _folder(F.col("_metadata.file_path")).alias("video_id"),
        _file(F.col("_metadata.file_path")).alias("file_name"),
        "value",
    )
    return parse_cues(files)


def parse_video_info(files: DataFrame, text: str = "metadata") -> DataFrame:
    """Fields of whole JSON files; ``error`` names broken JSON or missing required fields.

    Absent and null interval lists become empty. The raw text stays beside the fields.
    """
    corrupt = T.StructField("_corrupt", T.StringType())
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt.name}
    schema = T.StructType([*VIDEO_SCHEMA.fields, corrupt])
    parsed = files.withColumn("__v", F.from_json(text, schema, options)).withColumn(
        "__present", F.json_object_keys(text)
    )
    missing = F.array_except(F.array(*[F.lit(c) for c in REQUIRED]), F.col("__present"))
    broken = F.col(f"__v.{corrupt.name}").isNotNull() | F.col("__present").isNull()
    error = F.when(broken, F.lit("malformed JSON")).when(
        F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))
    )

    def value(f: T.StructField) -> Column:
        found = F.col(f"__v.{f.name}")
        if f.name in ("chapters", "heatmap"):
            found = F.coalesce(found, F.array().cast(f.dataType))
        return found.alias(f.name)

    fields = [value(f) for f in VIDEO_SCHEMA.fields]
    return parsed.select(*files.columns, *fields, error.alias("error"))


def read_video_info(
    spark: SparkSession, paths: str | Sequence[str], pattern: str = "video.info.json"
) -> DataFrame:
    """One row per info file in a folder of video folders, their names as ``video_id``."""
    files = _whole_files(spark, paths, pattern).select(
        _folder(F.col("_metadata.file_path")).alias("video_id"), F.col("value").alias("metadata")
    )
    return parse_video_info(files)


def choose_captions(captions: DataFrame, preferred: str, fallback: str) -> DataFrame:
    """Cues of the preferred file of each video, or else of the fallback file.

    The choice is made on distinct file names and joined back, so that a video with very many cues
    costs one row in the choice.
    """
    files = captions.where(F.col("file_name").isin(preferred, fallback))
    rank = F.when(F.col("file_name") == preferred, 0).otherwise(1)
    chosen = files.groupBy("video_id").agg(F.min_by("file_name", rank).alias("file_name"))
    return files.join(chosen, ["video_id", "file_name"], "left_semi")


def load_status(
    info: DataFrame, captions: DataFrame, preferred: str, fallback: str
) -> DataFrame:
    """Per video of ``info``: the file used, whether loading works, and why not.

    A missing subtitle and a broken or missing record are told apart.
    """
    rank = F.when(F.col("file_name") == preferred, 0).otherwise(1)
    used = (
        captions.where(F.col("file_name").isin(preferred, fallback))
        .groupBy("video_id")
        .agg(F.min_by("file_name", rank).alias("file_name"))
    )
    known = info.select("video_id", "error", F.lit(True).alias("__known"))
    joined = known.join(used, "video_id", "full")
    problem = (
        F.when(F.col("__known").isNull(), F.lit("no info file"))
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("file_name").isNull(), F.lit("no subtitle file"))
    )
    return joined.select(
        "video_id",
        "file_name",
        (F.col("file_name") == fallback).alias("is_fallback"),
        problem.isNull().alias("successful"),
        problem.alias("error"),
    )


def load_videos(
    info: DataFrame, captions: DataFrame, preferred: str, fallback: str
) -> tuple[DataFrame, DataFrame]:
    """Cues to go on with, and the outcome of every video.

    Cues of videos whose record is broken are left out, as their load fails.
    """
    status = load_status(info, captions, preferred, fallback)
    good = info.where(F.col("error").isNull()).select("video_id")
    chosen = choose_captions(captions, preferred, fallback).join(good, "video_id", "left_semi")
    return chosen, status
