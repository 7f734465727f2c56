"""Queries on whole tables: scaling, observing, outcomes, steps, written files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions.text import first_element, split_text
from topicloom.operators import columns
from topicloom.operators import conversations as chats
from topicloom.operators.content import content
from topicloom.plans.base import Query
from topicloom.session import scratch_path
from topicloom.sources import tables
from topicloom.sources.tables import load

IGNORED = ("l_orderkey", "l_linenumber")
SCALED = ("l_discount", "l_extendedprice", "l_quantity", "l_tax")


def _numbers(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "lineitem").select(*IGNORED, *SCALED)


def standardized(spark: SparkSession, folder: str) -> DataFrame:
    df = _numbers(spark, folder)
    scaled = columns.fit_scaler(df, IGNORED).transform(df)
    return scaled.select(*IGNORED, *[(F.round(c, 6) + 0.0).alias(c) for c in SCALED])


STANDARDIZED_SQL = (
    "WITH f AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in SCALED)
    + " FROM lineitem) SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) + 0.0 AS {c}" for c in SCALED)
    + " FROM lineitem, f"
)


def restored(spark: SparkSession, folder: str) -> DataFrame:
    df = _numbers(spark, folder)
    scaler = columns.fit_scaler(df, IGNORED)
    back = scaler.inverse_transform(scaler.transform(df))
    return back.select(*IGNORED, *[F.round(c, 4).alias(c) for c in SCALED])


RESTORED_SQL = "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round({c}, 4) AS {c}" for c in SCALED
) + " FROM lineitem"


def staged(spark: SparkSession, folder: str) -> DataFrame:
    """A stage that sums its columns in name order, with some columns kept from it."""

    def stage(df: DataFrame) -> DataFrame:
        names = df.columns[1:]
        return df.select("p_partkey", F.concat_ws("|", *[F.col(c).cast("string") for c in names]).alias("row"))

    parts = load(spark, folder, "part").select("p_partkey", "p_size", "p_name", "p_brand")
    return columns.project_except(parts, stage, ["p_brand"], "p_partkey")


def observed(spark: SparkSession, folder: str) -> DataFrame:
    """Figures taken while the rows of a count pass by, as a row."""
    events = load(spark, folder, "events")
    watched, seen = columns.observe(
        events, "events",
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
    )
    rows = watched.where(F.col("value") > 10).count()
    got = seen.get
    return spark.createDataFrame(
        [(rows, got["n"], float(got["total"]), got["errors"])],
        "n_large long, n long, total double, errors long",
    )


OBSERVED_SQL = """
SELECT count(*) FILTER (value > 10) AS n_large, count(*) AS n, round(sum(value), 2) AS total,
       count(*) FILTER (event_type = 'error') AS errors
FROM events"""


def json_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Properties as JSON, cut short for one type of event."""
    events = load(spark, folder, "events")
    raw = F.when(F.col("event_type") == "error", F.expr("substring(props, 2)")).otherwise(F.col("props"))
    parsed = columns.process_json(events.select("event_id", raw.alias("raw")), "raw", "k int")
    return parsed.select("event_id", F.col("value.k").alias("k"), "successful", "error")


JSON_SQL = """
SELECT event_id,
       CASE WHEN event_type <> 'error' THEN regexp_extract(props, '(\\d+)', 1)::INTEGER END AS k,
       event_type <> 'error' AS successful,
       CASE WHEN event_type = 'error' THEN 'malformed JSON' END AS error
FROM events""".replace("\\\\", "\\")


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """A Python function with a step after it; some rows fail in one, some in the other."""

    def price(name: str) -> int:
        kind, number = name.split("#")
        return 1000 // (int(number) - 3)

    def step(value: int) -> str:
        if value < 0:
            raise ValueError("below zero")
        return f"v{value}"

    parts = load(spark, folder, "part").select("p_partkey", "p_brand")
    return columns.process_all(parts, "p_brand", price, [step]).drop("p_brand")


OUTCOMES_SQL = """
WITH n AS (SELECT p_partkey, split_part(p_brand, '#', 2)::BIGINT - 3 AS d FROM part)
SELECT p_partkey, CASE WHEN d > 0 THEN 'v' || (1000 // d) END AS value, d > 0 AS successful,
       CASE WHEN d = 0 THEN 'ZeroDivisionError: integer division or modulo by zero'
            WHEN d < 0 THEN 'ValueError: below zero' END AS error
FROM n"""


def steps(spark: SparkSession, folder: str) -> DataFrame:
    """Steps in a row, each with the columns it needs; the helper column is dropped at the end."""
    lines = columns.Step(
        lambda d: d.withColumn("lines", split_text(F.col("text"))),
        frozenset({"text"}), frozenset({"lines"}),
    )
    first = columns.Step(
        lambda d: d.withColumn("first", first_element(F.col("lines"))),
        frozenset({"lines"}), frozenset({"first"}),
    )
    count = columns.Step(
        lambda d: columns.drop_columns(d.withColumn("n_lines", F.size("lines")), "lines"),
        frozenset({"lines"}), frozenset({"n_lines"}),
    )
    docs = load(spark, folder, "documents").select("doc_id", "text")
    return columns.chain(docs, [lines, first, count]).drop("text")


STEPS_SQL = """
SELECT doc_id, string_split(text, chr(10))[1] AS "first", len(string_split(text, chr(10)))::INTEGER AS n_lines
FROM documents"""


def content_files(spark: SparkSession, folder: str) -> DataFrame:
    """Text of the conversations written as CSV content files and read back."""
    turns = load(spark, folder, "conversations")
    made = content(turns, ["conv_id", "role"], "turn", separator="\n").select(
        F.col("conv_id").cast("string").alias("video_id"),
        F.concat(F.lit('Talk "'), "conv_id", F.lit('", part')).alias("video_title"),
        F.when(F.col("role") != "system", F.col("role")).alias("chapter"),
        "content",
    )
    path = scratch_path(spark, "content")
    tables.write_content(made, path)
    return tables.read_content(spark, path)


CONTENT_FILES_SQL = """
SELECT conv_id::VARCHAR AS video_id, 'Talk "' || conv_id || '", part' AS video_title,
       nullif(role, 'system') AS chapter, string_agg(text, chr(10) ORDER BY turn) AS content
FROM conversations GROUP BY conv_id, role"""


def history_files(spark: SparkSession, folder: str) -> DataFrame:
    """Histories written as JSON, read back and turned into rows."""
    path = scratch_path(spark, "histories")
    tables.write_histories(chats.histories(load(spark, folder, "conversations")), path)
    return chats.to_turns(tables.read_histories(spark, path))


QUERIES = {
    "standardize_except": Query(standardized, STANDARDIZED_SQL),
    "standardize_inverse": Query(restored, RESTORED_SQL),
    "project_except": Query(
        staged, "SELECT p_partkey, p_brand, p_name || '|' || p_size AS row FROM part"
    ),
    "observe": Query(observed, OBSERVED_SQL),
    "json_outcomes": Query(json_outcomes, JSON_SQL),
    "process_all": Query(outcomes, OUTCOMES_SQL),
    "chain": Query(steps, STEPS_SQL),
    "content_files": Query(content_files, CONTENT_FILES_SQL),
    "history_files": Query(
        history_files,
        "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text"
        " FROM conversations",
    ),
}
