"""Queries on ordered rows: runs, interval labels, filling, text per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions.intervals import literal_intervals
from topicloom.functions.text import strip, to_seconds
from topicloom.operators import content as texts
from topicloom.operators import intervals, runs
from topicloom.plans.base import Query, text_table
from topicloom.session import scratch_path
from topicloom.sources.captions import (
    load_videos,
    parse_cues,
    parse_video_info,
    read_captions,
    read_video_info,
)
from topicloom.sources.tables import load

# Chapters of a conversation by turn: two overlap, there is a gap, a turn may straddle an end.
CHAPTERS = [
    {"start_time": 0.0, "end_time": 1.5, "title": "opening"},
    {"start_time": 1.0, "end_time": 4.0, "title": "questions"},
    {"start_time": 3.0, "end_time": 5.0, "title": "answers"},
    {"start_time": 6.0, "end_time": 1e9, "title": "closing"},
]
HEAT = [
    {"start_time": 0.0, "end_time": 2.0, "value": 1.0},
    {"start_time": 2.0, "end_time": 3.0, "value": 0.25},
]
# Parts of a day in seconds.
DAY_PARTS = [
    {"start_time": 0.0, "end_time": 21600.0, "title": "night"},
    {"start_time": 18000.0, "end_time": 43200.0, "title": "morning"},
    {"start_time": 46800.0, "end_time": 64800.0, "title": "afternoon"},
]
LOAD = [
    {"start_time": 0.0, "end_time": 36000.0, "value": 0.5},
    {"start_time": 30000.0, "end_time": 72000.0, "value": 0.75},
]


def _case(rows: list[dict], value: str, default: str | None = None) -> str:
    whens = " ".join(
        f"WHEN \"start\" >= {r['start_time']} AND \"end\" <= {r['end_time']} THEN "
        + (f"'{r[value]}'" if isinstance(r[value], str) else f"{r[value]}::DOUBLE")
        for r in rows
    )
    return f"CASE {whens} ELSE {default or 'NULL'} END"


def _micros() -> Column:
    # The time stamps have no zone and count as UTC, whatever the zone of the session.
    return F.unix_micros(F.concat(F.col("ts").cast("string"), F.lit("Z")).cast("timestamp"))


def turn_captions(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as captions: one cue per turn, a unit of time each."""
    start = F.col("turn").cast("double")
    return load(spark, folder, "conversations").select(
        "conv_id", "turn", start.alias("start"), (start + 1).alias("end"), "text"
    )


def clean_turns(spark: SparkSession, folder: str) -> DataFrame:
    return runs.clean_captions(turn_captions(spark, folder), "conv_id", "turn")


CLEAN_TURNS_SQL = """
lines AS (
  SELECT conv_id, turn, generate_subscripts(parts, 1) AS line_ix, unnest(parts) AS text
  FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS parts FROM conversations)
), stepped AS (
  SELECT *, CASE WHEN row_number() OVER w > 1 AND text IS DISTINCT FROM lag(text) OVER w
            THEN 1 ELSE 0 END AS step
  FROM lines WINDOW w AS (PARTITION BY conv_id ORDER BY turn, line_ix)
), numbered AS (
  SELECT *, sum(step) OVER (PARTITION BY conv_id ORDER BY turn, line_ix) AS run FROM stepped
), clean AS (
  SELECT conv_id, run::BIGINT AS run, min(turn)::DOUBLE AS "start",
         (max(turn) + 1)::DOUBLE AS "end", any_value(text) AS text
  FROM numbered GROUP BY conv_id, run
)"""


def augmented_turns(spark: SparkSession, folder: str) -> DataFrame:
    labelled = intervals.interval_label(
        clean_turns(spark, folder), literal_intervals(CHAPTERS, "title"), "chapters", "title",
        fill="forward", key="conv_id", order="run",
    )
    heat = literal_intervals(HEAT, "value", value_type="double")
    return intervals.interval_label(labelled, heat, "heatmap", "value", default=0.0)


AUGMENTED_SQL = f"""{CLEAN_TURNS_SQL}, labelled AS (
  SELECT *, {_case(CHAPTERS, "title")} AS label, {_case(HEAT, "value", "0.0::DOUBLE")} AS heatmap
  FROM clean
), filled AS (
  SELECT conv_id, run, "start", "end", text, heatmap,
         last_value(label IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY run
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chapters
  FROM labelled
)"""


def augmented_videos(spark: SparkSession, folder: str) -> DataFrame:
    """Captions labelled from the lists of their own video; some videos lack one, a heat is null."""
    turns = load(spark, folder, "conversations")
    n, conv = F.col("n"), F.col("conv_id")

    def spans(value: str, rows: list[tuple]) -> Column:
        parts = [(start, end, what) for start, end, what in rows]
        return F.array(
            *[
                F.struct(s.alias("start_time"), e.alias("end_time"), w.alias(value))
                for s, e, w in parts
            ]
        )

    chapters = spans("title", [
        (F.lit(0.0), F.lit(1.5), F.lit("opening")), (F.lit(1.0), n - 1, F.concat(F.lit("part "), conv)),
        (n, n + 5, F.lit("after")),
    ])
    heat = spans("value", [
        (F.lit(0.0), F.lit(2.0), conv.cast("double")), (F.lit(2.0), F.lit(3.0), F.lit(None).cast("double")),
        (F.lit(3.0), n, F.lit(0.25)),
    ])
    sizes = turns.groupBy("conv_id").agg((F.max("turn") + 1.0).alias("n"))
    info = sizes.select(
        "conv_id",
        F.when(conv % 4 != 0, chapters).alias("chapters"),
        F.when(conv % 5 != 0, heat).alias("heatmap"),
    )
    return intervals.augment_captions(clean_turns(spark, folder), info, "conv_id")


AUGMENTED_VIDEOS_SQL = f"""WITH {CLEAN_TURNS_SQL}, sizes AS (
  SELECT conv_id, max(turn) + 1.0::DOUBLE AS n FROM conversations GROUP BY conv_id
), labelled AS (
  SELECT c.*,
    CASE WHEN conv_id % 4 = 0 THEN NULL WHEN "start" >= 0 AND "end" <= 1.5 THEN 'opening'
         WHEN "start" >= 1 AND "end" <= n - 1 THEN 'part ' || conv_id
         WHEN "start" >= n AND "end" <= n + 5 THEN 'after' END AS label,
    CASE WHEN conv_id % 5 = 0 THEN 0.0::DOUBLE WHEN "start" >= 0 AND "end" <= 2 THEN conv_id::DOUBLE
         WHEN "start" >= 2 AND "end" <= 3 THEN NULL WHEN "start" >= 3 AND "end" <= n THEN 0.25::DOUBLE
         ELSE 0.0::DOUBLE END AS heat
  FROM clean c JOIN sizes USING (conv_id)
)
SELECT conv_id, run, "start", "end", text,
       last_value(label IGNORE NULLS) OVER w AS chapters, last_value(heat IGNORE NULLS) OVER w AS heatmap
FROM labelled WINDOW w AS (PARTITION BY conv_id ORDER BY run
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def chapter_text(spark: SparkSession, folder: str) -> DataFrame:
    return texts.chapters_content(augmented_turns(spark, folder), key="conv_id")


CHAPTER_TEXT_SQL = f"""WITH {AUGMENTED_SQL}
SELECT conv_id, chapters, min(run)::BIGINT AS first_seen,
       string_agg(text, ' ' ORDER BY run) AS content
FROM filled GROUP BY conv_id, chapters"""


def collapse_lines(spark: SparkSession, folder: str) -> DataFrame:
    return runs.collapse_lines(text_table(spark, folder), "doc_id")


COLLAPSE_LINES_SQL = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) - 1 AS ix, unnest(parts) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
), stepped AS (
  SELECT *, CASE WHEN ix > 0 AND text IS DISTINCT FROM lag(text) OVER w THEN 1 ELSE 0 END AS step
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY ix)
), numbered AS (
  SELECT *, sum(step) OVER (PARTITION BY doc_id ORDER BY ix) AS run FROM stepped
)
SELECT doc_id, run::BIGINT AS run, min(ix)::INTEGER AS first_line, max(ix)::INTEGER AS last_line,
       any_value(text) AS text
FROM numbered GROUP BY doc_id, run"""


def event_runs(spark: SparkSession, folder: str) -> DataFrame:
    events = load(spark, folder, "events").select(
        "user_id", "ts", "event_id", "event_type",
        _micros().alias("start"), _micros().alias("end"),
    )
    return runs.collapse_runs(events, "user_id", ["ts", "event_id"], "event_type")


EVENT_RUNS_SQL = """
WITH stepped AS (
  SELECT *, CASE WHEN row_number() OVER w > 1 AND event_type IS DISTINCT FROM lag(event_type) OVER w
            THEN 1 ELSE 0 END AS step
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), numbered AS (
  SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM stepped
)
SELECT user_id, run::BIGINT AS run, min(epoch_us(ts)) AS "start", max(epoch_us(ts)) AS "end",
       any_value(event_type) AS event_type
FROM numbered GROUP BY user_id, run"""


def _day_spans(spark: SparkSession, folder: str) -> DataFrame:
    events = load(spark, folder, "events")
    start = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("double")
    return events.select("user_id", "ts", "event_id", start.alias("start"), (start + 600).alias("end"))


def label_intervals(spark: SparkSession, folder: str) -> DataFrame:
    spans = _day_spans(spark, folder)
    part = literal_intervals(DAY_PARTS, "title")
    busy = literal_intervals(LOAD, "value", value_type="double")
    labelled = intervals.interval_label(
        spans, part, "part", "title", fill="forward", key="user_id", order=["ts", "event_id"]
    )
    return intervals.interval_label(labelled, busy, "load", "value", default=0.0).drop("ts")


LABEL_INTERVALS_SQL = f"""
WITH spans AS (
  SELECT user_id, ts, event_id,
         (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::DOUBLE AS "start",
         (hour(ts) * 3600 + minute(ts) * 60 + second(ts) + 600)::DOUBLE AS "end"
  FROM events
), labelled AS (
  SELECT *, {_case(DAY_PARTS, "title")} AS label, {_case(LOAD, "value", "0.0::DOUBLE")} AS load
  FROM spans
)
SELECT user_id, event_id, "start", "end", load,
       last_value(label IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part
FROM labelled"""


def label_from_table(spark: SparkSession, folder: str) -> DataFrame:
    events = load(spark, folder, "events").select(
        "user_id", "event_id", "event_type", (_micros() / 1e6).alias("start")
    )
    spans = events.select("user_id", "event_id", "start", (F.col("start") + 60).alias("end"))
    opened = events.where(F.col("event_type") == "purchase").select(
        "user_id",
        F.col("event_id").alias("position"),
        F.col("start").alias("start_time"),
        (F.col("start") + 86400 * (1 + F.col("event_id") % 5)).alias("end_time"),
        F.concat(F.lit("after "), F.col("event_id").cast("string")).alias("title"),
    )
    return intervals.interval_table_label(
        spans, opened, "user_id", "event_id", "part", "title", "position", default="none"
    ).select("user_id", "event_id", "part")


LABEL_FROM_TABLE_SQL = """
WITH spans AS (SELECT user_id, event_id, event_type, epoch_us(ts) / 1e6 AS "start" FROM events),
hits AS (
  SELECT s.user_id, s.event_id, min(i.event_id) AS hit
  FROM spans s JOIN spans i ON s.user_id = i.user_id AND i.event_type = 'purchase'
   AND s."start" >= i."start" AND s."start" + 60 <= i."start" + 86400 * (1 + i.event_id % 5)
  GROUP BY s.user_id, s.event_id
)
SELECT e.user_id, e.event_id, coalesce('after ' || hit, 'none') AS part
FROM events e LEFT JOIN hits h ON e.event_id = h.event_id"""


def _gaps(spark: SparkSession, folder: str) -> DataFrame:
    events = load(spark, folder, "events")
    return events.select(
        "user_id", "ts", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("value")
    )


def fill_gaps(spark: SparkSession, folder: str) -> DataFrame:
    gaps, order = _gaps(spark, folder), ["ts", "event_id"]
    filled = runs.forward_fill(gaps, "user_id", order, "value", "before")
    filled = runs.forward_fill(filled, "user_id", order, "value", "after", backward=True)
    return filled.select("user_id", "event_id", "value", "before", "after")


FILL_GAPS_SQL = """
WITH gaps AS (
  SELECT user_id, ts, event_id, CASE WHEN event_type = 'purchase' THEN value END AS value FROM events
)
SELECT user_id, event_id, value,
       last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before,
       first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
         ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after
FROM gaps"""


def conversation_content(spark: SparkSession, folder: str) -> DataFrame:
    return texts.content(load(spark, folder, "conversations"), "conv_id", "turn")


def role_content(spark: SparkSession, folder: str) -> DataFrame:
    return texts.group_captions(load(spark, folder, "conversations"), "role", "conv_id", "turn", "\n")


def seconds(spark: SparkSession, folder: str) -> DataFrame:
    clock = F.date_format("ts", "HH:mm:ss.SSS")
    return load(spark, folder, "events").select(
        "event_id",
        F.round(to_seconds(clock), 3).alias("seconds"),
        F.round(to_seconds(F.substring(clock, 4, 9)), 3).alias("seconds_of_hour"),
    )


SECONDS_SQL = """
SELECT event_id,
       round(hour(ts) * 3600 + minute(ts) * 60 + second(ts) + (epoch_us(ts) // 1000 % 1000) / 1000.0, 3)::DOUBLE
         AS seconds,
       round(minute(ts) * 60 + second(ts) + (epoch_us(ts) // 1000 % 1000) / 1000.0, 3)::DOUBLE
         AS seconds_of_hour
FROM events"""


def strip_text(spark: SparkSession, folder: str) -> DataFrame:
    padded = F.concat(F.lit(" \t\n"), F.col("text"), F.lit("\r\n "))
    return load(spark, folder, "documents").select(
        "doc_id", strip(padded).alias("text"), F.length(strip(padded)).cast("bigint").alias("n")
    )


STRIP_SQL = r"""
WITH s AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM documents)
SELECT doc_id, text, length(text) AS n FROM s"""


def split_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = runs.split_lines(load(spark, folder, "documents").select("doc_id", "text"), "text")
    return lines.drop("text")


def parsed_cues(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations written as subtitle files, then read: blocks, times, tags, white space."""
    turns = load(spark, folder, "conversations")
    clock = F.format_string("%02d:%02d:%02d.500", F.lit(0), F.floor(F.col("turn") / 60).cast("int"), (F.col("turn") % 60).cast("int"))
    later = F.format_string("%02d:%02d.750", F.floor(F.col("turn") / 60).cast("int"), (F.col("turn") % 60).cast("int"))
    line = F.regexp_replace(F.col("text"), r"[\s<>]+", " ")
    block = F.concat(clock, F.lit(" --> "), later, F.lit(" align:start\n <c>"), line, F.lit("</c>\n"))
    files = texts.content(
        turns.select("conv_id", "turn", block.alias("text")), "conv_id", "turn", separator="\n", out="value"
    )
    headed = files.select("conv_id", F.concat(F.lit("WEBVTT\n\nNOTE made\n\n"), "value").alias("value"))
    return parse_cues(headed)


PARSED_CUES_SQL = r"""
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS cue_ix,
       turn + 0.5::DOUBLE AS "start", turn + 0.75::DOUBLE AS "end",
       trim(regexp_replace(text, '[\s<>]+', ' ', 'g')) AS text
FROM conversations"""


def video_info(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as info files: some lack fields, some are cut JSON, some have null chapters."""
    docs = load(spark, folder, "documents")
    chapter = F.array(
        F.struct(F.lit(0.0).alias("start_time"), F.col("n_chars").cast("double").alias("end_time"),
                 F.col("lang").alias("title"))
    )
    record = F.to_json(
        F.struct(
            F.col("source").alias("title"),
            F.col("source").alias("fulltitle"),
            F.col("text").alias("description"),
            F.when(F.col("doc_id") % 5 != 0, F.col("n_chars")).alias("duration"),
            F.array("lang").alias("categories"),
            F.array("lang", "source").alias("tags"),
            F.when(F.col("doc_id") % 3 != 0, chapter).alias("chapters"),
            F.col("source").alias("playlist_title"),
            F.col("lang").alias("language"),
        )
    )
    cut = F.when(F.col("doc_id") % 7 == 0, F.expr("concat('{', substring(__json, 3))")).otherwise(F.col("__json"))
    files = docs.withColumn("__json", record).select("doc_id", cut.alias("metadata"))
    info = parse_video_info(files)
    return info.select(
        "doc_id", "title", "duration", F.size("tags").alias("n_tags"),
        F.size("chapters").alias("n_chapters"),
        F.get("chapters", F.lit(0))["title"].alias("first_chapter"),
        (F.length("description")).cast("bigint").alias("n_description"), "error",
    ).where(F.col("doc_id") % 7 != 0).unionByName(
        info.where(F.col("doc_id") % 7 == 0).select(
            "doc_id", F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("duration"),
            F.lit(None).cast("int").alias("n_tags"), F.size("chapters").alias("n_chapters"),
            F.lit(None).cast("string").alias("first_chapter"), F.lit(None).cast("bigint").alias("n_description"),
            "error",
        )
    )


VIDEO_INFO_SQL = """
SELECT doc_id,
       CASE WHEN doc_id % 7 <> 0 THEN source END AS title,
       CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 <> 0 THEN n_chars::INTEGER END AS duration,
       CASE WHEN doc_id % 7 <> 0 THEN 2 END AS n_tags,
       CASE WHEN doc_id % 7 <> 0 AND doc_id % 3 <> 0 THEN 1 ELSE 0 END AS n_chapters,
       CASE WHEN doc_id % 7 <> 0 AND doc_id % 3 <> 0 THEN lang END AS first_chapter,
       CASE WHEN doc_id % 7 <> 0 THEN length(text) END AS n_description,
       CASE WHEN doc_id % 7 = 0 THEN 'malformed JSON'
            WHEN doc_id % 5 = 0 THEN 'missing: duration' END AS error
FROM documents"""


#: Files that a task writes, about.
FILES_PER_TASK = 32


def _files(df: DataFrame, spark: SparkSession, name: str) -> str:
    """Write one text file per conversation below a folder of its own; returns the root folder.

    Time goes by files and not by bytes, so files are what is dealt to tasks.
    """
    path = scratch_path(spark, name)
    tasks = max(1, -(-df.count() // FILES_PER_TASK))
    df.repartition(tasks, "conv_id").write.partitionBy("conv_id").text(path)
    return path


def _of_folder(video: str = "video_id") -> Column:
    return F.regexp_extract(video, r"conv_id=(\d+)", 1).cast("bigint").alias("conv_id")


def caption_files(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations written to a folder of video folders and read from the root; cues hold blank lines."""
    turn, text = F.col("turn"), F.regexp_replace(F.col("text"), r"[\s<>]+", " ")
    clock = F.format_string("%02d:%02d.500", F.floor(turn / 60).cast("int"), (turn % 60).cast("int"))
    later = F.format_string("%02d:%02d.750", F.floor(turn / 60).cast("int"), (turn % 60).cast("int"))
    block = F.concat(clock, F.lit(" --> "), later, F.lit("\n \nsaid <c>"), text, F.lit("</c>\n \nend\n"))
    cues = load(spark, folder, "conversations").select("conv_id", "turn", block.alias("text"))
    files = texts.content(cues, "conv_id", "turn", separator="\n", out="value")
    headed = files.select("conv_id", F.concat(F.lit("WEBVTT\n\n"), "value").alias("value"))
    found = read_captions(spark, _files(headed, spark, "subtitles"), "*.txt")
    return found.select(_of_folder(), "cue_ix", "start", "end", "text")


CAPTION_FILES_SQL = r"""
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS cue_ix,
       turn + 0.5::DOUBLE AS "start", turn + 0.75::DOUBLE AS "end",
       'said ' || regexp_replace(text, '[\s<>]+', ' ', 'g') || chr(10) || ' ' || chr(10) || 'end' AS text
FROM conversations"""


def video_files(spark: SparkSession, folder: str) -> DataFrame:
    """Info files of conversations, read from the root folder."""
    turns = load(spark, folder, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("n"))
    name = F.concat(F.lit("video "), "conv_id")
    record = F.to_json(
        F.struct(
            name.alias("title"), name.alias("fulltitle"), F.lit("").alias("description"),
            F.col("n").alias("duration"), F.array(F.lit("a")).alias("categories"),
            F.array(name).alias("tags"), F.lit("list").alias("playlist_title"), F.lit("en").alias("language"),
        )
    )
    cut = F.when(F.col("conv_id") % 7 == 0, F.expr("substring(__json, 2)")).otherwise(F.col("__json"))
    files = turns.withColumn("__json", record).select("conv_id", cut.alias("value"))
    info = read_video_info(spark, _files(files, spark, "videos"), "*.txt")
    broken = F.col("error").isNotNull()
    return info.select(
        _of_folder(), F.when(~broken, F.col("title")).alias("title"),
        F.when(~broken, F.col("duration")).alias("duration"), "error",
    )


VIDEO_FILES_SQL = """
SELECT conv_id, CASE WHEN conv_id % 7 <> 0 THEN 'video ' || conv_id END AS title,
       CASE WHEN conv_id % 7 <> 0 THEN count(*)::INTEGER END AS duration,
       CASE WHEN conv_id % 7 = 0 THEN 'malformed JSON' END AS error
FROM conversations GROUP BY conv_id"""


def load_status(spark: SparkSession, folder: str) -> DataFrame:
    """Roles as subtitle files of a conversation: system is preferred, user the fallback."""
    turns = load(spark, folder, "conversations")
    captions = turns.select(F.col("conv_id").alias("video_id"), F.col("role").alias("file_name"), "turn", "text")
    info = turns.groupBy(F.col("conv_id").alias("video_id")).agg(
        F.when(F.count("*") == 1, F.lit("malformed JSON")).alias("error")
    )
    return load_videos(info, captions, "system", "user")[1]


LOAD_STATUS_SQL = """
WITH files AS (
  SELECT conv_id AS video_id, count(*) AS n, bool_or(role = 'system') AS preferred,
         bool_or(role = 'user') AS fallback
  FROM conversations GROUP BY conv_id
), chosen AS (
  SELECT video_id, CASE WHEN preferred THEN 'system' WHEN fallback THEN 'user' END AS file_name,
         CASE WHEN n = 1 THEN 'malformed JSON' WHEN NOT preferred AND NOT fallback
              THEN 'no subtitle file' END AS error
  FROM files
)
SELECT video_id, file_name, file_name = 'user' AS is_fallback, error IS NULL AS successful, error
FROM chosen"""


def loaded_captions(spark: SparkSession, folder: str) -> DataFrame:
    turns = load(spark, folder, "conversations")
    captions = turns.select(F.col("conv_id").alias("video_id"), F.col("role").alias("file_name"), "turn", "text")
    info = turns.groupBy(F.col("conv_id").alias("video_id")).agg(
        F.when(F.count("*") == 1, F.lit("malformed JSON")).alias("error")
    )
    return load_videos(info, captions, "system", "user")[0]


LOADED_CAPTIONS_SQL = """
WITH files AS (
  SELECT conv_id, CASE WHEN bool_or(role = 'system') THEN 'system' ELSE 'user' END AS file_name
  FROM conversations GROUP BY conv_id HAVING count(*) > 1
)
SELECT c.conv_id AS video_id, c.role AS file_name, turn, text
FROM conversations c JOIN files f ON c.conv_id = f.conv_id AND c.role = f.file_name"""


QUERIES = {
    "chapter_text": Query(chapter_text, CHAPTER_TEXT_SQL),
    "augmented_captions": Query(
        augmented_turns, f"WITH {AUGMENTED_SQL} SELECT * FROM filled"
    ),
    "augmented_videos": Query(augmented_videos, AUGMENTED_VIDEOS_SQL),
    "read_caption_files": Query(caption_files, CAPTION_FILES_SQL),
    "read_video_files": Query(video_files, VIDEO_FILES_SQL),
    "clean_captions": Query(clean_turns, f"WITH {CLEAN_TURNS_SQL} SELECT * FROM clean"),
    "collapse_lines": Query(collapse_lines, COLLAPSE_LINES_SQL),
    "event_runs": Query(event_runs, EVENT_RUNS_SQL),
    "label_intervals": Query(label_intervals, LABEL_INTERVALS_SQL),
    "label_from_table": Query(label_from_table, LABEL_FROM_TABLE_SQL),
    "fill_gaps": Query(fill_gaps, FILL_GAPS_SQL),
    "conversation_content": Query(
        conversation_content,
        "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS content FROM conversations GROUP BY conv_id",
    ),
    "role_content": Query(
        role_content,
        "SELECT conv_id, role, string_agg(text, chr(10) ORDER BY turn) AS content,"
        " min(turn) AS first_seen FROM conversations GROUP BY conv_id, role",
    ),
    "to_seconds": Query(seconds, SECONDS_SQL),
    "strip_text": Query(strip_text, STRIP_SQL),
    "split_lines": Query(
        split_lines,
        "SELECT doc_id, (generate_subscripts(parts, 1) - 1)::INTEGER AS line_ix,"
        " unnest(parts) AS sentences"
        " FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)",
    ),
    "read_captions": Query(parsed_cues, PARSED_CUES_SQL),
    "read_video_info": Query(video_info, VIDEO_INFO_SQL),
    "load_videos": Query(loaded_captions, LOADED_CAPTIONS_SQL),
    "load_status": Query(load_status, LOAD_STATUS_SQL),
}
