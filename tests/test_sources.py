import json

import pytest
from conftest import rows

from topicloom.operators.columns import Step, chain, fit_scaler, observe, process_all
from topicloom.operators.intervals import augment_captions
from topicloom.operators.runs import clean_captions
from topicloom.operators.content import chapters_content
from topicloom.sources.captions import load_videos, read_captions, read_video_info
from topicloom.sources.tables import read_content, write_content
from topicloom.streaming.ingest import append_batches, stream_captions

PREFERRED, FALLBACK = "subtitle.en-US.vtt", "auto-subtitle.en.vtt"
ROLLING = """WEBVTT
Kind: captions

STYLE
::cue { color: red }

00:00:00.000 --> 00:00:02.000 align:start
<c>first</c> line

1
00:00:02.000 --> 00:00:04.500
first line
second line

00:04.500 --> 00:07.000
second line
third<00:00:05.000> line
"""
INFO = {
    "title": "T", "fulltitle": "T full", "description": "d", "duration": 7, "categories": ["c"],
    "tags": ["a", "b"], "playlist_title": "p", "language": "en", "formats": [{"id": 1}],
    "chapters": [{"start_time": 0.0, "end_time": 5.0, "title": "one"},
                 {"start_time": 4.5, "end_time": 7.0, "title": "two"}],
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("videos")
    videos = {
        "both": (INFO, {PREFERRED: ROLLING, FALLBACK: ROLLING.replace("line", "word")}),
        "auto": ({**INFO, "chapters": None}, {FALLBACK: ROLLING.replace("\n", "\r\n")}),
        "none": (INFO, {}),
        "broken": ('{"title": ', {PREFERRED: ROLLING}),
        "short": ({k: v for k, v in INFO.items() if k not in ("duration", "tags")}, {PREFERRED: ROLLING}),
        "lone": (None, {PREFERRED: ROLLING}),
    }
    for name, (info, files) in videos.items():
        (root / name).mkdir()
        if info is not None:
            text = info if isinstance(info, str) else json.dumps(info)
            (root / name / "video.info.json").write_text(text)
        for file, text in files.items():
            (root / name / file).write_bytes(text.encode())
    return str(root)


@pytest.fixture(scope="module")
def loaded(spark, folder):
    info = read_video_info(spark, f"{folder}/*/video.info.json")
    captions = read_captions(spark, f"{folder}/*/*.vtt")
    return info, captions, *load_videos(info, captions, PREFERRED, FALLBACK)


def test_cues(loaded):
    cues = loaded[1].where(f"video_id = 'both' and file_name = '{PREFERRED}'")
    assert rows(cues, "cue_ix", "start", "end", "text") == [
        (0, 0.0, 2.0, "first line"),
        (1, 2.0, 4.5, "first line\nsecond line"),
        (2, 4.5, 7.0, "second line\nthird line"),
    ]


def test_info(loaded):
    found = {r.video_id: r for r in loaded[0].collect()}
    assert found["both"].error is None and found["both"].duration == 7
    assert json.loads(found["both"].formats) == [{"id": 1}]
    assert [c.title for c in found["both"].chapters] == ["one", "two"]
    assert found["auto"].chapters == [] and found["both"].heatmap == []
    assert found["broken"].error == "malformed JSON"
    assert found["short"].error == "missing: duration, tags"
    assert json.loads(found["both"].metadata) == INFO


def test_status(loaded):
    found = {r.video_id: (r.file_name, r.is_fallback, r.successful, r.error) for r in loaded[3].collect()}
    assert found["both"] == (PREFERRED, False, True, None)
    assert found["auto"] == (FALLBACK, True, True, None)
    assert found["none"] == (None, None, False, "no subtitle file")
    assert found["broken"][2:] == (False, "malformed JSON")
    assert found["short"][2:] == (False, "missing: duration, tags")
    assert found["lone"][2:] == (False, "no info file")


def test_folder_to_chapter_text(loaded):
    info, _, chosen, _ = loaded
    captions = augment_captions(clean_captions(chosen), info.where("error is null"))
    assert rows(chapters_content(captions), "video_id", "chapters", "content") == [
        ("auto", None, "first line second line third line"),
        ("both", "one", "first line second line"),
        ("both", "two", "third line"),
    ]


def test_content_csv(spark, tmp_path):
    data = [("1", 'a "b", c', None, "x\n\ny,\"z\""), ("2", "", "ch", None), ("3", "t", "", "\\N?\\")]
    df = spark.createDataFrame(data, "video_id string, video_title string, chapter string, content string")
    for kind in ("csv", "parquet"):
        write_content(df, str(tmp_path / kind), kind)
        assert rows(read_content(spark, str(tmp_path / kind), format=kind)) == rows(df)


def test_streamed_folder(spark, folder, tmp_path, loaded):
    out = str(tmp_path / "out")
    stream = stream_captions(spark, folder, files_per_batch=2)
    query = append_batches(
        stream, out, str(tmp_path / "progress"),
        lambda d: clean_captions(d, ["video_id", "file_name"]),
    )
    assert query.awaitTermination(120)
    streamed = spark.read.parquet(out).drop("batch")
    batch = clean_captions(loaded[1], ["video_id", "file_name"])
    assert rows(streamed, *batch.columns) == rows(batch)


def test_outcomes(spark):
    df = spark.createDataFrame([(1, "4"), (2, "x"), (3, None)], "id int, t string")
    found = process_all(df, "t", int, [lambda v: v * 2], "long").orderBy("id").collect()
    assert [r.value for r in found] == [8, None, None]
    assert [r.successful for r in found] == [True, False, False]
    assert found[1].error.startswith("ValueError")


def test_chain_checks_columns_first(spark):
    df = spark.range(3)
    add = Step(lambda d: d.withColumn("a", d.id + 1), frozenset({"id"}), frozenset({"a"}))
    use = Step(lambda d: d.withColumn("b", d.a * 2), frozenset({"a"}), frozenset({"b"}))
    assert chain(df, [add, use]).agg({"b": "sum"}).first()[0] == 12
    with pytest.raises(ValueError, match="step 0 needs"):
        chain(df, [use, add])


def test_scaler_constant_column(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 5.0)], "id int, a double, b double")
    scaler = fit_scaler(df, ["id"])
    assert rows(scaler.transform(df)) == [(1, -1.0, 0.0), (2, 1.0, 0.0)]
    assert rows(scaler.inverse_transform(scaler.transform(df))) == rows(df)


def test_observe(spark):
    from pyspark.sql import functions as F

    df, seen = observe(spark.range(10), "seen", F.count("*").alias("n"))
    assert df.where("id > 4").count() == 5
    assert seen.get["n"] == 10


def test_root_folder_and_lines_of_white_space(spark, tmp_path):
    for video, text in (("a", "first\n \nthird"), ("b/c", "\n \nwelcome<00:00:01.000><c> to</c>")):
        (tmp_path / video).mkdir(parents=True)
        cue = f"WEBVTT\r\n\r\n00:00.000 --> 00:02.389 align:start\n{text}\n\nNOTE x\n"
        (tmp_path / video / "s.vtt").write_text(cue)
        (tmp_path / video / "video.info.json").write_text("{}")
    found = rows(read_captions(spark, str(tmp_path)), "video_id", "file_name", "start", "end", "text")
    assert found == [("a", "s.vtt", 0.0, 2.389, "first\n \nthird"), ("c", "s.vtt", 0.0, 2.389, "welcome to")]
    assert rows(read_captions(spark, f"{tmp_path}/*/*.vtt"), "video_id") == [("a",)]
    assert rows(read_video_info(spark, str(tmp_path)), "video_id") == [("a",), ("c",)]


def test_files_of_conversations_are_dealt_to_tasks(spark):
    from pyspark.sql import functions as F

    from topicloom.plans import captions as plans

    turns = spark.range(100).select(F.col("id").alias("conv_id"), F.lit("text").alias("value"))
    files = turns.groupBy("conv_id").agg(F.first("value").alias("value"))
    found = spark.read.text(plans._files(files, spark, "videos"), wholetext=True, recursiveFileLookup=True)
    names = [r.n for r in found.select(F.col("_metadata.file_name").alias("n")).collect()]
    assert len(names) == 100 and len({n[:10] for n in names}) == 4
