"""The registered queries and the pipeline against plain Python, on whole tables."""

import hashlib

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from topicloom.llm import language, queries
from topicloom.llm.sample import crc_remainder
from topicloom.sources.tables import load

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in load(spark, FOLDER, "documents").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def library():
    ranks = queries.vocabulary().ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digests(library, i, text):
    ids = library.encode_ordinary(text)
    raw = np.array(ids, "<u4").tobytes()
    return (i, len(ids), hashlib.sha256(raw).hexdigest(), brute.sha(text.encode()))


def test_every_operator_has_a_query():
    names = set(entry.queries())
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names


def test_repeated_bytes(spark, documents):
    found = entry.queries()["op5_suffixes"](spark, FOLDER)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = sorted((*r[:4], brute.sha(r[4])) for r in brute.repeated_bytes(documents))
    assert sorted(map(tuple, found.collect())) == want


def test_tokens(spark, documents, library):
    found = entry.queries()["op7_bpe"](spark, FOLDER)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, found.collect())) == sorted(digests(library, i, t) for i, t in documents)


@pytest.mark.parametrize("name,divisor,held", [("op1_quality", 3, 1), ("op3_toxicity", 5, 0), ("op4_language", 5, 0)])
def test_held_out_rows(spark, name, divisor, held):
    found = entry.queries()[name](spark, FOLDER)
    assert found.where(F.col("held_out") != (crc_remainder("doc_id", divisor) == held)).count() == 0
    assert found.count() == load(spark, FOLDER, "documents").count()
    assert found.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def brute_pipeline(model, docs, items, library):
    """The stages one after another; also the ids that each one leaves."""
    left = []
    labelled = language._label(model, [t or "" for _, t in docs], language.SWITCH)
    docs = [d for d, (lang, _, _) in zip(docs, labelled, strict=True) if lang != "und"]
    left.append({i for i, _ in docs})
    groups = brute.near_duplicates(docs, 80)
    docs = [d for d in docs if groups[d[0]][1] == d[0]]
    left.append({i for i, _ in docs})
    cut = {i: (n, gone, kept.decode()) for i, n, gone, kept in brute.repeated_words(docs)}
    docs = [(i, cut[i][2] if cut[i][1] else t) for i, t in docs if cut[i][1] < cut[i][0] or not cut[i][1]]
    left.append({i for i, _ in docs})
    leaked = {i for i, _ in brute.leaks(docs, items)}
    docs = [d for d in docs if d[0] not in leaked]
    left.append({i for i, _ in docs})
    return left, sorted(digests(library, i, t) for i, t in docs)


def test_pipeline(spark, documents, library):
    docs = load(spark, FOLDER, "documents")
    items = [tuple(r) for r in load(spark, FOLDER, "benchmark").select("item_id", "text").collect()]
    left, want = brute_pipeline(queries.fitted_language(docs), documents, items, library)
    assert len(left[0]) > len(left[1]) > len(left[3])
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language", "near_duplicates", "repeats", "benchmark", "tokens"
    ]
    found = entry.queries()["pipeline"](spark, FOLDER)
    got = found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == want


LONG = " ".join(f"w{i}" for i in range(40))
ODD = [
    (1, LONG, "en"), (1, LONG, "en"), (1, LONG + " other", "en"), (2, LONG, None), (3, None, "en"), (4, "", "en"),
    (5, "123", "en"), (None, "no id but words", "en"), (None, "no id but words", "en"), (None, None, None),
    (6, "start " + LONG[:100] + " und so weiter", "de"), (7, "word " * 30_000, "en"),
]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, score int"
    rows = [(i, t, lang, "s", len(t or ""), 1, "r", 2) for i, t, lang in ODD]
    docs = spark.createDataFrame(rows, schema).repartition(2)
    found = stage(spark, docs, FOLDER)
    if name != "tokens":
        assert found.columns == docs.columns
        assert {f.name: f.dataType for f in found.schema} == {f.name: f.dataType for f in docs.schema}
    got = found.collect()
    ids = sorted((r.doc_id for r in got), key=str)
    if name == "language":
        assert ids == sorted([1, 1, 1, 2, 6, 7, None, None], key=str)
    elif name == "near_duplicates":
        assert ids == sorted([1, 3, 4, 5, 6, 7, None, None, None], key=str)
    elif name == "repeats":
        assert ids == sorted([1, 1, 1, 3, 4, 5, 6, 7, None, None, None], key=str)
        assert next(r for r in got if r.doc_id == 6).text == "start " + LONG[:100].rpartition(" ")[2] + " und so weiter"
    else:
        assert len(got) == len(ODD)
    assert stage(spark, docs.where("doc_id > 99"), FOLDER).collect() == []


def test_rows_of_one_id_are_documents_of_their_own(spark):
    texts = [" ".join(f"{w}{i}" for i in range(30)) for w in "abc"]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1] + " end"), (2, texts[1]), (3, texts[2]), (None, texts[2])]
    docs = spark.createDataFrame(
        [(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"
    )
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    found = sorted(((r.doc_id, r.text) for r in stage(spark, docs, FOLDER).collect()), key=repr)
    assert found == sorted([(1, texts[0]), (1, texts[1]), (3, texts[2]), (None, texts[2])], key=repr)


def test_texts_of_several_languages_stay(spark):
    seen = load(spark, FOLDER, "documents").where("lang IS NOT NULL")
    parts = [r.text for r in seen.groupBy("lang").agg(F.max(F.substring("text", 1, 400)).alias("text")).collect()]
    mixed = spark.createDataFrame([(10**6, " ".join(parts))], "doc_id long, text string")
    docs = seen.unionByName(mixed, allowMissingColumns=True)
    stage = dict(corpus_pipeline.STAGES)["language"]
    assert stage(spark, docs, FOLDER).where("doc_id = 1000000").count() == 1


def test_words_that_powers_of_one_number_confuse(spark):
    """The word of 1,024 letters and its complement of which such hashes agree in all bits."""
    bits = [i.bit_count() % 2 for i in range(1024)]
    one, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    start = " ".join(f"w{i}" for i in range(12))
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(1, f"{start} {one}"), (2, f"{start} {other}")], schema)
    assert queries.substring.remove_repeats(docs).where("n_removed > 0").count() == 0
    alone = spark.createDataFrame([(1, one), (2, other)], schema)
    assert queries.minhash.near_duplicates(alone).where("kept").count() == 2


@pytest.mark.parametrize("name", ["language", "near_duplicates", "repeats", "tokens"])
def test_stages_send_texts_in_small_batches(spark, name):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(0, 600, 1, 1).selectExpr("id AS doc_id", "repeat('a b ', 5000) AS text")

    def rows_of_batches():
        sizes = lambda batches: (pa.RecordBatch.from_pydict({"doc_id": [b.num_rows]}) for b in batches)
        return [r.doc_id for r in texts.mapInArrow(sizes, "doc_id long").collect()]

    spark.conf.unset(setting)
    try:
        assert max(rows_of_batches()) == 600
        docs = spark.createDataFrame([(1, "a", None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
        dict(corpus_pipeline.STAGES)[name](spark, docs, FOLDER)
        assert max(rows_of_batches()) < 300
    finally:
        spark.conf.unset(setting)
