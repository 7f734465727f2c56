"""Terms packed on their way give what counts, scores and joins of rows give."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from topicloom.functions.text import hash_vector, tokens
from topicloom.operators import packed_terms, soft_topics, text_features, topics
from topicloom.operators.embedding import hashed_words

WORDS = "the soup oven garlic match goal team \u00e9t\u00e9 code loop test a1 \U0001d538\U0001d539 player".split()
SIZES, STOP = (1, 3), ("the", "loop")


@pytest.fixture(scope="module")
def docs(spark):
    """Ids that come twice, missing ids, topics, shares and texts, and texts without words."""
    noise = np.random.default_rng(4)
    data = []
    for i in range(150):
        text = " ".join(noise.choice(WORDS, noise.integers(0, 30)))
        # Rows of one id have one share, as any of several may count.
        p = p if i > 130 and i % 2 else [float(x) for x in noise.dirichlet([1, 1, 1])]
        data.append((None if i % 37 == 5 else i // 2 * 2 if i > 130 else i, None if i % 29 == 3 else text,
                     None if i % 23 == 7 else int(i % 3), None if i in (9, 40, 71) else p))
    return spark.createDataFrame(data, "doc_id long, text string, topic int, shares array<double>").repartition(5).cache()


@pytest.fixture(params=["one", "many"])
def small(request, monkeypatch):
    """Few letters to a chunk and to a bucket, or all in one."""
    if request.param == "many":
        monkeypatch.setattr(packed_terms, "CHUNK_LETTERS", 300)
        monkeypatch.setattr(packed_terms, "BUCKET_LETTERS", 400)
        monkeypatch.setattr(packed_terms, "SMALL_PART", 2_000)
        monkeypatch.setattr(packed_terms, "LEADERS", 5)


def close(found, expected):
    assert [r[:-1] for r in found] == [r[:-1] for r in expected]
    assert all(abs(a[-1] - b[-1]) < 2e-9 for a, b in zip(found, expected, strict=True))


def test_arrays_as_bytes():
    whole = [np.arange(5), np.array([], np.int64), np.array([1 << 40, 3]), np.array([0.1, -2.0]), np.array([70_000])]
    for a, b in zip(whole, packed_terms.unpack(packed_terms.pack(whole)), strict=True):
        assert a.tolist() == b.tolist()


def test_term_totals(docs, small):
    counts = text_features.count_vectorize(docs, "doc_id", sizes=SIZES, stop_words=STOP)
    expected = counts.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n"))
    found = packed_terms.term_totals(docs, sizes=SIZES, stop_words=STOP)
    assert rows(found, "term", "n_docs", "n") == rows(expected, "term", "n_docs", "n")


def test_classes(docs, small):
    found = packed_terms.class_terms(docs, "doc_id", "text", "topic", SIZES, STOP, True)
    options = {"sizes": SIZES, "stop_words": STOP}
    totals = text_features.class_totals(docs, "topic", **options)
    terms = topics.document_terms(docs, **options)
    counts = text_features.counts_side_by_side(terms, "topic", totals, F.col("tf"))
    scores = text_features.class_tfidf(counts, "topic", True, totals).cache()
    for column in ("n", "idf", "score"):
        close(rows(found.scores, "topic", "term", column), rows(scores, "topic", "term", column))
    near = topics.similarities(terms, scores, "doc_id", "topic", True).where("topic IS NOT NULL")
    close(rows(found.similar, "topic", "doc_id", "similarity"), rows(near, "topic", "doc_id", "similarity"))
    best = text_features.top_terms(scores.withColumn("score", F.round("score", 9)), "topic", 4)
    leading = text_features.top_terms(found.scores.withColumn("score", F.round("score", 9)), "topic", 4)
    assert rows(leading, "topic", "rank", "term") == rows(best, "topic", "rank", "term")


def test_shares(docs, small):
    options = {"sizes": SIZES, "stop_words": STOP}
    found = packed_terms.class_terms(docs, "doc_id", "text", "shares", SIZES, STOP, True, 3, 0.2, 9)
    terms = topics.document_terms(docs, extra=["shares"], **options)
    counts = soft_topics.soft_counts(terms, 3).cache()
    scores = text_features.class_tfidf(counts, "topic", True).withColumn("score", F.round("score", 9)).cache()
    for column in ("n", "score"):
        close(rows(found.scores, "topic", "term", column), rows(scores, "topic", "term", column))
    near = soft_topics.soft_representatives(terms, scores, least_share=0.2)
    mine = soft_topics._nearest(found.similar.where("doc_id IS NOT NULL"), "doc_id", 5)
    close(rows(mine, "topic", "doc_id", "similarity"), rows(near, "topic", "doc_id", "similarity"))


def test_what_goes_by_joins(docs, monkeypatch):
    """Very many classes or documents, and shares below 0."""
    many = docs.withColumn("topic", F.col("doc_id").cast("int"))
    assert packed_terms.class_terms(many, "doc_id", "text", "topic") is None
    below = docs.withColumn("shares", F.array(F.lit(-0.5), F.lit(1.5), F.lit(0.0)))
    assert packed_terms.class_terms(below, "doc_id", "text", "shares", topics=3) is None
    monkeypatch.setattr(packed_terms, "STATE_BYTES", 100)
    assert packed_terms.class_terms(docs, "doc_id", "text", "topic") is None


def test_topics_neither_join_nor_write_terms(docs, monkeypatch):
    """What is shuffled and written is packed: no table has a row for a term of a document."""

    def fail(*args, **options):
        raise AssertionError("a row per term and document")

    monkeypatch.setattr(topics, "document_terms", fail)
    monkeypatch.setattr(soft_topics, "document_terms", fail)
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "shares")
    assert topics.fit_topics(texts, k_range=range(2, 4), sizes=(1, 2)).info().count() >= 2
    assert soft_topics.describe_soft_topics(texts, 3, sizes=(1, 2))[2].count() == 3


def test_vectors_of_words(docs):
    found = docs.select(hashed_words(tokens(F.col("text")), 16).alias("a"), hash_vector(tokens(F.col("text")), 16).alias("b"))
    assert all(r.a == r.b and len(r.a) == 16 for r in found.collect())
