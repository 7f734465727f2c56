import math
from collections import Counter

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from topicloom.functions import stopwords
from topicloom.functions.text import collapse_repeats, first_element, ngrams, strip, to_seconds, topic_name
from topicloom.operators import text_features as features
from topicloom.operators.embedding import embed

TEXTS = ["The cat saw the cat.", "A dog; THE dog", "", "x_1 éé über, Über! a b c cat"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").cache()


def test_to_seconds(spark):
    df = spark.createDataFrame([("01:02:03.500",), ("02:03.5",), ("3.25",), ("1:0:0:0",)], "t string")
    assert [r[0] for r in df.select(to_seconds(F.col("t"))).collect()] == [3723.5, 123.5, 3.25, 216000.0]


def test_strip(spark):
    df = spark.createDataFrame([("\t a \n b\r\n",), ("",)], "t string")
    assert [r[0] for r in df.select(strip(F.col("t"))).collect()] == ["a \n b", ""]


def test_tokens(docs):
    def of(**options):
        return [r.tokens for r in features.tokenize(docs, "text", **options).orderBy("doc_id").collect()]

    assert of()[3] == ["x_1", "éé", "über", "über", "cat"]
    assert of(clean=False)[3] == ["x_1", "éé", "über", "Über", "cat"]
    # Stop words are met in any case, extra ones as the token comes out.
    assert of(clean=False, stop_words=["the"], extra_stop_words=["Über"])[1] == ["dog", "dog"]
    assert of(clean=False, extra_stop_words=["Über"])[3] == ["x_1", "éé", "über", "cat"]
    # Both lists count only when removing.
    kept = of(remove_stop_words=False, stop_words=["the"], extra_stop_words=["cat"])
    assert kept[0] == ["the", "cat", "saw", "the", "cat"]


def test_own_tokenizer(docs):
    def lemmas(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [w.rstrip(".;").replace("saw", "see") for w in t.split()])

    found = features.tokenize(docs, "text", stop_words=["the"], tokenizer=lemmas).orderBy("doc_id")
    assert found.first().tokens == ["cat", "see", "cat"]


def test_sentences_flatten_to_words(spark):
    df = spark.createDataFrame([(1, "One cat. Two dogs saw it! Three?")], "id int, text string")
    found = features.sentence_tokens(df, "text", stop_words=["it"]).first().tokens
    assert found == [["one", "cat"], ["two", "dogs", "saw"], ["three"]]


def test_collapse_repeats(spark):
    df = spark.createDataFrame([(["a", "a", None, None, "a"],), ([],), (["b"],)], "p array<string>")
    found = [[(r.run, r.first, r.last, r.value) for r in x[0]] for x in df.select(collapse_repeats(F.col("p"))).collect()]
    assert found == [[(0, 0, 1, "a"), (1, 2, 3, None), (2, 4, 4, "a")], [], [(0, 0, 0, "b")]]


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    assert [r[0] for r in df.select(ngrams(F.col("w"), (1, 3))).collect()] == [
        ["a", "b", "c", "a b", "b c", "a b c"], ["a"], [],
    ]
    assert [r[0] for r in df.select(ngrams(F.col("w"), (2, 2))).collect()] == [["a b", "b c"], [], []]


def test_counts(docs):
    found = features.count_vectorize(docs, "doc_id", sizes=(1, 2), stop_words=["the"])
    counts = {(r.doc_id, r.term): r.tf for r in found.collect()}
    words = ["cat", "saw", "cat"]
    expected = Counter(words + [" ".join(p) for p in zip(words, words[1:])])
    assert {t: n for (d, t), n in counts.items() if d == 0} == dict(expected)


def test_tfidf_has_unit_rows(docs):
    found = features.tfidf(docs, "doc_id")
    for r in found.groupBy("doc_id").agg(F.sum(F.col("tfidf") ** 2).alias("s")).collect():
        assert math.isclose(r.s, 1.0)


def test_hashing_collisions(docs):
    found = features.hashing_vectorize(docs, "doc_id", n_features=2)
    assert found.where("value = 0").count() == 0
    assert found.groupBy("doc_id", "bucket").count().where("count > 1").count() == 0


def test_class_tfidf(spark):
    data = [("a", "x", 3), ("a", "y", 1), ("b", "y", 4)]
    counts = spark.createDataFrame(data, "c string, term string, n long")
    found = {(r.c, r.term): r.score for r in features.class_tfidf(counts, "c").collect()}
    mean = 4
    assert math.isclose(found["a", "x"], 3 / 4 * math.log(1 + mean / 3))
    assert math.isclose(found["b", "y"], math.log(1 + mean / 5))
    rooted = {(r.c, r.term): r.score for r in features.class_tfidf(counts, "c", True).collect()}
    assert math.isclose(rooted["a", "y"], math.sqrt(1 / 4) * math.log(1 + mean / 5))


def test_top_terms_limit_before_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 as g", "cast(id as string) as term", "id * 1.0 as score")
    found = features.top_terms(df, "g", 5)
    assert found.count() == 15
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_counting_does_not_shuffle(docs):
    for df in (features.count_vectorize(docs, "doc_id", sizes=(1, 3)), features.hashing_vectorize(docs, "doc_id")):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_embeddings(docs):
    found = embed(docs, "text", dimensions=16).orderBy("doc_id").collect()
    assert [len(r.embedding) for r in found] == [16] * 4
    assert math.isclose(sum(x * x for x in found[0].embedding), 1.0)
    assert found[2].embedding == [0.0] * 16


def test_own_encoder(docs):
    def factory():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    found = embed(docs, "text", encoder=factory, normalize=False).orderBy("doc_id").collect()
    assert [r.embedding[0] for r in found] == [len(t) for t in TEXTS]


def test_names(spark):
    df = spark.createDataFrame([(3, list("abcdefg")), (4, [])], "t int, k array<string>")
    found = df.select(topic_name(F.col("t"), F.col("k")).alias("n"), first_element(F.col("k")).alias("f")).collect()
    assert found[0].n == "Topic 3: `a, b, c, d, e...`" and found[0].f == "a" and found[1].f is None


def test_english(spark):
    assert {"the", "and", "i"} <= set(stopwords.english(spark))


def test_summaries(spark):
    text = "common words here\nrare zebra\ncommon words here again"
    data = [(1, text), (2, "common words here"), (3, "."), (4, ""), (5, None)]
    df = spark.createDataFrame(data, "doc_id int, text string")
    found = {r.doc_id: r.summary for r in features.tfidf_summarize(df, "doc_id", n=1).collect()}
    assert found[2] == "common words here" and [found[i] for i in (3, 4, 5)] == [""] * 3
    assert rows(features.tfidf_summarize(df, "doc_id", n=9))[0] == (1, text)


@pytest.mark.parametrize("few", [True, False], ids=["map", "join"])
def test_lemmas(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(features, "LEMMAS_IN_ROW", 1)
    data = [(1, ["cats", "dog", "cats", "mice"]), (2, []), (3, None), (None, ["cats"]), (4, ["é'\"\\"])]
    df = spark.createDataFrame(data, "id long, tokens array<string>")
    table = [("cats", "cat"), ("cats", "catt"), ("mice", "mouse"), (None, "x"), ("dog", None), ("é'\"\\", "e")]
    lemmas = spark.createDataFrame(table, "term string, lemma string")
    found = {r.id: r.tokens for r in features.lemmatize(df, lemmas, "id").collect()}
    assert found[1] == ["cat", "dog", "cat", "mouse"] and found[2] == [] and found[3] is None and found[4] == ["e"]
    assert found[None] == ["cats"]
    none = features.lemmatize(df, lemmas.where("term = 'no'"), "id", out="same")
    assert all(r.same == r.tokens for r in none.collect())


@pytest.mark.parametrize("in_row", [64, 1])
def test_scores_of_classes_from_texts(spark, monkeypatch, in_row):
    """As from counts; a class may be null, a text may be missing, copies of a row count."""
    monkeypatch.setattr(features, "CLASSES_IN_ROW", in_row)
    data = [("a", "cat dog cat"), ("b", "dog cow the dog"), (None, "cow cat"), ("a", None), ("c", ""), ("a", "cat dog cat")]
    df = spark.createDataFrame(data, "kind string, text string")
    options = {"sizes": (1, 2), "stop_words": ["the"]}
    counts = features.class_counts(df, "kind", **options)
    expected = rows(features.class_tfidf(counts, "kind", True).select("kind", "term", "n", F.round("score", 9)))
    found = features.class_scores(df, "kind", **options, reduce_frequent_words=True)
    assert rows(found.select("kind", "term", "n", F.round("score", 9))) == expected


def test_texts_are_dealt_by_letters(spark, monkeypatch):
    df = spark.createDataFrame([(i, "word " * 20) for i in range(100)], "doc_id int, text string").coalesce(1)
    assert features.dealt(df).rdd.getNumPartitions() == 1
    monkeypatch.setattr(features, "LETTERS_PER_TASK", 500)
    assert features.dealt(df).rdd.getNumPartitions() == 20


@pytest.mark.parametrize("common", [100_000, 2])
def test_sentences_are_scored_without_sending_common_terms(spark, monkeypatch, common):
    """As by weights of terms joined with sentences, also for ids of several rows; null ids have no summary."""
    monkeypatch.setattr(features, "COMMON_TERMS", common)
    text = "one two two\nthree one\n\n  two four five "
    data = [(1, text), (2, "two six\nseven two"), (3, text), (3, "six six\ntwo"), (None, text), (4, None), (5, "one\none two")]
    df = spark.createDataFrame(data, "doc_id int, text string")
    places = features._places_of_terms(df, "doc_id", "text", "\n")
    found = {(r.doc_id, r.term): r["__places"] for r in places.where("doc_id = 1").collect()}
    assert found[1, "two"] == [0, 0, 3] and found[1, "one"] == [0, 1] and len(found) == 5
    by_join = features._sentence_scores(df, features.tfidf(df, "doc_id"), "doc_id", "text", "\n")
    single = df.where("doc_id IN (1, 2, 5)")
    idf = features._inverse(places, df.count())
    by_sums = features._scores_by_sums(features._places_of_terms(single, "doc_id", "text", "\n"), idf, "doc_id")
    columns = ["doc_id", "__at", F.round("__score", 12)]
    assert rows(by_sums.select(*columns)) == rows(by_join.where("doc_id IN (1, 2, 5)").select(*columns))
    partial = by_sums._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in partial) and partial.count("partial_sum") >= 2
    got = {(r.doc_id, r.summary) for r in features.tfidf_summarize(df, "doc_id", n=1).collect()}
    assert len(got) == 6 and (None, "") in got and (4, "") in got
