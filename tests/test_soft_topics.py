"""Topics that share documents."""

import math

import numpy as np
import pytest
from conftest import rows

from topicloom.operators import soft_topics as soft
from topicloom.operators.text_features import class_tfidf
from topicloom.operators.topics import Aspect, document_terms

DOCS = [
    (1, "apple pear apple", [1.0, 0.0]), (2, "apple plum", [0.5, 0.5]), (3, "goal match goal", [0.0, 1.0]),
    (4, "match ball", [0.25, 0.75]), (5, "", [0.5, 0.5]), (6, None, [1.0, 0.0]), (7, "pear ball", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, shares array<double>")


@pytest.fixture(scope="module")
def terms(docs):
    return document_terms(docs, extra=["shares"])


def test_fractional_counts(terms):
    found = rows(soft.soft_counts(terms, 2), "topic", "term", "n")
    assert found == sorted(
        [(0, "apple", 2.5), (0, "pear", 1.0), (0, "plum", 0.5), (0, "match", 0.25), (0, "ball", 0.25),
         (1, "apple", 0.5), (1, "plum", 0.5), (1, "goal", 2.0), (1, "match", 1.75), (1, "ball", 0.75)], key=repr,
    )


def test_whole_shares_are_ordinary_classes(spark, terms):
    """With shares of 0 and 1 the scores are those of hard topics."""
    hard = terms.where("doc_id in (1, 3)")
    counts = soft.soft_counts(hard, 2)
    found = {(r.topic, r.term): r.score for r in class_tfidf(counts, "topic").collect()}
    assert set(found) == {(0, "apple"), (0, "pear"), (1, "goal"), (1, "match")}
    assert math.isclose(found[0, "apple"], 2 / 3 * math.log(1 + 3 / 2))


def test_sizes(docs):
    assert rows(soft.soft_sizes(docs)) == [(0, 3.25, 4), (1, 2.75, 2)]


def test_representatives_weigh_their_share(terms):
    scores = class_tfidf(soft.soft_counts(terms, 2), "topic").cache()
    found = soft.soft_representatives(terms, scores, least_share=0.3).collect()
    at = {(r.topic, r.doc_id): r.similarity for r in found}
    # Documents 4 and 2 hold 0.25 and 0.5 of topic 0; shares below the least one do not count.
    assert set(at) == {(0, 1), (0, 2), (1, 2), (1, 3), (1, 4)}
    assert at[0, 1] > at[0, 2] and all(0 < v <= 1 for v in at.values())
    assert at[0, 2] <= 0.5 and at[1, 4] <= 0.75


def test_descriptions(docs):
    aspects = {"words": Aspect(keywords=3, diversity=None), "sentence": Aspect(None, None, generate=True)}
    scores, near, found = soft.describe_soft_topics(docs, 3, sizes=(1, 1), aspects=aspects)
    at = {r.topic: r for r in found.collect()}
    # Nothing belongs to topic 2.
    assert set(at) == {0, 1}
    # sqrt(1 / 4.5) * ln(1 + 4 / 1) of "pear" is more than sqrt(2.5 / 4.5) * ln(1 + 4 / 3) of "apple".
    assert at[0].main[:2] == ["pear", "apple"] and at[1].main[0] == "goal" and len(at[0].words) == 3
    assert at[0].sentence.startswith("Documents about pear, apple and ")


def test_no_documents(docs):
    scores, near, found = soft.describe_soft_topics(docs.where("doc_id > 99"), 2)
    assert scores.collect() == near.collect() == found.collect() == []


def test_fitted(spark):
    noise = np.random.default_rng(0)
    kinds = [["apple", "pear", "plum", "juice"], ["goal", "match", "ball", "team"]]
    data = [(i, " ".join(noise.choice(kinds[i % 2], 12))) for i in range(80)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    model = soft.fit_soft_topics(df, k_range=range(2, 4), components=3, sizes=(1, 1))
    assert model.memberships.groupBy("doc_id").sum("p").where("abs(`sum(p)` - 1) > 1e-9").count() == 0
    info = model.info().collect()
    assert sum(r["count"] for r in info) == 80 and math.isclose(sum(r.weight for r in info), 80, rel_tol=1e-9)
    # Each kind of text is at home in one topic, and new text goes there too.
    new = model.assign(spark.createDataFrame([(1, "apple pear juice plum")], "id int, text string")).first().shares
    old = {r.doc_id: r.shares for r in model.documents.collect()}
    assert math.isclose(sum(new), 1.0) and len(new) == model.chosen.k
    # Its largest share is one that the texts of the same kind hold most.
    assert int(np.argmax(new)) in {int(np.argmax(s)) for i, s in old.items() if i % 2 == 0}
    again = soft.describe_again(model, sizes=(1, 2))
    assert any(" " in w for r in again.descriptions.collect() for w in r.main)
