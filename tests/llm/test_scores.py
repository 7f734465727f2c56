"""Classifiers: held-out accuracy on the given tables, and what they do with odd rows."""

import random

import numpy as np
import pytest

import __spark_entry__ as entry
from topicloom.llm import language, quality, queries, toxicity
from topicloom.llm.sample import class_weights
from topicloom.sources.tables import load

FOLDER = "/root/testdata/sf0.1"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "123 !?"), (5, "word " * 50_000), (6, "x" * 100_000), (None, "a"), (2, "")]


def held_out(spark, query, label):
    found = entry.queries()[query](spark, FOLDER)
    labels = load(spark, FOLDER, "labels").where(f"{label} IS NOT NULL")
    rows = found.where("held_out").join(labels, "doc_id").select("predicted", "score", label).collect()
    assert found.count() == load(spark, FOLDER, "documents").count()
    return np.array([tuple(r) for r in rows], float)


@pytest.mark.parametrize("query,label", [("op1_quality", "quality"), ("op3_toxicity", "toxic")])
def test_held_out_accuracy(spark, query, label):
    predicted, score, truth = held_out(spark, query, label).T
    assert (predicted == truth).mean() > 0.96
    assert (predicted[truth == 1] == 1).mean() > 0.85 and (predicted[truth == 0] == 0).mean() > 0.9
    # Calibrated: scores add up to about the share of positive rows.
    assert abs(score.mean() - truth.mean()) < 0.03


@pytest.mark.parametrize("query,label,limit", [
    ("op1_quality", "quality", "QUALITY_TEXTS"), ("op3_toxicity", "toxic", "TOXICITY_TEXTS")
])
def test_limited_sample_keeps_the_share(spark, monkeypatch, query, label, limit):
    # Both classes of 300 rows, of which the table has one in seven or eight.
    monkeypatch.setattr(queries, limit, 10**6)
    whole = held_out(spark, query, label)
    monkeypatch.setattr(queries, limit, 300)
    predicted, score, truth = held_out(spark, query, label).T
    assert abs(score.mean() - truth.mean()) < 0.02
    assert abs(score.mean() - whole[:, 1].mean()) < 0.02
    assert abs(predicted.mean() - whole[:, 0].mean()) < 0.02


def test_weights_stand_for_the_table(spark):
    rows = [(i, int(i % 10 == 0)) for i in range(100)] + [(None, 1), (200, None)]
    labels = spark.createDataFrame(rows, "doc_id long, y int")
    assert class_weights(labels, "y", 5) == {0: 18.0, 1: 2.0}
    assert class_weights(labels, "y", 50) == {0: 1.8, 1: 1.0}
    assert class_weights(labels.where("y > 1"), "y", 5) == {}
    rng = random.Random(4)
    text = lambda bad: " ".join(rng.choice(["tree", "stone", "light", *bad]) for _ in range(20))
    sample = [(text([]), 0) for _ in range(60)] + [(text(["scum"]), 1) for _ in range(60)]
    model = toxicity.fit_toxicity(sample, {0: 18.0, 1: 2.0})
    assert model.label_model.prior == pytest.approx(0.1)
    # Texts that say nothing of their class have the score of the table's share.
    alike = [(text([]), x) for x in (0, 1) for _ in range(200)]
    model = quality.fit_quality(alike, {0: 1.0, 1: 9.0})
    scores = [1 / (1 + np.exp(-np.dot(model.measure()(t.encode()), model.weights))) for t, _ in alike[:50]]
    assert np.mean(scores) == pytest.approx(0.9, abs=0.05)


def test_held_out_languages(spark):
    found = entry.queries()["op4_language"](spark, FOLDER).where("held_out")
    rows = found.join(load(spark, FOLDER, "documents"), "doc_id").select("lang_pred", "lang").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.99


def frame(spark, rows=ODD):
    return spark.createDataFrame([(i, t, 0.5, 1) for i, t in rows], "doc_id long, text string, score double, id int")


MODELS = {
    "none": [],
    "one class": [("some text here", 1)] * 5,
    "small": [("good words of a text", 1), ("BAD!!!! ### &&&", 0)] * 20,
}


@pytest.mark.parametrize("sample", MODELS.values(), ids=MODELS)
@pytest.mark.parametrize("fit,score", [
    (quality.fit_quality, quality.score_quality), (toxicity.fit_toxicity, toxicity.score_toxicity)
])
def test_odd_rows_get_scores(spark, fit, score, sample):
    model = fit(sample)
    rows = score(frame(spark), model).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in ODD)
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1  # null is empty
    assert score(frame(spark).where("doc_id > 99"), model).collect() == []


def test_label_model_finds_accuracies_and_copies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.2
    accuracy = [0.9, 0.75, 0.6]
    votes = [np.where(rng.random(len(truth)) < a, truth, ~truth) for a in accuracy]
    votes = np.stack([*votes, votes[2], votes[2]], 1) * 2 - 1
    model = toxicity.fit_label_model(votes, 0.2)
    right = [model.tables[j, 1, 2] for j in range(5)]
    assert right[0] > right[1] > right[2]
    assert model.weights[0] > 0.9 and model.weights[2:].max() < 0.5  # three copies count as about one
    assert model.correlations[2, 3] > 0.9
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.87


def test_toxic_words_decide():
    rng = random.Random(1)
    plain = lambda: " ".join(rng.choice(["house", "tree", "water", "stone", "light"]) for _ in range(30))
    sample = [(plain(), 0) for _ in range(300)] + [(plain() + " vermin scum", 1) for _ in range(60)]
    model = toxicity.fit_toxicity(sample)
    assert model.margin(toxicity.text_keys({"scum", "vermin", "tree"}), 3) > 0
    assert model.margin(toxicity.text_keys({"stone", "tree"}), 2) < 0


LANGUAGES = [("the house and the tree " * 5, "en"), ("das Haus und der Baum " * 5, "de"), ("дом и дерево " * 5, "ru")]


def test_spans_of_mixed_text(spark):
    model = language.fit_language(LANGUAGES)
    text = "the house and the tree and the house das Haus und der Baum und das Haus дом и дерево"
    row = language.label_languages(frame(spark, [(1, text)]), model).first()
    assert [(s.lang, s.words) for s in row.spans] == [("en", 8), ("de", 8), ("ru", 3)]
    assert row.lang_pred == "en" and 0 < row.score < 1


def test_odd_texts_have_a_language(spark):
    rows = {r.doc_id: r for r in language.label_languages(frame(spark), language.fit_language(LANGUAGES)).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4
    assert all(rows[i].score == 0 and rows[i].spans == [] for i in (1, 2, 3, 4))
    assert rows[5].lang_pred == "en" or rows[5].lang_pred == "de"
    none = language.fit_language([])
    assert {r.lang_pred for r in language.label_languages(frame(spark), none).collect()} == {"und"}
    assert language.label_languages(frame(spark).where("doc_id > 99"), none).collect() == []


def test_rows_are_carried(spark):
    found = language.label_languages(frame(spark), language.fit_language(LANGUAGES), keep=["id", "score"])
    assert {(r.row.id, r.row.score) for r in found.collect()} == {(1, 0.5)}


def test_path_is_the_best_one():
    rng = np.random.default_rng(2)
    lengths = np.array([1, 7, 3, 7, 2])
    scores = rng.normal(size=(lengths.sum(), 3)) * 2
    path = language.viterbi(scores, lengths, 1.5)

    def worth(states, rows):
        return sum(r[s] for r, s in zip(rows, states, strict=True)) - 1.5 * sum(
            a != b for a, b in zip(states, states[1:], strict=False)
        )

    begin = 0
    for n in lengths.tolist():
        rows = scores[begin : begin + n]
        best = max(worth(s, rows) for s in np.ndindex(*(3,) * n))
        assert worth(path[begin : begin + n].tolist(), rows) == pytest.approx(best)
        begin += n


def test_pieces_end_between_words():
    points, _ = language.code_points(["abc def ghijklmnopqrstuvw x", "y" * 50, ""])
    cuts = list(language.pieces(points, 5))
    assert cuts[0][0] == 0 and cuts[-1][1] == len(points)
    letter = language._letters()[0][points]
    assert all(not (letter[end - 1] and letter[end]) for _, end in cuts[:-1])
