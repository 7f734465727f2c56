import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from topicloom.operators import topics
from topicloom.operators.conversations import batch_infer
from topicloom.operators.embedding import embed

THEMES = {
    0: "python code function class module import test loop",
    1: "soup recipe oven garlic onion bake taste kitchen",
    2: "match goal team player league coach score stadium",
}


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    data = []
    for i in range(120):
        theme = 0 if i < 60 else 1 if i < 100 else 2
        words = rng.choice(THEMES[theme].split(), size=25)
        data.append((i, " ".join(words), f"video {i % 7}", theme))
    return spark.createDataFrame(data, "doc_id long, text string, video_title string, theme int").cache()


@pytest.fixture(scope="module")
def model(docs):
    return topics.fit_topics(docs, k_range=range(2, 6), sizes=(1, 2))


def test_topics_follow_themes(model):
    assert model.chosen.k == 3
    pairs = rows(model.assigned.select("topic", "theme").distinct())
    # Topics are numbered by falling size.
    assert pairs == [(0, 0), (1, 1), (2, 2)]


def test_info(model):
    found = {r.topic: r for r in model.info("video_title").collect()}
    assert [found[t]["count"] for t in range(3)] == [60, 40, 20]
    assert [found[t].n_files for t in range(3)] == [7, 7, 7]
    for t, r in found.items():
        theme = set(THEMES[t].split())
        assert len(r.reduced_keywords) == topics.DIVERSE_WORDS and len(r.main) == topics.MAIN_WORDS
        assert {w for k in r.reduced_keywords for w in k.split()} <= theme
        assert r.name == f"Topic {t}: `{', '.join(r.reduced_keywords[:5])}...`"
        a, b, c = r.textual.removeprefix("Documents about ").replace(" and ", ", ").split(", ")
        assert [a, b, c] == r.reduced_keywords[:3]
        assert r.parent_topics == []


def test_new_text(spark, model):
    new = spark.createDataFrame([(1, "garlic soup taste"), (2, "coach team goal")], "id int, text string")
    assert rows(model.assign(new), "id", "topic") == [(1, 1), (2, 2)]


def test_subtopics(model):
    with pytest.raises(ValueError, match="at least one"):
        topics.subtopics(model, [])
    with pytest.raises(ValueError, match="all topics"):
        topics.subtopics(model, [0, 1, 2])
    below = topics.subtopics(model, [0, 2], range(2, 4))
    assert below.run_id != model.run_id
    assert rows(below.assigned.groupBy("parent_topic").count()) == [(0, 60), (2, 20)]
    assert {tuple(r.parent_topics) for r in below.info().collect()} == {(0, 2)}


def test_recompute(model):
    again = topics.recompute(model, range(2, 3))
    assert again.chosen.k == 2 and again.assigned.count() == 120


def test_update_keeps_clusters(model):
    def loud(max_length):
        return lambda messages: messages[-1]["content"].upper()

    changed = topics.update_topics(
        model, stop_words=("code", "soup"), sizes=(1, 1),
        aspects={"textual": topics.Aspect(keywords=5, diversity=None, generate=True)},
        generator=lambda df, prompt: batch_infer(df, prompt, loud),
    )
    assert rows(changed.assigned) == rows(model.assigned)
    found = changed.descriptions.collect()
    assert all(r.textual.startswith("DESCRIBE IN ONE SENTENCE") for r in found)
    assert not any(w in ("code", "soup") for r in found for w in r.main)


def brute_mmr(vectors, target, diversity, n):
    to_topic = [round(float(v @ target), 9) for v in vectors]
    taken = [int(np.argmax(to_topic))]
    while len(taken) < min(n, len(vectors)):
        best, place = -np.inf, None
        for i in range(len(vectors)):
            if i in taken:
                continue
            closest = max(round(float(vectors[i] @ vectors[j]), 9) for j in taken)
            gain = (1 - diversity) * to_topic[i] - diversity * closest
            if gain > best:
                best, place = gain, i
        taken.append(place)
    return sorted(taken)


def test_diverse_words(spark):
    words = [(t, w, 1.0 - i / 100, i + 1) for t in (1, 2) for i, w in enumerate((THEMES[t] + " team soup").split()[:9])]
    df = spark.createDataFrame(words, "topic int, term string, score double, rank int")
    found = topics.diverse_words(df, diversity=0.7, top_n=4)
    for t in (1, 2):
        mine = [w for k, w, _, _ in words if k == t]
        text = spark.createDataFrame([(i, w) for i, w in enumerate([*mine, " ".join(mine)])], "i int, text string")
        v = np.array([r.embedding for r in embed(text, "text").orderBy("i").collect()])
        chosen = [mine[i] for i in brute_mmr(v[:-1], v[-1], 0.7, 4)]
        assert [r.term for r in found.where(F.col("topic") == t).orderBy("rank").collect()] == chosen


def test_overview(spark):
    counts = spark.createDataFrame([(0, 5), (1, 2), (2, 2), (3, 8)], "topic int, n_files long")

    def of(selected, **options):
        return tuple(topics.topic_overview(counts, selected, **options).first())

    assert of([0, 1]) == (2, -2, 7, -10, 3.5)
    assert of([0, 1, 2, 3]) == (4, None, 17, None, 3.5)
    assert of([]) == (4, None, 0, -17, None)
    assert of([], empty_is_all=True) == (4, None, 17, None, 3.5)


def test_tree(spark):
    data = [(1, "a", None), (2, "b", None), (3, "c", 1), (4, "d", 1)]
    df = spark.createDataFrame(data, "value int, label string, parent int")
    found = {r.label: [(c.value, c.label) for c in r.children] for r in topics.topic_tree(df).collect()}
    assert found == {"a": [(3, "c"), (4, "d")], "b": []}


def test_more_than_a_hundred_topics(spark):
    df = spark.range(300).select((F.col("id") % 200).alias("topic"), "id")
    found = topics.renumber_topics(df).groupBy("topic").agg(F.count("*").alias("n")).orderBy("topic").collect()
    assert [(r.topic, r.n) for r in found] == [(t, 2 if t < 100 else 1) for t in range(200)]
