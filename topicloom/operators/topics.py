"""Topics: clusters of documents described by words and sentences, with sub-topics."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.stopwords import english
from topicloom.functions.text import topic_name
from topicloom.functions.vectors import cosine
from topicloom.operators.clustering import Chosen, assign, auto_kmeans, centroids
from topicloom.operators.embedding import embed
from topicloom.operators.packed_terms import class_terms
from topicloom.operators.skew import ROWS_PER_TASK, attach, frequent_keys, salted_join
from topicloom.operators.text_features import (
    class_scores,
    class_tfidf,
    class_totals,
    count_vectorize,
    counts_side_by_side,
    dealt,
    share,
    top_terms,
)
from topicloom.session import at_rest, checkpoint

# The defaults of the topic descriptions.
CANDIDATE_WORDS = 100
KEYWORDS = 50
REPRESENTATIVE_DOCUMENTS = 5
DIVERSE_WORDS = 10
DIVERSITY = 0.5
MAIN_WORDS = 10
DEFAULT_K_RANGE = range(2, 20)


# --- words -------------------------------------------------------------------------------------


def document_terms(
    df: DataFrame, id: str = "doc_id", text: str = "text", extra: Sequence[str] = ("topic",), **options: Any
) -> DataFrame:
    """``(id, extra ..., term, tf, __total)``: what scores and representatives of topics are made of.

    Cut anew from the texts wherever it is read: written, n-grams are many times the size of the texts.
    """
    return count_vectorize(dealt(df, text), [id, *extra], text, total="__total", **options)


def topic_counts(terms: DataFrame, topic: str = "topic") -> DataFrame:
    """``(topic, term, n)`` from the terms of documents, combined within each task first."""
    return terms.groupBy(topic, "term").agg(F.sum("tf").alias("n"))


def similarities(
    placed: DataFrame, scores: DataFrame, id: str, topic: str, reduce_frequent_words: bool, extra: Sequence[str] = ()
) -> DataFrame:
    """``(topic, id, similarity, extra ...)``: cosine of each document with the class TF-IDF vector of its topic.

    ``placed`` has ``(id, topic, term, tf, __total)`` and what goes with a document, ``extra``. A document is weighted like a class: share of its
    terms times the same inverse frequencies.
    """
    terms = scores.select(topic, "term", "score", "idf")
    # The count in the class is no less than the number of documents that have the term. A key is one row.
    many = scores.where(F.col("n") > ROWS_PER_TASK)
    hot = frequent_keys(many, [topic, "term"], weight="n")
    joined = salted_join(placed, terms, [topic, "term"], id, hot)
    weight = share(F.col("tf"), F.col("__total"), reduce_frequent_words) * F.col("idf")
    sums = joined.groupBy(id, topic).agg(
        F.sum(weight * F.col("score")).alias("__dot"),
        F.sum(weight * weight).alias("__own"),
        *[F.first(c).alias(c) for c in extra],
    )
    squares = terms.groupBy(topic).agg(F.sum(F.col("score") * F.col("score")).alias("__class"))
    similarity = F.col("__dot") / F.sqrt(F.col("__own") * F.col("__class"))
    return attach(sums, squares, topic, "inner").select(
        topic, id, F.round(similarity, 9).alias("similarity"), *extra
    )


def representative_documents(
    df: DataFrame,
    scores: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    topic: str = "topic",
    n: int = REPRESENTATIVE_DOCUMENTS,
    reduce_frequent_words: bool = True,
    terms: DataFrame | None = None,
    **options: Any,
) -> DataFrame:
    """``(topic, id, similarity)``: the documents closest to their topic's class TF-IDF vector.

    All documents of a topic take part. ``terms`` are those of the documents, where they are at hand.
    """
    if terms is None:
        terms = count_vectorize(df, [id, topic], text, total="__total", **options)
    return nearest_documents(similarities(terms, scores, id, topic, reduce_frequent_words), id, topic, n)


def nearest_documents(similar: DataFrame, id: str, topic: str, n: int = REPRESENTATIVE_DOCUMENTS) -> DataFrame:
    """The ``n`` rows of largest ``similarity`` in each topic; equal ones go by id."""
    best = Window.partitionBy(topic).orderBy(F.desc("similarity"), id)
    ranked = similar.withColumn("__rank", F.row_number().over(best))
    return ranked.where(F.col("__rank") <= n).drop("__rank")


def keyword_words(
    df: DataFrame,
    scores: DataFrame,
    representatives: DataFrame,
    id: str = "doc_id",
    topic: str = "topic",
    vector: str = "embedding",
    candidates: int = CANDIDATE_WORDS,
    top_n: int = KEYWORDS,
    **options: Any,
) -> DataFrame:
    """``(topic, term, score, rank)``: candidates most similar to the topic's mean document.

    Candidates are the best words by class TF-IDF; the mean runs over the representative documents;
    similarity is the cosine between word vector and mean, in the space of the document vectors.
    """
    words = top_terms(scores, topic, candidates).select(topic, "term")
    chosen = representatives.select(topic, id).join(df.select(id, F.col(vector).alias("__v")), id)
    means = (
        chosen.select(topic, F.posexplode("__v").alias("__at", "__x"))
        .groupBy(topic, "__at")
        .agg(F.avg("__x").alias("__x"))
        .groupBy(topic)
        .agg(F.sort_array(F.collect_list(F.struct("__at", "__x"))).alias("__mean"))
        .select(topic, F.transform("__mean", lambda p: p["__x"]).alias("__mean"))
    )
    embedded = embed(words, "term", "__w", **options)
    scored = attach(embedded, means, topic, "inner").select(
        topic, "term", F.round(cosine(F.col("__w"), F.col("__mean")), 9).alias("score")
    )
    return top_terms(scored, topic, top_n)


def diverse_words(
    words: DataFrame,
    topic: str = "topic",
    diversity: float = DIVERSITY,
    top_n: int = DIVERSE_WORDS,
    **options: Any,
) -> DataFrame:
    """Keep ``top_n`` words per topic by maximal marginal relevance, in their old order.

    The first is the word closest to all words read together; each next one weighs its closeness
    to these against its closeness to the words already taken. A topic has at most as many rows as
    it has keywords.
    """
    joined = words.groupBy(topic).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda w: w["term"]),
            " ",
        ).alias("__all")
    )
    vectors = attach(
        embed(words, "term", "__w", **options), embed(joined, "__all", "__t", **options), topic
    ).select(topic, "term", "score", "rank", "__w", "__t")

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank").reset_index(drop=True)
        w = np.array(rows["__w"].tolist(), dtype=float)
        t = np.array(rows["__t"].iloc[0], dtype=float)
        to_topic, among = np.round(w @ t, 9), np.round(w @ w.T, 9)
        taken = [int(to_topic.argmax())]
        while len(taken) < min(top_n, len(rows)):
            gain = (1 - diversity) * to_topic - diversity * among[:, taken].max(1)
            gain[taken] = -np.inf
            taken.append(int(gain.argmax()))
        kept = rows.iloc[sorted(taken)][[topic, "term", "score"]].reset_index(drop=True)
        return kept.assign(rank=np.arange(1, len(kept) + 1, dtype="int32"))

    kinds = vectors.schema
    schema = f"{topic} {kinds[topic].dataType.simpleString()}, term string, score double, rank int"
    return vectors.groupBy(topic).applyInPandas(choose, schema)


def word_lists(words: DataFrame, topic: str = "topic", out: str = "words") -> DataFrame:
    """``(topic, words)``: the terms of each topic as one list in rank order."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "term")))
    return words.groupBy(topic).agg(F.transform(ordered, lambda w: w["term"]).alias(out))


def describe_topics(
    lists: DataFrame,
    words: str = "words",
    out: str = "textual",
    generator: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """A sentence per topic. ``generator`` gets the table and the name of a prompt column and adds
    ``answer``; without one the sentence names the first three words."""
    if generator is not None:
        prompt = F.concat(
            F.lit("Describe in one sentence a topic with these keywords: "),
            F.array_join(words, ", "),
        )
        asked = generator(lists.withColumn("__prompt", prompt), "__prompt")
        return asked.withColumn(out, F.col("answer")).select(*lists.columns, out)
    first, last = F.slice(words, 1, F.least(F.size(words), F.lit(3)) - 1), F.get(words, F.least(F.size(words), F.lit(3)) - 1)
    sentence = F.when(
        F.size(words) > 1, F.concat(F.array_join(first, ", "), F.lit(" and "), last)
    ).otherwise(F.array_join(words, ", "))
    return lists.withColumn(out, F.concat(F.lit("Documents about "), sentence))


# --- tables about topics -------------------------------------------------------------------------


def topic_sizes(assigned: DataFrame, topic: str = "topic") -> DataFrame:
    return assigned.groupBy(topic).agg(F.count("*").alias("count"))


def renumber_topics(assigned: DataFrame, topic: str = "topic") -> DataFrame:
    """Number the topics 0, 1, ... by falling size, then by topic. Only one row per topic is ordered."""
    by_size = Window.orderBy(F.desc("count"), topic)
    numbers = topic_sizes(assigned, topic).select(
        topic, (F.row_number().over(by_size) - 1).alias("__number")
    )
    numbered = attach(assigned, numbers, topic)
    return numbered.withColumn(topic, F.col("__number")).select(*assigned.columns)


def topic_files(assigned: DataFrame, topic: str = "topic", file: str = "video_title") -> DataFrame:
    """``(topic, file)``, each pair once. One row per file and not a list per topic, as a topic may
    hold any number of files."""
    return assigned.select(topic, file).distinct()


def file_counts(assigned: DataFrame, topic: str = "topic", file: str = "video_title") -> DataFrame:
    files = topic_files(assigned, topic, file).where(F.col(file).isNotNull())
    return files.groupBy(topic).agg(F.count("*").alias("n_files"))


def topic_info(
    assigned: DataFrame,
    lists: DataFrame,
    topic: str = "topic",
    file: str | None = None,
    words: str = "reduced_keywords",
) -> DataFrame:
    """One row per topic: ``count``, ``name``, number of files, and the columns of ``lists``."""
    info = attach(topic_sizes(assigned, topic), lists, topic)
    if file is not None:
        info = attach(info, file_counts(assigned, topic, file), topic)
        info = info.withColumn("n_files", F.coalesce("n_files", F.lit(0)))
    shown = F.coalesce(F.col(words), F.array().cast("array<string>"))
    return info.withColumn("name", topic_name(F.col(topic), shown))


def topic_overview(
    counts: DataFrame,
    selected: Sequence[int],
    topic: str = "topic",
    empty_is_all: bool = False,
) -> DataFrame:
    """One row about ``(topic, n_files)``: numbers of the selection and their difference to all.

    An empty selection counts as all topics but as no files; ``empty_is_all`` makes it all files
    too. Differences of 0 are null.
    """
    everything = not selected and empty_is_all
    mine = F.lit(True) if everything else F.col(topic).isin(list(selected))
    files = F.when(mine, F.col("n_files"))
    all_files, all_topics = F.coalesce(F.sum("n_files"), F.lit(0)), F.count("*")
    some_files = F.coalesce(F.sum(files), F.lit(0))
    some_topics = F.count_if(mine) if selected else all_topics
    return counts.agg(
        some_topics.alias("n_topics"),
        F.nullif(some_topics - all_topics, F.lit(0)).alias("n_topics_diff"),
        some_files.alias("n_files"),
        F.nullif(some_files - all_files, F.lit(0)).alias("n_files_diff"),
        F.median(files).alias("median_files"),
    )


def select_topics(assigned: DataFrame, topics: Sequence[int], topic: str = "topic") -> DataFrame:
    """Documents whose topic is among the given ones."""
    return assigned.where(F.col(topic).isin(list(topics)))


def select_by_table(assigned: DataFrame, selection: DataFrame, topic: str = "topic") -> DataFrame:
    """The same from a table of topics."""
    return assigned.join(selection.select(topic).distinct(), topic, "left_semi")


def topic_tree(topics: DataFrame) -> DataFrame:
    """``(value, label, children)`` from ``(value, label, parent)``, one row per root.

    A parent has at most as many children as a run has topics.
    """
    children = (
        topics.where(F.col("parent").isNotNull())
        .groupBy("parent")
        .agg(F.sort_array(F.collect_list(F.struct("value", "label"))).alias("children"))
    )
    roots = topics.where(F.col("parent").isNull()).select("value", "label")
    joined = roots.join(children, roots["value"] == children["parent"], "left")
    empty = F.array().cast(children.schema["children"].dataType)
    return joined.select("value", "label", F.coalesce("children", empty).alias("children"))


# --- the model -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Aspect:
    """How one description of the topics is made."""

    keywords: int | None = KEYWORDS
    diversity: float | None = DIVERSITY
    diverse_words: int = DIVERSE_WORDS
    generate: bool = False


#: Keywords, re-ranked for diversity; and a sentence made of these.
DEFAULT_ASPECTS = {"reduced_keywords": Aspect(), "textual": Aspect(generate=True)}


@dataclass
class TopicModel:
    """A fitted run: who is where, what the topics are about, and the model for new text."""

    run_id: str
    documents: DataFrame
    scores: DataFrame
    descriptions: DataFrame
    chosen: Chosen
    numbers: dict[int, int]
    settings: dict[str, Any] = field(default_factory=dict)
    parent_topics: tuple[int, ...] = ()
    kept: DataFrame | None = None

    @property
    def assigned(self) -> DataFrame:
        return self.documents.drop("embedding")

    def info(self, file: str | None = None) -> DataFrame:
        run = F.lit(self.run_id).alias("run_id")
        parents = F.array(*[F.lit(p) for p in self.parent_topics]).cast("array<int>")
        info = topic_info(self.assigned, self.descriptions, file=file)
        return info.select(run, "*", parents.alias("parent_topics"))

    def assign(self, df: DataFrame, text: str | None = None) -> DataFrame:
        """Topic of new text."""
        embedded = embed(df, text or self.settings["text"], "__e", **self.settings["embedding"])
        return assign_topics(embedded, self.centroids(), "__e").drop("__e")

    def centroids(self) -> list[tuple[int, list[float]]]:
        return [(self.numbers[c], v) for c, v in centroids(self.chosen.model) if c in self.numbers]

    def unpersist(self) -> None:
        """Give up the kept vectors; they are computed anew if needed again."""
        if self.kept is not None:
            self.kept.unpersist()


def assign_topics(
    df: DataFrame, topic_centroids: Any, vector: str = "embedding", out: str = "topic"
) -> DataFrame:
    return assign(df, topic_centroids, vector, out, "__d").drop("__d")


def score_words(
    documents: DataFrame,
    text: str,
    sizes: tuple[int, int] = (1, 3),
    stop_words: Sequence[str] = (),
    reduce_frequent_words: bool = True,
) -> DataFrame:
    """Class TF-IDF of the words of each topic."""
    return class_scores(documents, "topic", text, sizes, stop_words, reduce_frequent_words)


def describe(
    documents: DataFrame, scores: DataFrame, near: DataFrame, settings: dict[str, Any]
) -> DataFrame:
    """``(topic, main, <aspect> ...)`` for all topics, ``near`` being their representative documents.

    Word tables have at most the number of keywords per topic and are written once, as several
    aspects build on the same ones.
    """
    id, embedding = settings["id"], settings["embedding"]
    table = word_lists(top_terms(scores, "topic", MAIN_WORDS), out="main")
    made: dict[Any, DataFrame] = {}
    for name, aspect in settings["aspects"].items():
        wanted = (aspect.keywords, aspect.diversity, aspect.diverse_words)
        if wanted not in made:
            words = top_terms(scores, "topic", CANDIDATE_WORDS)
            if aspect.keywords is not None:
                words = keyword_words(
                    documents, scores, near, id, top_n=aspect.keywords, **embedding
                )
            if aspect.diversity is not None:
                words = diverse_words(
                    words, diversity=aspect.diversity, top_n=aspect.diverse_words, **embedding
                )
            made[wanted] = checkpoint(word_lists(words, out="__words"))
        lists = made[wanted].withColumnRenamed("__words", name)
        if aspect.generate:
            words = made[wanted]
            lists = describe_topics(words, "__words", name, settings["generator"]).drop("__words")
        table = attach(table, lists, "topic")
    return table


def fit_topics(
    df: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    k_range: Iterable[int] = DEFAULT_K_RANGE,
    seed: int = 42,
    stop_words: Sequence[str] | None = None,
    sizes: tuple[int, int] = (1, 3),
    reduce_frequent_words: bool = True,
    aspects: dict[str, Aspect] | None = None,
    embedding: dict[str, Any] | None = None,
    generator: Callable[[DataFrame, str], DataFrame] | None = None,
    parent_topics: Sequence[int] = (),
    embedded: bool = False,
) -> TopicModel:
    """Embed, cluster with the chosen number of topics, and describe the clusters.

    Topics are numbered by falling size. ``embedded`` says that ``df`` has its vectors already.
    Without ``stop_words`` the English ones are left out of the descriptions.
    """
    if stop_words is None:
        stop_words = english(df.sparkSession)
    settings = {
        "id": id, "text": text, "seed": seed, "stop_words": tuple(stop_words), "sizes": sizes,
        "reduce_frequent_words": reduce_frequent_words, "embedding": embedding or {},
        "aspects": DEFAULT_ASPECTS if aspects is None else aspects, "generator": generator,
    }
    # Written once and not kept in the memory of executors, where texts and vectors would fill it.
    with_vectors = df if embedded else at_rest(embed(df, text, **settings["embedding"]))
    chosen = auto_kmeans(with_vectors, k_range, id, seed=seed)
    labelled = assign_topics(with_vectors, centroids(chosen.model), out="topic")
    sizes_found = topic_sizes(labelled).orderBy(F.desc("count"), "topic").collect()
    numbers = {r.topic: n for n, r in enumerate(sizes_found)}
    new = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
    documents = labelled.withColumn("topic", new[F.col("topic")])
    model = TopicModel(uuid.uuid4().hex, documents, None, None, chosen, numbers, settings, tuple(parent_topics))
    return update_topics(model)


def update_topics(model: TopicModel, **changes: Any) -> TopicModel:
    """Describe the topics of a model anew, with other words or aspects, without clustering again.

    Takes ``stop_words``, ``sizes``, ``reduce_frequent_words``, ``aspects`` and ``generator``.
    """
    settings = {**model.settings, **changes}
    id, reduced = settings["id"], settings["reduce_frequent_words"]
    options = {name: settings[name] for name in ("sizes", "stop_words")}
    packed = class_terms(model.documents, id, settings["text"], "topic", reduce_frequent_words=reduced, **options)
    if packed is not None:
        scores, near = packed.scores, nearest_documents(packed.similar.drop("__p"), id, "topic")
    else:
        terms = document_terms(model.documents, id, settings["text"], **options)
        totals = class_totals(model.documents, "topic", settings["text"], **options)
        counts = counts_side_by_side(terms, "topic", totals, F.col("tf"))
        scores = at_rest(class_tfidf(counts, "topic", reduced, totals))
        near = representative_documents(
            model.documents, scores, id, reduce_frequent_words=reduced, terms=terms
        )
    descriptions = checkpoint(describe(model.documents, scores, checkpoint(near), settings))
    return replace(model, scores=scores, descriptions=descriptions, settings=settings)


_FIT_SETTINGS = (
    "id", "text", "seed", "stop_words", "sizes", "reduce_frequent_words",
    "aspects", "embedding", "generator",
)


def subtopics(
    model: TopicModel, topics: Sequence[int], k_range: Iterable[int] = DEFAULT_K_RANGE
) -> TopicModel:
    """A new run on the documents of some topics, which keep their ``parent_topic``."""
    known = set(model.numbers.values())
    if not topics:
        raise ValueError("select at least one topic")
    if known <= set(topics):
        raise ValueError("all topics are selected: change the number of topics instead")
    some = select_topics(model.documents, topics).withColumnRenamed("topic", "parent_topic")
    settings = {name: model.settings[name] for name in _FIT_SETTINGS}
    return fit_topics(some, k_range=k_range, parent_topics=topics, embedded=True, **settings)


def recompute(model: TopicModel, k_range: Iterable[int]) -> TopicModel:
    """The same documents with another range of topic numbers."""
    settings = {name: model.settings[name] for name in _FIT_SETTINGS}
    return fit_topics(
        model.documents.drop("topic"), k_range=k_range, parent_topics=model.parent_topics,
        embedded=True, **settings,
    )
