"""Topics that share documents: words, documents and sentences from fractional memberships.

Every document carries its share of each topic. A term counts for a topic by the shares of the
documents it is in, so one table of terms serves all topics, and what is shuffled is one row per term
and task with a sum per topic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.stopwords import english
from topicloom.functions.text import topic_name
from topicloom.operators.clustering import Chosen, auto_gaussian_mixture, mixture_shares
from topicloom.operators.embedding import Components, embed, fit_components
from topicloom.operators.packed_terms import class_terms
from topicloom.operators.skew import attach
from topicloom.operators.text_features import class_tfidf
from topicloom.operators.topics import (
    DEFAULT_ASPECTS,
    DEFAULT_K_RANGE,
    REPRESENTATIVE_DOCUMENTS,
    Aspect,
    describe,
    document_terms,
    nearest_documents,
    similarities,
)
from topicloom.session import at_rest, checkpoint

#: Components that vectors are reduced to before they are clustered.
COMPONENTS = 50

#: The share from which a document may represent a topic.
LEAST_SHARE = 0.05


def soft_counts(terms: DataFrame, topics: int, shares: str = "shares") -> DataFrame:
    """``(topic, term, n, everywhere)``: sums of ``tf * share`` over the documents that hold the term.

    ``terms`` has ``(term, tf, shares)``; a topic is a place in the array, from 0 on. A missing array or
    share counts as 0; terms of no weight in a topic have no row there. ``everywhere`` is the sum over topics.
    """
    sums = terms.groupBy("term").agg(
        *[F.sum(F.col("tf") * F.get(shares, F.lit(i)).cast("double")).alias(f"__{i}") for i in range(topics)]
    )
    found = [F.when(F.col(f"__{i}") > 0, F.col(f"__{i}")).otherwise(0.0) for i in range(topics)]
    everywhere = sum(found[1:], found[0]).alias("everywhere")
    held = F.posexplode(F.array(*[F.col(f"__{i}") for i in range(topics)])).alias("topic", "n")
    return sums.select("term", everywhere, held).where(F.col("n") > 0).select("topic", "term", "n", "everywhere")


def soft_representatives(
    terms: DataFrame,
    scores: DataFrame,
    id: str = "doc_id",
    shares: str = "shares",
    n: int = REPRESENTATIVE_DOCUMENTS,
    least_share: float = LEAST_SHARE,
    reduce_frequent_words: bool = True,
) -> DataFrame:
    """``(topic, id, similarity)``: the documents of largest share times similarity in each topic.

    Documents of less than ``least_share`` of a topic do not stand for it, so a document is compared with
    ``1 / least_share`` topics at most; ``similarity`` is the product.
    """
    held = F.transform(F.col(shares), lambda p, i: F.struct(i.alias("topic"), p.cast("double").alias("p")))
    belonging = terms.select(
        id, "term", "tf", "__total", F.explode(F.filter(held, lambda s: s["p"] >= least_share)).alias("__s")
    ).select(id, F.col("__s.topic").alias("topic"), "term", "tf", "__total", F.col("__s.p").alias("__p"))
    # Documents without an id stand for nothing.
    belonging = belonging.where(F.col(id).isNotNull())
    return _nearest(similarities(belonging, scores, id, "topic", reduce_frequent_words, ["__p"]), id, n)


def _nearest(similar: DataFrame, id: str, n: int) -> DataFrame:
    """The ``n`` documents of largest similarity times share ``__p`` in each topic."""
    weighted = similar.select("topic", id, F.round(F.col("similarity") * F.col("__p"), 9).alias("similarity"))
    return nearest_documents(weighted, id, "topic", n)


def soft_sizes(documents: DataFrame, shares: str = "shares") -> DataFrame:
    """``(topic, weight, count)``: sum of the shares, and documents that have their largest share there.

    Equal shares go to the lower topic. Documents without shares do not count.
    """
    best = F.array_position(shares, F.array_max(shares)).cast("int") - 1
    rows = documents.select(best.alias("__best"), F.posexplode(shares).alias("topic", "__p"))
    mine = F.col("topic") == F.col("__best")
    return rows.groupBy("topic").agg(F.sum("__p").alias("weight"), F.count_if(mine).alias("count"))


def describe_soft_topics(
    documents: DataFrame,
    topics: int,
    id: str = "doc_id",
    text: str = "text",
    shares: str = "shares",
    sizes: tuple[int, int] = (1, 3),
    stop_words: Sequence[str] = (),
    reduce_frequent_words: bool = True,
    aspects: dict[str, Aspect] | None = None,
    generator: Callable[[DataFrame, str], DataFrame] | None = None,
    embedding: dict[str, Any] | None = None,
    least_share: float = LEAST_SHARE,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(scores, representatives, descriptions)`` of soft topics from given shares.

    ``documents`` has ``(id, text, shares)``. Scores are class TF-IDF on fractional counts; descriptions
    hold, per topic, the main words and every aspect (keywords, diverse keywords, a sentence). Only
    representatives are embedded. A topic that no document holds enough of has main words alone.
    """
    aspects = DEFAULT_ASPECTS if aspects is None else aspects
    packed = class_terms(
        documents, id, text, shares, sizes, stop_words, reduce_frequent_words, topics, least_share, places=9
    )
    if packed is not None:
        scores = packed.scores
        near = checkpoint(_nearest(packed.similar.where(F.col(id).isNotNull()), id, REPRESENTATIVE_DOCUMENTS))
    else:
        terms = document_terms(documents, id, text, [shares], sizes=sizes, stop_words=stop_words)
        counts = at_rest(soft_counts(terms, topics, shares))
        scored = class_tfidf(counts, "topic", reduce_frequent_words)
        scores = at_rest(scored.withColumn("score", F.round("score", 9)))
        near = checkpoint(
            soft_representatives(
                terms, scores, id, shares, least_share=least_share, reduce_frequent_words=reduce_frequent_words
            )
        )
    chosen = documents.select(id, text).join(near.select(id).distinct(), id, "left_semi")
    settings = {"id": id, "embedding": embedding or {}, "aspects": aspects, "generator": generator}
    vectors = embed(chosen, text, **settings["embedding"])
    return scores, near, checkpoint(describe(vectors, scores, near, settings))


@dataclass
class SoftTopicModel:
    """A fitted run: the shares of every document, what the topics are about, and the model for new text."""

    documents: DataFrame
    scores: DataFrame | None
    representatives: DataFrame | None
    descriptions: DataFrame | None
    chosen: Chosen
    components: Components
    settings: dict[str, Any]

    @property
    def memberships(self) -> DataFrame:
        """``(id, topic, p)`` of every document and topic."""
        return self.documents.select(self.settings["id"], F.posexplode("shares").alias("topic", "p"))

    def info(self) -> DataFrame:
        """One row per topic: ``weight``, ``count``, ``name``, main words and every aspect."""
        described = attach(soft_sizes(self.documents), self.descriptions, "topic")
        return described.withColumn("name", topic_name(F.col("topic"), F.col("main")))

    def assign(self, df: DataFrame, text: str | None = None, out: str = "shares") -> DataFrame:
        """Shares of new text."""
        embedded = embed(df, text or self.settings["text"], "__e", **self.settings["embedding"])
        reduced = self.components.transform(embedded, "__e", "__r")
        return mixture_shares(reduced, self.chosen.model, "__r", out).drop("__e", "__r")


def fit_soft_topics(
    df: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    k_range: Iterable[int] = DEFAULT_K_RANGE,
    components: int = COMPONENTS,
    seed: int = 42,
    embedding: dict[str, Any] | None = None,
    **describing: Any,
) -> SoftTopicModel:
    """Embed, reduce, fit mixtures and describe the components of the chosen one as topics.

    ``describing`` goes to :func:`describe_soft_topics`. Without ``stop_words`` the English ones are
    left out of the descriptions. Vectors of fewer numbers than ``components`` keep them all.
    """
    embedding = embedding or {}
    if describing.get("stop_words") is None:
        describing["stop_words"] = tuple(english(df.sparkSession))
    embedded = checkpoint(embed(df.select(id, text), text, **embedding))
    width = embedded.agg(F.max(F.size("embedding"))).first()[0] or 0
    fitted = fit_components(embedded, k=min(components, width))
    reduced = checkpoint(fitted.transform(embedded).drop("embedding"))
    chosen = auto_gaussian_mixture(reduced, k_range, id, "reduced", seed)
    documents = checkpoint(mixture_shares(reduced, chosen.model, "reduced").drop("reduced"))
    settings = {"id": id, "text": text, "embedding": embedding, **describing}
    model = SoftTopicModel(documents, None, None, None, chosen, fitted, settings)
    return describe_again(model)


def describe_again(model: SoftTopicModel, **changes: Any) -> SoftTopicModel:
    """Describe the topics of a model anew, with other words or aspects; shares stay as they are."""
    settings = {**model.settings, **changes}
    scores, near, descriptions = describe_soft_topics(model.documents, model.chosen.k, **settings)
    return replace(model, scores=scores, representatives=near, descriptions=descriptions, settings=settings)
