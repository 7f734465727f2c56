"""Queries on topics that share documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.operators import soft_topics as soft
from topicloom.operators.text_features import top_terms
from topicloom.operators.topics import Aspect
from topicloom.plans.base import STOP_WORDS, Query, text_table
from topicloom.plans.text import WORDS_SQL, class_sql

TOPICS = 3
LEAST_SHARE = 0.25
#: Descriptions that SQL can follow: the best words as they are, and a sentence of them.
ASPECTS = {"best": Aspect(keywords=None, diversity=None), "textual": Aspect(None, None, generate=True)}


def shared(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with given shares of three topics, from id and length."""
    docs = text_table(spark, folder).select("doc_id", "text", "n_chars")
    weights = [1 + F.pmod(F.col("doc_id") * (2 * t + 3) + F.col("n_chars") * t, F.lit(7)) for t in range(TOPICS)]
    total = sum(weights[1:], weights[0])
    shares = F.array(*[w / total for w in weights])
    return docs.select("doc_id", "text", shares.alias("shares"))


_WEIGHTS = [f"(1 + (doc_id * {2 * t + 3} + n_chars * {t}) % 7)" for t in range(TOPICS)]
SHARES_CTE = f"""{WORDS_SQL}, memberships AS (
  SELECT doc_id, unnest(range({TOPICS}))::INTEGER AS topic,
         unnest([{", ".join(_WEIGHTS)}])::DOUBLE / ({" + ".join(_WEIGHTS)}) AS p
  FROM documents
), placed AS (
  SELECT doc_id, unnest(w) AS term FROM words
), tf AS (
  SELECT doc_id, term, count(*) AS tf FROM placed GROUP BY doc_id, term
), {
    class_sql("topic", True).replace(
        "SELECT topic, term, count(*) AS n FROM grams GROUP BY topic, term",
        "SELECT topic, term, sum(tf * p) AS n FROM tf JOIN memberships USING (doc_id) GROUP BY topic, term",
    )
}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(score, 9) DESC, term) AS rank FROM scores
)"""


def _described(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    docs = shared(spark, folder)
    return docs, *soft.describe_soft_topics(
        docs, TOPICS, sizes=(1, 1), stop_words=STOP_WORDS, aspects=ASPECTS, least_share=LEAST_SHARE
    )


def soft_topic_words(spark: SparkSession, folder: str) -> DataFrame:
    """The best words of topics that share documents."""
    _, scores, _, _ = _described(spark, folder)
    best = top_terms(scores, "topic", 50)
    return best.select("topic", "rank", "term", F.round("n", 6).alias("n"), F.round("score", 6).alias("score"))


SOFT_TOPIC_WORDS_SQL = f"""
WITH {SHARES_CTE}
SELECT topic, rank::INTEGER AS rank, term, round(n, 6) AS n, round(score, 6) AS score
FROM ranked WHERE rank <= 50"""


def soft_topic_info(spark: SparkSession, folder: str) -> DataFrame:
    """Weight, count, words and a sentence of each topic."""
    docs, _, _, described = _described(spark, folder)
    found = described.join(soft.soft_sizes(docs), "topic")
    return found.select(
        "topic",
        F.round("weight", 6).alias("weight"),
        "count",
        F.array_join("main", ", ").alias("main"),
        F.array_join("best", ", ").alias("best"),
        "textual",
    )


SOFT_TOPIC_INFO_SQL = f"""
WITH {SHARES_CTE}, lists AS (
  SELECT topic, list(term ORDER BY rank) AS k FROM ranked WHERE rank <= 100 GROUP BY topic
), weights AS (
  SELECT topic, round(sum(p), 6) AS weight FROM memberships GROUP BY topic
), largest AS (
  SELECT doc_id, arg_max(topic, (p, -topic)) AS topic FROM memberships GROUP BY doc_id
), sizes AS (
  SELECT topic, count(*) AS "count" FROM largest GROUP BY topic
)
SELECT topic, weight, coalesce("count", 0) AS "count", array_to_string(k[1:10], ', ') AS main,
       array_to_string(k, ', ') AS best, 'Documents about ' || k[1] || ', ' || k[2] || ' and ' || k[3] AS textual
FROM weights LEFT JOIN sizes USING (topic) JOIN lists USING (topic)"""


def soft_topic_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that stand for each topic."""
    _, _, near, _ = _described(spark, folder)
    return near.select("topic", "doc_id", F.round("similarity", 6).alias("similarity"))


SOFT_TOPIC_DOCUMENTS_SQL = f"""
WITH {SHARES_CTE}, rounded AS (
  SELECT topic, term, idf, round(score, 9) AS score FROM scores
), own AS (
  SELECT doc_id, sum(tf) AS total FROM tf GROUP BY doc_id
), weighted AS (
  SELECT doc_id, m.topic, p, sqrt(tf / total) * idf AS w, score
  FROM tf JOIN own USING (doc_id) JOIN memberships m USING (doc_id)
  JOIN rounded r ON r.topic = m.topic AND r.term = tf.term WHERE p >= {LEAST_SHARE}
), sums AS (
  SELECT doc_id, topic, p, sum(w * score) AS dot, sum(w * w) AS squares FROM weighted GROUP BY doc_id, topic, p
), lengths AS (
  SELECT topic, sum(score * score) AS squares FROM rounded GROUP BY topic
), closest AS (
  SELECT topic, doc_id, round(p * round(dot / sqrt(s.squares * l.squares), 9), 9) AS similarity
  FROM sums s JOIN lengths l USING (topic)
), nearest AS (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY similarity DESC, doc_id) AS place FROM closest
)
SELECT topic, doc_id, round(similarity, 6) AS similarity FROM nearest WHERE place <= {soft.REPRESENTATIVE_DOCUMENTS}"""


def fit_soft_topics(spark: SparkSession, folder: str) -> DataFrame:
    """Mixtures fitted on the documents, their components described as topics.

    Each topic also says whether the shares of its documents are probabilities and the weights those of
    all documents.
    """
    model = soft.fit_soft_topics(
        text_table(spark, folder), k_range=range(2, 5), components=6, sizes=(1, 2), stop_words=STOP_WORDS
    )
    words = F.array_join("reduced_keywords", ", ").alias("reduced_keywords")
    info = model.info().select("topic", F.round("weight", 3).alias("weight"), "count", "name", words, "textual")
    off = model.memberships.groupBy("doc_id").agg(F.sum("p").alias("s")).where("abs(s - 1) > 1e-9")
    return info.withColumn("shares_add_up", F.lit(not off.take(1)))


QUERIES = {
    "soft_topic_words": Query(soft_topic_words, SOFT_TOPIC_WORDS_SQL),
    "soft_topic_info": Query(soft_topic_info, SOFT_TOPIC_INFO_SQL),
    "soft_topic_documents": Query(soft_topic_documents, SOFT_TOPIC_DOCUMENTS_SQL),
    "fit_soft_topics": Query(fit_soft_topics),
}
