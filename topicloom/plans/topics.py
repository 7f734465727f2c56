"""Queries on topics: words, sentences, tables about topics, the whole model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.operators import topics
from topicloom.operators.embedding import embed
from topicloom.operators.text_features import class_counts, class_tfidf, top_terms
from topicloom.plans.base import STOP_WORDS, Query, text_table
from topicloom.plans.text import EMBEDDING_CTE, WORDS_SQL, bucket_sql, class_sql, grams_sql
from topicloom.session import checkpoint
from topicloom.sources.tables import load

# Languages stand for topics where a fixed assignment is wanted.
LANGUAGES = ("de", "en", "es", "fr")
TOPIC_SQL = "CASE lang " + " ".join(
    f"WHEN '{name}' THEN {n}" for n, name in enumerate(LANGUAGES)
) + " ELSE -1 END::INTEGER"


def _topic() -> Column:
    number = F.lit(-1)
    for n, name in enumerate(LANGUAGES):
        number = F.when(F.col("lang") == name, n).otherwise(number)
    return number


def assigned(spark: SparkSession, folder: str, text: bool = False) -> DataFrame:
    docs = text_table(spark, folder) if text else load(spark, folder, "documents")
    kept = ["doc_id", "text"] if text else ["doc_id"]
    return docs.select(*kept, F.col("source").alias("video_title"), _topic().alias("topic"))


ASSIGNED_CTE = f"""
assigned AS (SELECT doc_id, text, source AS video_title, {TOPIC_SQL} AS topic FROM documents)"""


def _scores(docs: DataFrame) -> DataFrame:
    return _scored(checkpoint(class_counts(docs, "topic", stop_words=STOP_WORDS)))


def _scored(counts: DataFrame) -> DataFrame:
    # Counts are written before: they are read for terms, totals and their mean. So are the scores.
    scored = class_tfidf(counts, "topic", reduce_frequent_words=True)
    return checkpoint(scored.withColumn("score", F.round("score", 9)))


def _word_lists(docs: DataFrame, n: int = 10) -> DataFrame:
    return topics.word_lists(top_terms(_scores(docs), "topic", n), out="reduced_keywords")


TOPIC_WORDS_CTE = f"""{ASSIGNED_CTE}, {WORDS_SQL}, placed AS (
  SELECT a.doc_id, topic, unnest(w) AS term FROM words JOIN assigned a USING (doc_id)
), grams AS (
  SELECT doc_id, topic, term FROM placed
), {class_sql("topic", True)}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(score, 9) DESC, term) AS rank FROM scores
)"""


def topic_info(spark: SparkSession, folder: str) -> DataFrame:
    docs = assigned(spark, folder, text=True)
    info = topics.topic_info(docs, _word_lists(docs), file="video_title")
    described = topics.describe_topics(info, "reduced_keywords")
    words = F.array_join("reduced_keywords", ", ").alias("reduced_keywords")
    return described.select("topic", "count", "name", "n_files", words, "textual")


TOPIC_INFO_SQL = f"""
WITH {TOPIC_WORDS_CTE}, lists AS (
  SELECT topic, list(term ORDER BY rank) AS k FROM ranked WHERE rank <= 10 GROUP BY topic
), sizes AS (
  SELECT topic, count(*) AS "count", count(DISTINCT video_title) AS n_files FROM assigned GROUP BY topic
)
SELECT topic, "count", 'Topic ' || topic || ': `' || array_to_string(k[1:5], ', ') || '...`' AS name,
       n_files, array_to_string(k, ', ') AS reduced_keywords,
       'Documents about ' || k[1] || ', ' || k[2] || ' and ' || k[3] AS textual
FROM sizes JOIN lists USING (topic)"""


def score_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words of given topics scored anew, as when a model is updated with other n-grams."""
    scores = topics.score_words(assigned(spark, folder, text=True), "text", (1, 2), STOP_WORDS)
    best = top_terms(scores.withColumn("score", F.round("score", 9)), "topic", 100)
    return best.select("topic", "rank", "term", "n", F.round("score", 6).alias("score"))


SCORE_WORDS_SQL = f"""
WITH {ASSIGNED_CTE}, {grams_sql(1, 2).replace("grams AS (", "all_grams AS (")}, grams AS (
  SELECT topic, term FROM all_grams JOIN assigned USING (doc_id)
), {class_sql("topic", True)}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(score, 9) DESC, term) AS rank FROM scores
)
SELECT topic, rank::INTEGER AS rank, term, n, round(score, 6) AS score FROM ranked WHERE rank <= 100"""


def topic_files(spark: SparkSession, folder: str) -> DataFrame:
    return topics.topic_files(assigned(spark, folder))


def topic_overview(spark: SparkSession, folder: str) -> DataFrame:
    """The figures for a selection, for none, and for none read as all."""
    counts = topics.file_counts(assigned(spark, folder))
    some = topics.topic_overview(counts, [0, 3]).withColumn("selection", F.lit("some"))
    none = topics.topic_overview(counts, []).withColumn("selection", F.lit("none"))
    every = topics.topic_overview(counts, [], empty_is_all=True)
    return some.unionByName(none).unionByName(every.withColumn("selection", F.lit("all")))


TOPIC_OVERVIEW_SQL = f"""
WITH {ASSIGNED_CTE}, counts AS (
  SELECT topic, count(DISTINCT video_title) AS n FROM assigned GROUP BY topic
), total AS (SELECT count(*) AS t, sum(n)::BIGINT AS f, median(n)::DOUBLE AS m FROM counts),
mine AS (SELECT count(*) AS t, sum(n)::BIGINT AS f, median(n)::DOUBLE AS m FROM counts WHERE topic IN (0, 3))
SELECT 'some' AS selection, mine.t AS n_topics, nullif(mine.t - total.t, 0) AS n_topics_diff,
       mine.f AS n_files, nullif(mine.f - total.f, 0) AS n_files_diff, mine.m AS median_files
FROM mine, total
UNION ALL SELECT 'none', t, NULL, 0, nullif(-f, 0), NULL FROM total
UNION ALL SELECT 'all', t, NULL, f, NULL, m FROM total"""


def topic_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Languages with their sources as children, as nested nodes in JSON."""
    pairs = load(spark, folder, "documents").select("lang", "source").distinct()
    node = F.concat_ws("/", "lang", "source").alias("value")
    below = pairs.select(node, F.col("source").alias("label"), F.col("lang").alias("parent"))
    roots = pairs.select("lang").distinct().select(
        F.col("lang").alias("value"), F.concat(F.lit("Topic "), "lang").alias("label"),
        F.lit(None).cast("string").alias("parent"),
    )
    tree = topics.topic_tree(roots.union(below))
    names = F.transform("children", lambda c: F.concat(c["value"], F.lit("="), c["label"]))
    return tree.select("value", "label", F.array_join(names, ";").alias("children"))


TOPIC_TREE_SQL = """
WITH pairs AS (SELECT DISTINCT lang, source FROM documents)
SELECT lang AS value, 'Topic ' || lang AS label,
       string_agg(lang || '/' || source || '=' || source, ';' ORDER BY lang || '/' || source) AS children
FROM pairs GROUP BY lang"""


def topic_sizes(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").select("doc_id", F.col("source").alias("topic"))
    return topics.topic_sizes(docs)


def renumbered(spark: SparkSession, folder: str) -> DataFrame:
    return topics.renumber_topics(assigned(spark, folder)).select("doc_id", "topic")


RENUMBERED_SQL = f"""
WITH {ASSIGNED_CTE}, sizes AS (
  SELECT topic, row_number() OVER (ORDER BY count(*) DESC, topic) - 1 AS number FROM assigned GROUP BY topic
)
SELECT doc_id, number::INTEGER AS topic FROM assigned JOIN sizes USING (topic)"""


def selected_topics(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the topics that hold at least 15 sources, and of topic 1."""
    docs = assigned(spark, folder)
    crowded = topics.file_counts(docs).where(F.col("n_files") >= 15)
    by_table = topics.select_by_table(docs, crowded).select("doc_id", F.lit("crowded").alias("why"))
    by_list = topics.select_topics(docs, [1]).select("doc_id", F.lit("chosen").alias("why"))
    return by_table.union(by_list)


SELECTED_SQL = f"""
WITH {ASSIGNED_CTE}, crowded AS (
  SELECT topic FROM assigned GROUP BY topic HAVING count(DISTINCT video_title) >= 15
)
SELECT doc_id, 'crowded' AS why FROM assigned WHERE topic IN (FROM crowded)
UNION ALL SELECT doc_id, 'chosen' FROM assigned WHERE topic = 1"""


def distinct_labels(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "embeddings").select("label").distinct()


def representative_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = assigned(spark, folder, text=True)
    near = topics.representative_documents(docs, _scores(docs), stop_words=STOP_WORDS)
    return near.withColumn("similarity", F.round("similarity", 6))


REPRESENTATIVE_CTE = f"""{TOPIC_WORDS_CTE}, rounded AS (
  SELECT topic, term, idf, round(score, 9) AS score FROM scores
), tf AS (
  SELECT doc_id, topic, term, count(*) AS tf FROM placed GROUP BY doc_id, topic, term
), own AS (
  SELECT doc_id, sum(tf) AS total FROM tf GROUP BY doc_id
), weighted AS (
  SELECT doc_id, tf.topic, sqrt(tf / total) * idf AS w, score
  FROM tf JOIN own USING (doc_id) JOIN rounded r ON r.topic = tf.topic AND r.term = tf.term
), sums AS (
  SELECT doc_id, topic, sum(w * score) AS dot, sum(w * w) AS squares FROM weighted GROUP BY doc_id, topic
), lengths AS (
  SELECT topic, sum(score * score) AS squares FROM rounded GROUP BY topic
), closest AS (
  SELECT s.topic, doc_id, round(dot / sqrt(s.squares * l.squares), 9) AS similarity
  FROM sums s JOIN lengths l ON s.topic = l.topic
), nearest AS (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY similarity DESC, doc_id) AS place FROM closest
  QUALIFY place <= {topics.REPRESENTATIVE_DOCUMENTS}
)"""


def _keywords(spark: SparkSession, folder: str) -> DataFrame:
    docs = assigned(spark, folder, text=True)
    terms = topics.document_terms(docs, stop_words=STOP_WORDS)
    scores = _scored(checkpoint(topics.topic_counts(terms)))
    near = checkpoint(topics.representative_documents(docs, scores, terms=terms))
    # Only representatives are embedded: a few documents per topic.
    chosen = docs.join(near.select("doc_id").distinct(), "doc_id", "left_semi")
    return topics.keyword_words(embed(chosen, "text"), scores, near)


def keyword_words(spark: SparkSession, folder: str) -> DataFrame:
    return _keywords(spark, folder).withColumn("score", F.round("score", 6))


KEYWORDS_CTE = f"""{REPRESENTATIVE_CTE}, {EMBEDDING_CTE}, means AS (
  SELECT topic, place AS bucket, avg(value) AS mean
  FROM vectors JOIN (SELECT topic, doc_id FROM nearest) USING (doc_id) GROUP BY topic, place
), norms AS (
  SELECT topic, sqrt(sum(mean * mean)) AS length FROM means GROUP BY topic
), candidates AS (
  SELECT topic, term, {bucket_sql(64)} FROM ranked WHERE rank <= {topics.CANDIDATE_WORDS}
), closeness AS (
  SELECT topic, term, bucket, sign, round(sign * mean / length, 9) AS score
  FROM candidates JOIN means USING (topic, bucket) JOIN norms USING (topic)
), best AS (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS rank FROM closeness
  QUALIFY rank <= {topics.KEYWORDS}
)"""


def diverse_words(spark: SparkSession, folder: str) -> DataFrame:
    found = topics.diverse_words(_keywords(spark, folder))
    return found.withColumn("score", F.round("score", 6))


# The words of a topic read together, their closeness to this and to each other, and the greedy choice.
DIVERSE_SQL = f"""
WITH RECURSIVE {KEYWORDS_CTE}, together AS (
  SELECT topic, bucket, sum(sign)::DOUBLE AS v FROM best GROUP BY topic, bucket
), lengths_together AS (
  SELECT topic, sqrt(sum(v * v)) AS length FROM together GROUP BY topic
), words_near AS (
  SELECT topic, rank, term, score, bucket, sign, round(sign * v / length, 9) AS near
  FROM best JOIN together USING (topic, bucket) JOIN lengths_together USING (topic)
), alike AS (
  SELECT a.topic, a.rank AS a, b.rank AS b,
         CASE WHEN a.bucket = b.bucket THEN a.sign * b.sign ELSE 0 END AS same
  FROM words_near a JOIN words_near b ON a.topic = b.topic
), chosen AS (
  SELECT topic, [arg_max(rank, (near, -rank))] AS taken FROM words_near GROUP BY topic
  UNION ALL
  SELECT c.topic, list_append(any_value(c.taken), arg_max(g.rank, (g.gain, -g.rank)))
  FROM chosen c JOIN (
    SELECT c2.topic, w.rank, {1 - topics.DIVERSITY} * any_value(w.near)
             - {topics.DIVERSITY} * max(l.same) AS gain
    FROM chosen c2 JOIN words_near w ON w.topic = c2.topic AND NOT list_contains(c2.taken, w.rank)
    JOIN alike l ON l.topic = w.topic AND l.a = w.rank AND list_contains(c2.taken, l.b)
    GROUP BY c2.topic, w.rank
  ) g ON g.topic = c.topic
  WHERE len(c.taken) < {topics.DIVERSE_WORDS}
  GROUP BY c.topic
), kept AS (
  SELECT topic, unnest(taken) AS rank FROM chosen WHERE len(taken) = {topics.DIVERSE_WORDS}
)
SELECT topic, term, round(score, 6) AS score,
       (row_number() OVER (PARTITION BY topic ORDER BY rank))::INTEGER AS rank
FROM kept JOIN best USING (topic, rank)"""


def assign_topics(spark: SparkSession, folder: str) -> DataFrame:
    """Documents to the nearest mean document of a language."""
    docs = embed(text_table(spark, folder).select("doc_id", "text", _topic().alias("label")), "text")
    rows = (
        docs.select("label", F.posexplode("embedding").alias("place", "x"))
        .groupBy("label", "place")
        .agg(F.avg("x").alias("x"))
        .groupBy("label")
        .agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("v"))
    )
    means = rows.select("label", F.transform("v", lambda p: p["x"]).alias("v"))
    return topics.assign_topics(docs, means).select("doc_id", "topic")


ASSIGN_TOPICS_SQL = f"""
WITH {ASSIGNED_CTE}, {EMBEDDING_CTE}, labelled AS (
  SELECT doc_id, topic, place, value FROM vectors JOIN assigned USING (doc_id)
), means AS (
  SELECT topic, place, avg(value) AS mean FROM labelled GROUP BY topic, place
), distances AS (
  SELECT doc_id, m.topic, round(sqrt(sum((value - mean) ** 2)), 12) AS d
  FROM vectors v JOIN means m ON v.place = m.place GROUP BY doc_id, m.topic
)
SELECT doc_id, arg_min(topic, (d, topic))::INTEGER AS topic FROM distances GROUP BY doc_id"""


def _fitted(spark: SparkSession, folder: str) -> topics.TopicModel:
    return topics.fit_topics(
        text_table(spark, folder).withColumnRenamed("source", "video_title"),
        k_range=range(2, 6), stop_words=STOP_WORDS, sizes=(1, 3),
    )


def _info(model: topics.TopicModel) -> DataFrame:
    info = model.info("video_title")
    words = F.array_join("reduced_keywords", ", ").alias("reduced_keywords")
    parents = F.array_join(F.col("parent_topics").cast("array<string>"), ",").alias("parent_topics")
    return info.select("topic", "count", "n_files", "name", words, "textual", parents)


def fit_topics(spark: SparkSession, folder: str) -> DataFrame:
    return _info(_fitted(spark, folder))


def subtopics(spark: SparkSession, folder: str) -> DataFrame:
    """Topics within the largest topic of a fit."""
    return _info(topics.subtopics(_fitted(spark, folder), [0], range(2, 4)))


def recomputed(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of a fit with another range of topic numbers."""
    return _info(topics.recompute(_fitted(spark, folder), range(2, 4)))


def new_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Topics of the benchmark texts under a model fitted on the documents."""
    model = _fitted(spark, folder)
    return model.assign(load(spark, folder, "benchmark")).select("item_id", "topic")


QUERIES = {
    "recompute": Query(recomputed),
    "topic_info": Query(topic_info, TOPIC_INFO_SQL),
    "score_words": Query(score_words, SCORE_WORDS_SQL),
    "topic_files": Query(
        topic_files, f"WITH {ASSIGNED_CTE} SELECT DISTINCT topic, video_title FROM assigned"
    ),
    "topic_overview": Query(topic_overview, TOPIC_OVERVIEW_SQL),
    "topic_tree": Query(topic_tree, TOPIC_TREE_SQL),
    "topic_sizes": Query(
        topic_sizes, 'SELECT source AS topic, count(*) AS "count" FROM documents GROUP BY source'
    ),
    "renumber_topics": Query(renumbered, RENUMBERED_SQL),
    "selected_topics": Query(selected_topics, SELECTED_SQL),
    "distinct_labels": Query(distinct_labels, "SELECT DISTINCT label FROM embeddings"),
    "representative_documents": Query(
        representative_documents,
        f"WITH {REPRESENTATIVE_CTE}"
        " SELECT topic, doc_id, round(similarity, 6) AS similarity FROM nearest",
    ),
    "keyword_words": Query(
        keyword_words,
        f"WITH {KEYWORDS_CTE}"
        " SELECT topic, term, round(score, 6) AS score, rank::INTEGER AS rank FROM best",
    ),
    "diverse_words": Query(diverse_words, DIVERSE_SQL),
    "assign_topics": Query(assign_topics, ASSIGN_TOPICS_SQL),
    "fit_topics": Query(fit_topics),
    "subtopics": Query(subtopics),
    "assign_new_documents": Query(new_documents),
}
