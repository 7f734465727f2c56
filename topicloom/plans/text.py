"""Queries on tokens, n-grams, TF-IDF, hashing and class TF-IDF."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.operators import embedding
from topicloom.operators import text_features as features
from topicloom.operators.packed_terms import term_totals
from topicloom.plans.base import EXTRA_STOP_WORDS, STOP_WORDS, Query, quoted, text_table
from topicloom.session import checkpoint
from topicloom.sources.tables import load

TOKENS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"

# One row per document with its list of tokens, stop words out.
WORDS_SQL = f"""
words AS (
  SELECT *, [x FOR x IN {TOKENS_SQL} IF x NOT IN ({quoted(STOP_WORDS)})] AS w FROM documents
)"""


def grams_sql(low: int, high: int) -> str:
    """Rows ``(doc_id, lang, term)``, one per n-gram."""
    joined = ["w", "w || ' ' || w2", "w || ' ' || w2 || ' ' || w3"]
    parts = " UNION ALL ".join(
        f"SELECT doc_id, lang, {joined[n - 1]} AS term FROM followed WHERE w{n if n > 1 else ''} IS NOT NULL"
        for n in range(low, high + 1)
    )
    return f"""{WORDS_SQL}, placed AS (
  SELECT doc_id, lang, generate_subscripts(w, 1) AS ix, unnest(w) AS w FROM words
), followed AS (
  SELECT *, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM placed
  WINDOW o AS (PARTITION BY doc_id ORDER BY ix)
), grams AS ({parts})"""


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    found = features.tokenize(
        text_table(spark, folder), "text", stop_words=STOP_WORDS, extra_stop_words=EXTRA_STOP_WORDS
    )
    return found.select("doc_id", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("tokens"))


TOKENS_QUERY_SQL = f"""
WITH t AS (
  SELECT doc_id, [x FOR x IN {TOKENS_SQL} IF x NOT IN ({quoted(STOP_WORDS + EXTRA_STOP_WORDS)})] AS w
  FROM documents
)
SELECT doc_id, len(w)::INTEGER AS n, array_to_string(w, ' ') AS tokens FROM t"""


#: Terms with lemmas in the small table.
FEW_LEMMAS = 50


def _plurals(found: DataFrame) -> DataFrame:
    """Terms that end in s with what is left without it, and in how many places they stand."""
    terms = found.select(F.explode("tokens").alias("term")).where("term LIKE '%s' AND length(term) > 3")
    counted = terms.groupBy("term").agg(F.count("*").alias("n"))
    return counted.withColumn("lemma", F.expr("left(term, length(term) - 1)"))


def _lemmas(spark: SparkSession, folder: str, few: bool) -> DataFrame:
    found = features.tokenize(text_table(spark, folder), "text", stop_words=STOP_WORDS).select("doc_id", "tokens")
    table = checkpoint(_plurals(found))
    if few:
        table = table.orderBy(F.desc("n"), "term").limit(FEW_LEMMAS)
    replaced = features.lemmatize(found, table.select("term", "lemma"), "doc_id")
    return replaced.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def lemmas_in_row(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens with the lemmas of a small table."""
    return _lemmas(spark, folder, few=True)


def lemmas_by_join(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens with the lemmas of a table of any size."""
    return _lemmas(spark, folder, few=False)


def lemmas_sql(chosen: str) -> str:
    return f"""
WITH {WORDS_SQL}, placed AS (
  SELECT doc_id, generate_subscripts(w, 1) AS ix, unnest(w) AS term FROM words
), plurals AS (
  SELECT term, count(*) AS n FROM placed WHERE term LIKE '%s' AND length(term) > 3 GROUP BY term
), chosen AS ({chosen}), replaced AS (
  SELECT doc_id, string_agg(CASE WHEN c.term IS NULL THEN p.term ELSE left(p.term, -1) END, ' ' ORDER BY ix) AS tokens
  FROM placed p LEFT JOIN chosen c USING (term) GROUP BY doc_id
)
SELECT doc_id, coalesce(tokens, '') AS tokens FROM documents LEFT JOIN replaced USING (doc_id)"""


def sentence_tokens(spark: SparkSession, folder: str) -> DataFrame:
    found = features.sentence_tokens(text_table(spark, folder), "text", stop_words=STOP_WORDS)
    rows = found.select("doc_id", F.posexplode("tokens").alias("sentence", "words"))
    return rows.select("doc_id", "sentence", F.array_join("words", " ").alias("tokens"))


def ngram_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of all documents: those of each (:func:`features.count_vectorize`) summed up, packed on their way."""
    return term_totals(text_table(spark, folder), sizes=(1, 3), stop_words=STOP_WORDS)


NGRAM_COUNTS_SQL = f"""
WITH {grams_sql(1, 3)}
SELECT term, count(DISTINCT doc_id) AS n_docs, count(*) AS n FROM grams GROUP BY term"""


def term_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = features.count_vectorize(text_table(spark, folder), "doc_id", stop_words=STOP_WORDS)
    return counts.withColumn("tf", F.col("tf").cast("bigint"))


def tfidf(spark: SparkSession, folder: str) -> DataFrame:
    found = features.tfidf(text_table(spark, folder), "doc_id", stop_words=STOP_WORDS)
    return found.withColumn("tfidf", F.round("tfidf", 6))


TFIDF_CTE = f"""{grams_sql(1, 1)}, tf AS (
  SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY doc_id, term
), df AS (
  SELECT term, count(*) AS df FROM tf GROUP BY term
), weighted AS (
  SELECT doc_id, term, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0) AS w
  FROM tf JOIN df USING (term)
), unit AS (
  SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS tfidf FROM weighted
)"""


def hashing_vectors(spark: SparkSession, folder: str) -> DataFrame:
    found = features.hashing_vectorize(
        text_table(spark, folder), "doc_id", n_features=2**20, sizes=(1, 2), stop_words=STOP_WORDS
    )
    return found.withColumn("value", F.round("value", 6))


def bucket_sql(dimensions: int) -> str:
    return (
        f"(('0x' || substr(md5(term), 1, 8))::BIGINT % {dimensions})::INTEGER AS bucket,"
        " CASE WHEN substr(md5(term), 9, 1) < '8' THEN 1 ELSE -1 END AS sign"
    )


HASHING_SQL = f"""
WITH {grams_sql(1, 2)}, hashed AS (
  SELECT doc_id, {bucket_sql(2**20)} FROM grams
), sums AS (
  SELECT doc_id, bucket, sum(sign) AS v FROM hashed GROUP BY doc_id, bucket HAVING sum(sign) <> 0
)
SELECT doc_id, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6)::DOUBLE AS value
FROM sums"""


def class_tfidf(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each quality class, over the documents that have a label."""
    docs = text_table(spark, folder).join(load(spark, folder, "labels"), "doc_id")
    counts = checkpoint(features.class_counts(docs, "quality", stop_words=STOP_WORDS))
    scored = features.class_tfidf(counts, "quality")
    return scored.select("quality", "term", "n", F.round("score", 6).alias("score"))


def class_sql(group: str, reduce_frequent_words: bool) -> str:
    share = "sqrt(n / total)" if reduce_frequent_words else "n / total"
    return f"""counts AS (
  SELECT {group}, term, count(*) AS n FROM grams GROUP BY {group}, term
), totals AS (
  SELECT {group}, sum(n) AS total FROM counts GROUP BY {group}
), inverse AS (
  SELECT term, ln(1 + (SELECT floor(avg(total)) FROM totals) / sum(n)) AS idf FROM counts GROUP BY term
), scores AS (
  SELECT {group}, term, n, idf, {share} * idf AS score
  FROM counts JOIN totals USING ({group}) JOIN inverse USING (term)
)"""


CLASS_TFIDF_SQL = f"""
WITH {WORDS_SQL}, grams AS (
  SELECT quality, unnest(w) AS term FROM words JOIN labels USING (doc_id)
), {class_sql("quality", False)}
SELECT quality, term, n, round(score, 6) AS score FROM scores"""


def top_terms(spark: SparkSession, folder: str) -> DataFrame:
    scored = features.class_scores(
        text_table(spark, folder), "lang", sizes=(1, 3), stop_words=STOP_WORDS, reduce_frequent_words=True
    )
    best = features.top_terms(scored.withColumn("score", F.round("score", 9)), "lang", 50)
    return best.select("lang", "rank", "term", "n", F.round("score", 6).alias("score"))


TOP_TERMS_SQL = f"""
WITH {grams_sql(1, 3)}, {class_sql("lang", True)}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(score, 9) DESC, term) AS rank FROM scores
)
SELECT lang, rank::INTEGER AS rank, term, n, round(score, 6) AS score FROM ranked WHERE rank <= 50"""


def hash_embedding(spark: SparkSession, folder: str) -> DataFrame:
    found = embedding.embed(text_table(spark, folder), "text")
    rows = found.select("doc_id", F.posexplode("embedding").alias("place", "value"))
    return rows.withColumn("value", F.round("value", 6) + 0.0)


# Rows (doc_id, place, value): the vector of a document, at length one.
EMBEDDING_CTE = f"""
all_tokens AS (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents), hashed AS (
  SELECT doc_id, {bucket_sql(embedding.DIMENSIONS)} FROM all_tokens
), bucket_sums AS (
  SELECT doc_id, bucket, sum(sign) AS v FROM hashed GROUP BY doc_id, bucket
), places AS (
  SELECT doc_id, place::INTEGER AS place
  FROM documents, (SELECT unnest(range({embedding.DIMENSIONS})) AS place)
), dense AS (
  SELECT p.doc_id, place, coalesce(v, 0)::DOUBLE AS v,
         sqrt(sum(coalesce(v, 0)::DOUBLE ^ 2) OVER (PARTITION BY p.doc_id)) AS length
  FROM places p LEFT JOIN bucket_sums s ON p.doc_id = s.doc_id AND p.place = s.bucket
), vectors AS (
  SELECT doc_id, place, CASE WHEN length > 0 THEN v / length ELSE 0 END AS value FROM dense
)"""


def summaries(spark: SparkSession, folder: str) -> DataFrame:
    return features.tfidf_summarize(text_table(spark, folder), "doc_id", n=2)


SUMMARIES_SQL = rf"""
WITH all_words AS (SELECT doc_id, lang, {TOKENS_SQL} AS w FROM documents),
{TFIDF_CTE.replace(WORDS_SQL, "words AS (SELECT * FROM all_words)")},
sentences AS (
  SELECT doc_id, ix, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line
  FROM (SELECT doc_id, generate_subscripts(parts, 1) AS ix, unnest(parts) AS line
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
), said AS (
  SELECT doc_id, ix, unnest(regexp_extract_all(lower(line), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM sentences
), scored AS (
  SELECT doc_id, ix, avg(tfidf) AS score FROM said JOIN unit USING (doc_id, term) GROUP BY doc_id, ix
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, ix) AS rank FROM scored
)
SELECT d.doc_id, coalesce(summary, '') AS summary
FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY ix) AS summary
  FROM ranked JOIN sentences USING (doc_id, ix) WHERE rank <= 2 GROUP BY doc_id
) s USING (doc_id)"""


QUERIES = {
    "tokens": Query(tokens, TOKENS_QUERY_SQL),
    "lemmas_in_row": Query(
        lemmas_in_row, lemmas_sql(f"SELECT term FROM plurals ORDER BY n DESC, term LIMIT {FEW_LEMMAS}")
    ),
    "lemmas_by_join": Query(lemmas_by_join, lemmas_sql("SELECT term FROM plurals")),
    "sentence_tokens": Query(sentence_tokens),
    "ngram_counts": Query(ngram_counts, NGRAM_COUNTS_SQL),
    "term_counts": Query(
        term_counts,
        f"WITH {grams_sql(1, 1)} SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY doc_id, term",
    ),
    "tfidf": Query(tfidf, f"WITH {TFIDF_CTE} SELECT doc_id, term, round(tfidf, 6) AS tfidf FROM unit"),
    "hashing_vectors": Query(hashing_vectors, HASHING_SQL),
    "class_tfidf": Query(class_tfidf, CLASS_TFIDF_SQL),
    "top_terms": Query(top_terms, TOP_TERMS_SQL),
    "hash_embedding": Query(
        hash_embedding,
        f"WITH {EMBEDDING_CTE} SELECT doc_id, place, round(value, 6) + 0.0 AS value FROM vectors",
    ),
    "summaries": Query(summaries, SUMMARIES_SQL),
}
