"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import (
    bpe,
    hard_negatives,
    language,
    lines,
    minhash,
    nearest,
    quality,
    spaced_seeds,
    spelling,
    substring,
    suffixes,
    toxicity,
    warc,
)
from topicloom.llm.sample import class_weights, crc_remainder, labelled_sample
from topicloom.plans.base import Query
from topicloom.sources.tables import load

#: Labelled rows that a classifier is fitted on: texts per class and letters of a text, at most.
QUALITY_TEXTS = 2_000
TOXICITY_TEXTS = 4_000
LANGUAGE_TEXTS = 500
TEXT_LETTERS = 100_000


def _predicted(scored: DataFrame, divisor: int, held: int) -> DataFrame:
    return scored.select(
        "doc_id",
        (crc_remainder("doc_id", divisor) == held).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learned from labels that are not held out."""
    docs, labels = load(spark, folder, "documents"), load(spark, folder, "labels")
    seen = labels.where(crc_remainder("doc_id", 3) != 1)
    sample = labelled_sample(docs, seen, "quality", QUALITY_TEXTS, TEXT_LETTERS)
    model = quality.fit_quality(sample, class_weights(seen, "quality", QUALITY_TEXTS))
    return _predicted(quality.score_quality(docs, model), 3, 1)


def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from labels that are not held out."""
    docs, labels = load(spark, folder, "documents"), load(spark, folder, "labels")
    seen = labels.where(crc_remainder("doc_id", 5) != 0)
    sample = labelled_sample(docs, seen, "toxic", TOXICITY_TEXTS, TEXT_LETTERS)
    model = toxicity.fit_toxicity(sample, class_weights(seen, "toxic", TOXICITY_TEXTS))
    return _predicted(toxicity.score_toxicity(docs, model), 5, 0)


def fitted_language(docs: DataFrame) -> language.LanguageModel:
    """A language model of the documents that are not held out."""
    seen = docs.where(F.col("text").isNotNull() & (crc_remainder("doc_id", 5) != 0))
    sample = labelled_sample(docs, seen.select("doc_id", "lang"), "lang", LANGUAGE_TEXTS, TEXT_LETTERS)
    return language.fit_language(sample)


def languages(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document."""
    docs = load(spark, folder, "documents")
    return language.label_languages(docs, fitted_language(docs)).select(
        "doc_id", (crc_remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score"
    )


def vocabulary() -> bpe.Vocabulary:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.Vocabulary(bpe.read_ranks(path), public_tokenizers.PATTERN)


def bpe_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the tokens of every document and of what they decode to."""
    encoded = bpe.encode_texts(load(spark, folder, "documents"), vocabulary())
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("tokens", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def repeated_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that stand in passages of smaller ids."""
    return substring.remove_repeats(load(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document that stand in strings that start earlier."""
    return suffixes.remove_repeated_bytes(load(spark, folder, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of similar documents."""
    return minhash.near_duplicates(load(spark, folder, "documents"))


def leaked_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold passages of the benchmark, by item."""
    return spaced_seeds.find_passages(load(spark, folder, "documents"), load(spark, folder, "benchmark"))


def archived_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as the archives give it back."""
    return warc.round_trip(spark, load(spark, folder, "pages")).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


ARCHIVED_PAGES_SQL = """
WITH payloads AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), digests AS (
    SELECT page_id, octet_length(payload) AS size, sha1(payload) AS digest FROM payloads
), named AS (
    SELECT *, max(page_id) OVER (PARTITION BY digest) AS last FROM digests
)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN size >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN size >= 1000 AND page_id <> last THEN last END AS refers_to
FROM named
"""


def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    return nearest.nearest(load(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


NEAREST_VECTORS_SQL = """
WITH vectors AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), distances AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.v, c.v) AS score
    FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER nearest AS INTEGER) AS rank, vec_id, score
FROM distances
WINDOW nearest AS (PARTITION BY query_id ORDER BY score, vec_id)
QUALIFY row_number() OVER nearest <= 10
"""

LEAKED_PASSAGES_SQL = r"""
WITH texts AS (
    SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS words FROM documents
), items AS (
    SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS words FROM benchmark
), text_grams AS (
    SELECT doc_id, place, array_to_string(words[place:place + 2], ' ') AS gram
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS place FROM texts)
), item_grams AS (
    SELECT item_id, place, array_to_string(words[place:place + 2], ' ') AS gram
    FROM (SELECT item_id, words, unnest(range(1, len(words) - 1)) AS place FROM items WHERE len(words) >= 13)
), shifts AS (  -- thirteen words of which two differ hold three in a row that agree
    SELECT DISTINCT doc_id, item_id, t.place - i.place AS shift
    FROM text_grams t JOIN item_grams i USING (gram)
), opposite AS (
    SELECT doc_id, item_id, shift, i.words AS item_words, t.words AS words,
           greatest(1, 1 - shift) AS first, least(len(i.words), len(t.words) - shift) AS last
    FROM shifts JOIN texts t USING (doc_id) JOIN items i USING (item_id)
), agreed AS (
    SELECT doc_id, item_id, shift, first, last,
           list_transform(range(first, last + 1), lambda j:
               CASE WHEN item_words[j] = words[j + shift] THEN 1 ELSE 0 END) AS agree
    FROM opposite
), windows AS (
    SELECT *, list_filter(range(1, len(agree) - 13 + 2), lambda s: list_sum(agree[s:s + 12]) >= 11) AS starts
    FROM agreed
), sizes AS (  -- shorter items stand in the text as a whole and unchanged
    SELECT DISTINCT len(words) AS size FROM items WHERE len(words) BETWEEN 1 AND 12
), runs AS (
    SELECT doc_id, size, words, unnest(range(1, len(words) - size + 2)) AS place FROM texts, sizes
), whole AS (
    SELECT doc_id, item_id, size, min(place) - 1 AS start
    FROM runs JOIN items i ON size = len(i.words) AND runs.words[place:place + size - 1] = i.words
    GROUP BY doc_id, item_id, size
)
SELECT doc_id, item_id, CAST(min(starts[1] - 1 + first - 1 + shift) AS BIGINT) AS start,
       CAST(max(list_sum(agree)) AS BIGINT) AS matched,
       CAST(max_by(len(agree), list_sum(agree) * 1000000 + len(agree)) AS BIGINT) AS aligned
FROM windows WHERE len(starts) > 0 GROUP BY doc_id, item_id
UNION ALL
SELECT doc_id, item_id, CAST(start AS BIGINT), CAST(size AS BIGINT), CAST(size AS BIGINT) FROM whole
"""

REPEATED_WORDS_SQL = r"""
WITH texts AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), places AS (
    SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS place FROM texts
), windows AS (
    SELECT doc_id, place, array_to_string(words[place:place + 12], ' ') AS words
    FROM places WHERE place + 12 <= len(words)
), firsts AS (
    SELECT words, min(doc_id) AS doc_id FROM windows GROUP BY words
), repeats AS (
    SELECT w.doc_id, w.place FROM windows w JOIN firsts f ON w.words = f.words AND w.doc_id > f.doc_id
), removed AS (
    SELECT DISTINCT doc_id, unnest(range(place, place + 13)) AS place FROM repeats
), kept AS (
    SELECT p.doc_id, count(*) AS n, string_agg(p.words[p.place], ' ' ORDER BY p.place) AS words
    FROM places p ANTI JOIN removed r ON p.doc_id = r.doc_id AND p.place = r.place GROUP BY p.doc_id
)
SELECT t.doc_id, CAST(len(t.words) AS BIGINT) AS n_words,
       CAST(len(t.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.words, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (doc_id)
"""

NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS words
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ')
        ELSE array_to_string(words[place:place + 4], ' ') END AS shingle
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS place
          FROM texts WHERE len(words) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * common.n >= 85 * (x.n + y.n - common.n)
), reached AS (
    SELECT doc_id AS a, doc_id AS b FROM texts UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), named AS (
    SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, component_id = doc_id AS kept
FROM named LEFT JOIN sizes USING (doc_id)
"""


def mined_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector; labels of every seventh are moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = load(spark, folder, "embeddings")
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0, label=moved)


MINED_NEGATIVES_SQL = """
WITH vectors AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same,
           CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
    FROM vectors a JOIN vectors c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id AS negative_id,
       positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 5
"""


def spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents and the spelling each belongs to."""
    return spelling.group_variants(load(spark, folder, "documents"))


def frequent_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Documents less the lines that ten or more of them share."""
    return lines.drop_frequent_lines(load(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


FREQUENT_LINES_SQL = r"""
WITH texts AS (
    SELECT row_number() OVER () AS nr, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), places AS (
    SELECT nr, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS place FROM texts
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM places
), frequent AS (
    SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT nr) >= 10
), kept AS (
    SELECT nr, count(*) AS n, string_agg(line, chr(10) ORDER BY place) AS text
    FROM keyed ANTI JOIN frequent USING (key) GROUP BY nr
)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - coalesce(n, 0) AS BIGINT) AS n_dropped,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (nr)
"""

QUERIES: dict[str, Query] = {
    "op1_quality": Query(quality_scores),
    "op2_substring": Query(repeated_words, REPEATED_WORDS_SQL),
    "op3_toxicity": Query(toxicity_scores),
    "op4_language": Query(languages),
    "op5_suffixes": Query(repeated_bytes),
    "op6_minhash": Query(near_duplicates, NEAR_DUPLICATES_SQL),
    "op7_bpe": Query(bpe_tokens),
    "op8_warc": Query(archived_pages, ARCHIVED_PAGES_SQL),
    "op9_nearest": Query(nearest_vectors, NEAREST_VECTORS_SQL),
    "op10_spaced_seeds": Query(leaked_passages, LEAKED_PASSAGES_SQL),
    "op11_hard_negatives": Query(mined_negatives, MINED_NEGATIVES_SQL),
    "op12_spelling": Query(spelling_variants),
    "op13_lines": Query(frequent_lines, FREQUENT_LINES_SQL),
}
