"""From raw documents to tokens: five stages, each written as Parquet and read by the next one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicloom.llm import bpe, language, minhash, queries, spaced_seeds, substring
from topicloom.llm.store import small_batches, written
from topicloom.operators.skew import frequent_keys, salted_join
from topicloom.sources.tables import load

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Hundredths of similarity from which documents are near-duplicates.
SIMILARITY = 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the model knows.

    The model is fitted on the labelled documents of the stage's input. A document goes if its text is
    null or has no letter. Texts of several languages stay: every span of theirs is in one that is known.
    Where nothing is labelled there is no model, and every document with a letter stays.
    """
    small_batches(spark)
    model = queries.fitted_language(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    labelled = language.label_languages(docs, model, keep=docs.columns)
    return labelled.where(F.col("lang_pred") != language.UNKNOWN).select("row.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest id.

    Rows whose id is repeated are documents of their own, known by a hash of id and text; of those of the
    smallest id in a group the first by its columns stays.
    Documents without words or without an id are in no group and all stay.
    """
    small_batches(spark)
    several = docs.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__rows"))
    several = written(several.where("__rows > 1 AND __id IS NOT NULL").select("__id"), "repeated_ids")
    if not several.take(1):
        kept = minhash.near_duplicates(docs, SIMILARITY).where("kept AND doc_id IS NOT NULL")
        ids = written(kept.select(F.col("doc_id").alias("__id")), "kept")
        stay = docs.join(ids, F.col("doc_id") == F.col("__id"), "left_semi")
        return stay.unionByName(docs.where("doc_id IS NULL"))
    marks = several.select(F.col("__id").alias("doc_id"), F.lit(True).alias("__several"))
    keyed = salted_join(docs, marks, "doc_id", "text", frequent_keys(docs, "doc_id"), "left")
    own = F.when(F.col("__several"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))
    keyed = written(keyed.withColumn("__key", own).drop("__several"), "keyed")
    found = minhash.near_duplicates(keyed, SIMILARITY, id="__key").where("__key IS NOT NULL")
    groups = written(found.select("__key", "component_id").distinct(), "groups")
    placed = salted_join(keyed, groups, "__key", "source", frequent_keys(keyed, "__key"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    first = F.min(F.struct(F.col("doc_id").alias("__first"), F.struct(*columns).alias("row"))).alias("__least")
    stay = placed.groupBy("component_id").agg(first).select("__least.row.*")
    return stay.unionByName(keyed.where("__key IS NULL").select(docs.columns))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the passages of 13 words that a smaller id holds too.

    A document that loses words is rewritten as the others joined by blanks, with ``n_chars`` anew; one
    that loses nothing stays as it is; one that loses all of its words goes.
    """
    small_batches(spark)
    cut = substring.remove_repeats(docs, keep=[c for c in docs.columns if c != "text"])
    changed = F.col("n_removed") > 0
    left = F.col("kept").cast("string")
    new = {
        "text": F.when(changed, left).otherwise(F.col("text")),
        "n_chars": F.when(changed, F.length(left).cast("long")).otherwise(F.col("row.n_chars")),
    }
    columns = [new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    return cut.where(~changed | (F.col("n_removed") < F.col("n_words"))).select(columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    # Rows are told apart by id and text, so that null and repeated ids do no harm.
    row = F.concat_ws(":", F.col("doc_id").cast("string"), F.hex(F.xxhash64("doc_id", "text")))
    benchmark = load(spark, sf_dir, "benchmark")
    leaks = spaced_seeds.find_passages(docs.select(row.alias("__row"), "text"), benchmark, id="__row")
    return docs.join(leaks.select("__row").distinct(), row == F.col("__row"), "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document, and a digest of what they decode to."""
    small_batches(spark)
    encoded = bpe.encode_texts(docs, queries.vocabulary())
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("tokens", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "tokens",
    )


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("near_duplicates", without_near_duplicates),
    ("repeats", without_repeats),
    ("benchmark", without_benchmark),
    ("tokens", tokens),
]

#: Language labels, similarities and merges are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
