"""Tokens, n-gram counts, TF-IDF, hashing and class-based TF-IDF in long form.

A document is one row, so its terms are counted inside the row, without a shuffle. Counts per class
are combined within each task before they are shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.binding import computed
from topicloom.functions.text import (
    collapse_repeats,
    hash_weights,
    ngrams,
    split_text,
    strip,
    term_counts,
    tokens,
    without,
)
from topicloom.operators.skew import (
    attach,
    ROWS_PER_TASK,
    as_list,
    frequent_keys,
    salted_join,
)
from topicloom.session import at_rest, checkpoint


#: Terms of a lemma table that is looked up inside the row: a map is searched from its first entry on.
LEMMAS_IN_ROW = 256


#: Letters of text that a task cuts into terms: what it counts of them stays in its memory.
LETTERS_PER_TASK = 8_000_000

#: Terms of the most documents whose weights every task may hold.
COMMON_TERMS = 100_000

#: Classes whose counts stand beside each other in the row of a term.
CLASSES_IN_ROW = 64

#: Column of a table of scores that tells which rows may be among the so many best of their class.
LEADS, LEADERS = "__leads", 100


def dealt(df: DataFrame, text: str = "text") -> DataFrame:
    """Texts in so many tasks that none has many more than ``LETTERS_PER_TASK``, as they are if they are already."""
    letters = df.agg(F.sum(F.length(text).cast("long")).alias("n")).first().n or 0
    wanted = -(-letters // LETTERS_PER_TASK)
    # The plans spread small tables over all cores.
    if wanted <= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def _kept(words: Column, clean: bool, stop_words: Sequence[str], extra: Sequence[str]) -> Column:
    """Stop words are met in any case; extra ones are compared with the token as it comes out."""
    cleaned = F.transform(words, F.lower) if clean else words
    if not stop_words and not extra:
        return cleaned
    stop, extra = sorted({w.lower() for w in stop_words}), sorted(set(extra))
    return F.filter(
        cleaned,
        lambda w: ~(F.lower(w).isin(stop) if stop else F.lit(False))
        & ~(w.isin(extra) if extra else F.lit(False)),
    )


def tokenize(
    df: DataFrame,
    column: str,
    out: str = "tokens",
    clean: bool = True,
    remove_stop_words: bool = True,
    stop_words: Sequence[str] = (),
    extra_stop_words: Sequence[str] = (),
    tokenizer: Callable[[pd.Series], pd.Series] | None = None,
) -> DataFrame:
    """Tokens of each text; ``clean`` lower-cases, both word lists count only when removing.

    ``tokenizer`` replaces the built-in pattern by a function from a batch of texts to a batch of
    token lists, for instance one that returns lemmas.
    """
    if tokenizer is None:
        words = tokens(F.col(column), lower=False)
    else:
        words = F.pandas_udf(tokenizer, "array<string>")(F.col(column))
    if not remove_stop_words:
        stop_words = extra_stop_words = ()
    return df.withColumn(out, _kept(words, clean, stop_words, extra_stop_words))


def sentence_tokens(
    df: DataFrame,
    column: str,
    out: str = "tokens",
    clean: bool = True,
    remove_stop_words: bool = True,
    stop_words: Sequence[str] = (),
    extra_stop_words: Sequence[str] = (),
) -> DataFrame:
    """One token list per sentence of each text."""
    if not remove_stop_words:
        stop_words = extra_stop_words = ()
    split = F.sentences(F.col(column), F.lit("en"), F.lit("US"))
    return df.withColumn(
        out, F.transform(split, lambda s: _kept(s, clean, stop_words, extra_stop_words))
    )


def lemmatize(
    df: DataFrame,
    lemmas: DataFrame,
    id: str,
    tokens: str = "tokens",
    out: str = "tokens",
) -> DataFrame:
    """Replace tokens by their lemmas, given as ``(term, lemma)``; others stay as they are.

    A table of at most ``LEMMAS_IN_ROW`` terms becomes a map that is looked up inside the row. A larger one
    is joined with the distinct terms of each row, of which only those with a lemma go on. Of several
    lemmas of a term the smallest counts; missing terms and lemmas do not. ``id`` must identify a row; rows
    without an id or tokens keep their tokens.
    """
    known = lemmas.where(F.col("term").isNotNull() & F.col("lemma").isNotNull())
    known = known.groupBy("term").agg(F.min("lemma").alias("lemma"))
    few = known.limit(LEMMAS_IN_ROW + 1).collect()
    if len(few) <= LEMMAS_IN_ROW:
        # A constant, so that the map is made once and not for every row.
        table = F.from_json(F.lit(json.dumps({r.term: r.lemma for r in few})), "map<string,string>")
        replaced = F.transform(tokens, lambda t: F.coalesce(table[t], t))
        return df.withColumn(out, F.when(F.col(id).isNotNull(), replaced).otherwise(F.col(tokens)))
    found = df.where(F.col(id).isNotNull()).select(id, F.explode(F.array_distinct(tokens)).alias("term"))
    met = salted_join(found, known, "term", id, frequent_keys(found, "term"))
    # A row holds its own distinct terms.
    pairs = F.map_from_entries(F.collect_list(F.struct("term", "lemma"))).alias("__lemmas")
    joined = attach(df, met.groupBy(id).agg(pairs), id)
    replaced = F.transform(tokens, lambda t: F.coalesce(F.col("__lemmas")[t], t))
    return joined.withColumn(out, replaced).drop("__lemmas")


def terms(
    text: str, sizes: tuple[int, int] = (1, 1), stop_words: Sequence[str] = ()
) -> Column:
    """N-grams of a text column, stop words out before the n-grams are built."""
    return ngrams(without(tokens(F.col(text)), stop_words), sizes)


def count_vectorize(
    df: DataFrame,
    id: str | Sequence[str],
    text: str = "text",
    sizes: tuple[int, int] = (1, 1),
    stop_words: Sequence[str] = (),
    total: str | None = None,
) -> DataFrame:
    """``(id, term, tf)``, one row of ``df`` per document. No shuffle.

    ``total`` names a column for the number of terms in the document.
    """
    id = as_list(id)
    found = terms(text, sizes, stop_words)
    if total is None:
        counted = df.select(*id, F.explode(term_counts(found)).alias("__c"))
        extra = []
    else:
        kept = computed(df.select(*id, text), "__terms", found).withColumn(total, F.size("__terms"))
        counted = kept.select(*id, total, F.explode(term_counts(F.col("__terms"))).alias("__c"))
        extra = [total]
    return counted.select(*id, F.col("__c.term").alias("term"), F.col("__c.tf").alias("tf"), *extra)


def frequent_terms(df: DataFrame, id: str, text: str, **options) -> list[int]:
    """Hashes of the terms that are in so many documents that a join on them needs salting.

    A term has one row per document, so small corpora have none. Large ones are judged on every
    hundredth document: this steers where rows are joined and does not touch any result.
    """
    n = df.count()
    if n <= ROWS_PER_TASK:
        return []
    some = df.where(F.pmod(F.xxhash64(id), F.lit(100)) == 0)
    return frequent_keys(count_vectorize(some, id, text, **options), "term", ROWS_PER_TASK // 100)


def tfidf(
    df: DataFrame,
    id: str,
    text: str = "text",
    sizes: tuple[int, int] = (1, 1),
    stop_words: Sequence[str] = (),
) -> DataFrame:
    """``(id, term, tfidf)`` with ``tf * (ln((1 + n) / (1 + df)) + 1)`` at document length one."""
    options = {"sizes": sizes, "stop_words": stop_words}
    counts = count_vectorize(df, id, text, **options)
    idf = _inverse(counts, df.count())
    return _at_length_one(counts, idf, id, frequent_terms(df, id, text, **options))


def _inverse(counts: DataFrame, n: int) -> DataFrame:
    """``(term, __idf)`` of terms that have one row per document, of ``n`` documents."""
    documents = counts.groupBy("term").agg(F.count("*").alias("__df"))
    return documents.select("term", (F.log((1.0 + n) / (1.0 + F.col("__df"))) + 1.0).alias("__idf"))


def _at_length_one(counts: DataFrame, idf: DataFrame, id: str, hot: Sequence[int]) -> DataFrame:
    weighted = salted_join(counts, idf, "term", id, hot).withColumn(
        "__w", F.col("tf") * F.col("__idf")
    )
    # A window holds the distinct terms of one document.
    length = F.sqrt(F.sum(F.col("__w") * F.col("__w")).over(Window.partitionBy(id)))
    return weighted.select(id, "term", (F.col("__w") / length).alias("tfidf"))


def hashing_vectorize(
    df: DataFrame,
    id: str,
    text: str = "text",
    n_features: int = 2**20,
    sizes: tuple[int, int] = (1, 1),
    stop_words: Sequence[str] = (),
) -> DataFrame:
    """``(id, bucket, value)``: signed hash counts at document length one. No shuffle."""
    weights = hash_weights(term_counts(terms(text, sizes, stop_words)), n_features)
    with_weights = computed(df.select(id, text), "__w", weights).drop(text)
    squares = F.aggregate(
        "__w", F.lit(0).cast("bigint"), lambda t, p: t + p["weight"].cast("bigint") * p["weight"]
    )
    # Before the explode: an expression beside it would be computed for every exploded row.
    with_length = computed(with_weights, "__length", F.sqrt(squares))
    rows = with_length.select(id, "__length", F.explode("__w").alias("__p"))
    return rows.where(F.col("__p.weight") != 0).select(
        id,
        F.col("__p.bucket").alias("bucket"),
        (F.col("__p.weight") / F.col("__length")).alias("value"),
    )


def class_counts(
    df: DataFrame,
    group: str | Sequence[str],
    text: str = "text",
    sizes: tuple[int, int] = (1, 1),
    stop_words: Sequence[str] = (),
) -> DataFrame:
    """``(group, term, n)``: term counts per class, combined within each task first."""
    group = as_list(group)
    exploded = dealt(df, text).select(*group, F.explode(terms(text, sizes, stop_words)).alias("term"))
    return exploded.groupBy(*group, "term").agg(F.count("*").alias("n"))


def class_totals(
    df: DataFrame,
    group: str,
    text: str = "text",
    sizes: tuple[int, int] = (1, 1),
    stop_words: Sequence[str] = (),
) -> DataFrame:
    """``(group, total)``: the number of terms in each class, from the number of words of its texts."""
    words = F.size(without(tokens(F.col(text)), stop_words))
    sized = computed(df.where(F.col(text).isNotNull()).select(group, text), "__words", words)
    found = [F.greatest(F.col("__words") - (n - 1), F.lit(0)) for n in range(sizes[0], sizes[1] + 1)]
    sums = sized.groupBy(group).agg(F.sum(sum(found[1:], found[0]).cast("long")).alias("total"))
    return checkpoint(sums.where("total > 0"))


def counts_side_by_side(
    rows: DataFrame, group: str, classes: DataFrame, n: Column | None = None
) -> DataFrame:
    """``(group, term, n, everywhere)`` from ``(group, term)``, ``n`` telling how often a row counts.

    ``classes`` has a row per class. A term is shuffled once per task, with a sum for every class, so that
    the count over all of them is at hand. More than ``CLASSES_IN_ROW`` classes go by rows of their own.
    """
    kind = rows.schema[group].dataType
    some = [r[0] for r in classes.select(group).limit(CLASSES_IN_ROW + 1).collect()]
    one = F.lit(1) if n is None else n
    if not 0 < len(some) <= CLASSES_IN_ROW:
        counts = rows.groupBy(group, "term").agg(F.sum(one).alias("n"))
        return counts.withColumn("everywhere", F.sum("n").over(Window.partitionBy("term")))
    values = [F.lit(v).cast(kind) for v in some]
    sums = rows.groupBy("term").agg(
        *[F.sum(F.when(F.col(group).eqNullSafe(v), one)).alias(f"__{i}") for i, v in enumerate(values)]
    )
    everywhere = sum([F.coalesce(F.col(f"__{i}"), F.lit(0)) for i in range(1, len(some))], F.coalesce(F.col("__0"), F.lit(0)))
    held = F.array(*[F.struct(v.alias("c"), F.col(f"__{i}").alias("n")) for i, v in enumerate(values)])
    found = sums.select("term", everywhere.alias("everywhere"), F.explode(held).alias("__s"))
    return found.where(F.col("__s.n").isNotNull()).select(
        F.col("__s.c").alias(group), "term", F.col("__s.n").alias("n"), "everywhere"
    )


def class_scores(
    df: DataFrame,
    group: str,
    text: str = "text",
    sizes: tuple[int, int] = (1, 1),
    stop_words: Sequence[str] = (),
    reduce_frequent_words: bool = False,
) -> DataFrame:
    """:func:`class_tfidf` of :func:`class_counts` from texts, with one shuffle of terms and none written."""
    options = {"sizes": sizes, "stop_words": stop_words}
    totals = class_totals(df, group, text, **options)
    exploded = dealt(df, text).select(group, F.explode(terms(text, **options)).alias("term"))
    counts = counts_side_by_side(exploded, group, totals)
    return class_tfidf(counts, group, reduce_frequent_words, totals)


def class_tfidf(
    counts: DataFrame, group: str, reduce_frequent_words: bool = False, totals: DataFrame | None = None
) -> DataFrame:
    """``(group, term, n, idf, score)`` from class counts: ``tf * ln(1 + A / f)``.

    ``tf`` is the share of the term in its class, or the root of it when frequent words are
    reduced; ``f`` the count over all classes; ``A`` the mean number of terms per class, cut to a
    whole number. The class totals are small and joined as measured at run time. The counts are
    read three times, so write or checkpoint them first; once, if ``totals`` are given as ``(group, total)``
    and the counts have a column ``everywhere``.
    """
    small = totals is not None and totals.limit(CLASSES_IN_ROW + 1).count() <= CLASSES_IN_ROW
    if totals is None:
        totals = counts.groupBy(group).agg(F.sum("n").alias("total"))
    totals = totals.select(group, F.col("total").alias("__total"))
    mean = totals.agg(F.floor(F.avg("__total")).alias("a")).scalar()
    if "everywhere" not in counts.columns:
        # A window holds one term: a row per class.
        counts = counts.withColumn("everywhere", F.sum("n").over(Window.partitionBy("term")))
    idf = F.log(1.0 + mean / F.col("everywhere"))
    weighted = counts.select(group, "term", "n", idf.alias("idf"))
    score = share(F.col("n"), F.col("__total"), reduce_frequent_words) * F.col("idf")
    totals = F.broadcast(totals) if small else totals
    return weighted.join(totals, group).select(group, "term", "n", "idf", score.alias("score"))


def share(n: Column, total: Column, reduce_frequent_words: bool) -> Column:
    """Part of a term in its class or document, or the root of that part."""
    return F.sqrt(n / total) if reduce_frequent_words else n / total


def top_terms(
    scores: DataFrame, group: str | Sequence[str], n: int, score: str = "score", term: str = "term"
) -> DataFrame:
    """The ``n`` best rows per group with their ``rank``; equal scores go by term.

    Spark keeps the best ``n`` per group in each task before it shuffles. Only rows that lead are sorted where
    the table tells them.
    """
    if LEADS in scores.columns:
        scores = (scores.where(LEADS) if n <= LEADERS else scores).drop(LEADS)
    best = Window.partitionBy(*as_list(group)).orderBy(F.desc(score), term)
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def _sentence_scores(df: DataFrame, weights: DataFrame, id: str, text: str, separator: str) -> DataFrame:
    """``(id, __at, __score)`` by a join of the terms of sentences with weights of documents."""
    sentences = df.select(id, F.posexplode(split_text(F.col(text), separator)).alias("__at", "__sentence"))
    words = sentences.select(id, "__at", F.explode(tokens(strip(F.col("__sentence")))).alias("term"))
    # Term counts per sentence meet the weights on document and term, which no row dominates.
    return (
        words.groupBy(id, "__at", "term")
        .agg(F.count("*").alias("__n"))
        .join(weights, [id, "term"])
        .groupBy(id, "__at")
        .agg((F.sum(F.col("tfidf") * F.col("__n")) / F.sum("__n")).alias("__score"))
    )


def _places_of_terms(df: DataFrame, id: str, text: str, separator: str) -> DataFrame:
    """``(id, term, __places)``: of each term of a document the sentence of every occurrence. No shuffle."""

    def said(sentence: Column, at: Column) -> Column:
        return F.transform(tokens(sentence), lambda term: F.struct(term.alias("term"), at.alias("at")))

    pairs = F.sort_array(F.flatten(F.transform(split_text(F.col(text), separator), said)))
    found = computed(df.select(id, text), "__pairs", pairs).drop(text)
    runs = collapse_repeats(F.transform("__pairs", lambda p: p["term"]))
    found = found.select(id, "__pairs", F.explode(runs).alias("__run"))
    members = F.slice("__pairs", F.col("__run.first") + 1, F.col("__run.last") - F.col("__run.first") + 1)
    return found.select(
        id, F.col("__run.value").alias("term"), F.transform(members, lambda p: p["at"]).alias("__places")
    )


def _scores_by_sums(places: DataFrame, idf: DataFrame, id: str) -> DataFrame:
    """``(id, __at, __score)`` of documents that are one row each.

    Rows of common terms stay in the task that made them, and are summed up there before anything is
    shuffled; only those of the other terms are sent to their weights.
    """
    common = F.broadcast(idf.orderBy("__idf", "term").limit(COMMON_TERMS))
    near = places.join(common, "term")
    far = places.join(common, "term", "left_anti").join(idf, "term")
    weight = F.size("__places") * F.col("__idf")

    def sums(rows: DataFrame) -> DataFrame:
        # Place -1 stands for the whole document.
        weighed = rows.select(id, weight.alias("__w"), F.explode(F.concat("__places", F.array(F.lit(-1)))).alias("__at"))
        part = F.when(F.col("__at") < 0, F.col("__w") * F.col("__w")).otherwise(F.col("__w"))
        return weighed.groupBy(id, "__at").agg(F.sum(part).alias("__sum"), F.count("*").alias("__n"))

    parts = sums(near).unionByName(sums(far)).groupBy(id, "__at").agg(F.sum("__sum").alias("__sum"), F.sum("__n").alias("__n"))
    squares = F.max(F.when(F.col("__at") < 0, F.col("__sum"))).over(Window.partitionBy(id))
    scored = parts.withColumn("__squares", squares).where("__at >= 0")
    return scored.select(id, "__at", (F.col("__sum") / F.col("__n") / F.sqrt("__squares")).alias("__score"))


def tfidf_summarize(
    df: DataFrame, id: str, text: str = "text", n: int = 3, separator: str = "\n"
) -> DataFrame:
    """``(id, summary)``: the ``n`` sentences with the highest mean TF-IDF, in text order.

    A document without any token has an empty summary. Rows of one id are one document.
    """
    if separator.isspace():
        # Sentences have the terms of their text, and a document of one row is summed up without a join of its own.
        # Terms are cut out of the texts once and read three times.
        places = at_rest(_places_of_terms(df, id, text, separator))
        idf = at_rest(_inverse(places, df.count()))
        counted = df.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("__several")).count()
        several = checkpoint(counted.where("count > 1").select("__several"))
        repeated = F.col(id) == F.col("__several")
        scored = None
        if several.take(1):
            rest = df.join(several, repeated, "left_semi")
            weights = _at_length_one(count_vectorize(rest, id, text), idf, id, frequent_terms(rest, id, text))
            scored = _sentence_scores(rest, weights, id, text, separator)
            places = places.join(several, repeated, "left_anti")
        summed = _scores_by_sums(places.where(F.col(id).isNotNull()), idf, id)
        scored = summed if scored is None else summed.unionByName(scored)
    else:
        scored = _sentence_scores(df, tfidf(df, id, text), id, text, separator)
    sentences = df.select(
        id, F.posexplode(split_text(F.col(text), separator)).alias("__at", "__sentence")
    ).withColumn("__sentence", strip(F.col("__sentence")))
    best = Window.partitionBy(id).orderBy(F.desc(F.round("__score", 9)), "__at")
    chosen = scored.withColumn("__rank", F.row_number().over(best)).where(F.col("__rank") <= n)
    ordered = F.sort_array(F.collect_list(F.struct("__at", "__sentence")))
    found = (
        sentences.join(chosen, [id, "__at"])
        .groupBy(id)
        .agg(F.array_join(F.transform(ordered, lambda s: s["__sentence"]), separator).alias("summary"))
    )
    return attach(df.select(id), found, id).withColumn("summary", F.coalesce("summary", F.lit("")))
