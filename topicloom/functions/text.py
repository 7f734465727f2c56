"""Scalar text functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from topicloom.functions.binding import let
from topicloom.functions.vectors import hash_bucket, hash_sign

# Fixed value: what counts as a token, two or more letters, digits or underscores of any script.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def to_seconds(time: Column) -> Column:
    """``HH:MM:SS.mmm``, or any number of parts between colons, as seconds."""
    return F.aggregate(
        F.split(time, ":"),
        F.lit(0.0),
        lambda total, part: total * 60 + part.cast("double"),
    )


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def split_text(text: Column, separator: str = "\n") -> Column:
    """Parts between literal separators; empty parts are kept, also at the end."""
    quoted = r"\Q" + separator.replace(r"\E", r"\E\\E\Q") + r"\E"
    return F.split(text, quoted, -1)


def tokens(text: Column, pattern: str = TOKEN_PATTERN, lower: bool = True) -> Column:
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(pattern), F.lit(0))


def without(words: Column, stop_words: Sequence[str]) -> Column:
    """The words that are not in the list."""
    if not stop_words:
        return words
    stop = sorted(set(stop_words))
    return F.filter(words, lambda w: ~w.isin(stop))


def ngrams(words: Column, sizes: tuple[int, int] = (1, 1)) -> Column:
    """All runs of neighbouring words with a length in the range, both ends included."""
    low, high = sizes
    if (low, high) == (1, 1):
        return words

    def of_size(w: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - n + 1)
        grams = F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, grams).otherwise(F.array().cast("array<string>"))

    return let(words, lambda w: F.flatten(F.array(*[of_size(w, n) for n in range(low, high + 1)])))


def collapse_repeats(parts: Column) -> Column:
    """Runs of equal neighbours in an array, as ``(run, first, last, value)`` structs.

    Works inside the row, so lines of one text are collapsed without a shuffle.
    """

    def starts(p: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(p) - 1)
        new = F.filter(places, lambda i: (i == 0) | ~F.get(p, i).eqNullSafe(F.get(p, i - 1)))
        return F.when(F.size(p) > 0, new).otherwise(F.array().cast("array<int>"))

    def runs(p: Column, firsts: Column) -> Column:
        return F.transform(
            firsts,
            lambda first, run: F.struct(
                run.alias("run"),
                first.alias("first"),
                (F.coalesce(F.get(firsts, run + 1), F.size(p)) - 1).alias("last"),
                F.get(p, first).alias("value"),
            ),
        )

    return let(parts, lambda p: let(starts(p), lambda firsts: runs(p, firsts)))


def term_counts(terms: Column) -> Column:
    """How often each distinct term occurs, as ``(term, tf)`` structs in term order."""
    runs = collapse_repeats(F.sort_array(terms))
    return F.transform(
        runs, lambda r: F.struct(r["value"].alias("term"), (r["last"] - r["first"] + 1).alias("tf"))
    )


def hash_weights(counts: Column, size: int) -> Column:
    """Signed sums of term counts per hash bucket, as ``(bucket, weight)`` structs."""

    def total(pairs: Column, run: Column) -> Column:
        members = F.slice(pairs, run["first"] + 1, run["last"] - run["first"] + 1)
        return F.aggregate(members, F.lit(0), lambda t, p: t + p["weight"])

    def sums(pairs: Column) -> Column:
        runs = collapse_repeats(F.transform(pairs, lambda p: p["bucket"]))
        return F.transform(
            runs, lambda r: F.struct(r["value"].alias("bucket"), total(pairs, r).alias("weight"))
        )

    # Each digest is made once and read twice.
    digests = F.transform(counts, lambda c: F.struct(F.md5(c["term"]).alias("digest"), c["tf"].alias("tf")))
    pairs = F.transform(
        digests,
        lambda c: F.struct(
            hash_bucket(c["digest"], size).alias("bucket"),
            (hash_sign(c["digest"]) * c["tf"]).alias("weight"),
        ),
    )
    return let(F.sort_array(pairs), sums)


def hash_vector(terms: Column, size: int) -> Column:
    """Dense vector of signed hash counts, not normalised."""
    weights = let(
        hash_weights(term_counts(terms), size),
        lambda w: F.map_from_arrays(
            F.transform(w, lambda p: p["bucket"]),
            F.transform(w, lambda p: p["weight"].cast("double")),
        ),
    )
    places = F.sequence(F.lit(0), F.lit(size - 1))
    return let(weights, lambda m: F.transform(places, lambda b: F.coalesce(m[b], F.lit(0.0))))


# Fixed value: how a topic is written.
def topic_name(topic: Column, keywords: Column, n: int = 5) -> Column:
    """``Topic 3: `a, b, c...```, from the first keywords."""
    shown = F.array_join(F.slice(keywords, 1, n), ", ")
    return F.concat(F.lit("Topic "), topic.cast("string"), F.lit(": `"), shown, F.lit("...`"))


def first_element(values: Column) -> Column:
    """First item, null for an empty list."""
    return F.get(values, F.lit(0))
