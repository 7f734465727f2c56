"""Terms of documents counted by class, packed on their way.

A task cuts its texts into n-grams as numbers and spells each one out once. What is shuffled is a compressed row
for every so many letters of text ("chunk") and range of hashes ("bucket"): terms, and the documents that hold
them. Buckets are sorted into parts, of which there are few however many texts there are. A part goes through its
buckets one at a time and adds up for every document how near it is to its classes, so that neither counts
nor scores nor terms of documents are written or joined.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions.text import tokens
from topicloom.operators.text_features import CLASSES_IN_ROW, LEADERS, LEADS
from topicloom.session import at_rest

#: Letters of words that a task packs at a time, and letters of all texts for a bucket.
CHUNK_LETTERS, BUCKET_LETTERS = 3_000_000, 3_000_000
#: Parts at least and at most, letters for a part between, and letters that make a part worth its task.
FEWEST_PARTS, MOST_PARTS, PART_LETTERS, SMALL_PART = 12, 96, 160_000_000, 500_000
#: Bytes about documents that a part may hold.
STATE_BYTES = 512 << 20
#: Rows that are handed on at a time.
BATCH_ROWS = 50_000

_PACKED = "part int, bucket int, chunk long, data binary"


def _give_back() -> None:
    """Freed memory goes back to the machine, as the worker lives on beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


# --- arrays as bytes -------------------------------------------------------------------------------


def pack(arrays: Sequence[np.ndarray]) -> bytes:
    """Whole numbers from 0 on and doubles: the narrowest kind that holds them, by byte planes, compressed."""
    head, planes = [len(arrays)], []
    for a in arrays:
        if a.dtype.kind == "f":
            a, code = a.astype("<f8"), 9
        else:
            code = next(c for c in (1, 2, 4, 8) if c == 8 or int(a.max(initial=0)) < 1 << 8 * c)
            a = a.astype(f"<u{code}")
        head += [code, len(a)]
        planes.append(np.ascontiguousarray(np.frombuffer(a.tobytes(), np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"")
    data = np.array(head, "<u4").tobytes() + b"".join(planes)
    return np.array([len(data)], "<u4").tobytes() + pa.Codec("zstd", compression_level=3).compress(data, asbytes=True)


def unpack(packed: Any) -> list[np.ndarray]:
    view = memoryview(packed)
    size = int(np.frombuffer(view[:4], "<u4")[0])
    data = pa.Codec("zstd").decompress(pa.py_buffer(view[4:]), size)
    count = int(np.frombuffer(data, "<u4", 1)[0])
    head, at, found = np.frombuffer(data, "<u4", 2 * count, 4).tolist(), 4 + 8 * count, []
    for code, n in zip(head[::2], head[1::2], strict=True):
        width = min(code, 8)
        planes = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
        found.append(np.ascontiguousarray(planes.T).reshape(-1).view("<f8" if code == 9 else f"<u{code}"))
        at += n * width
    return found


# --- from texts to packed terms --------------------------------------------------------------------


@dataclass(frozen=True)
class Grams:
    """Distinct n-grams with their hashes, the documents of each in a row, and the n-grams of every document."""

    terms: pa.Array
    hashes: np.ndarray
    held: np.ndarray
    documents: np.ndarray
    times: np.ndarray
    totals: np.ndarray


def grams(words: pa.Array, sizes: tuple[int, int], stop_words: Iterable[str]) -> Grams:
    """N-grams of lists of words, stop words out before they are built."""
    low, high = sizes
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    n_docs = len(lengths)
    doc = np.repeat(np.arange(n_docs), lengths)
    encoded = words.flatten().dictionary_encode()
    order = pc.sort_indices(encoded.dictionary)
    vocabulary = encoded.dictionary.take(order)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    codes = rank[encoded.indices.to_numpy()]
    stop = pc.is_in(vocabulary, pa.array(sorted(set(stop_words)), vocabulary.type)).to_numpy(zero_copy_only=False)
    if stop.any():
        kept = ~stop[codes]
        doc, codes = doc[kept], codes[kept]
        lengths = np.bincount(doc, minlength=n_docs)
    own = pd.util.hash_array(np.array(vocabulary.to_pylist(), object), categorize=False) if len(vocabulary) else np.zeros(0, np.uint64)
    size, base, texts, hashes, now = max(1, len(vocabulary)), 0, vocabulary, own, codes
    found: list[tuple] = []
    for n in range(1, high + 1):
        at = np.arange(len(doc))
        c = codes
        if n > 1:
            at = np.flatnonzero(doc[: max(0, len(doc) - n + 1)] == doc[n - 1 :])
            # The n-gram before and one more word, as numbers in the order of their texts.
            c, different = pd.factorize(now[at] * size + codes[at + n - 1])
            order = np.argsort(different)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            c, different = rank[c], different[order]
            first, last = different // size, different % size
            texts = pc.binary_join_element_wise(texts.take(pa.array(first)), vocabulary.take(pa.array(last)), " ")
            hashes = hashes[first] * np.uint64(0x9E3779B97F4A7C15) + own[last]
            now = np.zeros(len(doc), np.int64)
            now[at] = c
        if n >= low:
            pairs = np.sort(c * n_docs + doc[at])
            new = np.flatnonzero(np.diff(pairs, prepend=-1))
            gram, documents = np.divmod(pairs[new], max(1, n_docs))
            held = np.bincount(gram, minlength=len(texts))
            # Words that only stood in for stop words are no terms.
            some = np.flatnonzero(held)
            found.append((texts.take(pa.array(some)), hashes[some], held[some], documents, np.diff(np.append(new, len(pairs)))))
        if not len(at):
            break
    totals = sum(np.maximum(lengths - n + 1, 0) for n in range(low, high + 1))
    terms = pa.concat_arrays([f[0] for f in found]) if found else pa.array([], pa.string())
    parts = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(1, 5)]
    return Grams(terms, *parts, totals)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def _by_bucket(found: Grams, buckets: int, postings: bool) -> Iterator[tuple[int, bytes]]:
    """``(bucket, data)``: lengths and letters of the terms, documents of each, and these or the sums of their times."""
    bucket = (_mixed(found.hashes.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=buckets))
    terms = found.terms.take(pa.array(order))
    offsets = np.frombuffer(terms.buffers()[1], np.int32, len(terms) + 1) if len(terms) else np.zeros(1, np.int32)
    letters = np.frombuffer(terms.buffers()[2], np.uint8) if len(terms) and terms.buffers()[2] else np.zeros(0, np.uint8)
    held, before = found.held[order], np.cumsum(found.held) - found.held
    places = np.concatenate([[0], np.cumsum(held)])
    at = np.repeat(before[order] - places[:-1], held) + np.arange(places[-1])
    documents, times = found.documents[at], found.times[at]
    lengths = np.diff(offsets)
    for b in range(buckets):
        low, high = int(ends[b - 1]) if b else 0, int(ends[b])
        if low == high:
            continue
        rows = slice(places[low], places[high])
        told = [documents[rows], times[rows]] if postings else [np.add.reduceat(times[rows], places[low:high] - places[low])]
        yield b, pack([lengths[low:high], letters[offsets[low] : offsets[high]], held[low:high], *told])


def _terms(lengths: np.ndarray, letters: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(letters.tobytes()))


@dataclass(frozen=True)
class Layout:
    """Parts by their labels, each its own partition, and buckets that are dealt to them."""

    labels: list[int]
    buckets: int


def layout(spark: SparkSession, letters: int, most: int | None = MOST_PARTS) -> Layout:
    cores = spark.sparkContext.defaultParallelism
    parts = max(min(max(FEWEST_PARTS, cores), letters // SMALL_PART + 1), letters // PART_LETTERS)
    parts = min(parts, most) if most else max(parts, letters // (2 * BUCKET_LETTERS))
    tried = F.col("id").cast("int")
    rows = spark.range(24 * parts).select(tried.alias("i"), F.pmod(F.hash(tried), F.lit(parts)).alias("p"))
    labels = {r.p: r.i for r in rows.groupBy("p").agg(F.min("i").alias("i")).collect()}
    found = [labels.get(p, 24 * parts + p) for p in range(parts)]
    return Layout(found, parts * max(1, -(-letters // (BUCKET_LETTERS * parts))))


def _letters(df: DataFrame, text: str, *also: Column) -> Any:
    return df.agg(F.sum(F.length(text).cast("long")).alias("letters"), F.count("*").alias("n"), *also).first()


def _packed(
    df: DataFrame, columns: Sequence[Column], text: str, sizes: tuple[int, int], stop_words: Sequence[str], where: Layout,
    about: Callable[[pa.Table, np.ndarray], bytes] | None = None, kind: str = "long",
) -> DataFrame:
    """Rows ``(part, bucket, chunk, data, ids)`` in the order of these; ``about`` makes what every part is told of a chunk.

    That comes as bucket -1; one part of each chunk gets the ids too.
    """
    rows = df.select(tokens(F.col(text)).alias("words"), *columns)
    stop_words, labels, buckets = tuple(stop_words), where.labels, where.buckets

    def of_chunk(chunk: int, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        words = table.column("words")
        found = grams(pa.concat_arrays(words.chunks), sizes, stop_words)
        names, made, size = ["part", "bucket", "chunk", "data", "ids"], [], 0
        ids = table.schema.field("id").type if about else pa.int64()
        if about:
            told = about(table, found.totals)
            for p, label in enumerate(labels):
                mine = table.column("id").to_pylist() if p == chunk % len(labels) else None
                made.append((label, -1, chunk, told, mine))
        for b, data in _by_bucket(found, buckets, about is not None):
            made.append((labels[b % len(labels)], b, chunk, data, None))
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(ids)]
        for begin in range(0, len(made), 64):
            some = zip(*made[begin : begin + 64], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(some, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, waiting, letters = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
            size = int(pc.sum(pc.binary_length(batch.column(0).flatten())).as_py() or 0)
            # A batch of many letters is cut by its words.
            share = np.cumsum(lengths) * (size / max(1, int(lengths.sum())))
            begin = 0
            while begin < batch.num_rows:
                before = share[begin - 1] if begin else 0.0
                end = max(begin + 1, int(np.searchsorted(share, before + CHUNK_LETTERS - letters, "right")))
                waiting.append(batch.slice(begin, end - begin))
                letters += int(share[min(end, len(share)) - 1] - before)
                begin = end
                if letters >= 0.9 * CHUNK_LETTERS:
                    yield from of_chunk(chunk, waiting)
                    chunk, waiting, letters = chunk + 1, [], 0
                    _give_back()
        if letters or waiting:
            yield from of_chunk(chunk, waiting)

    made = rows.mapInArrow(run, f"{_PACKED}, ids array<{kind}>")
    return made.repartition(len(labels), "part").sortWithinPartitions("part", "bucket", "chunk")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[tuple]]]:
    """``(part, bucket, [(chunk, data, ids)])`` of rows in this order."""
    last, group = None, []
    for batch in batches:
        part, bucket, chunk = (batch.column(i).to_numpy() for i in range(3))
        for i in range(batch.num_rows):
            key = int(part[i]), int(bucket[i])
            if key != last and group:
                yield *last, group
                group = []
            last = key
            ids = batch.column(4)[i]
            group.append((int(chunk[i]), batch.column(3)[i].as_py(), ids.values if ids.is_valid else None))
    if group:
        yield *last, group


# --- counts over all documents ---------------------------------------------------------------------


def term_totals(
    df: DataFrame, text: str = "text", sizes: tuple[int, int] = (1, 1), stop_words: Sequence[str] = ()
) -> DataFrame:
    """``(term, n_docs, n)``: in how many documents a term is, and how often; a row of ``df`` is a document."""
    where = layout(df.sparkSession, _letters(df, text).letters or 0, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, group in _groups(batches):
            parts = [unpack(data) for _, data, _ in group]
            whole = pa.concat_arrays([_terms(p[0], p[1]) for p in parts]).dictionary_encode()
            at, size = whole.indices.to_numpy(), len(whole.dictionary)
            sums = [np.bincount(at, np.concatenate([p[i] for p in parts]), size).astype(np.int64) for i in (2, 3)]
            yield from _sliced([whole.dictionary, *map(pa.array, sums)], ["term", "n_docs", "n"])

    packed = _packed(df, [], text, sizes, stop_words, where)
    return packed.mapInArrow(run, "term string, n_docs long, n long")


def _sliced(arrays: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(arrays, names=names)
    for begin in range(0, whole.num_rows, BATCH_ROWS):
        yield whole.slice(begin, BATCH_ROWS)


# --- counts and nearness by class ------------------------------------------------------------------


@dataclass(frozen=True)
class ClassTerms:
    """Scores of the terms of each class, and ``(class, id, similarity, __p)`` of the documents."""

    scores: DataFrame
    similar: DataFrame


class _Part:
    """What a part knows of all documents, and what it adds up for them."""

    def __init__(self, told: list[tuple], classes: int, soft: bool):
        self.first: dict[int, int] = {}
        totals, weights, n = [], [], 0
        for chunk, data, _ in told:
            total, weight = unpack(data)
            self.first[chunk] = n
            n += len(total)
            totals.append(total)
            weights.append(weight)
        self.n, self.classes, self.soft = n, classes, soft
        self.total = np.concatenate(totals).astype(np.int32)
        self.weight = np.concatenate(weights)
        if soft:
            self.weight = self.weight.reshape(-1, classes)
            self.totals = (self.total[:, None] * self.weight).sum(0) if n else np.zeros(classes)
        else:
            self.totals = np.bincount(self.weight, self.total, classes)
        there = self.totals[self.totals > 0]
        self.mean = float(np.floor(there.mean())) if len(there) else 0.0
        columns = classes if soft else 1
        self.dot, self.own = np.zeros((columns, n)), np.zeros((columns, n))
        self.squares = np.zeros(classes)


def class_terms(
    documents: DataFrame,
    id: str,
    text: str,
    group: str,
    sizes: tuple[int, int] = (1, 1),
    stop_words: Sequence[str] = (),
    reduce_frequent_words: bool = False,
    topics: int | None = None,
    least_share: float = 0.0,
    places: int | None = None,
) -> ClassTerms | None:
    """Class TF-IDF of the terms of documents, and the cosine of each document with its classes.

    ``group`` names the class of a document, or its shares of ``topics`` classes as an array, of which those
    from ``least_share`` on are compared. Scores are rounded to ``places``. Nothing is returned for more than
    ``CLASSES_IN_ROW`` classes, for more documents than a part may hold, or for shares below 0: those go
    by joins. Of the scores the best ``LEADERS`` of every class and bucket are written and the others made when read.
    """
    spark, soft = documents.sparkSession, topics is not None
    if soft:
        values: list[Any] = list(range(topics))
        share = F.transform(F.sequence(F.lit(0), F.lit(max(topics, 1) - 1)), lambda i: F.coalesce(F.get(group, i).cast("double"), F.lit(0.0)))
        odd = F.exists(group, lambda s: (s.cast("double") < 0) | F.isnan(s.cast("double")) | (s.cast("double") == float("inf")))
        weight, kind = share, "int"
        found = _letters(documents, text, F.max(F.coalesce(odd, F.lit(False))).alias("odd"))
    else:
        kind = documents.schema[group].dataType.simpleString()
        values = [r[0] for r in documents.select(group).distinct().limit(CLASSES_IN_ROW + 1).collect()]
        values.sort(key=lambda v: (v is None, v if v is not None else 0))
        tests = [F.when(F.col(group).eqNullSafe(F.lit(v).cast(kind)), F.lit(i)) for i, v in enumerate(values)]
        weight = F.coalesce(*tests, F.lit(0)) if tests else F.lit(0)
        found = _letters(documents, text, F.lit(False).alias("odd"))
    classes = len(values)
    if not 0 < classes <= CLASSES_IN_ROW or found.odd:
        return None
    if (found.n or 0) * (4 + (24 * classes if soft else 17)) > STATE_BYTES:
        return None
    where = layout(spark, found.letters or 0)
    named = np.array([v is not None for v in values])

    def about(table: pa.Table, totals: np.ndarray) -> bytes:
        column = table.column("weight").combine_chunks()
        flat = column.flatten() if soft else column
        return pack([totals, flat.to_numpy(zero_copy_only=False)])

    def add(part: _Part, group: list[tuple]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of a bucket with their counts, inverse frequencies and scores by class; documents get their sums."""
        parts = [unpack(data) for _, data, _ in group]
        whole = pa.concat_arrays([_terms(p[0], p[1]) for p in parts]).dictionary_encode()
        size = len(whole.dictionary)
        gram = np.repeat(whole.indices.to_numpy(), np.concatenate([p[2] for p in parts]))
        doc = np.concatenate([p[3].astype(np.int64) + part.first[chunk] for (chunk, _, _), p in zip(group, parts, strict=True)])
        times = np.concatenate([p[4] for p in parts]).astype(float)
        if soft:
            n = np.stack([np.bincount(gram, times * part.weight[doc, c], size) for c in range(classes)], axis=1)
        else:
            n = np.bincount(gram.astype(np.int64) * classes + part.weight[doc], times, size * classes).reshape(size, classes)
        with np.errstate(divide="ignore", invalid="ignore"):
            idf = np.log(1.0 + part.mean / n.sum(1))
            shares = n / part.totals
            score = (np.sqrt(shares) if reduce_frequent_words else shares) * idf[:, None]
            if places is not None:
                score = np.round(score, places)
            score = np.where((n > 0) & named, score, 0.0)
            part.squares += (score * score).sum(0)
            own = times / part.total[doc]
            weight = (np.sqrt(own) if reduce_frequent_words else own) * idf[gram]
        if soft:
            for c in range(classes):
                at = np.flatnonzero((part.weight[doc, c] >= least_share) & (n[gram, c] > 0))
                mine = weight[at]
                part.dot[c] += np.bincount(doc[at], mine * score[gram[at], c], part.n)
                part.own[c] += np.bincount(doc[at], mine * mine, part.n)
        else:
            part.dot[0] += np.bincount(doc, weight * score[gram, part.weight[doc]], part.n)
            part.own[0] += np.bincount(doc, weight * weight, part.n)
        return whole.dictionary, n, idf, score

    names = ["cls", "term", "n", "idf", "score", "part", "chunk", "sums", "told", "ids"]

    def run(leading: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def over(label: int, part: _Part, told: list[tuple]) -> Iterator[pa.RecordBatch]:
            ids = next((pa.list_(i.type) for _, _, i in told if i is not None), None)
            for chunk, data, mine in told:
                low = part.first[chunk]
                high = low + len(unpack(data)[0])
                sums = pack([part.dot[:, low:high].ravel(), part.own[:, low:high].ravel()])
                yield chunk, sums, data if mine is not None else None, mine
            yield -1, pack([part.squares]), None, None

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, told, label, kind = None, [], None, None

            def closed() -> Iterator[pa.RecordBatch]:
                if part is None or not leading:
                    return
                for chunk, sums, data, mine in over(label, part, told):
                    listed = pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), mine) if mine is not None else pa.nulls(1, kind)
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(1, pa.int32()), pa.nulls(1, pa.string()), *[pa.nulls(1, pa.float64())] * 3, pa.array([label], pa.int32()),
                         pa.array([chunk], pa.int64()), pa.array([sums], pa.binary()), pa.array([data], pa.binary()), listed],
                        names=names,
                    )

            def watched() -> Iterator[pa.RecordBatch]:
                nonlocal kind
                for batch in batches:
                    kind = batch.schema.field(4).type
                    yield batch

            for of, bucket, group in _groups(watched()):
                if bucket < 0:
                    yield from closed()
                    part, told, label = _Part(group, classes, soft), group, of
                    continue
                terms, n, idf, score = add(part, group)
                for c in np.flatnonzero(named):
                    at = np.flatnonzero(n[:, c] > 0)
                    value = score[at, c]
                    if len(at) > LEADERS:
                        leads = value >= np.partition(value, len(at) - LEADERS)[len(at) - LEADERS]
                        at = at[leads if leading else ~leads]
                    elif not leading:
                        continue
                    m = len(at)
                    yield from _sliced(
                        [pa.array(np.full(m, c, np.int32)), terms.take(pa.array(at)), pa.array(n[at, c]), pa.array(idf[at]),
                         pa.array(score[at, c]), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()),
                         pa.nulls(m, pa.binary()), pa.nulls(m, kind)],
                        names,
                    )
            yield from closed()
            _give_back()

        return rows

    id_kind = documents.schema[id].dataType.simpleString()
    schema = (
        "cls int, term string, n double, idf double, score double, part int, chunk long, sums binary, told binary,"
        f" ids array<{id_kind}>"
    )
    columns = [F.col(id).alias("id"), weight.alias("weight")]
    packed = _packed(documents, columns, text, sizes, stop_words, where, about, id_kind)
    written = at_rest(packed.mapInArrow(run(True), schema))

    listed = F.array(*[F.lit(v).cast(kind) for v in values])
    counted = "double" if soft else "long"

    def scored(rows: DataFrame, leads: bool) -> DataFrame:
        of = rows.where("term IS NOT NULL").select(
            F.get(listed, F.col("cls")).alias("topic" if soft else group), "term", F.col("n").cast(counted).alias("n"), "idf", "score"
        )
        return of.withColumn(LEADS, F.lit(leads))

    scores = scored(written, True).unionByName(scored(packed.mapInArrow(run(False), schema), False))

    def nearness(table: pa.Table) -> pa.Table:
        sums = sorted(zip(table.column("part").to_pylist(), table.column("sums").to_pylist(), strict=True))
        both = np.sum([np.stack(unpack(s)) for _, s in sums], axis=0)
        at = next(i for i in range(len(table)) if table.column("ids")[i].is_valid)
        ids = table.column("ids")[at].values
        _, weight = unpack(table.column("told")[at].as_py())
        dot, own = both.reshape(2, classes if soft else 1, len(ids))
        if soft:
            p = weight.reshape(-1, classes)
            c, doc = np.nonzero(own > 0)
            found = [c, dot[c, doc], own[c, doc], p[doc, c]]
        else:
            doc = np.flatnonzero((own[0] > 0) & named[weight])
            found = [weight[doc], dot[0, doc], own[0, doc], np.ones(len(doc))]
        return pa.table({
            "id": ids.take(pa.array(doc)), "cls": pa.array(found[0].astype(np.int32)), "dot": pa.array(found[1]),
            "own": pa.array(found[2]), "p": pa.array(found[3].astype(float)),
        })

    sums = written.where("chunk >= 0").select("part", "chunk", "sums", "told", "ids")
    documents_near = sums.groupBy("chunk").applyInArrow(nearness, f"id {id_kind}, cls int, dot double, own double, p double")
    squares = np.zeros(classes)
    for r in sorted(written.where("chunk = -1").select("part", "sums").collect()):
        squares += unpack(r.sums)[0]
    whole = F.array(*[F.lit(float(s)) for s in squares])
    # Rows of one id are one document.
    near = documents_near.groupBy("id", "cls").agg(F.sum("dot").alias("dot"), F.sum("own").alias("own"), F.first("p").alias("__p"))
    similarity = F.round(F.col("dot") / F.sqrt(F.col("own") * F.get(whole, F.col("cls"))), 9)
    similar = near.select(
        F.get(listed, F.col("cls")).alias("topic" if soft else group), F.col("id").alias(id), similarity.alias("similarity"), "__p"
    )
    return ClassTerms(scores, similar)
