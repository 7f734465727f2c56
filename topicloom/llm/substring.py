"""Removing repeated passages of words, found by fixed-block anchors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from topicloom.llm import packed
from topicloom.llm.store import written
from topicloom.llm.words import Words, covered, gather, ngrams

#: Words of the shortest passage that counts as repeated.
WINDOW = 13

SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
RESULT = pa.schema(
    [
        ("id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("spans", pa.list_(SPAN)),
        ("kept", pa.binary()),
    ]
)
RESULT_KIND = (
    "id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"
)


def _left(words: Words) -> np.ndarray:
    """How many words of its text follow from each word on, itself included."""
    return np.repeat(words.first[1:], words.counts) - np.arange(len(words.starts))


def _padded(grams: np.ndarray, size: int) -> np.ndarray:
    return np.concatenate([grams, np.zeros(size - len(grams), np.uint64)])


def _blocks_and_probes(window: int, block: int) -> packed.Enter:
    """Every rolling block is a probe; those at multiples of the block length are references."""

    def entries(data, offsets, ids):
        words = Words(data, offsets)
        size = len(words.starts)
        grams = _padded(ngrams(words.hashes(), block), size)
        # Texts too short for a window take no part.
        valid = (_left(words) >= block) & np.repeat(words.counts >= window, words.counts)
        place = np.arange(size) - np.repeat(words.first[:-1], words.counts)
        doc = np.repeat(ids, words.counts)
        return packed.Entries.of(grams[valid], doc[valid], (place % block == 0)[valid])

    return entries


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    id: str = "doc_id",
    text: str = "text",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Remove words in passages that also start in a text with a smaller id.

    Words are runs of bytes other than blank and U+0009 to U+000D. Returns, per row, ``id``,
    ``n_words``, ``n_removed``, the removed ``spans`` (maximal, as ranges of word numbers) and
    ``kept``, the other words joined by one blank. Windows of ``window`` words are judged on the
    input. A null or empty text has no words. Rows with the same id are no smaller than each other;
    a row without an id is kept whole and makes nothing else a repeat. Other columns are not read,
    unless ``keep`` names some: then the row's ``text`` and a struct ``row`` of them follow the result, and
    ``kept`` is empty where nothing is removed.

    A window holds at least one whole block of the texts' fixed blocks of ``(window + 1) // 2``
    words, wherever it lies. So the blocks that do not overlap are indexed, and every rolling block
    probes the index; both travel as packed short keys. Around the hits, on both sides, the
    windows that hold one are extended word by word: they meet again under their full hashes, and
    those confirmed in a smaller id merge into maximal repeats.
    """
    block = (window + 1) // 2
    size = packed.text_bytes(docs, text)
    # A word takes two bytes at least, mostly six. A probe hits by chance once in a thousand.
    count = size // 5 + 1
    coarse = packed.plan_layout(docs, size, count, min(64, max(32, count.bit_length() + 10)))
    fine = packed.Layout(coarse.buckets, coarse.places)
    texts = packed.texts_by_place(docs, id, text, coarse)

    probes = packed.send(docs, id, text, _blocks_and_probes(window, block), coarse)
    hits = written(packed.meet(probes, packed.shared_keys, coarse), "anchors")

    def around_hits(ids, data, offsets, entered) -> Iterator[pa.Table]:
        words = Words(data, offsets)
        size = len(words.starts)
        left = _left(words)
        hashes = words.hashes()
        doc = np.repeat(ids.fill_null(0).to_numpy(zero_copy_only=False), words.counts)
        named = np.repeat(ids.is_valid().to_numpy(zero_copy_only=False), words.counts)
        hit = np.zeros(size, bool)
        probe = (left >= block) & named
        hit[probe] = entered(_padded(ngrams(hashes, block), size)[probe], doc[probe])
        # A window holds the blocks that begin at its first words.
        sums = np.concatenate([[0], np.cumsum(hit)])
        reach = np.minimum(np.arange(size) + window - block + 1, size)
        wanted = (left >= window) & named & (sums[reach] > sums[:-1])
        grams = _padded(ngrams(hashes, window), size)
        found = packed.blocks_of(fine, packed.Entries.of(grams[wanted], doc[wanted]))
        yield pa.Table.from_batches([packed.block_rows(found, packed.BLOCK_SCHEMA)])

    windows = packed.receive(texts, hits, around_hits, coarse, packed.BLOCK_SCHEMA, packed.BLOCKS)
    repeats = written(packed.meet(windows, packed.later_keys, fine), "repeats")

    def cut(ids, data, offsets, entered) -> Iterator[pa.Table]:
        words = Words(data, offsets)
        size = len(words.starts)
        doc = np.repeat(ids.fill_null(0).to_numpy(zero_copy_only=False), words.counts)
        named = np.repeat(ids.is_valid().to_numpy(zero_copy_only=False), words.counts)
        start = np.zeros(size, bool)
        whole = (_left(words) >= window) & named
        start[whole] = entered(_padded(ngrams(words.hashes(), window), size)[whole], doc[whole])
        yield _result(ids, words, covered(start, window, size), keep is not None)

    rows = packed.texts_by_place(docs, id, text, coarse, keep)
    result = packed.receive(rows, repeats, cut, fine, RESULT, RESULT_KIND)
    return result.withColumnRenamed("id", id)


def _result(ids: pa.Array, words: Words, removed: np.ndarray, carried: bool = False) -> pa.Table:
    """Results by text; of a text that is carried along and loses nothing no words are kept apart."""
    owner = words.text_of_word()
    texts = len(words.counts)
    # Spans are runs of removed words; the first word of a text begins a new one.
    fresh = np.ones(len(removed), bool)
    fresh[1:] = ~removed[:-1] | (owner[1:] != owner[:-1])
    over = np.ones(len(removed), bool)
    over[:-1] = ~removed[1:] | (owner[1:] != owner[:-1])
    begins, ends = np.flatnonzero(removed & fresh), np.flatnonzero(removed & over) + 1
    base = words.first[:-1][owner[begins]] if len(begins) else begins
    spans = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[begins], minlength=texts))]), pa.int32()),
        pa.StructArray.from_arrays([pa.array(begins - base), pa.array(ends - base)], fields=list(SPAN)),
    )
    # Every kept word with the byte after it, which becomes the blank; the last one has none.
    lost = np.bincount(owner, removed, texts).astype(np.int64)
    kept = np.flatnonzero(~removed & (lost > 0)[owner] if carried else ~removed)
    data = np.append(words.data, np.uint8(32))
    letters = gather(data, words.starts[kept], words.ends[kept] + 1)
    sizes = words.ends[kept] + 1 - words.starts[kept]
    after = np.cumsum(sizes)
    letters[after - 1] = 32
    last = np.ones(len(kept), bool)
    last[:-1] = owner[kept][1:] != owner[kept][:-1]
    letters = np.delete(letters, after[last] - 1)
    length = np.bincount(owner[kept], sizes, texts).astype(np.int64)
    length -= np.bincount(owner[kept][last], minlength=texts)
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    text = pa.Array.from_buffers(
        pa.binary(), texts, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters.tobytes())]
    )
    return pa.table(
        [
            ids,
            pa.array(words.counts.astype(np.int64)),
            pa.array(lost),
            spans,
            text,
        ],
        schema=RESULT,
    )
