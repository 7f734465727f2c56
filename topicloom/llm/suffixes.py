"""Removing repeated byte strings by a depth-limited radix sort of suffixes.

Two strings of ``depth`` bytes are equal if and only if their suffixes agree in all digits through
that depth. So suffixes are dealt by one digit after another, the most significant first, and a
suffix that is alone in its bucket is in order and leaves. What is still together after the last
digit is a group of equal windows.

Digits may be taken in any order that only depends on the window. The most significant one here is
the window's *anchor*: of its strings of ``GRAM`` bytes the one with the least hash. Neighbouring
windows mostly share their anchor, so a *run* of windows goes through the first passes as one entry:

1. the anchor of the run (a few hundredths as many entries as bytes);
2. all bytes of the run: runs that agree in these are equal window by window, the earliest stands
   for all; other runs of the same anchor stay open;
3. of open runs, every window by all its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from topicloom.llm import packed
from topicloom.llm.packed import Entries
from topicloom.llm.store import written
from topicloom.llm.words import SLICE_BYTES, Hasher

#: Bytes of a window, and of the string that anchors it.
DEPTH = 100
GRAM = 32

SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
RESULT = pa.schema(
    [
        ("id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_removed", pa.int64()),
        ("n_spans", pa.int64()),
        ("spans", pa.list_(SPAN)),
        ("kept", pa.binary()),
    ]
)
RESULT_KIND = (
    "id long, n_bytes long, n_removed long, n_spans long,"
    " spans array<struct<start: long, end: long>>, kept binary"
)


@dataclass(frozen=True)
class Runs:
    """Runs of windows with one anchor: first and last window, text, anchor and whole content."""

    first: np.ndarray
    last: np.ndarray
    text: np.ndarray
    anchor: np.ndarray
    content: np.ndarray


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def segments(data: np.ndarray, offsets: np.ndarray, depth: int) -> Iterator[tuple[int, int]]:
    """Ranges of windows that are worked on at once."""
    for begin in range(0, max(len(data) - depth + 1, 0), SLICE_BYTES):
        yield begin, min(begin + SLICE_BYTES, len(data) - depth + 1)


def find_runs(data: np.ndarray, offsets: np.ndarray, depth: int, gram: int) -> Runs:
    """All runs of the texts in a buffer. Shorter texts have none."""
    parts: list[tuple] = []
    width = depth - gram + 1
    for begin, end in segments(data, offsets, depth):
        part = data[begin : end - 1 + depth]
        hasher = Hasher(part)
        at = np.arange(len(part) - gram + 1)
        hashes = hasher(at, at + gram)
        # The place in the low bits tells the anchor; it also makes the leftmost win.
        ranked = (hashes & ~np.uint64((1 << 24) - 1)) | at.astype(np.uint64)
        anchor = (_sliding_minimum(ranked, width) & np.uint64((1 << 24) - 1)).astype(np.int64)
        window = np.arange(begin, end)
        text = np.searchsorted(offsets, window, side="right") - 1 if len(offsets) > 2 else window * 0
        valid = window + depth <= offsets[text + 1]
        same = valid[1:] & valid[:-1] & (anchor[1:] == anchor[:-1]) & (text[1:] == text[:-1])
        first = np.flatnonzero(valid & np.concatenate([[True], ~same]))
        last = np.flatnonzero(valid & np.concatenate([~same, [True]]))
        parts.append(
            (first + begin, last + begin, text[first], hashes[anchor[first]], hasher(first, last + depth))
        )
    if not parts:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    return Runs(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def window_hashes(data: np.ndarray, offsets: np.ndarray, windows: np.ndarray, depth: int) -> np.ndarray:
    """A hash of the bytes of each window, which are in order."""
    found = [np.zeros(0, np.uint64)]
    for begin, end in segments(data, offsets, depth):
        cut = np.searchsorted(windows, [begin, end])
        if cut[1] > cut[0]:
            at = windows[cut[0] : cut[1]] - begin
            found.append(Hasher(data[begin : end - 1 + depth])(at, at + depth))
    return np.concatenate(found)


def _seen_before(texts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Marks values that stand earlier in the same text."""
    order = np.lexsort((hashes, texts))
    again = np.zeros(len(order), bool)
    again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (texts[order][1:] == texts[order][:-1])
    marks = np.zeros(len(order), bool)
    marks[order] = again
    return marks


def _open_runs(e: Entries) -> Entries:
    """Of the runs of each anchor: those a smaller id holds wholly, marked; the open ones.

    Keys are anchors and values contents; the answer is keyed by content.
    """
    order = np.lexsort((e.docs, e.values, e.keys))
    e = e[order]
    new_key = np.concatenate([[True], e.keys[1:] != e.keys[:-1]])
    new_value = new_key | np.concatenate([[True], e.values[1:] != e.values[:-1]])
    starts = np.flatnonzero(new_value)
    sizes = np.diff(np.append(starts, len(e)))
    later = e.docs > np.repeat(e.docs[starts], sizes)
    contents = np.add.reduceat(new_value.astype(np.int64), np.flatnonzero(new_key))
    several = np.repeat(contents > 1, np.diff(np.append(np.flatnonzero(new_key), len(e))))
    kept = later | several
    return Entries(e.values[kept], e.docs[kept], np.zeros(int(kept.sum()), np.uint64), later[kept])


def remove_repeated_bytes(
    docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Remove bytes in strings of ``depth`` bytes that also start earlier.

    Earlier is a smaller id, or an earlier place of the same text; strings overlap freely, never
    cross texts and are judged on the input. Returns, per row, ``id``, ``n_bytes``, ``n_removed``,
    ``n_spans``, the removed ``spans`` (maximal, as ranges of bytes) and the ``kept`` bytes. A null
    text is empty. Rows with the same id are not earlier than each other. A row without an id is
    kept whole and makes nothing else a repeat. Other columns are not read.
    """
    gram = min(gram, depth)
    size = packed.text_bytes(docs, text)
    # Two of every ``depth - gram + 2`` places are anchors.
    count = 2 * size // (depth - gram + 2) + 1
    coarse = packed.plan_layout(docs, size, count, min(64, max(32, count.bit_length() + 12)))
    fine = packed.Layout(max(coarse.buckets, -(-size // (8 * packed.KEYS_PER_BUCKET))), coarse.places)
    texts = packed.texts_by_place(docs, id, text, coarse)

    def anchors(data, offsets, ids) -> Entries:
        runs = find_runs(data, offsets, depth, gram)
        return Entries.of(runs.anchor, ids[runs.text], _seen_before(runs.text, runs.anchor))

    repeated = written(
        packed.meet(packed.send(docs, id, text, anchors, coarse), packed.repeated_keys, coarse), "anchors"
    )

    def contents(ids, data, offsets, entered) -> Iterator[pa.Table]:
        runs = find_runs(data, offsets, depth, gram)
        doc = _ids(ids)[runs.text]
        together = _named(ids)[runs.text] & entered(runs.anchor, doc)
        found = Entries.of(runs.anchor[together], doc[together], None, runs.content[together])
        yield _blocks(fine, found)

    judged = written(
        packed.meet(
            packed.receive(texts, repeated, contents, coarse, packed.BLOCK_SCHEMA, packed.BLOCKS),
            _open_runs,
            fine,
        ),
        "runs",
    )

    def windows(ids, data, offsets, entered) -> Iterator[pa.Table]:
        _, places, hashes, owner = _open_windows(ids, data, offsets, entered, depth, gram)
        yield _blocks(fine, Entries.of(hashes, _ids(ids)[owner]))

    repeats = written(
        packed.meet(
            packed.receive(texts, judged, windows, fine, packed.BLOCK_SCHEMA, packed.BLOCKS),
            packed.later_keys,
            fine,
        ),
        "windows",
    )

    def cut(ids, data, offsets, entered, confirmed) -> Iterator[pa.Table]:
        gone, places, hashes, owner = _open_windows(ids, data, offsets, entered, depth, gram)
        known = confirmed(hashes, _ids(ids)[owner]) | _seen_before(owner, hashes)
        at = places[known]
        change = np.zeros(len(data) + 1, np.int32)
        np.add.at(change, np.concatenate([gone[0], at]), 1)
        np.add.at(change, np.concatenate([gone[1], at + depth]), -1)
        yield _result(ids, data, offsets, np.cumsum(change[:-1]) > 0)

    result = packed.receive_both(texts, judged, repeats, cut, fine, RESULT, RESULT_KIND)
    return result.withColumnRenamed("id", id)


def _ids(ids: pa.Array) -> np.ndarray:
    return ids.fill_null(0).to_numpy(zero_copy_only=False)


def _named(ids: pa.Array) -> np.ndarray:
    return ids.is_valid().to_numpy(zero_copy_only=False)


def _blocks(layout: packed.Layout, entries: Entries) -> pa.Table:
    rows = packed.block_rows(packed.blocks_of(layout, entries), packed.BLOCK_SCHEMA)
    return pa.Table.from_batches([rows])


def _open_windows(ids, data, offsets, entered, depth, gram):
    """Byte ranges of the runs that are repeats as a whole; windows of open runs, hashed, by text."""
    runs = find_runs(data, offsets, depth, gram)
    doc, named = _ids(ids)[runs.text], _named(ids)[runs.text]
    gone = named & entered(runs.content, doc, True)
    still = named & ~gone & entered(runs.content, doc, False)
    # A run whose like stands earlier in the text is a repeat, wherever the first one is.
    again = np.zeros(len(gone), bool)
    again[named] = _seen_before(runs.text[named], runs.content[named])
    gone |= again
    still &= ~again
    first, count = runs.first[still], (runs.last - runs.first + 1)[still]
    places = np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)
    owner = np.repeat(runs.text[still], count)
    hashes = window_hashes(data, offsets, places, depth)
    return (runs.first[gone], runs.last[gone] + depth), places, hashes, owner


def _result(ids: pa.Array, data: np.ndarray, offsets: np.ndarray, removed: np.ndarray) -> pa.Table:
    texts = len(offsets) - 1
    sums = np.concatenate([[0], np.cumsum(removed)])
    gone = sums[offsets[1:]] - sums[offsets[:-1]]
    size = len(data)
    begins = offsets[:-1][offsets[:-1] < size]
    fresh, over = np.ones(size, bool), np.ones(size, bool)
    fresh[1:], over[:-1] = ~removed[:-1], ~removed[1:]
    fresh[begins] = True
    over[begins[begins > 0] - 1] = True
    first, end = np.flatnonzero(removed & fresh), np.flatnonzero(removed & over) + 1
    cuts = np.searchsorted(first, offsets)
    base = np.repeat(offsets[:-1], np.diff(cuts))
    spans = pa.ListArray.from_arrays(
        pa.array(cuts, pa.int32()),
        pa.StructArray.from_arrays([pa.array(first - base), pa.array(end - base)], fields=list(SPAN)),
    )
    letters = data[~removed]
    lengths = np.concatenate([[0], np.cumsum(np.diff(offsets) - gone)]).astype(np.int32)
    kept = pa.Array.from_buffers(
        pa.binary(), texts, [None, pa.py_buffer(lengths.tobytes()), pa.py_buffer(letters.tobytes())]
    )
    columns = [ids, pa.array(np.diff(offsets)), pa.array(gone), pa.array(np.diff(cuts)), spans, kept]
    return pa.table(columns, schema=RESULT)
