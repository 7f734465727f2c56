"""Words, n-grams and hashes of whole batches of texts in numpy."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text stands alone.
SLICE_BYTES = 1 << 20

# What parts words, U+0020 and U+0009 to U+000D.
_PARTS = np.zeros(256, bool)
_PARTS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_MULTIPLIER = 0x5851F42D4C957F2D | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_LETTERS = np.random.default_rng(20_240_601).integers(0, 1 << 64, 256, np.uint64)


def give_back() -> None:
    """Return freed memory of this worker to the machine: workers stay, and the next stage needs it elsewhere."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of SplitMix64)."""
    values = values.astype(np.uint64)
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


@functools.cache
def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    tables = []
    for base in (_MULTIPLIER, _INVERSE):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        tables.append(np.cumprod(steps, dtype=np.uint64))
    return tables[0], tables[1]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, at least ``size`` of them."""
    return _power_table(1 << max(20, int(size).bit_length()))


@functools.cache
def _multiplier_table(size: int) -> np.ndarray:
    return mix(np.arange(size, dtype=np.uint64) + np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def _multipliers(size: int) -> np.ndarray:
    """Odd numbers without pattern, at least ``size`` of them."""
    return _multiplier_table(1 << max(20, int(size).bit_length()))


class Hasher:
    """Hashes of substrings of one buffer, each in constant time."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LETTERS[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins, and the end. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, letters = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if letters is None:
        return np.zeros(0, np.uint8), offsets * 0
    return np.frombuffer(letters, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes."""
    begin, count = 0, len(offsets) - 1
    while begin < count:
        end = int(np.searchsorted(offsets, offsets[begin] + size, side="right")) - 1
        end = min(max(end, begin + 1), count)
        yield begin, end
        begin = end


class Words:
    """Where the words of some texts lie: ``starts`` and ``ends`` by word, ``first`` by text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = ~_PARTS[data]
        size = len(data)
        new = np.ones(size, bool)
        new[1:] = ~inside[:-1]
        over = np.ones(size, bool)
        over[:-1] = ~inside[1:]
        borders = offsets[:-1][offsets[:-1] < size]
        new[borders] = True
        over[borders[borders > 0] - 1] = True
        self.starts = np.flatnonzero(inside & new)
        self.ends = np.flatnonzero(inside & over) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A hash of each word; ``lower`` takes A-Z as a-z.

        Every place of a word has a multiplier of its own, drawn without pattern: powers of one number
        would let long words be built that agree in all bits, whatever that number is.
        """
        found = np.empty(len(self.starts), np.uint64)
        begin = 0
        while begin < len(found):
            base = self.starts[begin]
            # Eight arrays of 64 bits per byte are held meanwhile, so pieces are smaller than slices.
            end = int(np.searchsorted(self.ends, base + SLICE_BYTES // 8, side="right"))
            end = max(end, begin + 1)
            part = self.data[base : self.ends[end - 1]]
            if lower:
                part = part + np.where((part >= 65) & (part <= 90), np.uint8(32), np.uint8(0))
            starts, ends = self.starts[begin:end] - base, self.ends[begin:end] - base
            place = np.zeros(len(part), np.int64)
            place[starts] = starts
            place = np.arange(len(part)) - np.maximum.accumulate(place)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_LETTERS[part] * _multipliers(len(part))[place], out=sums[1:])
            sizes = (ends - starts).astype(np.uint64)
            found[begin:end] = mix(sums[ends] - sums[starts] + sizes * np.uint64(0x9E3779B97F4A7C15))
            begin = end
        return found


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` hashes in a row; empty when there are fewer."""
    count = max(0, len(hashes) - n + 1)
    value = np.zeros(count, np.uint64)
    for i in range(n):
        value = value * np.uint64(_MULTIPLIER) + hashes[i : i + count]
    return mix(value)


def covered(hits: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` places lie in a window of ``n`` that begins at a marked place."""
    change = np.zeros(size + n + 1, np.int32)
    at = np.flatnonzero(hits)
    np.add.at(change, at, 1)
    np.add.at(change, at + n, -1)
    return np.cumsum(change)[:size] > 0


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of many ranges in a row."""
    sizes = ends - starts
    total = int(sizes.sum())
    where = np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return data[where]
