"""Byte-level BPE in numpy: padded matrices of pieces of like length, merged a round at a time."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a task remembers with their tokens, and the letters of the longest of them.
CACHE_WORDS = 600_000
CACHE_LETTERS = 64
#: Bytes of the pieces encoded together.
MATRIX_BYTES = 1 << 22
#: No token, and no rank.
PAD = -1
NO_RANK = np.int32(2**31 - 1)
LONG_PIECE = 4096

#: White space before a blank.
_DOUBLE = re.compile(r"\s ")
_SPACE = re.compile(r"\s")


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base 64 and its rank per line."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


def _slot(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class PairTable:
    """From two adjacent tokens to the rank of their union, by open addressing."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = rank
        self.bits = max(4, (4 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NO_RANK, np.int32)
        keys = np.array([(a << 32) | b for a, b in pairs], np.int64)
        values = np.array(list(pairs.values()), np.int32)
        slots = _slot(keys >> 32, keys & 0xFFFFFFFF, self.bits)
        self.probes = 0
        while len(keys):  # every round each free slot takes one of the keys that want it
            self.probes += 1
            free = self.keys[slots] == -1
            _, one = np.unique(np.where(free, slots, -1 - np.arange(len(slots))), return_index=True)
            one = one[free[one]]
            self.keys[slots[one]] = keys[one]
            self.ranks[slots[one]] = values[one]
            rest = np.ones(len(keys), bool)
            rest[one] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) % size

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the unions, ``NO_RANK`` where the pair has none or ends in padding."""
        wanted = (left.astype(np.int64) << 32) | right.astype(np.int64)
        found = np.full(wanted.shape, NO_RANK, np.int32)
        real = np.flatnonzero(right.ravel() != PAD)
        flat, want = found.ravel(), wanted.ravel()
        slots = _slot(left.ravel()[real], right.ravel()[real], self.bits)
        for _ in range(self.probes):
            held = self.keys[slots]
            hit = held == want[real]
            flat[real[hit]] = self.ranks[slots[hit]]
            on = ~hit & (held != -1)
            if not on.any():
                break
            real, slots = real[on], (slots[on] + 1) % len(self.keys)
        return flat.reshape(found.shape)


@dataclass(frozen=True)
class Vocabulary:
    """Ranks of a public tokenizer and the pattern that splits a text before merging."""

    ranks: dict[bytes, int]
    pattern: str


class Encoder:
    """Encodes texts within a task.

    The pattern must let a match hold a blank as its first character only, or white space alone.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.split = regex.compile(vocabulary.pattern).findall
        self.ranks = vocabulary.ranks
        self.single = np.array([vocabulary.ranks.get(bytes([b]), PAD) for b in range(256)], np.int32)
        if (self.single == PAD).any():
            raise ValueError("the vocabulary lacks single bytes")
        self.pairs = PairTable(vocabulary.ranks)
        tokens = {rank: token for token, rank in vocabulary.ranks.items()}
        named = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.sizes = np.array([len(t) for t in named])
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(named), np.uint8)
        self.known: dict[str, bytes] = {}

    def merge(self, pieces: Sequence[bytes]) -> list[bytes]:
        """Tokens of each piece, as little-endian unsigned 32-bit integers.

        A piece that is a token itself is that token. Other pieces of like length share a matrix of
        tokens, padded at the right. Every round merges, in each row, the leftmost pair of least
        rank; rows without any pair leave, and the matrix shrinks to the longest row.
        """
        results = [b""] * len(pieces)
        rest = []
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                results[i] = whole.to_bytes(4, "little")
            elif len(piece) > LONG_PIECE:
                results[i] = self._merge_long(piece)
            elif piece:
                rest.append(i)
        rest.sort(key=lambda i: len(pieces[i]))
        lengths = np.array([len(pieces[i]) for i in rest])
        begin = 0
        while begin < len(rest):
            widest = max(8, int(lengths[begin]) * 5 // 4)
            end = min(int(np.searchsorted(lengths, widest, side="right")), begin + MATRIX_BYTES // widest)
            bucket = rest[begin:end]
            for i, tokens in zip(bucket, self._merge_bucket([pieces[i] for i in bucket]), strict=True):
                results[i] = tokens
            begin = end
        return results

    def _merge_bucket(self, pieces: list[bytes]) -> Iterator[bytes]:
        sizes = np.array([len(p) for p in pieces])
        matrix = np.full((len(pieces), int(sizes.max())), PAD, np.int32)
        matrix[np.arange(matrix.shape[1]) < sizes[:, None]] = self.single[
            np.frombuffer(b"".join(pieces), np.uint8)
        ]
        ranks = self.pairs.lookup(matrix[:, :-1], matrix[:, 1:])
        rows = np.arange(len(pieces))
        final, final_sizes = np.zeros(matrix.shape, "<u4"), sizes.copy()
        while len(rows):
            width = matrix.shape[1]
            own = np.arange(len(rows))
            if width > 1:
                at = ranks.argmin(1)
                least = ranks[own, at]
                live = least != NO_RANK
            else:
                live = np.zeros(len(rows), bool)
            if not live.all():
                done = ~live
                final[rows[done], :width] = matrix[done]
                final_sizes[rows[done]] = sizes[done]
                if not live.any():
                    break
                rows, sizes, matrix, ranks = rows[live], sizes[live], matrix[live], ranks[live]
                at, least, own = at[live], least[live], own[: int(live.sum())]
            # Take the right token of the pair out of its row.
            matrix[own, at] = least
            kept = np.arange(width) != (at + 1)[:, None]
            matrix = matrix[kept].reshape(len(rows), width - 1)
            sizes = sizes - 1
            # Only the pairs around the merged token are new.
            ranks = ranks[kept[:, 1:]].reshape(len(rows), width - 2)
            for place in (at - 1, at):
                inside = (place >= 0) & (place < width - 2)
                row, col = own[inside], place[inside]
                ranks[row, col] = self.pairs.lookup(matrix[row, col], matrix[row, col + 1])
            longest = int(sizes.max())
            if longest < matrix.shape[1]:
                matrix, ranks = matrix[:, :longest], ranks[:, : longest - 1]
        flat = final[np.arange(final.shape[1]) < final_sizes[:, None]].tobytes()
        ends = (4 * np.cumsum(final_sizes)).tolist()
        return (flat[begin:end] for begin, end in zip([0, *ends], ends, strict=False))

    def _merge_long(self, piece: bytes) -> bytes:
        """One very long piece: a round merges all non-overlapping pairs of the least rank.

        Merging one occurrence of a pair cannot make a pair of lower rank than its own that did not
        stand there before it was made, so equal pairs merge together, from the left.
        """
        row = self.single[np.frombuffer(piece, np.uint8)]
        while len(row) > 1:
            ranks = self.pairs.lookup(row[:-1], row[1:])
            least = ranks.min()
            if least == NO_RANK:
                break
            at = np.flatnonzero(ranks == least)
            # In a run of overlapping pairs every other one is taken.
            run = np.concatenate([[True], np.diff(at) > 1])
            start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            row[at] = least
            row = np.delete(row, at + 1)
        return row.astype("<u4").tobytes()

    def words(self, text: str) -> list[str]:
        """The text cut ahead of blanks that follow on no white space: there no match goes across.

        The first word starts the text; the others stand for themselves and the blank before them.
        """
        parts = text.split(" ")
        if _DOUBLE.search(text) is None:
            return parts
        words = parts[:1]
        for part in parts[1:]:
            before = words[-1] if len(words) == 1 else " " + words[-1]
            if before and before[-1].isspace():
                words[-1] += " " + part
            else:
                words.append(part)
        return words

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Tokens of each text as little-endian unsigned 32-bit integers."""
        split = [self.words(text) for text in texts]
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        new = list({word for words in split for word in words[1:]} - known.keys())
        # Words without white space are split together: a blank then begins each and nothing else.
        spaced = _SPACE.search
        plain = [w for w in new if w and spaced(w) is None]
        other = [w for w in new if not w or spaced(w) is not None]
        pieces = self.split(" " + " ".join(plain)) if plain else []
        begins = [i for i, piece in enumerate(pieces) if piece[0] == " "]
        alone = [self.split(" " + word) for word in other] + [self.split(words[0]) for words in split]
        distinct = list(set(pieces).union(*alone))
        merged = dict(zip(distinct, self.merge([p.encode() for p in distinct]), strict=True))
        coded = [merged[piece] for piece in pieces]
        ends = [*begins[1:], len(pieces)] if begins else []
        for word, begin, end in zip(plain, begins, ends, strict=True):
            known[word] = coded[begin] if end == begin + 1 else b"".join(coded[begin:end])
        rest = [b"".join([merged[piece] for piece in found]) for found in alone]
        known.update(zip(other, rest[: len(other)], strict=True))
        get = known.__getitem__
        encoded = [
            head + b"".join(map(get, words[1:]))
            for head, words in zip(rest[len(other) :], split, strict=True)
        ]
        for word in new:
            if len(word) > CACHE_LETTERS:
                del known[word]
        return encoded

    def decode(self, tokens: Sequence[bytes]) -> list[bytes]:
        """The bytes that each row of tokens stands for."""
        flat = np.frombuffer(b"".join(tokens), "<u4")
        sizes = self.sizes[flat]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        place = np.arange(total) + np.repeat(self.begins[flat] - (ends - sizes), sizes)
        letters = self.letters[place].tobytes()
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *(len(t) // 4 for t in tokens)])].tolist()
        return [letters[begin:end] for begin, end in zip(cuts, cuts[1:], strict=False)]


def _runs(texts: Sequence[str], letters: int = 1 << 21) -> Iterator[tuple[int, int]]:
    begin = held = 0
    for i, text in enumerate(texts):
        if i > begin and held + len(text) > letters:
            yield begin, i
            begin, held = i, 0
        held += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def encode_texts(
    docs: DataFrame, vocabulary: Vocabulary, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``id``, ``n_tokens``, ``tokens`` and ``decoded`` of every whole text.

    ``tokens`` is a binary of little-endian unsigned 32-bit ids, ``decoded`` the bytes they stand
    for. A null text is empty: no token. Rows stay one to one; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for begin, end in _runs(texts):
                tokens = encoder.encode(texts[begin:end])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, end - begin),
                        pa.array([len(t) // 4 for t in tokens], pa.int64()),
                        pa.array(tokens, pa.binary()),
                        pa.array(encoder.decode(tokens), pa.binary()),
                    ],
                    ["id", "n_tokens", "tokens", "decoded"],
                )

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(
        encoded, f"id {kind}, n_tokens long, tokens binary, decoded binary"
    )
    return rows.withColumnRenamed("id", id)
