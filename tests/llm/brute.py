"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
TOKEN = re.compile(r"[^\W_]+")


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def repeated_words(rows, window=13):
    """(id, words, removed, kept) of (id, text) rows."""
    split = [(i, WORD.findall((t or "").encode())) for i, t in rows]
    first = {}
    for i, words in split:
        if i is not None:
            for s in range(len(words) - window + 1):
                key = tuple(words[s : s + window])
                first[key] = min(first.get(key, i), i)
    found = []
    for i, words in split:
        gone = set()
        if i is not None:
            for s in range(len(words) - window + 1):
                if first[tuple(words[s : s + window])] < i:
                    gone.update(range(s, s + window))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        found.append((i, len(words), len(gone), kept))
    return found


def repeated_bytes(rows, depth=100):
    """(id, bytes, removed, spans, kept) of (id, text) rows with different ids."""
    first, found = set(), []
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - depth + 1):
            key = raw[s : s + depth]
            if key in first:
                gone[s : s + depth] = b"\1" * depth
            first.add(key)
        spans = bytes(gone).count(b"\0\1") + bytes(gone).startswith(b"\1")
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        found.append((i, len(raw), sum(gone), spans, kept))
    for i, text in rows:
        if i is None:
            raw = (text or "").encode()
            found.append((None, len(raw), 0, 0, raw))
    return found


def shingles(text):
    words = WORD.findall((text or "").encode().translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def near_duplicates(rows, percent=85):
    """{id: (shingles, component)} of (id, text) rows with different ids."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(set)
    for i, held in sets.items():
        for s in held:
            holders[s].add(i)
    for i, held in sets.items():
        for j in {j for s in held for j in holders[s] if j < i}:
            if 100 * len(held & sets[j]) >= percent * len(held | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(held), root(i)) for i, held in sets.items()}


def leaks(rows, items, window=13, substituted=2):
    """{(id, item)} of (id, text) rows and (item, text) rows."""
    found = set()
    split = [(i, TOKEN.findall((t or "").lower())) for i, t in rows]
    for item, text in items:
        want = TOKEN.findall((text or "").lower())
        if not want:
            continue
        width = min(window, len(want))
        least = len(want) if len(want) < window else window - substituted
        for i, words in split:
            for at in range(len(words) - width + 1):
                if any(
                    sum(words[at + k] == want[j + k] for k in range(width)) >= least
                    for j in range(len(want) - width + 1)
                ):
                    found.add((i, item))
                    break
    return found
