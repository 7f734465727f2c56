"""Words one letter apart and the spelling they belong to, against plain Python."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from topicloom.llm import spelling
from topicloom.sources.tables import load

SCHEMA = "doc_id long, text string, word string, n int, form string, root long"


def vocabulary(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(words):
    """Words one letter apart, by the patterns that leave one place open."""
    replaced, less = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            replaced[w[:i], w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in words:
                less[w].add(w[:i] + w[i + 1 :])
                less[w[:i] + w[i + 1 :]].add(w)
    for group in replaced.values():
        for w in group:
            less[w] |= group - {w}
    return less


def brute(words):
    found, forms = near(words), {}
    for w in words:
        best = min(found[w], key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best and words[best] >= 2 * words[w] else None
    result = []
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        result.append((w, forms[w], root, n, len(found[w]), words.get(forms[w])))
    return sorted(result)


def rows(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()))


def table(spark, docs):
    return spark.createDataFrame([(i, t, "w", 1, "f", 2) for i, t in docs], SCHEMA).repartition(3)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in load(spark, "/root/testdata/sf0.001", "documents").collect()]
    want = brute(vocabulary(docs))
    assert any(r[1] for r in want)
    assert rows(entry.queries()["op12_spelling"](spark, "/root/testdata/sf0.001")) == want


ODD = [
    (1, "colour " * 9 + "color " * 4 + "colouur " * 3), (2, None), (3, ""), (4, "1234 ... \n"), (None, "Colour COLOUR"),
    (None, "Colour COLOUR"), (5, "Élan Élans élans ELANS"), (5, "Élan Élans élans ELANS"), (6, "Élans élans élans"),
    (7, "abcde abcdf abcdg " * 4), (8, ("x" * 3000 + " ") * 4), (9, ("x" * 2999 + " ") * 8), (10, "aaaaa aaaaaa " * 3),
    (11, "word" * 5 + " " + "many words here again " * 5000),
]


def test_odd_rows(spark):
    assert rows(spelling.group_variants(table(spark, ODD))) == brute(vocabulary(ODD))


def test_empty_table(spark):
    assert rows(spelling.group_variants(table(spark, ODD).where("doc_id > 99"))) == []


@pytest.mark.parametrize("seed", range(3))
def test_buckets_and_pieces(spark, monkeypatch, seed):
    """Few letters, so that words are dense and ends are shared by very many."""
    noise = np.random.default_rng(seed)
    monkeypatch.setattr(spelling, "BUCKET_WORDS", 50)
    monkeypatch.setattr(spelling, "PIECE_WORDS", 30)
    monkeypatch.setattr(spelling, "STRIP", 64)
    words = {"".join(noise.choice(list("abé"), noise.integers(5, 9))): int(noise.integers(3, 99)) for _ in range(700)}
    counted = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: (r.n_near, r.form) for r in spelling.near_words(counted).collect()}
    want = near(words)
    assert got == {
        w: (len(v), min(v, key=lambda x: (-words[x], x))) for w, v in want.items() if v
    }


def test_long_chains_of_forms(spark):
    chain = [(f"word{i:03}", f"word{i + 1:03}") for i in range(60)] + [(f"leaf{i}", "word000") for i in range(50)]
    found = spelling._rooted(spark.createDataFrame(chain, "word string, form string")).collect()
    assert {r.root for r in found} == {"word060"} and len(found) == 110
