"""Byte-level BPE against the tiktoken library."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from topicloom.llm import bpe, queries


@pytest.fixture(scope="module")
def library():
    ranks = queries.vocabulary().ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(3)
    texts = [
        "", " ", "  ", "a", " a", "a ", "a  b", "\n a", " \n", "a  b  c", "don't we'll I'M 123 4567",
        "aaaaaaa" * 1500, "ab" * 4000 + "c", "é" * 3000, "x" * 4097, "😀漢字かなÿ\0", "tab\tand\r\nline ", "<|endoftext|>",
        "\x1c a\x85 b", "word" * 30 + " " + "word" * 30,
    ]
    return texts + [
        "".join(rng.choice("abcdeé 1\n'\t,") for _ in range(rng.randrange(200))) for _ in range(300)
    ]


def test_like_the_library(spark, library):
    texts = odd_texts()
    df = spark.createDataFrame(
        [(i, t, 1) for i, t in enumerate([*texts, None])], "doc_id long, text string, n_tokens int"
    )
    got = {r.doc_id: r for r in bpe.encode_texts(df.repartition(2), queries.vocabulary()).collect()}
    for i, text in enumerate([*texts, ""]):
        assert np.frombuffer(got[i].tokens, "<u4").tolist() == library.encode_ordinary(text), text[:50]
        assert bytes(got[i].decoded) == text.encode()
        assert got[i].n_tokens == len(got[i].tokens) // 4


def test_remembered_words_do_not_matter(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    monkeypatch.setattr(bpe, "CACHE_LETTERS", 3)
    monkeypatch.setattr(bpe, "MATRIX_BYTES", 64)
    encoder = bpe.Encoder(queries.vocabulary())
    for text in odd_texts()[-60:]:
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], "doc_id long, text string")
    assert len({bytes(r.tokens) for r in bpe.encode_texts(df, queries.vocabulary()).collect()}) == 1
    assert bpe.encode_texts(df.where("doc_id > 9"), queries.vocabulary()).collect() == []


def test_pairs_without_single_bytes_are_refused():
    with pytest.raises(ValueError):
        bpe.Encoder(bpe.Vocabulary({b"a": 0}, public_tokenizers.PATTERN))
