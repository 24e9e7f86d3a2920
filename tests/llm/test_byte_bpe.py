"""Byte-level BPE beside the library, and back again."""

import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from clausegrid.llm import byte_bpe, vocab
from clausegrid.llm.byte_bpe import PerfectHash

FILE = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ours():
    return byte_bpe.load(FILE, vocab.SPLIT)


@pytest.fixture(scope="module")
def theirs(ours):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})


def as_bytes(ids):
    return np.array(ids, "<u4").tobytes()


def texts(rng):
    letters = ["a", "é", "Ж", "漢", "1", "½", ".", "'s", " ", "  ", "\n", "\x85", "　", "\x1c", "​", "\U0001f600", "\U0001e6c0", "<|endoftext|>", "﻿"]
    return ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(400)]


def test_pattern_is_the_public_one():
    assert vocab.SPLIT == P.PATTERN


def test_every_code_point(ours, theirs):
    for first in range(0, 0x110000, 0x2000):
        points = [chr(c) for c in range(first, first + 0x2000) if not 0xD800 <= c < 0xE000]
        for text in ("".join(points), "a".join(points), " ".join(points)):
            assert ours.encoded([text])[0] == as_bytes(theirs.encode_ordinary(text))


def test_random_texts(ours, theirs):
    for text in texts(random.Random(1)):
        assert ours.encoded([text])[0] == as_bytes(theirs.encode_ordinary(text))


def test_long_runs(ours, theirs, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHUNK", 100)
    for text in ("ab" * 6000, "=" * 7001, " " * 9000 + "x", "\n" * 9001, "word " * 900, "a1" * 900 + "\U000323b0" + " b" * 500):
        assert ours.encoded([text, text[5:]]) == [as_bytes(theirs.encode_ordinary(t)) for t in (text, text[5:])]
    assert ours.decoded(ours.encoded([" " * 1_000_000])[0]) == b" " * 1_000_000


def test_memo_that_overflows(ours, theirs, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO", 5)
    for text in texts(random.Random(2))[:50]:
        assert ours.encoded([text, "one two three four five six seven"])[0] == as_bytes(theirs.encode_ordinary(text))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000])
def test_perfect_hash(n):
    keys = [b"k%d" % i for i in range(n)]
    table = PerfectHash(keys, list(range(n)))
    assert table.find(keys) == list(range(n)) and sorted(table.keys) == sorted(keys)
    assert table.find([b"other", b"", b"k%d" % n]) == [None] * 3


def test_query(spark, theirs):
    rows = [(1, None), (2, ""), (3, "Déjà vu,  don't\n"), (3, "Déjà vu,  don't\n"), (None, "x"), (4, "word " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as _id", "3 as ids", "4 as n_tokens", "5 as _text")
    encoded = byte_bpe.encode(docs)
    got = sorted(((r.doc_id, r.n_tokens, bytes(r.ids)) for r in encoded.collect()), key=str)
    want = sorted(((k, len(i), as_bytes(i)) for k, t in rows for i in [theirs.encode_ordinary(t or "")]), key=str)
    assert got == want
    back = sorted(((r.doc_id, bytes(r.decoded)) for r in byte_bpe.decode(encoded).collect()), key=str)
    assert back == sorted(((k, (t or "").encode()) for k, t in rows), key=str)
    digest = byte_bpe.digest(docs).filter("doc_id = 1").first()
    assert digest.n_tokens == 0 and digest.ids_sha256 == digest.decoded_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert byte_bpe.digest(docs.limit(0)).collect() == []


def test_unknown_ids_and_null(spark):
    rows = spark.createDataFrame([(1, None), (2, bytearray(as_bytes([60_000])))], "doc_id long, ids binary")
    assert {r.doc_id: r.decoded and bytes(r.decoded) for r in byte_bpe.decode(rows).collect()} == {1: b"", 2: None}
