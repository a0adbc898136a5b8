"""Packing: ids against the reference tokenizer, and an exact round trip of every document."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sylvatica.llm import packing as P

TEXTS = [
    None, "", "a", "Hello, world! It's we've 12345 ...\n\n\n  x", "é" * 3000, "<|endoftext|> inside <|endoftext|>", " " * 5000, "word " * 9000, "   \U0001f600 mixed \t\r\n",
    "x" * 20_000, "日本語のテキスト。", "\x00\x01 control", "a" * 2046, "1" * 4000, "!?" * 3000,
]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_tokenizers(reference):
    encode = P.encoder()
    for text in TEXTS:
        assert encode(text or "") == reference.encode(text or "", add_special_tokens=False).ids


def test_round_trip(spark, reference):
    docs = spark.createDataFrame([(i if i else None, t, 3) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 3)], "doc_id long, text string, length int")
    rows = P.pack(docs).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert all(r.offset == 0 and r.length == len(r.ids) <= 2048 and r.length & (r.length - 1) == 0 for r in rows)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)
    for i, text in enumerate(TEXTS):
        own = sorted((r.start, r.length, tuple(r.ids)) for r in rows if r.doc_id == (i or None))
        ids = reference.encode(text or "", add_special_tokens=False).ids + [1]
        copies = 2 if i == 3 else 1
        assert [x for s, n, part in own[::copies] for x in part] == ids
        assert [s for s, _, _ in own[::copies]] == list(np.cumsum([0] + [n for _, n, _ in own[::copies]])[:-1])
    assert P.pack(docs, keep_ids=False).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", "sequence_id", "offset"]


@pytest.mark.parametrize("tokens", [1, 2, 3, 7, 2047, 2048, 2049, 5000, 1 << 20])
def test_pieces(tokens):
    pieces = P.piece_lengths(tokens)
    assert sum(pieces) == tokens and all(n & (n - 1) == 0 and n <= 2048 for n in pieces)
    assert len([n for n in pieces if n < 2048]) == len({n for n in pieces if n < 2048})


def test_a_text_that_the_fast_encoder_refuses(monkeypatch, reference):
    import tiktoken

    class Refusing:
        def __init__(self, *_, **__):
            pass

        def encode(self, *_, **__):
            raise ValueError("no")

    monkeypatch.setattr(tiktoken, "Encoding", Refusing)
    assert P.encoder()("Hello there") == reference.encode("Hello there", add_special_tokens=False).ids


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
