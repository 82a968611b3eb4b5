"""Alignment of two tokenizers against their own libraries and plain Python."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
import sentencepiece
from conftest import tuples
from tokenizers import Tokenizer

from terrafold.llm.alignment import Bits, PieceBpe, PlainBpe, alignments
from terrafold.llm.bpe import _byte_letters
from terrafold.llm.tokenizers_public import tokenizer_path

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
A_PATH, B_PATH = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    letters = _byte_letters()

    def a_bytes(i):
        return bytes(letters[c] for c in a.id_to_token(i))

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    return lambda t: a.encode(" " + t, add_special_tokens=False).ids, a_bytes, lambda t: b.encode(t), b_bytes


HOSTILE = ["<|endoftext|> <s> </s> <unk> <0x41>", "with ▁ inside", "▁", " ", "  ", "a ", " a", "   a   b   ", "tail  \n", "\n \t \r\n", "\x00 \x01", "naïve ßtraße Ünïcödé", "日本語 テキスト", "é café", "ﬁ ½ ²", "👩‍🔬 🏳️", "x" * 500, "1234567 12 3.14", "don't we'll 's", "　wide space", "a b\x85c"]


@pytest.mark.parametrize("name", ["documents", "repeated", "empty", "clashing"])
def test_alignment(request, libraries, name):
    df = request.getfixturevalue(name)
    docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert tuples(alignments(df, chunk_bytes=30_000), *COLUMNS) == sorted(brute.alignment(docs, *libraries), key=repr)


def test_hostile_texts(spark, libraries):
    docs = list(enumerate(HOSTILE))
    got = alignments(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), chunk_bytes=50)
    assert tuples(got, *COLUMNS) == sorted(brute.alignment(docs, *libraries), key=repr)


def test_a_long_text(spark, libraries):
    draw = random.Random(6)
    long = " ".join("".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 8))) for _ in range(200_000))
    assert len(long.encode()) > 1_000_000
    docs = [(1, long), (2, None), (3, long[:1000]), (4, long[:1000])]
    got = alignments(spark.createDataFrame(docs, "doc_id long, text string"))
    assert tuples(got, *COLUMNS) == sorted(brute.alignment(docs, *libraries), key=repr)


def test_encoders_on_random_text(libraries):
    a, b = PlainBpe(A_PATH), PieceBpe(B_PATH)
    assert b.by_word
    draw = random.Random(4)
    pieces = ["a", "é", "'", "'s", " ", "  ", "\n", "\n\n", "1", "!", "<|endoftext|>", "<s>", "日", "　", " ", "\x85", "\t", "Z", "the", "ing", "▁"]
    texts = ["".join(draw.choice(pieces) for _ in range(60)) for _ in range(500)]
    for t, x, y in zip(texts, a.ids([b" " + t.encode() for t in texts]), b.ids([b" " + t.encode() for t in texts]), strict=True):
        assert x.tolist() == libraries[0](t)
        if "▁" not in t:
            assert y.tolist() == libraries[2](t)


def test_bits():
    draw = np.random.default_rng(2)
    for size in (1, 63, 64, 65, 1000):
        flags = draw.random(size) < 0.3
        bits = Bits.at(np.flatnonzero(flags), size)
        assert bits.select().tolist() == np.flatnonzero(flags).tolist()
        places = np.arange(size + 1)
        assert bits.rank(places).tolist() == [int(flags[:i].sum()) for i in places]
