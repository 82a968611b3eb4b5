"""Every operator on a text longer than a chunk, beside short, repeated and missing ones."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from conftest import tuples
from tokenizers import Tokenizer

from terrafold.llm.bpe import encode_decode
from terrafold.llm.bwt_dedup import repeated_bytes
from terrafold.llm.decontaminate import contamination
from terrafold.llm.imatch import fingerprints
from terrafold.llm.jaccard_join import near_duplicates
from terrafold.llm.kd_sharding import kd_shards
from terrafold.llm.pii import personal_data
from terrafold.llm.rows import row_keyed
from terrafold.llm.substring_dedup import duplicate_factors
from terrafold.llm.token_count import token_counts
from terrafold.llm.tokenizers_public import tokenizer_path
from terrafold.llm.toxicity import scored, train


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(8)
    body = " ".join("".join(draw.choice("abcdeé") for _ in range(draw.randint(2, 8))) for _ in range(170_000))
    assert len(body.encode()) > 1_000_000
    part = body[300_000:300_400]
    return [(1, body), (2, f"x {part} y"), (3, body[:500_000] + " 10.0.0.1 " + body[500_000:]), (4, None), (5, ""), (6, f"z {part} w")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2)


def test_counts_and_ids(docs, rows):
    words, pairs = (Tokenizer.from_file(tokenizer_path(f"{n}.json")) for n in ("word_bpe_49k", "byte_bpe_50k"))
    want = [(d, len((t or "").encode()), len(words.encode(t or "", add_special_tokens=False))) for d, t in rows]
    assert tuples(token_counts(docs), "doc_id", "n_bytes", "n_tokens") == sorted(want, key=repr)
    ids = {d: pairs.encode(t or "", add_special_tokens=False).ids for d, t in rows}
    got = {r.doc_id: (r.ids_sha256, r.decoded_sha256) for r in encode_decode(docs, full=False).collect()}
    assert got == {d: (brute.sha(np.array(ids[d], "<u4").tobytes()), brute.sha(t or "")) for d, t in rows}


def test_duplicates(docs, rows):
    assert tuples(duplicate_factors(docs, digest=True), "doc_id", "n_words", "n_removed", "kept") == sorted(brute.substring_dedup(rows), key=repr)
    got = repeated_bytes(docs, digest=True).selectExpr("doc_id", "n_bytes", "n_removed", "cast(size(spans) as long) n", "cast(kept as string) kept")
    assert tuples(got, "doc_id", "n_bytes", "n_removed", "n", "kept") == sorted(brute.byte_dedup(rows), key=repr)
    found, _ = near_duplicates(row_keyed(docs))
    assert tuples(found, "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard_components(rows), key=repr)


def test_the_others(spark, docs, rows):
    item = " ".join(brute.folded_words(rows[0][1])[90_000:90_014])
    items = [(1, item), (2, "q q")]
    got = contamination(docs, spark.createDataFrame(items, "item_id long, text string")).selectExpr("doc_id", "n_words", "n_hit", "cast(size(items) as long) n", "sha2(array_join(items, ','), 256) s", "n_hit > 0 c")
    assert tuples(got, "doc_id", "n_words", "n_hit", "n", "s", "c") == sorted(brute.contamination(rows, items), key=repr)
    base = {r.doc_id: [(s.kind, s.start, s.end) for s in r.base] for r in personal_data(row_keyed(docs)).collect()}
    assert base[3] == [(1, 500_001, 500_009)] and not base[1]
    prints = {r.doc_id: r for r in fingerprints(docs).collect()}
    assert len(prints) == 6 and prints[1].n_chars == len(rows[0][1]) and prints[4].fingerprint == prints[5].fingerprint
    assert kd_shards(docs, shards=8).count() == 6
    marks = spark.createDataFrame([(d, 1, d % 2) for d, _ in rows], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in scored(docs, train(docs, marks)).collect())
