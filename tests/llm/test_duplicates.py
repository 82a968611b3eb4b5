from __future__ import annotations

import random
import tempfile
import uuid
from pathlib import Path

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import pairs, tuples

from terrafold.llm import bwt_dedup, jaccard_join, kernel, phrase_index
from terrafold.llm.bwt_dedup import merge_transforms, repeated_bytes, shard_transform
from terrafold.llm.components import connected_components
from terrafold.llm.jaccard_join import near_duplicates, needed, prefix_length, superseded
from terrafold.llm.rows import row_keyed
from terrafold.llm.substring_dedup import duplicate_factors

TABLES = ["documents", "repeated", "empty", "clashing"]


def data_of(request, name):
    df = request.getfixturevalue(name)
    return df, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", TABLES)
def test_substring_dedup(request, name):
    df, rows = data_of(request, name)
    got = tuples(duplicate_factors(df, digest=True), "doc_id", "n_words", "n_removed", "kept")
    assert got == sorted(brute.substring_dedup(rows), key=repr)


@pytest.mark.parametrize("name", TABLES)
def test_byte_dedup(request, name):
    df, rows = data_of(request, name)
    got = tuples(repeated_bytes(df, digest=True).selectExpr("doc_id", "n_bytes", "n_removed", "cast(size(spans) as long) n", "cast(kept as string) kept"), "doc_id", "n_bytes", "n_removed", "n", "kept")
    assert got == sorted(brute.byte_dedup(rows), key=repr)


@pytest.mark.parametrize("name", TABLES)
def test_byte_dedup_by_single_strings(request, name):
    df, rows = data_of(request, name)
    got = tuples(repeated_bytes(df, digest=True, crowd=1).selectExpr("doc_id", "n_bytes", "n_removed", "cast(size(spans) as long) n", "cast(kept as string) kept"), "doc_id", "n_bytes", "n_removed", "n", "kept")
    assert got == sorted(brute.byte_dedup(rows), key=repr)


def test_a_passage_of_all_documents_makes_no_large_merge(spark, monkeypatch):
    draw = random.Random(7)
    prose = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    passage = prose(300)
    rows = [(i, prose(60 + i % 50) + passage + prose(60 + i % 40)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    send = bwt_dedup._send
    monkeypatch.setattr(bwt_dedup, "_send", lambda *a: lambda batches: noted(send(*a)(batches)))
    path = tempfile.mkdtemp()

    def noted(batches):
        for b in batches:
            with open(f"{path}/{uuid.uuid4().hex}", "w") as f:
                f.writelines(f"{k} {len(d or b'')}\n" for k, d in zip(b.column("bucket").to_pylist(), b.column("data").to_pylist()) if k >= 0)
            yield b

    out = repeated_bytes(df, digest=True, crowd=100).selectExpr("doc_id", "n_bytes", "n_removed", "cast(size(spans) as long) n", "cast(kept as string) kept")
    assert tuples(out, "doc_id", "n_bytes", "n_removed", "n", "kept") == sorted(brute.byte_dedup(rows), key=repr)
    sizes = {}
    for p in Path(path).iterdir():
        for k, n in (line.split() for line in p.read_text().splitlines()):
            sizes[k] = sizes.get(k, 0) + int(n)
    # without the second deal the two edges of the passage fill a bucket or two
    assert sizes and max(sizes.values()) < 3 * sum(sizes.values()) / len(sizes) and len(sizes) == 16


def batch_of(texts, first):
    keys = pa.array(range(first, first + len(texts)), pa.int64())
    return pa.RecordBatch.from_arrays([keys, keys, pa.array(texts)], names=["row_key", "doc_id", "text"])


def test_a_bucket_is_sent_few_rows_however_many_buckets_there_are():
    draw, buckets = random.Random(9), 40
    passages = ["".join(draw.choice("abcdefgh ") for _ in range(400)) for _ in range(300)]
    texts = [" ".join(draw.choice(passages)[draw.randint(0, 60) :] for _ in range(8)) for _ in range(1500)]
    assert sum(map(len, texts)) > 4_000_000
    sent = pa.Table.from_batches(phrase_index._send(bwt_dedup._phrases(50, 24), buckets)(iter([batch_of(texts[:700], 0), batch_of(texts[700:], 700)])))
    places = sent.column("bucket").to_pylist()
    assert sorted(b for b in places if b >= 0) == list(range(buckets))
    assert len(places) <= 2 * buckets


@pytest.mark.parametrize("crowd", [1, 3, bwt_dedup.CROWD])
def test_byte_dedup_over_more_buckets_than_fragments(request, monkeypatch, crowd):
    monkeypatch.setattr(bwt_dedup, "buckets_for", lambda *_: 97)
    monkeypatch.setattr(bwt_dedup, "SHARD_BYTES", 100)
    df, rows = data_of(request, "repeated")
    got = tuples(repeated_bytes(df, digest=True, crowd=crowd).selectExpr("doc_id", "n_bytes", "n_removed", "cast(size(spans) as long) n", "cast(kept as string) kept"), "doc_id", "n_bytes", "n_removed", "n", "kept")
    assert got == sorted(brute.byte_dedup(rows), key=repr)


def test_strings_alone_enter_the_merge(monkeypatch):
    entered = []
    one_pass = bwt_dedup._pass
    monkeypatch.setattr(bwt_dedup, "_pass", lambda rows, *a: (entered.append(len(rows)), one_pass(rows, *a))[1])
    strings = [b"x" * 7 + b"abcdefghij" * 6, b"abcdefghij" * 6 + b"y", b"z" * 30]
    data, begin = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([0, *map(len, strings)])
    flag = bwt_dedup.repeated([(data, begin)], [np.array([2, 1, 3])], 50)[0]
    assert np.flatnonzero(flag).tolist() == list(range(7, 18))
    assert entered[0] == sum(max(0, len(s) - 49) for s in strings)


def test_narrow_numbers_there_and_back():
    for values in ([0], [5, 260, 5], [-3, 1 << 40, 9], [-(1 << 63), 0, (1 << 63) - 1]):
        packed = phrase_index.Narrow(np.array(values, np.int64))
        got, n = phrase_index.widened([packed.packed(0, 1), packed.packed(1, len(values))])
        assert got.tolist() == values and n.tolist() == [1, len(values) - 1]


@pytest.mark.parametrize(("name", "boundary"), [*((t, None) for t in TABLES), ("documents", 0), ("documents", 9), ("repeated", 9)])
def test_jaccard_join(request, name, boundary, monkeypatch):
    if boundary is not None:
        monkeypatch.setattr(jaccard_join, "light_boundary", lambda sizes, sketch: boundary)
    df, rows = data_of(request, name)
    found, _ = near_duplicates(row_keyed(df))
    assert tuples(found, "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard_components(rows), key=repr)


def test_one_of_each_group_stays(documents, rows):
    gone = {r.row_key for r in superseded(row_keyed(documents)).collect()}
    groups = brute.jaccard_components(pairs(rows))
    assert gone == {d for d, n, c in groups if n and d != c}


def test_factors_name_the_words_and_where_they_stand(documents, rows):
    texts = {d: brute.plain_words(t) for d, t in pairs(rows)}
    some = 0
    for r in duplicate_factors(documents).collect():
        words = texts[r.doc_id]
        gone = set()
        for f in r.factors:
            own = words[f.first_word : f.first_word + f.n_words]
            assert f.source < r.doc_id and f.n_words >= 13 and own == texts[f.source][f.source_word : f.source_word + f.n_words]
            gone |= set(range(f.first_word, f.first_word + f.n_words))
            some += 1
        assert r.kept == " ".join(w for i, w in enumerate(words) if i not in gone)
    assert some > 10


def test_numbers_and_ids_there_and_back():
    from terrafold.llm.substring_dedup import packed_ids, packed_numbers, unpacked_ids, unpacked_numbers

    for values in ([], [0], [254, 255, 256, 509, 510, 511, 0, 70_000, 1]):
        assert unpacked_numbers(packed_numbers(np.array(values, np.int64))).tolist() == values
    for values in ([5], [-3, 9, 2], [-(1 << 63), 0, (1 << 63) - 1], [1 << 40, (1 << 40) + (1 << 32) - 1]):
        assert unpacked_ids(packed_ids(np.array(values, np.int64)), len(values)).tolist() == values


def test_a_phrase_across_two_factors_goes_too(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words[:30])), (2, " ".join(words[18:48])), (3, " ".join(words[:48]))]
    got = {r.doc_id: r for r in duplicate_factors(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(f.first_word, f.n_words, f.source, f.source_word) for f in got[3].factors] == [(0, 30, 1, 0), (18, 30, 2, 0)]
    assert got[3].kept == "" and got[2].kept == " ".join(words[18:48])


def test_thresholds():
    for s in range(1, 60):
        for t in range(1, 60):
            least = next((i for i in range(min(s, t) + 1) if 100 * i >= 75 * (s + t - i)), None)
            assert (needed(s, t) if needed(s, t) <= min(s, t) else None) == least
            if least:
                assert least > s - prefix_length(s) and least > t - prefix_length(t)


def test_components_of_paths_and_cycles(spark):
    draw = random.Random(3)
    path = list(range(300))
    draw.shuffle(path)
    edges = list(zip(path, path[1:])) + [(1000, 1001), (1001, 1002), (1002, 1000), (7, 7)]
    roots = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({roots[x] for x in path}) == 1 and len({roots[x] for x in (1000, 1001, 1002)}) == 1 and len(set(roots.values())) == 2


def test_merged_transforms_give_the_repeated_intervals_in_order():
    draw = random.Random(1)
    for depth in (1, 2, 7, 8, 12, 20):
        shards = []
        for _ in range(3):
            strings = ["".join(draw.choice("ab") for _ in range(draw.randint(1, 30))) for _ in range(5)]
            symbols = np.array([ord(c) if c != "$" else 0 for s in strings for c in s + "$"], np.uint16)
            shards.append((strings, symbols, np.concatenate(([0], np.cumsum([len(s) + 1 for s in strings])))))
        made = [shard_transform(symbols, begin) for _, symbols, begin in shards]
        suffixes = [s[i:] for strings, _, _ in shards for s in strings for i in range(len(s) + 1)]
        places, at = [], 0
        for (_, symbols, _), (order, *_) in zip(shards, made):
            places += (order + at).tolist()
            at += len(symbols)
        left = [np.array([len(suffixes[p]) for p in (order + b).tolist()]) for (order, *_), b in zip(made, np.cumsum([0, *[len(s) for _, s, _ in shards]]))]
        rows, group = merge_transforms([t for _, t, _ in made], [x for _, _, x in made], left, depth)
        merged = [suffixes[places[r]][:depth] for r in rows]
        counts = {}
        for s in suffixes:
            if len(s) >= depth:
                counts[s[:depth]] = counts.get(s[:depth], 0) + 1
        # rows of shorter suffixes leave a pass later than their group, so a last one can be alone
        again = [m for m in merged if counts[m] > 1]
        assert again == sorted(p for p, n in counts.items() if n > 1 for _ in range(n))
        assert [a == b for a, b in zip(merged, merged[1:])] == (np.diff(group) == 0).tolist()


def test_equal_windows_have_equal_hashes():
    words = kernel.words_of([b"a b c  d", b"z a\tb c d", b""], kernel.PLAIN_WORD, lower=False)
    assert words.windows(4)[0] == words.windows(4)[5] and list(words.window_counts(4)) == [1, 2, 0]
