from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib

import brute
import numpy as np
import pytest
from conftest import tuples
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrafold.llm import pii, toxicity
from terrafold.llm.bpe import ForcedBoundaryBpe, encode_decode
from terrafold.llm.decontaminate import Automaton, contamination, without_spans
from terrafold.llm.imatch import fingerprints
from terrafold.llm.kd_sharding import kd_shards
from terrafold.llm.pii import base_spans, personal_data, redact
from terrafold.llm.rows import row_keyed
from terrafold.llm.token_count import count_huge, token_counts
from terrafold.llm.tokenizers_public import open_tokenizer, tokenizer_path
from terrafold.llm.toxicity import held_out, scored, train

TABLES = ["documents", "repeated", "empty", "clashing"]


def data_of(request, name):
    df = request.getfixturevalue(name)
    return df, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", TABLES)
def test_token_counts(request, name):
    df, rows = data_of(request, name)
    tokenizer = open_tokenizer(tokenizer_path("word_bpe_49k.json"))
    want = [(d, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False))) for d, t in rows]
    assert tuples(token_counts(df), "doc_id", "n_bytes", "n_tokens") == sorted(want, key=repr)


def test_chunks_resynchronise_on_hostile_text():
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    draw = random.Random(2)
    pieces = ["a", "é", "́", "'s", "'re", " ", "\n", "1", "!!", "<|endoftext|>", "<|start", "oftext|>", "日本", "한", "ÀÉ", " ", "\x1c", "longword" * 3]
    for n in (50, 400, 2000):
        for _ in range(6):
            text = "".join(draw.choice(pieces) for _ in range(n))
            assert count_huge(tokenizer, text, chunk=200, overlap=80) == len(tokenizer.encode(text, add_special_tokens=False))
    for text in ("x" * 5000, "é" * 3000, "!" * 3000, " " * 3000 + "a", "1" * 3000):
        assert count_huge(tokenizer, text, chunk=500, overlap=80) == len(tokenizer.encode(text, add_special_tokens=False))


@pytest.mark.parametrize("name", TABLES)
def test_bpe_round_trip(request, name):
    df, rows = data_of(request, name)
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = []
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(tokenizer.decode(ids, skip_special_tokens=False))))
    out = encode_decode(df)
    assert tuples(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert {(r.doc_id, r.decoded) for r in out.collect()} == {(d, t or "") for d, t in rows}


def test_forced_boundaries_never_move_the_pretokenizer():
    bpe = ForcedBoundaryBpe(tokenizer_path("byte_bpe_50k.json"))
    draw = random.Random(4)
    pieces = ["a", "é", "'", "'s", "'ll", " ", "  ", "\n", "\n\n", "1", "!", "?!", "<|endoftext|>", "<|", "日", "　", " ", " ", "\x85", "\t", "\x1c", "Z", "ß"]
    texts = ["".join(draw.choice(pieces) for _ in range(60)) for _ in range(500)]
    for text, packed in zip(texts, bpe.encode([t.encode() for t in texts])):
        want = bpe.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packed, "<u4").tolist() == want
        assert bpe.decode(packed) == bpe.tokenizer.decode(want, skip_special_tokens=False)


ITEMS = [(0, "a b c d e f g h i j k l m"), (1, "Short one"), (2, "short ONE"), (3, None), (4, "..."), (10, "f g h i j k l m n o p"), (5, "x"), (None, "the of"), (None, "q r s t u v w x y z A b"), (None, "q r s t u v w x y z aa"), (None, None)]


def test_contamination(spark, request):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for name in TABLES:
        df, rows = data_of(request, name)
        rows += [(9001, "zz A b C d e f g h i j k l m n o p q"), (9002, "a short one, x-y x"), (9003, "b c d e f g h i j k"), (9004, "a b c d e f g h i"), (9005, "the of q r s t u v w x y z a")]
        df = df.select("doc_id", "text").union(spark.createDataFrame(rows[-5:], "doc_id long, text string"))
        got = contamination(df, items).selectExpr("doc_id", "n_words", "n_hit", "cast(size(items) as long) n", "sha2(array_join(items, ','), 256) s", "n_hit > 0 c")
        assert tuples(got, "doc_id", "n_words", "n_hit", "n", "s", "c") == sorted(brute.contamination(rows, ITEMS), key=repr)


def test_contamination_against_brute_force_on_two_letters():
    draw = random.Random(8)
    for _ in range(300):
        items = [(i, " ".join(draw.choice("ab") for _ in range(draw.randint(1, 9)))) for i in range(4)]
        text = " ".join(draw.choice("abc") for _ in range(25))
        automaton = Automaton([(str(i), [w.encode() for w in t.split()]) for i, t in items], 4)
        codes = [automaton.vocabulary.get(w.encode(), 0) for w in text.split()]
        spans, names = automaton.scan(codes)
        hit = {i for a, b in spans for i in range(a, b)}
        [(_, _, n_hit, n_items, sha, _)] = brute.contamination([(0, text)], items, 4)
        assert (len(hit), len(names), brute.sha(",".join(sorted(names)))) == (n_hit, n_items, sha)


def test_contaminated_passages_are_cut():
    automaton = Automaton([("0", [bytes([c]) for c in b"abcdefghijkl"])], 10)
    clean = without_spans(automaton, 0.5)
    assert clean("one two. A b c d e f g h i j, three four five six seven eight nine ten") == "one two. , three four five six seven eight nine ten"
    assert clean("a b c d e f g h i j k l") is None and clean("nothing here") == "nothing here" and clean(None) is None


FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def fits(kind, s):
    d = [int(c) for c in re.sub("[^0-9]", "", s)]
    if kind == "card":
        twice = [x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d[::-1])]
        return 16 <= len(d) <= 19 and sum(twice) % 10 == 0
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in s.split(".")), "phone": 8 <= len(d) <= 15}[kind]


def forms(text):
    return [(k, m.start(), m.end()) for k, p in FORMS.items() for m in re.finditer(p, text or "") if fits(k, m.group())]


def test_base_spans_against_plain_patterns():
    draw = random.Random(6)
    for _ in range(30_000):
        text = "".join(draw.choice("ab@.-+12 3(4%\né") for _ in range(draw.randint(1, 40)))
        assert [(k, a, b) for k, own in base_spans(text).items() for a, b in own] == forms(text)
    long_run = "a" * 50_000 + "@b.c " + "9" * 50_000 + ".1.1.1"
    assert base_spans(long_run)["email"] == [(0, 50_004)]


@pytest.mark.parametrize("name", TABLES)
def test_personal_data_base(request, name):
    df, rows = data_of(request, name)
    got = sorted(((r.doc_id, [(s.kind, s.start, s.end) for s in r.base]) for r in personal_data(row_keyed(df)).collect()), key=repr)
    kinds = list(FORMS)
    assert got == sorted(((d, [(kinds.index(k), a, b) for k, a, b in forms(t)]) for d, t in rows), key=repr)


def test_context_discovers_unseen_identifiers(spark):
    rows = [(i, f"word{i} please call phone +1 555 010 {1000 + i} now or never") for i in range(8)]
    rows += [(50, "again call phone 555-010-7777 now it rings"), (51, "weighs about 555-010-8888 grams at most"), (52, "number call phone 12 now")]
    out = {r.doc_id: r.found for r in personal_data(row_keyed(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert [(s.kind, rows[8][1][s.start : s.end]) for s in out[50]] == [(3, "555-010-7777")]
    assert all(not found for d, found in out.items() if d != 50)
    assert redact(rows[8][1], [s.asDict() for s in out[50]]) == "again call phone <PHONE> now it rings"


def test_few_and_many_seeds_carry_unseen_identifiers(spark):
    cases = [("ring desk", 3, 1), ("call phone", 1000, 500), ("weighs about", 3, 30)]
    rows, unseen = [], {}
    for k, (context, seeds, others) in enumerate(cases):
        rows += [(len(rows) + i, f"s{k}x{i} {context} +1 555 {k}{1000000 + i} r{k}x{i} end") for i in range(seeds)]
        unseen[k] = range(len(rows), len(rows) + others)
        rows += [(len(rows) + i, f"u{k}x{i} {context} 55{k}-{2000 + i}-777 q{k}x{i} end") for i in range(others)]
    words = [(i, re.sub("[0-9]x[0-9]+", lambda m: m.group().translate(str.maketrans("0123456789", "abcdefghij")), t)) for i, t in rows]
    out = {r.doc_id: [(s.kind, words[r.doc_id][1][s.start : s.end]) for s in r.found] for r in personal_data(row_keyed(spark.createDataFrame(words, "doc_id long, text string"))).collect()}
    want = {d: [(3, words[d][1].split()[3])] for k in (0, 1) for d in unseen[k]}
    assert {d: found for d, found in out.items() if found} == want


def test_hidden_secrets_are_discovered_by_their_contexts(spark):
    docs = row_keyed(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    r = pii.discovery(docs).first()
    assert r.hidden > 50 and r.back / r.hidden >= 0.9 and r.back / r.discovered >= 0.9
    seen = personal_data(docs).selectExpr("sum(size(found)) f", "sum(size(seeded)) s").first()
    assert seen.f >= seen.s >= 2 * r.back - r.hidden


def test_seeds_and_discoveries_are_told_apart(spark):
    hexes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(6)]
    texts = {i: f'the token = "{h}" is set' for i, h in enumerate(hexes)} | {9: 'the token = "Zx9-unlike_the-others77" is set', 10: f"lone {hexes[0]} here"}
    out = {r.doc_id: r for r in personal_data(row_keyed(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))).collect()}
    assert all(out[i].found == out[i].seeded and len(out[i].found) == 1 for i in range(6))
    assert len(out[9].found) == 1 and out[9].seeded == [] and out[10].found == []


def test_bootstrap_against_plain_dictionaries(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: {(s.kind, s.start, s.end) for s in r.found} for r in personal_data(row_keyed(docs)).collect()}
    scanned = {d: pii.scan_text(t)[1] for d, t in texts.items()}
    want = brute.bootstrap(scanned, pii.ROUNDS, pii.LEAST_SEEDS, pii.LEAST_PATTERN, pii.LEAST_INSTANCE, pii.SMOOTHING, pii.UNSEEN)
    assert got == want
    # what it discovers there are access tokens, all of them and nothing else
    planted = {(d, *m.span(1)) for d, t in texts.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t)}
    found = {(d, a, b) for d, own in got.items() for _, a, b in own}
    assert len(planted) > 10 and found == planted


def test_a_label_discovers_secrets_of_another_form(spark):
    rows = [(i, f'set api_key = "{i}{"0a1b2c3d4e5f6a7b" * 2}{i}" now') for i in range(6)]
    rows += [(50, 'then api_key = "Zx9-unlike_the-others77" here'), (51, 'a word = "Zx9-unlike_the-others78" here'), (52, f"a digest {'9f' * 20} alone")]
    out = {r.doc_id: [(s.kind, rows[[d for d, _ in rows].index(r.doc_id)][1][s.start : s.end]) for s in r.found] for r in personal_data(row_keyed(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert out[50] == [(pii.SECRET, "Zx9-unlike_the-others77")] and out[51] == out[52] == []
    assert all(len(out[i]) == 1 for i in range(6))


@pytest.mark.parametrize("name", TABLES)
def test_fingerprints(request, name):
    df, rows = data_of(request, name)
    got = fingerprints(df).collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(map(repr, (d for d, _ in rows)))
    own = {r.doc_id: r for r in got}
    prints = {}
    for d, t in rows:
        if name != "repeated":
            assert prints.setdefault(t or "", own[d].fingerprint) == own[d].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    if name != "repeated":
        rows = sorted(rows)
        for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
            t, after = t or "", after or ""
            edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
            assert own[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and own[d].n_chars == len(t)
            if edited == t:
                assert own[d].near_edited == 1


def test_likeness_against_brute_force(documents, rows):
    from terrafold.llm import imatch

    texts = [t or "" for _, t, *_ in sorted(rows)]
    frequency = {}
    for t in texts:
        for w in set(brute.folded_words(t)):
            frequency[w] = frequency.get(w, 0) + 1
    band = (0.05, 0.4)
    n = len(texts)

    def drawn(word):
        mask = int(imatch.draws(imatch.distinct_terms([word.encode()])[0])[0])
        return {j for j in range(imatch.SUBSETS) if mask >> j & 1}

    inside = {w for w, f in frequency.items() if max(2, band[0] * n) <= f <= max(2, band[1] * n)}
    alike = brute.likeness(texts, {"band": inside, "drawn": functools.cache(drawn)}, imatch.SUBSETS)
    got = sorted(fingerprints(documents, band).collect(), key=lambda r: r.doc_id)
    for r, t, after in zip(got, texts, texts[1:] + texts[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert r.near_edited == pytest.approx(alike(t, edited)) and r.near_next == pytest.approx(alike(t, after))
        assert (r.fingerprint == r.edited_fingerprint) == (alike(t, edited) == 1)


def test_rows_of_one_id_follow_by_the_hash_of_their_text(repeated, repeated_rows):
    import xxhash

    key = lambda r: (r[0] is not None, r[0] or 0, np.int64(np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), seed=42))))
    rows = sorted(repeated_rows, key=key)
    want = []
    for (d, t, *_), (_, after, *_) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, after = t or "", after or ""
        want.append((d, brute.sha(t[: len(t) - len(t) // 2] + after[: len(t) // 2])))
    assert tuples(fingerprints(repeated), "doc_id", "edited_sha256") == sorted(want, key=repr)


def test_texts_without_banded_terms_differ(spark):
    df = spark.createDataFrame([(i, f"only{i} here{i}") for i in range(6)] + [(9, None), (10, "...")], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints(df).collect()}
    assert len({got[i].fingerprint for i in range(6)}) == 6 and all(got[i].near_next == 0 for i in range(6))
    assert got[9].fingerprint == got[10].fingerprint == "0" * 256 and got[9].near_next == 1


def test_counters_of_many_small_tasks_stay_small(spark):
    from terrafold.llm import jaccard_join, sketch

    df = spark.range(422).selectExpr("id row_key", "id doc_id", "concat('some words of text number ', id, ' ', id * 7, ' and the same end for all') text")
    made = df.repartition(211).mapInArrow(jaccard_join._profile, jaccard_join._PROFILE_SQL)
    parts = made.where("block is not null").cache()
    total = parts.selectExpr("sum(length(at) + length(counts)) b").first().b
    counts = sketch.summed(parts.select(*sketch.SCHEMA.names), jaccard_join.SKETCH_CELLS)
    # 211 tasks of two texts: three bytes a shingle, not a block of counters each
    assert counts.sum() == made.selectExpr("sum(n) n").first().n and total <= 4 * counts.sum()
    parts.unpersist()


@pytest.mark.parametrize("name", TABLES)
def test_kd_shards(request, name):
    df, rows = data_of(request, name)
    got = kd_shards(df, shards=8).collect()
    assert len(got) == len(rows)
    sizes, slots = {}, {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted((r.doc_id, r.size) for r in got if r.doc_id is not None) == sorted((d, len((t or "").encode()) + 1) for d, t in rows if d is not None)
    if rows:
        largest = max(len((t or "").encode()) + 1 for _, t in rows)
        assert max(sizes.values()) - min([sizes.get(i, 0) for i in range(8)]) <= 2 * largest


def test_kd_shards_against_brute_force(spark, monkeypatch):
    from terrafold.llm import kd_sharding

    monkeypatch.setattr(kd_sharding, "FEW_ROWS", 20)
    monkeypatch.setattr(kd_sharding, "HISTOGRAM_BINS", 16)
    draw = random.Random(12)
    rows = [(3 * i - 200, f"text {i} " + "x" * int(draw.paretovariate(1) * 20), draw.choice(["en", "fr", None]), draw.choice(["a", "a", "a", "b", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    for shards in (2, 5, 8):
        got = kd_shards(df, shards=shards).collect()
        assert {r.doc_id: r.shard for r in got} == brute.kd_shards(rows, shards)
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {d: (len(t) + 1, zlib.crc32(t.encode())) for d, t, *_ in rows}


def test_equal_texts_have_equal_checksums(repeated, repeated_rows):
    want = sorted((zlib.crc32((t or "").encode()) for _, t, *_ in repeated_rows))
    assert sorted(r.text_crc32 for r in kd_shards(repeated, shards=8).collect()) == want


def test_kd_splits_a_group_of_copies(spark):
    df = spark.range(4000).selectExpr("id doc_id", "if(id < 3000, 'same text', concat('text ', id)) text", "'en' lang", "'s' source")
    sizes = [r.b for r in kd_shards(df, shards=8).groupBy("shard").agg({"size": "sum"}).toDF("shard", "b").collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 60
    assert kd_shards(df, target_bytes=10_000).select("shard").distinct().count() == 4


def test_toxicity_learns_pairs(spark):
    draw = random.Random(9)
    filler = ["alpha", "beta", "gamma", "delta", "stone", "river"]
    rows, labels = [], []
    for i in range(1500):
        words = [draw.choice(filler) for _ in range(30)]
        slur, group = draw.random() < 0.4, draw.random() < 0.4
        words[3] = "clown" if slur else words[3]
        words[9] = "strangers" if group else words[9]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(slur and group)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = scored(docs, train(docs, marks)).withColumn("held", held_out()).collect()
    right = [(r.score >= 0.5) == bool(labels[r.doc_id][2]) for r in out if r.held]
    assert len(right) > 200 and sum(right) / len(right) > 0.97


def test_toxicity_learns_pairs_without_effect_of_their_own(spark):
    draw = random.Random(11)
    filler = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(4000):
        words = [draw.choice(filler) for _ in range(30)]
        slur, group = draw.random() < 0.5, draw.random() < 0.5
        words[3] = "clown" if slur else words[3]
        words[9] = "strangers" if group else words[9]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(slur != group)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = scored(docs, train(docs, marks)).withColumn("held", held_out()).collect()
    right = [(r.score >= 0.5) == bool(labels[r.doc_id][2]) for r in out if r.held]
    assert len(right) > 600 and sum(right) / len(right) > 0.97


def test_scores_against_plain_sums(documents, rows):
    draw = np.random.default_rng(3)
    words = sorted({w for _, t, *_ in rows for w in brute.folded_words(t)})
    cell = {w: int(toxicity.distinct_cells([w.encode()])[0][0]) for w in words}
    known = np.array(sorted({cell[w] for w in words[::2]}))
    machine = toxicity.FactorizationMachine(known, -0.3, draw.normal(0, 0.2, len(known)), draw.normal(0, 0.3, (len(known), toxicity.FACTORS)))
    place = {c: i for i, c in enumerate(known.tolist())}
    got = {r.doc_id: r.score for r in scored(documents, machine).collect()}
    for d, t, *_ in rows:
        own = sorted({place[cell[w]] for w in brute.folded_words(t) if cell[w] in place})
        pairs = sum(float(machine.factors[a] @ machine.factors[b]) for i, a in enumerate(own) for b in own[:i])
        margin = machine.bias + sum(machine.weights[a] for a in own) + pairs / max(1, len(own))
        assert got[d] == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-9)


def test_the_sample_is_bounded_and_keeps_held_out_rows_apart(spark):
    docs = spark.createDataFrame([(i % 50, f"w{i} x{i} y{i}") for i in range(200)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, i % 2) for i in range(50)] + [(None, 1, 1), (3, 1, None), (4, 1, 7)], "doc_id long, quality int, toxic int")
    free = marks.where(~held_out() & marks.toxic.isin(0, 1) & marks.doc_id.isNotNull()).count()
    assert toxicity.sample_of(docs, marks).count() == 4 * free
    assert toxicity.sample_of(docs, marks, most=10).count() == 10
    assert toxicity.sample_of(docs, marks, most_terms=30).count() == 10


def test_a_huge_labelled_row_does_not_crowd_out_the_rest(spark):
    huge = " ".join(f"u{i}" for i in range(60_000))
    docs = spark.createDataFrame([(i, huge if i % 7 == 0 else f"w{i} x{i}") for i in range(60)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    free = marks.where(~held_out() & (F.col("doc_id") % 7 != 0)).count()
    assert toxicity.sample_of(docs, marks).count() == free
    assert toxicity.sample_of(docs, marks, most_terms=2 * free).count() == free


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = scored(docs.select("doc_id", "text"), train(docs, labels)).join(labels, "doc_id").where(held_out()).select("score", "toxic").collect()
    on, off = ([r.score for r in out if r.toxic == t] for t in (1, 0))
    auc = np.mean([(a > np.array(off)).mean() + 0.5 * (a == np.array(off)).mean() for a in on])
    assert len(on) > 80 and auc > 0.9
    assert np.mean(np.array(on) >= 0.5) > 0.75 and np.mean(np.array(off) >= 0.5) < 0.01


@pytest.mark.parametrize("name", TABLES)
def test_toxicity_scores_every_row(spark, request, name):
    df, rows = data_of(request, name)
    marks = spark.createDataFrame([(d, 1, i % 2) for i, (d, _) in enumerate(rows)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    name = "score_" if "score" in df.columns else "score"
    out = scored(df, train(df, marks), name).collect()
    assert len(out) == len(rows) and all(0 <= r[name] <= 1 for r in out)
    bare = scored(df, train(df, marks.limit(0)), name).collect()
    assert all(r[name] < 0.5 for r in bare)
