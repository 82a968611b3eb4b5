from __future__ import annotations

import brute
import numpy as np
from conftest import SCHEMA
from tokenizers import Tokenizer

import corpus_pipeline
from terrafold.llm.tokenizers_public import tokenizer_path

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ITEM = "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11 q12"


def folder(spark, tmp_path, rows, labels):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_each_stage_and_the_run(spark, rows, tmp_path):
    extra = [
        (1000 + i, f"plain words {i} number {i} stand here for the training of the model " + ("you idiot trash" if i % 2 else "kind friend"), "en", "s", 0)
        for i in range(80)
    ]
    leak = (2000, f"before {ITEM} after and much else that is not in any test at all, really not one bit of it here", "en", "s", 0)
    all_leak = (2001, ITEM, "en", "s", 0)
    labels = [(d, 1, int("idiot" in t)) for d, t, *_ in extra]
    where = folder(spark, tmp_path, [*rows, *extra, leak, all_leak], labels)
    docs = spark.read.parquet(f"{where}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, where)
        assert docs.columns == DOCUMENT_COLUMNS
        docs.write.parquet(f"{tmp_path}/out/{name}")
        docs = spark.read.parquet(f"{tmp_path}/out/{name}")
        out[name] = {r.doc_id: r for r in docs.collect()}
    kept = out["toxicity"]
    assert {d for d, t, *_ in extra if "idiot" in t}.isdisjoint(kept) and {r[0] for r in rows} <= set(kept)
    groups = brute.jaccard_components([(d, r.text) for d, r in kept.items()])
    assert set(out["ngram_jaccard_join"]) == {d for d, n, c in groups if not n or d == c}
    clean = out["decontamination"]
    assert 2001 not in clean and clean[2000].text == "before  after and much else that is not in any test at all, really not one bit of it here"
    assert clean[2000].n_chars == len(clean[2000].text)
    assert {d: r.text for d, r in out["ngram_jaccard_join"].items() if d < 2000} == {d: r.text for d, r in clean.items() if d < 2000}
    private = next(r.text for r in out["pii"].values() if r.text and r.text.startswith("mail "))
    assert private == "mail <EMAIL> or <IP> and <PHONE> card <CARD> end"
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = []
    for d, r in out["pii"].items():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        want.append((d, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(r.text or "")))
    got = [tuple(r) for r in corpus_pipeline.run(spark, where).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got) == sorted(want)


def test_empty_and_repeated_tables(spark, repeated_rows, tmp_path):
    where = folder(spark, tmp_path / "none", [], [])
    assert corpus_pipeline.run(spark, where).count() == 0
    where = folder(spark, tmp_path / "repeated", repeated_rows, [(5, 1, 0)])
    groups = brute.jaccard_components([(r[0], r[1]) for r in repeated_rows])
    assert corpus_pipeline.run(spark, where).count() <= len(groups)


def test_stages_pass_clashing_columns_and_rows_without_an_id(spark, repeated_rows, tmp_path):
    names = ["row_key", "score", "node", "spans", "root", "n", "text_", "block", "answers", "toxic", "runs"]
    rows = [(*r, *(f"{c}{i}" for c in names)) for i, r in enumerate(repeated_rows)]
    plain = folder(spark, tmp_path / "plain", repeated_rows, [(5, 1, 0)])
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", {c} string" for c in names))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, plain)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/clash/{name}")
        docs = spark.read.parquet(f"{tmp_path}/clash/{name}")
        kept[name] = docs.collect()
    whole = {tuple(r[5:]): (r[0], r[1]) for r in rows}
    for got in kept.values():
        assert all(whole[tuple(r)[5:]][0] == r.doc_id for r in got)
    # nobody is toxic; each group keeps one row, and all rows without words stay
    assert len(kept["toxicity"]) == len(rows)
    assert sum(1 for r in kept["ngram_jaccard_join"] if not brute.plain_words(r.text)) == sum(1 for r in rows if not brute.plain_words(r[1]))
    want = len({c if c is not None else ("lone", i) for i, (_, n, c) in enumerate(brute.jaccard_components([(r[0], r[1]) for r in rows])) if n})
    assert sum(1 for r in kept["ngram_jaccard_join"] if brute.plain_words(r.text)) == want
    assert len(bpe := corpus_pipeline.bpe(spark, docs, plain).collect()) == len(kept["pii"]) and all(r.n_tokens >= 0 for r in bpe)


def test_each_stage_on_an_empty_table(spark, empty, tmp_path):
    where = folder(spark, tmp_path, [], [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, where)
        assert out.count() == 0 and (name == "bpe" or out.columns == DOCUMENT_COLUMNS)


def test_a_text_over_a_chunk_in_every_stage(spark, tmp_path):
    body = " ".join(f"word{i * 7919 % 100_003}" for i in range(110_000))
    assert len(body) > 1_000_000
    rows = [(1, body, "en", "s", 0), (2, body + " more", "en", "s", 0), (3, f"{body[:600_000]} {ITEM} {body[600_000:]} mail a.b@c.example.com", "en", "s", 0), (4, "short clean text of a few words", "en", "s", 0)]
    where = folder(spark, tmp_path, rows, [(1, 1, 0), (4, 1, 0)])
    docs = spark.read.parquet(f"{where}/documents.parquet")
    assert corpus_pipeline.ngram_jaccard_join(spark, docs, where).count() == 2
    clean = {r.doc_id: r.text for r in corpus_pipeline.decontamination(spark, docs, where).collect()}
    assert clean[1] == body and ITEM not in clean[3] and clean[3].startswith(body[:600_000]) and clean[3].endswith("example.com")
    private = {r.doc_id: r.text for r in corpus_pipeline.pii(spark, docs, where).collect()}
    assert private[3].endswith("mail <EMAIL>") and private[1] == body
