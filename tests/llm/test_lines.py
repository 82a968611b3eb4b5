"""Line dedup against plain Python, and its filters against sets."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from conftest import SCHEMA, tuples

from terrafold.llm import line_dedup
from terrafold.llm.line_dedup import BLOCK_BITS, BlockFilters, TwiceSeen, _place, filter_bits, without_repeated_lines

COLUMNS = ["doc_id", "n_lines", "n_dropped", "sha2(text, 256)"]


def digests(df):
    return tuples(df.selectExpr("doc_id", "n_lines", "n_dropped", "sha2(text, 256) as kept"), "doc_id", "n_lines", "n_dropped", "kept")


def lined_rows():
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdeé日") for _ in range(draw.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    common = [line(12) for _ in range(8)] + ["é" * 40, "é" * 39, "x" * 40, "y" * 39, "a b " * 9 + "abcd", "日" * 45]
    texts = [None, "", "\n", "\n\n", " \t\n \r\n", common[0], common[0] + "\n", "\r\n".join(common)]
    for i in range(60):
        own = [line(draw.randint(1, 14)) for _ in range(draw.randint(0, 5))]
        shared = [draw.choice(common) for _ in range(draw.randint(0, 6))]
        shared = [draw.choice([x, x.upper() if x.isascii() else x, f"  {x}\t", f"\x0b{x}\r", f"{x}\x1c"]) for x in shared]
        both = own + shared
        draw.shuffle(both)
        texts.append("\n".join(both))
    texts += [common[1] + "\n" + common[1]] * 3
    rows = [(500 - 3 * i, t, "en", "s", None) for i, t in enumerate(texts)]
    rows += [(None, common[0], None, None, None), (500, common[0], None, None, None), (500, common[2] + "\nend", None, None, None)]
    rows += [(None, "q" * 50, None, None, None)] * 6
    return rows


@pytest.mark.parametrize("name", ["documents", "repeated", "empty", "clashing"])
def test_awkward_documents(request, name):
    df = request.getfixturevalue(name)
    docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert digests(without_repeated_lines(df)) == sorted(brute.line_dedup(docs), key=repr)


def test_lines(spark):
    rows = lined_rows()
    docs = [(r[0], r[1]) for r in rows]
    want = sorted(brute.line_dedup(docs), key=repr)
    assert sum(r[2] for r in want) > 50
    assert digests(without_repeated_lines(spark.createDataFrame(rows, SCHEMA).repartition(5))) == want


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rows = lined_rows()
    monkeypatch.setattr(line_dedup, "twice_seen", lambda *_: TwiceSeen(1, {0: b"\xff" * (BLOCK_BITS // 8)}))
    got = without_repeated_lines(spark.createDataFrame(rows, SCHEMA))
    assert digests(got) == sorted(brute.line_dedup([(r[0], r[1]) for r in rows]), key=repr)


def test_a_long_text_and_a_hot_line(spark):
    draw = random.Random(3)
    long = "\n".join(f"{draw.random()} {draw.random()} {draw.random()}" for _ in range(30_000))
    assert len(long) > 1_500_000
    hot = "the same licence line stands in very many documents of this table"
    rows = [(1, long + "\n" + hot), (2, hot + "\n" + long), *((10 + i, f"{hot}\nown {i}") for i in range(900))]
    got = without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert digests(got) == sorted(brute.line_dedup(rows), key=repr)


def test_filters_never_miss_a_repeat():
    draw = np.random.default_rng(1)
    hashes = draw.integers(0, 1 << 63, 60_000, dtype=np.uint64)
    blocks, filters = 4, {}
    parts = [hashes[:30_000], hashes[20_000:50_000], hashes[45_000:]]
    again = [hashes[:500], hashes[:0], hashes[:0]]
    for part, more in zip(parts, again, strict=True):
        block, prints = _place(part, blocks)
        more_block, more_prints = _place(more, blocks)
        for b in range(blocks):
            filters.setdefault(b, BlockFilters()).add(prints[block == b], more_prints[more_block == b])
    seen = TwiceSeen(blocks, {b: np.packbits(f.twice).tobytes() for b, f in filters.items()})
    known = seen.has(hashes)
    twice = np.zeros(len(hashes), bool)
    twice[:500] = twice[20_000:30_000] = twice[45_000:50_000] = True
    assert known[twice].all()
    assert known[~twice].mean() < 0.02


def test_the_filter_grows_with_the_corpus_up_to_a_bound():
    assert filter_bits(0) == BLOCK_BITS
    assert filter_bits(10**9) == 1 << 28
    assert filter_bits(10**14) == line_dedup.MOST_BITS
