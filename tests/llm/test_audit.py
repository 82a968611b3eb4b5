"""The filter audit against plain Python."""

from __future__ import annotations

from collections import Counter
from itertools import permutations

import brute
import pytest
from conftest import SCHEMA, tuples

from terrafold.llm.filter_audit import interactions

LABELS = "doc_id long, quality int, toxic int"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def labels_of(rows):
    return [(r[0], i % 2, int(i % 5 == 0)) for i, r in enumerate(rows) if i % 3] + [(rows[1][0], 1, 1), (rows[1][0], None, None), (None, 1, 1), (10**9, 1, 1)]


@pytest.mark.parametrize("name", ["documents", "repeated", "empty", "clashing"])
def test_audit(request, spark, rows, name):
    df = request.getfixturevalue(name)
    docs = [(r.doc_id, r.text, r.lang) for r in df.select("doc_id", "text", "lang").collect()]
    marks = labels_of(rows)
    got = interactions(df, spark.createDataFrame(marks, LABELS))
    assert tuples(got, *COLUMNS) == sorted(brute.audit(docs, marks), key=repr)


def test_texts_at_the_thresholds(spark):
    words = [f"w{i}" for i in range(100)]
    texts = [
        " ".join(words),  # passes all
        " ".join(words[:99]),  # A only
        " ".join(words[:80] + words[:20]),  # just distinct enough
        " ".join(words[:79] + words[:21]),  # B only
        "A" * 10 + "b" * 90,
        "A" * 11 + "b" * 89,
        "É" * 90 + "A" * 11,
        " ".join([*words, "a|b"]),
        " ".join(words),
        None,
        "",
    ]
    docs = [(len(texts) - i, t, "en", None, None) for i, t in enumerate(texts)]
    got = interactions(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([], LABELS))
    assert tuples(got, *COLUMNS) == sorted(brute.audit([(d, t, p) for d, t, p, *_ in docs], []), key=repr)


def test_every_order_accounts_for_all(spark, documents, rows):
    got = interactions(documents, spark.createDataFrame(labels_of(rows), LABELS)).collect()
    total = Counter((r[2] or "") for r in rows)
    assert {r.filter_order for r in got} == {"".join(p) for p in permutations("ABCDE")}
    for part, n in total.items():
        own = [r for r in got if r.part == part]
        assert len(own) == 600
        for order in {r.filter_order for r in own}:
            steps = sorted((r for r in own if r.filter_order == order), key=lambda r: r.step)
            assert steps[-1].kept + sum(r.removed for r in steps) == n
