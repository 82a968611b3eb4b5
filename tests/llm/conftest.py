"""Small documents with every awkward case: nulls, empties, repeats, ties, very long texts, clashing columns."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward_rows() -> list[tuple]:
    draw = random.Random(5)
    words = ["the", "of", "and", "tion", "ing", "er", "st", "re", "ça", "über", "naïve", "x1", "42", "Is", "THE"]
    prose = lambda n: " ".join(draw.choice(words) + draw.choice(["", "", "e", "s", ","]) for _ in range(n))
    passage = prose(70)
    base = prose(120)
    texts = [None, "", " \t\n", "one", "two words", "a b c d", "a b c d e", "A B C D E", "a  b\tc\nd e"]
    texts += [base, base, base + " tail", "head " + base, base.replace("the", "teh", 1)]
    texts += [prose(40) + " " + passage + " " + prose(30), passage, prose(10) + "\n" + passage + "\n" + prose(90)]
    texts += [prose(8000), "x" * 40_000, "word " * 9000, "日本語のテキスト" * 60, "é" * 300, "a b\x1cc   d"]
    texts += ["mail a.b@c.example.com or 10.0.0.1 and +1 (555) 010-9999 card 4111 1111 1111 1111 end", "don't  we'll <|endoftext|> x<|startoftext|>y !!'s ''re"]
    for n in range(3, 14):  # small sets that differ by a word
        small = prose(n + 4).split()
        texts += [" ".join(small), " ".join(small[:-1]), " ".join([*small, "more"])]
    near = prose(200).split()
    for i in range(12):
        texts.append(" ".join(w if j != 15 * i else "edit" for j, w in enumerate(near)))
    rows = [(100 - i if i % 3 else 300 + i, t, ["en", "fr", None][i % 3], f"src{i % 2}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    draw.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def repeated_rows(rows):
    """Also rows that share an id, with the same and other text, and rows without one."""
    return [*rows, rows[0], rows[3], (rows[5][0], rows[9][1], "en", "src0", 0), (None, rows[9][1], None, None, None), (None, None, None, None, None), (None, rows[12][1], None, None, None)]


@pytest.fixture(scope="session")
def repeated(spark, repeated_rows):
    return spark.createDataFrame(repeated_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(documents):
    """Extra columns by the names that operators use themselves."""
    names = ["row_key", "answers", "settled", "node", "block", "score", "n", "n_tokens", "n_words", "kept", "spans", "shard", "slot", "size", "root", "range", "guest", "place", "list", "bucket"]
    return documents.selectExpr("*", *(f"'x' as {n}" for n in names))


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
