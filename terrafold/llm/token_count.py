"""Token counts with overlap resynchronisation.

A huge text is cut into overlapping chunks, each encoded with offsets. Two
neighbours are spliced at a boundary that both have and that is proven stable:

- in the left chunk it starts a pre-token, is not within ``GUARD`` characters of
  the chunk's end and is not in its last pre-token, so no later text moves it
  (the pre-tokenizer looks at most a few characters ahead, and added tokens are
  shorter than GUARD);
- its character begins a canonical composition, so normalising the text from
  there on gives the same as normalising all of it;
- it starts a pre-token in the right chunk too, whose tokens from there on
  depend on nothing before it.

By induction from the start of the text, all tokens are those of the whole.
Where no boundary is common, the left chunk reaches further, until it takes the
rest of the text. A text of one chunk has nothing to splice; white space in ASCII is
such a boundary inside it, so its words are counted once each and looked up.

Cases: null is the empty text, with no tokens; strings of added tokens count as
one token, as the library does by default; repeated rows each get their count; an
empty table gives an empty result; other columns, whatever their names, pass by.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm import kernel
from terrafold.llm.rows import texts_of
from terrafold.llm.tokenizers_public import Bounded, open_tokenizer, tokenizer_path
from terrafold.runtime import ship

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 256
GUARD = 64
MAX_TOKENS = 2048
#: Bytes of words whose counts a worker keeps.
CACHED_BYTES = 192 << 20

_BLANK = re.compile("[^ \t\n\r\x0b\x0c]+")
#: What str.split takes for white space beyond ASCII's six.
_OTHER_WHITE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


def _starts_composition(c: str) -> bool:
    return not unicodedata.category(c).startswith("M") and not "\u1160" <= c <= "\u11ff"


class Chunk:
    """One encoded stretch of a text and the places where its pre-tokens start."""

    def __init__(self, tokenizer, text: str, start: int, end: int) -> None:
        encoding = tokenizer.encode(text[start:end], add_special_tokens=False)
        self.start, self.end, self.n_tokens = start, end, len(encoding)
        self.before: dict[int, int] = {}
        """Place of each pre-token's start -> tokens before it."""
        own = None
        for i, ((a, _), word) in enumerate(zip(encoding.offsets, encoding.word_ids, strict=True)):
            if word is None or word != own:
                self.before.setdefault(start + a, i)
            own = word
        self.last = max(self.before, default=start)


def count_huge(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of a whole text from overlapping chunks."""
    total, known, begin, width = 0, 0, 0, overlap
    left = Chunk(tokenizer, text, 0, min(len(text), chunk + overlap))
    while left.end < len(text):
        right = Chunk(tokenizer, text, left.end - width, min(len(text), left.end + chunk))
        stable = [p for p in right.before if p in left.before and begin <= p < left.last and p <= left.end - GUARD and _starts_composition(text[p])]
        if not stable:
            width *= 2
            left = Chunk(tokenizer, text, left.start, min(len(text), left.end + width))
            width = min(width, left.end - left.start)
            continue
        splice = max(stable)
        total += left.before[splice] - known
        left, known, begin, width = right, right.before[splice], splice, overlap
    return total + left.n_tokens - known


def _words(text: str) -> list[str]:
    return _BLANK.findall(text) if _OTHER_WHITE.search(text) else text.split()


class Counter:
    """Counts for one tokenizer file; words seen before are looked up."""

    def __init__(self, path: str) -> None:
        self.tokenizer = open_tokenizer(path)
        self.known = Bounded(CACHED_BYTES)

    def counts(self, texts: list[str], chunk: int, overlap: int) -> list[int]:
        split = [None if len(x) > chunk else _words(x) for x in texts]
        new = set().union(*filter(None, split)).difference(self.known)
        self.known.room(new, 2)
        if not self.known:
            new = set().union(*filter(None, split))
        order = list(new)
        for a in range(0, len(order), 4096):
            part = order[a : a + 4096]
            self.known.update(zip(part, map(len, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        look = self.known.__getitem__
        return [count_huge(self.tokenizer, x, chunk, overlap) if words is None else sum(map(look, words)) for x, words in zip(texts, split, strict=True)]


@functools.cache
def open_counter(path: str) -> Counter:
    return Counter(path)


_SQL = "doc_id long, n_bytes long, n_tokens long"


def token_counts(documents: DataFrame, path: str | None = None, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Per document its bytes and its tokens, without added begin or end tokens."""
    ship(documents.sparkSession)
    path = path or tokenizer_path("word_bpe_49k.json")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = open_counter(path)
        for batch in batches:
            for at, texts in kernel.chunks(batch):
                n = counter.counts([x.decode() for x in texts], chunk, overlap)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array(list(map(len, texts)), pa.int64()), pa.array(n, pa.int64())], schema=schema)

    return texts_of(documents).mapInArrow(run, _SQL)


def op1_overlap_token_counts(spark, sf_dir: str) -> DataFrame:
    out = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)
