"""Lines that many documents repeat, found through two Bloom filters.

The hash of every long line goes, once for each document, to the block of the filters that
it falls into, packed: four bytes a line. A block puts hashes that it has not seen into its
first filter and those that it has into its second; parts that come from elsewhere meet the
same two filters, so a block is one pass over a stream and holds its filters only. The
second filters together have a fixed largest size and are broadcast. Lines that they do not
know stand in one document and travel no further; the others are suspects, and only those
are shuffled, as digests of the whole line, to be counted exactly and to find the largest id.

A filter that is too small for a corpus costs time, never a result: more lines are suspects,
at worst all, 40 bytes each. Counts are summed in the tasks first, and the join back to the
documents reads two written tables, so that Spark can split a line that a third of all
documents hold. The texts meet their lost lines by one sort-merge join, at every size.

Cases: null and empty texts are one empty line; keys under LEAST_CHARS, white lines among
them, always stay; a line that stands several times in a document counts once and goes or
stays as a whole there. Rows that share an id are documents of their own: those with the
largest id all keep their line. A document without an id is never the largest; lines held
only by such documents stay. An empty table gives an empty result; other columns, whatever
their names, pass by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm import kernel
from terrafold.llm.rows import row_keyed, text_bytes
from terrafold.runtime import materialise, release, ship, shuffle_partitions

LEAST_CHARS = 40
LEAST_DOCUMENTS = 5
#: Bits of one block of a filter, and of a whole filter at most (128 MB).
BLOCK_BITS = 1 << 19
MOST_BITS = 1 << 30
#: Bits of a filter for each line that the corpus could hold.
BITS_A_LINE = 10
#: Hashes that a task holds before it sends them.
_HELD = 1 << 20
_PROBES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_SHIFT = np.uint32(32 - (BLOCK_BITS.bit_length() - 1))


@dataclass
class Lines:
    """The lines of some texts: line i is data[start[i]:end[i]], its key lower-cased[key_start[i]:key_end[i]]; text d has lines first[d]:first[d + 1]."""

    lowered: bytes
    start: np.ndarray
    end: np.ndarray
    key_start: np.ndarray
    key_end: np.ndarray
    first: np.ndarray
    long: np.ndarray
    """Indices of lines whose key is long enough."""
    hash: np.ndarray
    """Hashes of the keys of long lines."""

    def text_of_long(self) -> np.ndarray:
        return np.searchsorted(self.first, self.long, "right") - 1

    def digest(self, line: int) -> bytes:
        return blake2b(self.lowered[self.key_start[line] : self.key_end[line]], digest_size=16).digest()


def lines_of(texts: list[bytes], least_chars: int) -> Lines:
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    lowered = joined.translate(kernel.LOWER_BYTES)
    end = np.flatnonzero(data == 10)
    start = np.concatenate(([0], end[:-1] + 1))
    begins = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)))
    black = np.flatnonzero(~kernel.WHITE[data])
    a, b = np.searchsorted(black, start), np.searchsorted(black, end)
    some = b > a
    key_start, key_end = end.copy(), end.copy()
    key_start[some], key_end[some] = black[a[some]], black[b[some] - 1] + 1
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    long = np.flatnonzero(chars[key_end] - chars[key_start] >= least_chars)
    hashes = kernel.slice_hash(kernel.prefix_hash(np.frombuffer(lowered, np.uint8)), key_start[long], key_end[long])
    return Lines(lowered, start, end, key_start, key_end, np.searchsorted(start, begins), long, hashes)


def distinct_long(lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, hash, a line) for each distinct long key of each text."""
    text = lines.text_of_long()
    order = np.lexsort((lines.hash, text))
    t, h = text[order], lines.hash[order]
    new = np.ones(len(order), bool)
    new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    return t[new], h[new], lines.long[order[new]]


def filter_bits(total_bytes: int, most: int = MOST_BITS) -> int:
    """Bits of a filter for texts of so many bytes: a power of two, from one block to ``most``."""
    wanted = BITS_A_LINE * (total_bytes // (LEAST_CHARS + 1) + 1)
    return max(BLOCK_BITS, min(most, 1 << (wanted - 1).bit_length()))


def _probes(prints: np.ndarray) -> np.ndarray:
    """The bits of its block that each 32-bit print sets."""
    return (prints[:, None] * _PROBES[None, :]) >> _SHIFT


def _place(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, print in the block) of hashes; blocks is a power of two."""
    return ((hashes >> np.uint64(32)) & np.uint64(blocks - 1)).astype(np.int32), (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)


class BlockFilters:
    """The once-seen and the twice-seen filter of one block."""

    def __init__(self) -> None:
        self.once = np.zeros(BLOCK_BITS, bool)
        self.twice = np.zeros(BLOCK_BITS, bool)

    def add(self, prints: np.ndarray, again: np.ndarray) -> None:
        """prints: different ones, seen by one task; again: those of them that it saw more than once."""
        at = _probes(prints)
        known = self.once[at].all(axis=1)
        self.twice[at[known]] = True
        self.once[at] = True
        self.twice[_probes(again)] = True


class TwiceSeen:
    """The twice-seen filters of all blocks."""

    def __init__(self, blocks: int, parts: dict[int, bytes]) -> None:
        self.blocks = blocks
        self.index = np.full(blocks, -1, np.int32)
        self.index[list(parts)] = np.arange(len(parts))
        self.bits = np.frombuffer(b"".join(parts.values()), np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        block, prints = _place(hashes, self.blocks)
        at = self.index[block]
        out = at >= 0
        if out.any():
            bit = _probes(prints[out]).astype(np.int64) + at[out].astype(np.int64)[:, None] * BLOCK_BITS
            out[out] = ((self.bits[bit >> 3] << (bit & 7).astype(np.uint8)) & 128).astype(bool).all(axis=1)
        return out


_SENT = pa.schema([("block", pa.int32()), ("once", pa.binary()), ("again", pa.binary())])


def _send(blocks: int, least_chars: int):
    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        hashes, counts = np.unique(np.concatenate(held), return_counts=True)
        block, prints = _place(hashes, blocks)
        order = np.argsort(block, kind="stable")
        block, prints, many = block[order], prints[order], counts[order] > 1
        edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
        rows = [(int(block[a]), prints[a:b].tobytes(), prints[a:b][many[a:b]].tobytes()) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, texts in kernel.chunks(batch):
                _, hashes, _ = distinct_long(lines_of(texts, least_chars))
                held.append(hashes)
                size += len(hashes)
                if size > _HELD:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    return run


def _filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _SENT in the order of their blocks -> (block, packed twice-seen filter)."""
    own, filters = None, BlockFilters()

    def done() -> Iterator[pa.RecordBatch]:
        if own is not None and filters.twice.any():
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([np.packbits(filters.twice).tobytes()], pa.binary())], ["block", "bits"])

    for batch in batches:
        for block, once, again in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if block != own:
                yield from done()
                own, filters = block, BlockFilters()
            filters.add(np.frombuffer(once, np.uint32), np.frombuffer(again, np.uint32))
    yield from done()


def twice_seen(docs: DataFrame, bits: int, least_chars: int = LEAST_CHARS) -> TwiceSeen:
    """The twice-seen filter over all long lines; ``bits`` / 8 bytes at most on the driver."""
    blocks = bits // BLOCK_BITS
    tasks = min(blocks, shuffle_partitions(docs.sparkSession))
    parts = docs.select("text").mapInArrow(_send(blocks, least_chars), "block int, once binary, again binary")
    found = parts.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(_filter, "block int, bits binary")
    return TwiceSeen(blocks, {r.block: bytes(r.bits) for r in found.collect()})


_SUSPECT = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("line", pa.binary())])


def suspects(docs: DataFrame, seen: TwiceSeen, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(row_key, doc_id, digest of a line) for each distinct long line that the filter knows."""
    shared = docs.sparkSession.sparkContext.broadcast(seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at, texts in kernel.chunks(batch):
                lines = lines_of(texts, least_chars)
                text, hashes, line = distinct_long(lines)
                own = known.has(hashes)
                rows = pa.array(text[own] + at)
                digests = pa.array([lines.digest(i) for i in line[own].tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("row_key").take(rows), batch.column("doc_id").take(rows), digests], schema=_SUSPECT)

    return docs.mapInArrow(run, "row_key long, doc_id long, line binary")


_KEPT = pa.schema([("doc_id", pa.int64()), ("text", pa.large_string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])


def _without(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column("gone").to_pylist()
            for at, texts in kernel.chunks(batch):
                kept, n_lines, n_dropped = [], [], []
                for text, drop in zip(texts, gone[at : at + len(texts)], strict=True):
                    parts = text.split(b"\n")
                    n = len(parts)
                    if drop:
                        lines, drop = lines_of([text], least_chars), set(drop)
                        out = {i for i in lines.long.tolist() if lines.digest(i) in drop}
                        parts = [p for i, p in enumerate(parts) if i not in out]
                        text = b"\n".join(parts)
                    kept.append(text.decode())
                    n_lines.append(n)
                    n_dropped.append(n - len(parts))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array(kept, pa.large_string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], schema=_KEPT)

    return run


def without_repeated_lines(documents: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): each document without the lines that ``least_documents`` hold, but for the largest of them."""
    spark = documents.sparkSession
    ship(spark)
    docs = row_keyed(documents)
    seen = twice_seen(docs, filter_bits(text_bytes(docs), most_bits), least_chars)
    held = materialise(suspects(docs, seen, least_chars), "suspects")
    many = held.groupBy("line").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).where((F.col("n") >= least_documents) & F.col("last").isNotNull())
    repeated = materialise(many.select("line", "last"), "repeated")
    late = held.join(repeated, "line").where(~F.col("doc_id").eqNullSafe(F.col("last")))
    gone = materialise(late.groupBy("row_key").agg(F.collect_list("line").alias("gone")), "gone")
    release(held, repeated)
    both = docs.join(gone.hint("merge"), "row_key", "left").select("doc_id", "text", "gone")
    return both.mapInArrow(_without(least_chars), "doc_id long, text string, n_lines long, n_dropped long")


def op12_bloom_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = without_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
