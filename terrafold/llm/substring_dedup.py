"""Substring duplicates by relative Lempel-Ziv parsing over words.

The reference is every document with a smaller id. It is indexed by its phrases of
``window`` words with their places, in blocks of bounded size that Spark deals by the
phrase's hash, so that each document meets every block that can hold a phrase of it
and no block holds a document's pair with another. A block answers each phrase that a
smaller document holds with a reference position: the smallest such document and the
first place there. A document is then parsed greedily: a factor starts at the first
phrase with a position and grows word by word as long as the next phrase continues at
the next place of the same reference document. Phrases that straddle two factors are
checked like all others: each has its own answer, so a factor may begin inside the
last one, and the words that factors cover are exactly those of repeated phrases.

Phrases that a smaller document of the same chunk holds are answered on the spot, which
leaves at most one document for each phrase and chunk to send: a phrase that a third of
all documents share costs one entry for each chunk, not each document. Positions travel
as runs.

Cases: a null or empty text has no words. Documents that share one doc_id never
remove words of each other. A document without an id comes after all others: it
can lose words and takes none. Repeated rows each get their result; texts of any length
are read whole, in chunks that hold one text at least; an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm import kernel
from terrafold.llm.phrase_index import bucket_of
from terrafold.llm.rows import NO_ID, buckets_for, row_keyed, text_bytes
from terrafold.runtime import ship

WINDOW = 13
#: Bytes of text for which there is a block of the index.
BLOCK_BYTES = 16 << 20

_PARTS = (("keys", np.int64), ("places", np.int32), ("counts", np.int32), ("sources", np.int64), ("starts", np.int32))


class Runs:
    """Positions of phrases: ``counts`` phrases in a row from ``places`` on stand in ``sources`` from ``starts`` on, one run for each entry of ``keys``."""

    def __init__(self, keys, places, counts, sources, starts) -> None:
        self.keys, self.places, self.counts, self.sources, self.starts = keys, places, counts, sources, starts

    def take(self, at) -> Runs:
        return Runs(*(getattr(self, name)[at] for name, _ in _PARTS))

    def packed(self) -> tuple[bytes, ...]:
        return tuple(getattr(self, name).astype(kind).tobytes() for name, kind in _PARTS)

    @classmethod
    def unpacked(cls, *parts: bytes) -> Runs:
        return cls(*(np.frombuffer(x, kind) for x, (_, kind) in zip(parts, _PARTS, strict=True)))

    def joined(self) -> Runs:
        """Runs that go on where the last one ended become one; in order of key and place."""
        order = np.lexsort((self.places, self.keys))
        own = self.take(order)
        if not len(order):
            return own
        ends, stops = own.places[:-1] + own.counts[:-1], own.starts[:-1] + own.counts[:-1]
        goes_on = (own.keys[1:] == own.keys[:-1]) & (own.places[1:] == ends) & (own.sources[1:] == own.sources[:-1]) & (own.starts[1:] == stops)
        first = np.flatnonzero(np.concatenate(([True], ~goes_on)))
        out = own.take(first)
        out.counts = np.add.reduceat(own.counts, first)
        return out


def positions(hashes: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrases that a smaller document holds, in order; the smallest that does; where it stands there first).

    Entries of one document stand in order of place.
    """
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    begins = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    del ordered
    holder, counts = doc[order], np.diff(np.append(begins, len(order)))
    least = np.minimum.reduceat(holder, begins)
    group = np.repeat(np.arange(len(begins), dtype=np.int32), counts)
    late = np.flatnonzero(holder > least[group])
    own = np.flatnonzero(holder == least[group])
    first = own[np.flatnonzero(np.diff(group[own], prepend=-1))]
    held, which = order[late], group[late]
    back = np.argsort(held)
    return held[back], least[which][back], place[order[first]][which][back]


def packed_numbers(values: np.ndarray) -> bytes:
    """Numbers from 0 on, a byte each where they are below 255: 255 stands for itself and what follows."""
    more = values // 255
    out = np.full(int(more.sum()) + len(values), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = values % 255
    return out.tobytes()


def unpacked_numbers(data: bytes) -> np.ndarray:
    each = np.frombuffer(data, np.uint8)
    sums = np.cumsum(each, dtype=np.int64)[each < 255]
    return np.diff(sums, prepend=0)


def packed_ids(ids: np.ndarray) -> bytes:
    """Ids as the smallest of them and the distances from it, in 4 bytes where those fit."""
    base = int(ids.min())
    off = ids.astype(np.uint64) - np.uint64(base % (1 << 64))
    return np.int64(base).tobytes() + (off.astype(np.uint32) if int(off.max()) < 1 << 32 else off).tobytes()


def unpacked_ids(data: bytes, n: int) -> np.ndarray:
    off = np.frombuffer(data, np.uint32 if len(data) == 8 + 4 * n else np.uint64, offset=8).astype(np.uint64)
    return (off + np.frombuffer(data, np.uint64, 1)).view(np.int64)


_SENT = pa.schema([("block", pa.int32()), ("docs", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary()), ("steps", pa.binary()), ("phrases", pa.binary()), *((f"run_{name}", pa.binary()) for name, _ in _PARTS)])
_MAIL = pa.schema([("mailbox", pa.int32()), *((name, pa.binary()) for name, _ in _PARTS)])
_MAIL_SQL = "mailbox int, keys binary, places binary, counts binary, sources binary, starts binary"
_SENT_SQL = "block int, docs binary, keys binary, counts binary, steps binary, phrases binary, " + ", ".join(f"run_{name} binary" for name, _ in _PARTS)
_FOUND = pa.schema([("row_key", pa.int64()), ("runs", pa.struct([(name, pa.binary()) for name, _ in _PARTS]))])
_FOUND_SQL = "row_key long, runs struct<keys: binary, places: binary, counts: binary, sources: binary, starts: binary>"


def _mail(runs: Runs, mailboxes: int) -> Iterator[tuple]:
    """The runs, packed by the mailbox of their key."""
    box = (kernel.mix(runs.keys.astype(np.uint64)) % np.uint64(mailboxes)).astype(np.int32)
    order = np.argsort(box, kind="stable")
    edges = np.append(np.flatnonzero(np.diff(box[order], prepend=-1)), len(order))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(box[order[a]]), *runs.take(order[a:b]).packed()


def _send(window: int, blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column("row_key").to_numpy(), batch.column("doc_id").fill_null(NO_ID).to_numpy()
            for at, texts in kernel.chunks(batch):
                words = kernel.words_of(texts, kernel.PLAIN_WORD, lower=False)
                start, text = words.window_starts(window)
                if not len(start):
                    continue
                hashes, place = words.windows(window)[start], (start - words.first[text]).astype(np.int32)
                text = text + at
                held, source, begin = positions(hashes, ids[text], place)
                near = Runs(keys[text[held]], place[held], np.ones(len(held), np.int32), source, begin).joined()
                rows = [(-1 - box, *[None] * 5, *packed) for box, *packed in _mail(near, blocks)]
                kept = np.delete(np.arange(len(hashes)), held)
                block = bucket_of(hashes[kept], blocks)
                order = np.argsort(block, kind="stable")
                kept, block = kept[order], block[order]
                edges = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block))
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    rows.append((int(block[a]), *_packed_phrases(kept[a:b], hashes, text, place, ids, keys), *[None] * 5))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT)

    return send


def _packed_phrases(at: np.ndarray, hashes, text, place, ids, keys) -> tuple[bytes, ...]:
    """(documents, their row keys where those differ, phrases of each, steps from place to place, hashes) of some phrases of a chunk."""
    own, where = text[at], place[at]
    begins = np.flatnonzero(np.diff(own, prepend=-1))
    counts = np.diff(np.append(begins, len(own)))
    steps = np.diff(where, prepend=0)
    steps[begins] = where[begins]
    docs, names = ids[own[begins]], keys[own[begins]]
    return packed_ids(docs), b"" if (docs == names).all() else packed_ids(names), packed_numbers(counts), packed_numbers(steps), hashes[at].tobytes()


def _answer(blocks: int) -> Callable[[pa.Table], pa.Table]:
    def answer(table: pa.Table) -> pa.Table:
        """One block: the reference position of each of its phrases that a smaller document holds. Positions found on the spot pass."""
        block = table.column("block")[0].as_py()
        if block < 0:
            return pa.table([pa.array([-1 - block] * table.num_rows, pa.int32()), *(table.column(f"run_{name}") for name, _ in _PARTS)], schema=_MAIL)
        docs, keys, counts, places = [], [], [], []
        for d, k, n, s in zip(*(table.column(c).to_pylist() for c in ("docs", "keys", "counts", "steps")), strict=True):
            counts.append(own := unpacked_numbers(n))
            docs.append(unpacked_ids(d, len(own)))
            keys.append(unpacked_ids(k, len(own)) if k else docs[-1])
            steps = unpacked_numbers(s)
            sums = np.cumsum(steps)
            begins = np.cumsum(own) - own
            places.append((sums - np.repeat(sums[begins] - steps[begins], own)).astype(np.int32))
        ids, rank = np.unique(np.concatenate(docs), return_inverse=True)
        n, place = np.concatenate(counts), np.concatenate(places)
        del docs, counts, places
        hashes = np.frombuffer(b"".join(table.column("phrases").to_pylist()), np.uint64)
        held, source, start = positions(hashes, np.repeat(rank.astype(np.int32), n), place)
        key = np.concatenate(keys)[np.searchsorted(np.cumsum(n), held, "right")]
        rows = list(_mail(Runs(key, place[held], np.ones(len(key), np.int32), ids[source], start), blocks))
        return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_MAIL)], schema=_MAIL)

    return answer


def _deliver(table: pa.Table) -> pa.Table:
    """One mailbox: the runs of each of its documents, joined to factors."""
    runs = Runs.unpacked(*(b"".join(table.column(name).to_pylist()) for name, _ in _PARTS)).joined()
    edges = np.append(np.flatnonzero(np.concatenate(([True], runs.keys[1:] != runs.keys[:-1]))), len(runs.keys)) if len(runs.keys) else np.zeros(1, np.int64)
    spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    own = [dict(zip((name for name, _ in _PARTS), runs.take(slice(a, b)).packed(), strict=True)) for a, b in spans]
    return pa.table([pa.array(runs.keys[edges[:-1]], pa.int64()), pa.array(own, _FOUND.field("runs").type)], schema=_FOUND)


_FACTOR = pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("source", pa.int64()), ("source_word", pa.int64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("factors", pa.list_(_FACTOR)), ("kept", pa.string())])
_SQL = "doc_id long, n_words long, n_removed long, n_spans long, factors array<struct<first_word: long, n_words: long, source: long, source_word: long>>, kept string"


def _cut(window: int, digest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column("doc_id"), batch.column("runs")
            for at, texts in kernel.chunks(batch):
                columns: list[list] = [[] for _ in list(_SCHEMA)[1:]]
                for i, raw in enumerate(texts):
                    words, runs, factors = raw.split(), [], []
                    n = len(words)
                    if found[at + i].is_valid:
                        own = Runs.unpacked(*found[at + i].as_py().values())
                        factors = [{"first_word": p, "n_words": c + window - 1, "source": s, "source_word": b} for p, c, s, b in zip(*(x.tolist() for x in (own.places, own.counts, own.sources, own.starts)), strict=True)]
                        runs = covered_by(own, window, n)
                        words = [w for a, b in zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), n], strict=True) for w in words[a:b]]
                    left = b" ".join(words)
                    for column, value in zip(columns, (n, sum(b - a for a, b in runs), len(runs), factors, hashlib.sha256(left).hexdigest() if digest else left), strict=True):
                        column.append(value)
                if not digest:
                    columns[-1] = pa.array(columns[-1], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(texts)), *(pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip(columns, list(_SCHEMA)[1:], strict=True))], schema=_SCHEMA)

    return cut


def covered_by(factors: Runs, window: int, n: int) -> list[tuple[int, int]]:
    """The runs of words that factors cover, of a text of n words."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, factors.places, 1)
    np.subtract.at(step, factors.places + factors.counts + window - 1, 1)
    return list(zip(*(x.tolist() for x in kernel.segments(np.cumsum(step[:-1]) > 0)), strict=True))


def duplicate_factors(documents: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """Per document: its words, how many go and in how many spans, its factors with their reference positions, and the words left.

    A factor of n_words from first_word on stands in the document ``source`` from
    source_word on. kept holds the words left, joined by one space; with ``digest``,
    their SHA-256.
    """
    spark = documents.sparkSession
    ship(spark)
    docs = row_keyed(documents)
    blocks = buckets_for(spark, text_bytes(docs), BLOCK_BYTES)
    sent = docs.mapInArrow(_send(window, blocks), _SENT_SQL)
    # one pass over the texts: positions found on the spot ride along in blocks below zero
    found = sent.groupBy("block").applyInArrow(_answer(blocks), _MAIL_SQL).groupBy("mailbox").applyInArrow(_deliver, _FOUND_SQL)
    return docs.join(found, "row_key", "left").select("doc_id", "text", "runs").mapInArrow(_cut(window, digest), _SQL)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = duplicate_factors(documents, WINDOW, digest=True)
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"), "n_spans")
