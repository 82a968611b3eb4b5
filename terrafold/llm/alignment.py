"""Alignment of two tokenizers by bitsets of token ends.

The texts of a chunk lie behind each other as bytes; one packed bitset marks where tokens
of A end, another those of B. Their AND holds the shared cuts, and the popcount before a cut
(its rank) says how many tokens of either side end by then, which gives the token ranges of
a group. Their OR holds the ends of the links: tokens of one side follow each other without
a gap, so two tokens overlap in one stretch of bytes, which ends where either of them does;
rank in both bitsets names the two tokens. Links are made from the bitsets only, in one pass.

Counts of id pairs over the corpus: a chunk knows its distinct pairs. They are dealt to
buckets by hash, at most MOST_BUCKETS of them: the number of possible pairs is fixed by the
vocabularies, so a bucket's sums have a largest size, whatever the corpus. A first pass sums
the parts of a bucket as they stream by; the second sends the sums ahead of the same parts
and answers each part; the answers meet the documents of their chunk. A frequent pair costs
one entry for each chunk. Only the highest count of each B id, one number for each id of the
vocabulary, reaches the driver and is broadcast.

Both encoders cut texts where no token can lie across (see ``bpe``); for B that is before a
space that follows another character, which is checked against the vocabulary when it opens.

Cases: texts that are null or empty, or whose tokens do not spell space + text in A or in B,
such as those with U+2581, have no tokens, counts of zero and an empty digest; strings of
special tokens are plain text; rows that repeat each get their result; an empty table gives
an empty result; texts of any length are read whole; extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm import kernel
from terrafold.llm.bpe import ForcedBoundaryBpe
from terrafold.llm.rows import buckets_for, text_bytes, texts_of
from terrafold.llm.tokenizers_public import Bounded, tokenizer_path
from terrafold.runtime import materialise, ship, shuffle_partitions

#: Bytes of text that are aligned at once.
CHUNK_BYTES = 3_000_000
#: Bytes of text for each bucket of pairs, and buckets at most.
BUCKET_BYTES = 64 << 20
MOST_BUCKETS = 4096
#: Bytes of words and their ids that a worker keeps for B.
CACHED_BYTES = 64 << 20
#: An id of A takes so many bits of a pair's key, an id of B the bits above.
A_BITS = 16


class Bits:
    """A packed bitset with rank and select."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @classmethod
    def at(cls, places: np.ndarray, size: int) -> Bits:
        flags = np.zeros(-(-size // 64) * 64, bool)
        flags[places] = True
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.words | other.words)

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        word, low = places >> 6, (places & 63).astype(np.uint64)
        full = np.append(self.words, np.uint64(0))[word]
        return self.before[word] + np.bitwise_count(full & ((np.uint64(1) << low) - np.uint64(1)))

    def select(self) -> np.ndarray:
        """The places of all set bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class PlainBpe(ForcedBoundaryBpe):
    """Byte-level ids in which the strings of special tokens are plain text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.lengths = np.fromiter(map(len, self.token_bytes), np.int64, len(self.token_bytes))

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4") for x in self.encode(texts)]


class PieceBpe:
    """Ids of a sentencepiece model, from words that are encoded once each."""

    _SPACE = "▁"
    _WORD = re.compile(" +[^ ]*")

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.token_bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(self._SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.lengths = np.fromiter(map(len, self.token_bytes), np.int64, len(pieces))
        self.by_word = not any(re.search(f"[^{self._SPACE}]{self._SPACE}", p) for p in pieces)
        self.cache = Bounded(CACHED_BYTES)
        self.bad: set[str] = set()
        """Words whose pieces do not spell them; pieces never take more bytes than their word, so a text with one is not spelt either."""
        self.space = np.array([self.model.piece_to_id(self._SPACE)], "<u4").tobytes()

    def ids(self, texts: list[bytes]) -> list[np.ndarray | None]:
        """For space + text, which is what the model makes of a text; none where the pieces do not spell it."""
        split = [self._WORD.findall(x.decode()) if self.by_word else [x.decode()] for x in texts]
        known = self.cache
        new = {w for own in split for w in own if w not in known}
        known.room(new, 4)
        if not known:
            new, self.bad = {w for own in split for w in own}, set()
        order = list(new)
        for a in range(0, len(order), 4096):
            part = order[a : a + 4096]
            for w, ids in zip(part, self.model.encode([w[1:] for w in part], num_threads=1), strict=True):
                known[w] = np.array(ids, "<u4").tobytes() if len(w) > 1 else self.space
                if len(w) > 1 and b"".join(map(self.token_bytes.__getitem__, ids)) != w.encode():
                    self.bad.add(w)
        return [np.frombuffer(b"".join(map(known.__getitem__, own)), "<u4") if not self.bad or self.bad.isdisjoint(own) else None for own in split]


@dataclass
class Aligned:
    """Texts of a chunk: token counts, shared groups and links of each."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    links: np.ndarray
    """Key of the pair of each link, in the order of the texts."""
    n_links: np.ndarray
    digests: list[str]


def align(a: list[np.ndarray], b: list[np.ndarray], a_lengths: np.ndarray, b_lengths: np.ndarray, names: tuple[np.ndarray, np.ndarray]) -> Aligned:
    """Ids of the same bytes by two tokenizers, text by text; see ``names_of`` for the names."""
    n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    ids_a, ids_b = np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)
    # A bit stands on the last byte of its token.
    ends_a, ends_b = np.cumsum(a_lengths[ids_a]) - 1, np.cumsum(b_lengths[ids_b]) - 1
    size = int(ends_a[-1]) + 1
    bits_a, bits_b = Bits.at(ends_a, size), Bits.at(ends_b, size)

    cut = (bits_a & bits_b).select()
    last_a, last_b = bits_a.rank(cut + 1), bits_b.rank(cut + 1)
    texts_a, texts_b = np.cumsum(n_a), np.cumsum(n_b)
    group_of_text = np.searchsorted(last_a, texts_a) + 1
    n_groups = np.diff(group_of_text, prepend=0)

    end = (bits_a | bits_b).select()
    link_a, link_b = bits_a.rank(end), bits_b.rank(end)
    links = ids_b[link_b] << A_BITS | ids_a[link_a]
    n_links = np.diff(np.searchsorted(link_a, texts_a), prepend=0)

    # a1,a2|b1;a3|b2,b3: after the tokens of A of a group those of B, each with the sign that follows it.
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    in_a, in_b = (np.repeat(np.arange(len(cut)), np.diff(x, prepend=0)) for x in (last_a, last_b))
    first_b = np.concatenate(([0], last_b))
    v_a, v_b = len(a_lengths), len(b_lengths)
    closes_a, closes_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
    closes_a[last_a - 1] = closes_b[last_b - 1] = True
    order[np.arange(len(ids_a)) + first_b[in_a]] = ids_a + v_a * closes_a
    order[np.arange(len(ids_b)) + last_a[in_b]] = 2 * v_a + ids_b + v_b * closes_b
    table, widths = names
    named = table[order]
    spelled = named[named != 0].tobytes()
    at = np.concatenate(([0], np.cumsum(widths[order])))[np.concatenate(([0], texts_a + texts_b))].tolist()
    digests = [hashlib.sha256(spelled[x : y - 1]).hexdigest() for x, y in zip(at[:-1], at[1:], strict=True)]
    return Aligned(n_a, n_b, n_groups, links, n_links, digests)


def names_of(v_a: int, v_b: int) -> tuple[np.ndarray, np.ndarray]:
    """(id with the sign after it, its length): ids of A before "," and before "|", ids of B before "," and before ";"."""
    all_ids = [f"{i}{sign}".encode() for n, signs in ((v_a, ",|"), (v_b, ",;")) for sign in signs for i in range(n)]
    width = max(map(len, all_ids))
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in all_ids), np.uint8).reshape(-1, width), np.fromiter(map(len, all_ids), np.int64, len(all_ids))


@functools.cache
def open_pair(path_a: str, path_b: str) -> tuple[PlainBpe, PieceBpe, tuple[np.ndarray, np.ndarray]]:
    a, b = PlainBpe(path_a), PieceBpe(path_b)
    return a, b, names_of(len(a.lengths), len(b.lengths))


def _narrow(x: np.ndarray) -> bytes:
    """Non-negative numbers in as few bytes as the largest needs, with the width ahead."""
    most = int(x.max(initial=0))
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (kernel.mix(keys.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


#: Rows of one table: documents (bucket -1) and the distinct pairs of a chunk (bucket >= 0).
_FIELDS = [("chunk", pa.int64()), ("bucket", pa.int32()), ("doc_id", pa.int64())]
_FIELDS += [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
_FIELDS += [("groups_sha256", pa.string()), ("keys", pa.binary()), ("counts", pa.binary())]
_ALIGNED = pa.schema(_FIELDS)
_ALIGNED_SQL = "chunk long, bucket int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, counts binary"


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where equal neighbours begin, and the end."""
    new = np.ones(len(sorted_values) + 1, bool)
    new[1:-1] = sorted_values[1:] != sorted_values[:-1]
    return np.flatnonzero(new)


def _aligned_rows(chunk: int, doc_ids: list[int | None], texts: list[bytes], pair, buckets: int) -> pa.RecordBatch:
    tok_a, tok_b, names = pair
    n = len(texts)
    full = [b" " + x for x in texts]
    some = [i for i, x in enumerate(texts) if x]
    ids_a, ids_b = tok_a.ids([full[i] for i in some]), tok_b.ids([full[i] for i in some])
    spelt = lambda ids: b"".join(map(tok_a.token_bytes.__getitem__, ids.tolist()))
    good = [k for k, i in enumerate(some) if ids_b[k] is not None and spelt(ids_a[k]) == full[i]]
    columns = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    digests, doc_keys, doc_counts = [""] * n, [b""] * n, [b""] * n
    rows: list[tuple] = []
    if good:
        place = np.array([some[k] for k in good])
        got = align([ids_a[k] for k in good], [ids_b[k] for k in good], tok_a.lengths, tok_b.lengths, names)
        for c in columns:
            columns[c][place] = getattr(got, c)
        # The chunk's pairs, bucket by bucket, and each document's pairs as steps between their indices.
        pairs, index, counts = np.unique(got.links, return_inverse=True, return_counts=True)
        bucket = _bucket_of(pairs, buckets)
        order = np.argsort(bucket.astype(np.uint16), kind="stable")
        at = np.empty(len(pairs), np.int64)
        at[order] = np.arange(len(pairs))
        edges = _runs(bucket[order])
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = order[x:y]
            rows.append((int(bucket[own[0]]), pairs[own].astype("<u4").tobytes(), _narrow(counts[own])))
        text = np.repeat(np.arange(len(good)), got.n_links)
        both = np.sort(text * len(pairs) + at[index])
        run = _runs(both)
        value, times = both[run[:-1]], np.diff(run)
        of_text = np.searchsorted(value, np.arange(len(good) + 1) * len(pairs))
        for k, i in enumerate(place.tolist()):
            x, y = of_text[k], of_text[k + 1]
            digests[i] = got.digests[k]
            doc_keys[i], doc_counts[i] = _narrow(np.diff(value[x:y] - k * len(pairs), prepend=0)), _narrow(times[x:y])
    m = len(rows)
    values = {
        "chunk": [chunk] * (n + m),
        "bucket": [-1] * n + [r[0] for r in rows],
        "doc_id": doc_ids + [None] * m,
        **{c: v.tolist() + [None] * m for c, v in columns.items()},
        "groups_sha256": digests + [None] * m,
        "keys": doc_keys + [r[1] for r in rows],
        "counts": doc_counts + [r[2] for r in rows],
    }
    return pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) for f in _ALIGNED], schema=_ALIGNED)


def _align(path_a: str, path_b: str, buckets: int, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = open_pair(path_a, path_b)
        chunk = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            for at, part in kernel.chunks(batch):
                ids += batch.column("doc_id").slice(at, len(part)).to_pylist()
                texts += part
                size += sum(map(len, part))
                if size >= chunk_bytes:
                    yield _aligned_rows(chunk, ids, texts, pair, buckets)
                    chunk, ids, texts, size = chunk + 1, [], [], 0
        if ids:
            yield _aligned_rows(chunk, ids, texts, pair, buckets)

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts in the order of their buckets -> (bucket, keys, counts) of each bucket."""
    own, held, size = None, [], 0
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def settle() -> None:
        nonlocal keys, counts, held, size
        both = np.concatenate([keys, *(k for k, _ in held)])
        n = np.concatenate([counts, *(c for _, c in held)])
        keys, inverse = np.unique(both, return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, inverse, n)
        held, size = [], 0

    def done() -> Iterator[pa.RecordBatch]:
        nonlocal keys, counts
        if own is not None:
            settle()
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([keys.astype("<u4").tobytes()], pa.binary()), pa.array([_narrow(counts)], pa.binary())], ["bucket", "keys", "counts"])
            keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    for batch in batches:
        for bucket, k, c in zip(*(batch.column(x).to_pylist() for x in ("bucket", "keys", "counts")), strict=True):
            if bucket != own:
                yield from done()
                own = bucket
            held.append((np.frombuffer(k, "<u4").astype(np.int64), _wide(c)))
            size += len(held[-1][0])
            if size > max(1 << 19, len(keys)):
                settle()
    yield from done()


_ANSWER_SQL = "chunk long, bucket int, keys binary, counts binary"
_ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket its sums (no chunk), then its parts -> the parts with the sums of their keys."""
    keys = counts = np.zeros(0, np.int64)
    for batch in batches:
        out: list[tuple] = []
        for chunk, bucket, k, c in zip(*(batch.column(x).to_pylist() for x in _ANSWER.names), strict=True):
            if chunk is None:
                keys, counts = np.frombuffer(k, "<u4"), _wide(c)
            else:
                out.append((chunk, bucket, k, _narrow(counts[np.searchsorted(keys, np.frombuffer(k, "<u4"))])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _ANSWER, strict=True)], schema=_ANSWER)


def _highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, keys, counts) -> (B id, highest count of its pairs), once for each id of a task."""
    best = np.zeros(1 << (32 - A_BITS), np.int64)
    for batch in batches:
        for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            np.maximum.at(best, np.frombuffer(k, "<u4") >> A_BITS, _wide(c))
    some = np.flatnonzero(best)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(best[some])], ["b", "n"])


_RESULT_SQL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_RESULT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each chunk its answers in the order of their buckets, then its documents."""
        best, own, held, known = shared.value, None, [], None
        for batch in batches:
            n_best, count_sum, rows = [], [], []
            of = [batch.column(x).to_pylist() for x in ("chunk", "late", "keys", "counts")]
            for i, (chunk, late, k, c) in enumerate(zip(*of, strict=True)):
                if chunk != own:
                    own, held, known = chunk, [], None
                if not late:
                    held.append((k, c))
                    continue
                if known is None:
                    counts = np.concatenate([_wide(y) for _, y in held]) if held else np.zeros(0, np.int64)
                    b = np.concatenate([np.frombuffer(x, "<u4") for x, _ in held]) >> A_BITS if held else np.zeros(0, np.uint32)
                    known, held = (counts, counts == best[b]), []
                at, times = (np.cumsum(_wide(k)), _wide(c)) if k else (np.zeros(0, np.int64),) * 2
                rows.append(i)
                count_sum.append(int((known[0][at] * times).sum()))
                n_best.append(int(times[known[1][at]].sum()))
            if rows:
                own_rows = batch.take(pa.array(rows))
                new = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
                yield pa.RecordBatch.from_arrays([new.get(f.name, None) or own_rows.column(f.name) for f in _RESULT], schema=_RESULT)

    return run


def alignments(documents: DataFrame, path_a: str | None = None, path_b: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document: tokens, shared groups and links of both tokenizers, and how common its links are in the corpus."""
    spark = documents.sparkSession
    ship(spark)
    path_a, path_b = path_a or tokenizer_path("byte_bpe_50k.json"), path_b or tokenizer_path("piece_bpe_32k.model")
    docs = texts_of(documents)
    buckets = min(MOST_BUCKETS, buckets_for(spark, text_bytes(docs), BUCKET_BYTES))
    tasks = min(buckets, shuffle_partitions(spark))
    aligned = materialise(docs.mapInArrow(_align(path_a, path_b, buckets, chunk_bytes), _ALIGNED_SQL), "aligned")
    parts = aligned.where("bucket >= 0")
    dealt = parts.select("bucket", "keys", "counts").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    sums = materialise(dealt.mapInArrow(_add_up, "bucket int, keys binary, counts binary"), "pair_counts")
    best = np.zeros(1 << (32 - A_BITS), np.int64)
    for r in sums.mapInArrow(_highest, "b int, n long").groupBy("b").agg(F.max("n").alias("n")).collect():
        best[r.b] = r.n
    asked = sums.select(F.lit(None).cast("long").alias("chunk"), "bucket", "keys", "counts").unionByName(parts.select("chunk", "bucket", "keys", F.lit(None).cast("binary").alias("counts")))
    answers = asked.repartition(tasks, "bucket").sortWithinPartitions("bucket", F.col("chunk").asc_nulls_first()).mapInArrow(_answer, _ANSWER_SQL)
    columns = [f for f in _ALIGNED.names if f not in answers.columns]
    early = answers.select("chunk", "bucket", "keys", "counts", F.lit(False).alias("late"), *(F.lit(None).cast(aligned.schema[c].dataType).alias(c) for c in columns))
    both = early.unionByName(aligned.where("bucket < 0").withColumn("late", F.lit(True)))
    met = both.repartition(shuffle_partitions(spark), "chunk").sortWithinPartitions("chunk", "late", "bucket")
    return met.mapInArrow(_score(spark.sparkContext.broadcast(best)), _RESULT_SQL)


def op13_bitset_alignment(spark, sf_dir: str) -> DataFrame:
    return alignments(spark.read.parquet(f"{sf_dir}/documents.parquet"))
