"""Duplicate byte strings by merging Burrows-Wheeler transforms.

A transform of the whole corpus fits no task, so the text is first cut so that
equal strings meet. Each string of ``width`` bytes is found by its anchor: of
its GRAM-byte pieces the one with the least hash, leftmost of equals. Strings in
a row with the same anchor make a fragment; equal strings have equal anchors, so
it is enough to compare fragments of one anchor. ``phrase_index`` settles the
fragments that a smaller document holds as they are, and those whose anchor has
no other fragment. What is left, the distinct fragments that contest an anchor,
as at the edges of copied passages, goes to a bucket of its anchor. An anchor
that more than CROWD of them contest, as where a passage stands in a third of all
documents, would make a bucket that grows with the corpus. Its fragments are cut
into their single strings, which are dealt by their own hash instead; of equal
ones only the smallest document of a chunk sends its own.

There the fragments of a few senders are a shard. Its suffixes are sorted to
SHARD_DEPTH bytes, which gives its transform, of bounded context. The shards are
merged by refining their interleave alone: it begins as one shard after the other, all
in one group, and each stable pass over the symbols before the rows of the last
interleave, and the step from each row to that of the longer suffix, order them by
one or two bytes more, and groups split where those bytes differ. A row alone in its
group, or of a suffix too short, leaves: every longer suffix would be alone or too
short as well. How often a group has been split when two rows part is their common
prefix; after ``width`` bytes the groups are the intervals of suffixes with a common
prefix of that length. Suffixes are never compared nor sorted across shards. In each
interval the smallest document keeps its string, the others lose it.

Cases: null is the empty text; strings never cross documents; documents that
share an id never remove from each other; a document without an id comes after
all others; texts of any length are read whole, in chunks that hold one text at
least; an empty table gives an empty result; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm import kernel
from terrafold.llm.phrase_index import CHUNK_BYTES, FOUND_SQL, LOCAL, MAIL_SQL, Answers, Narrow, Owners, answers, as_batch, bucket_of, deliver, gathered, held_before, mail, mailed, passed_on, runs_of, unpacked_owners, whole, widened
from terrafold.llm.rows import buckets_for, row_keyed, text_bytes
from terrafold.runtime import ship

WIDTH = 50
GRAM = 24
#: Symbols to which a shard's transform is sorted before it is merged.
SHARD_DEPTH = 7
#: Buckets of contested fragments for each bucket of the phrase index: a merge holds its bucket's suffixes at once.
FINER = 4
#: Fragments that contest one anchor and still go to one bucket: CROWD times 76 bytes at most, for texts that are no runs.
CROWD = 1 << 14
#: Bytes of text for which there is a bucket of the phrase index, which gets about as many bytes of hashes.
BUCKET_BYTES = 16 << 20
#: Bytes of contested fragments that are sent together.
SEND_BYTES = 4 << 20
#: Bytes of fragments that make one shard of a bucket, with the last sender's.
SHARD_BYTES = 1 << 17
#: Places whose anchors are sought at a time, so that their hashes stay in the processor's cache.
PIECE = 1 << 14

_U = np.uint64


# ---- fragments


class Fragments:
    """The fragments of some texts, in order: strings start at first..last (both included) of ``data``."""

    def __init__(self, texts: list[bytes], width: int, gram: int) -> None:
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.begin = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
        n = len(self.data)
        if n < width:
            empty = np.zeros(0, np.int64)
            self.first, self.last, self.text, self.place, self.hash, self.prefix = empty, empty, empty, *(empty.astype(_U) for _ in range(3))
            return
        prefix = self.prefix = kernel.prefix_hash(self.data)
        anchor = _anchors(prefix, width, gram)
        begins = self.begin[:-1]
        ends = begins + np.maximum(np.diff(self.begin) - (width - 1), 0)
        edge = np.concatenate(([True], anchor[1:] != anchor[:-1]))
        stop = np.minimum(ends, len(edge))
        edge[kernel.ramps(stop, np.minimum(self.begin[1:], len(edge)) - stop)] = False  # no string begins in a text's last bytes
        some = ends > begins
        edge[begins[some]] = True
        self.first = np.flatnonzero(edge)
        self.text = np.searchsorted(self.begin, self.first, "right") - 1
        self.last = np.append(self.first[1:] - 1, 0)[: len(self.first)]
        final = np.flatnonzero(np.diff(self.text, append=-1))
        self.last[final] = ends[self.text[final]] - 1
        at = anchor[self.first].astype(np.int64)
        self.place = kernel.slice_hash(prefix, at, at + gram)
        self.hash = kernel.mix(kernel.slice_hash(prefix, self.first, self.last + width) ^ (self.place * _U(kernel._STEP)))


def _anchors(prefix: np.ndarray, width: int, gram: int) -> np.ndarray:
    """Where the anchor of the string at each place begins, text ends or not."""
    n, span = len(prefix) - width, width - gram + 1
    inverse, place = kernel.tables(len(prefix))[1], np.arange(PIECE + span, dtype=_U)
    out = np.empty(n, np.int32)
    for a in range(0, n, PIECE):
        b = min(a + PIECE, n)
        m = b - a + span - 1
        grams = prefix[a + gram : a + gram + m] - prefix[a : a + m]
        grams *= inverse[a : a + m]
        grams *= _U(0xFF51AFD7ED558CCD)
        grams &= _U(0xFFFFFFFF00000000)
        grams |= place[:m]
        reach = 1
        while 2 * reach <= span:
            grams = np.minimum(grams[:-reach], grams[reach:])
            reach *= 2
        if span > reach:
            grams = np.minimum(grams[: -(span - reach)], grams[span - reach :])
        out[a:b] = (grams & _U(0xFFFFFFFF)).astype(np.int32) + a
    return out


def _phrases(width: int, gram: int):
    def phrases(texts: list[bytes]):
        found = Fragments(texts, width, gram)
        return found.hash, found.text, found.place

    return phrases


# ---- transforms


def shard_transform(symbols: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, transform, longer) of strings symbols[begin[i]:begin[i + 1]], each of which ends with 0 and has none before.

    order: the places of the suffixes, sorted to SHARD_DEPTH symbols, those past a
    string's end included. transform: the symbol before each; 0 where a string begins.
    longer: the row of the suffix that begins there.
    """
    n = len(symbols)
    padded = np.concatenate((symbols.astype(np.int64), np.zeros(SHARD_DEPTH - 1, np.int64)))
    key = padded[:n].copy()
    for j in range(1, SHARD_DEPTH):
        key <<= 9
        key |= padded[j : j + n]
    order = np.argsort(key).astype(np.int32)
    row = np.empty(n, np.int32)
    row[order] = np.arange(n, dtype=np.int32)
    before = np.concatenate((symbols[:1] * 0, symbols[:-1]))
    before[begin[:-1]] = 0
    return order, before[order], row[np.maximum(order - 1, 0)]


def _pass(rows: np.ndarray, group: np.ndarray, before: np.ndarray, step: np.ndarray, reach: np.ndarray | None, known: int) -> tuple[np.ndarray, np.ndarray]:
    """One refinement: the rows of the longer suffixes, ordered to ``known`` symbols, and their groups; of groups of two or more, and of suffixes that ``reach`` so far."""
    own = before[rows]
    order = np.argsort(own, kind="stable")
    own = own[order]
    none = np.searchsorted(own, 1)  # where a string begins, nothing stands before
    order, own = order[none:], own[none:]
    if not len(order):
        return rows[:0], group[:0]
    group = group[order]
    edge = np.concatenate(([True], (own[1:] != own[:-1]) | (group[1:] != group[:-1]), [True]))
    keep = np.flatnonzero(~(edge[:-1] & edge[1:]))
    rows, group = step[rows[order[keep]]], np.cumsum(edge[:-1], dtype=np.int32)[keep]
    if reach is None:
        return rows, group
    long_enough = reach[rows] >= known
    return rows[long_enough], group[long_enough]


def merge_transforms(transforms: list[np.ndarray], longer: list[np.ndarray], left: list[np.ndarray] | None, depth: int, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, group): the merged rows of the suffixes whose first ``depth`` symbols occur again, and the interval that each is in.

    Rows count through all shards. left: how many symbols each suffix has. rows:
    instead of it, those of the suffixes that have ``depth`` symbols before them in
    their string, from which alone the passes come to suffixes of that length.
    """
    base = np.cumsum([0, *map(len, transforms)]).astype(np.int32)
    symbols, reach = np.concatenate(transforms), None if left is None else np.concatenate(left)
    step = np.concatenate([x + b for x, b in zip(longer, base, strict=False)])
    # the first interleave: shard after shard, nothing known of any suffix
    rows = np.arange(len(symbols), dtype=np.int32) if rows is None else rows
    group, known = np.zeros(len(rows), np.int32), 0
    if depth % 2 and len(rows):
        known = 1
        rows, group = _pass(rows, group, symbols, step, reach, known)
    if known < depth and len(rows):
        # two symbols a pass: both before a row as one code, in order, and the row two symbols longer
        pair = symbols[step].astype(np.int32) * 257 + symbols
        pair[(symbols == 0) | (symbols[step] == 0)] = 0
        used = np.bincount(pair, minlength=257 * 257) > 0
        used[0] = True
        code = (np.cumsum(used) - 1)[pair].astype(np.uint16 if used.sum() <= 1 << 16 else np.int32)
        step = step[step]
        while known < depth and len(rows):
            known += 2
            rows, group = _pass(rows, group, code, step, reach, known)
    return rows, group


def repeated(shards: list[tuple[np.ndarray, np.ndarray]], docs: list[np.ndarray], width: int) -> list[np.ndarray]:
    """For each shard (bytes, string begins): for each byte, whether a string of ``width`` bytes starts there that a smaller document has.

    docs: the document of each string of a shard.
    """
    transforms, longer, orders, enter, begins = [], [], [], [], []
    at = 0
    for data, begin in shards:
        lengths = np.diff(begin)
        closed = begin + np.arange(len(begin))
        symbols = np.zeros(closed[-1], np.uint16)
        inside = np.ones(len(symbols), bool)
        inside[closed[1:] - 1] = False
        symbols[inside] = data.astype(np.uint16) + 1
        order, transform, onward = shard_transform(symbols, closed)
        transforms.append(transform)
        longer.append(onward)
        behind = np.arange(len(symbols), dtype=np.int32) - np.repeat(closed[:-1].astype(np.int32), lengths + 1)
        enter.append((np.flatnonzero(behind[order] >= width) + at).astype(np.int32))
        orders.append(order + np.int32(at))
        begins.append(closed[:-1] + at)
        at += len(symbols)
    rows, group = merge_transforms(transforms, longer, None, width, np.concatenate(enter))
    out = np.zeros(at - sum(map(len, begins)), bool)
    if len(rows):
        place = np.concatenate(orders)[rows]
        string = np.searchsorted(np.concatenate(begins), place, "right") - 1
        doc = np.concatenate(docs)[string]
        first = np.flatnonzero(np.diff(group, prepend=-1))
        least = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(group))))
        out[place - string] = least < doc
    return np.split(out, np.cumsum([len(d) for d, _ in shards])[:-1])


# ---- contested fragments, dealt by anchor

_SENT = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary()), ("lengths", pa.binary()), ("data", pa.binary())])
_SENT_SQL = "bucket int, docs binary, keys binary, counts binary, lengths binary, data binary"
def _parts(found: Fragments, pick: np.ndarray, crowded: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, text, hash to deal by, whether single) of what is dealt of some fragments: they themselves, or the single strings of crowded ones."""
    count = np.where(crowded, found.last[pick] - found.first[pick] + 1, 1)
    own, single = np.repeat(pick, count), np.repeat(crowded, count)
    first = kernel.ramps(found.first[pick], count)
    key = found.place[own]
    key[single] = kernel.slice_hash(found.prefix, first[single], first[single] + width)
    return first, np.where(single, first, found.last[own]), found.text[own], key, single


def _send(width: int, gram: int, buckets: int):
    def found(held, batch, at, texts, keys, ids):
        heard = batch.column("answers").slice(at, len(texts))
        marked = np.flatnonzero(Answers(heard).any_contested())
        own = Fragments([texts[i] for i in marked.tolist()], width, gram)
        _, open_, crowded = Answers(heard.take(pa.array(marked))).read(own.hash, own.text, buckets, own.place)
        pick = np.flatnonzero(open_)
        if len(pick):
            first, last, text, key, single = _parts(own, pick, crowded[pick], width)
            lengths = last - first + width
            held.add(keys[marked], ids[marked], int(lengths.sum()), text, key, single, lengths, own.data[kernel.ramps(first, lengths)])

    def out(keys, ids, text, key, single, lengths, data):
        begins = np.cumsum(lengths) - lengths
        rows = []
        if single.any():
            # equal strings of what goes together are settled on the spot
            which = text[single]
            before = held_before(key[single], ids[which])
            edges = np.flatnonzero(np.diff(which, prepend=-1))
            rows += [(LOCAL - mailbox, None, k, n, None, bits) for mailbox, (k, n, bits) in mail(keys[which[edges]], np.diff(np.append(edges, len(which))), before, buckets)]
            single[single] = before
            begins, lengths, text, key = (x[~single] for x in (begins, lengths, text, key))
        bucket = bucket_of(key, FINER * buckets)
        order = np.argsort(bucket, kind="stable")
        begins, lengths, text, bucket = begins[order], lengths[order], text[order], bucket[order]
        data, ends = data[kernel.ramps(begins, lengths)], np.cumsum(lengths)
        owners, sizes, at = Owners(bucket, text, ids, keys), Narrow(lengths), np.concatenate(([0], ends)).tolist()
        for a, b in runs_of(bucket):
            rows.append((int(bucket[a]), *owners.packed(a, b), sizes.packed(a, b), data[at[a] : at[b]].tobytes()))
        return as_batch(rows, _SENT)

    return lambda batches: gathered(batches, found, out, SEND_BYTES)


def _merge(width: int, buckets: int):
    def merge(table: pa.Table) -> pa.Table:
        """One bucket: which strings of its fragments a smaller document holds."""
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:
            return passed_on(table, "data")
        docs, keys, counts = unpacked_owners(table)
        lengths = widened(table.column("lengths").to_pylist())[0]
        data, ends = whole(table, "data", np.uint8), np.cumsum(lengths)
        # shards of whole strings
        cuts = np.searchsorted(ends, np.arange(SHARD_BYTES, ends[-1] + SHARD_BYTES, SHARD_BYTES)) + 1
        cuts = np.unique(np.concatenate(([0], np.minimum(cuts, len(ends)))))
        doc, begin = np.repeat(docs, counts), np.concatenate(([0], ends))
        shards = [(data[begin[a] : begin[b]], begin[a : b + 1] - begin[a]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        flag = np.concatenate(repeated(shards, [doc[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], width))
        strings = lengths - width + 1
        firsts = np.cumsum(counts) - counts
        return mailed(bucket, keys, np.add.reduceat(strings, firsts), flag[kernel.ramps(begin[:-1], strings)], buckets)

    return merge


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", _SPANS), ("kept", pa.binary())])
_OUT_SQL = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"


def _cut(width: int, gram: int, buckets: int, digest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in kernel.chunks(batch, size_of=CHUNK_BYTES):
                heard, settled = (batch.column(name).slice(at, len(texts)) for name in ("answers", "settled"))
                data = np.frombuffer(b"".join(texts), np.uint8)
                begin = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
                marked = np.flatnonzero(Answers(heard).any_held() | settled.is_valid().to_numpy(zero_copy_only=False))
                gone = np.zeros(len(data), bool)
                if len(marked):
                    own = kernel.ramps(begin[marked], np.diff(begin)[marked])
                    gone[own] = _gone([texts[i] for i in marked.tolist()], heard.take(pa.array(marked)), settled.take(pa.array(marked)), width, gram, buckets)
                # a place that stays behind each text ends its last run
                closed = begin + np.arange(len(begin))
                inside = np.ones(closed[-1], bool)
                inside[closed[1:] - 1] = False
                laid = np.zeros(len(inside), bool)
                laid[inside] = gone
                starts, ends = kernel.segments(laid)
                text = np.searchsorted(closed, starts, "right") - 1
                runs = np.searchsorted(text, np.arange(len(begin))).astype(np.int32)
                left = data[~gone].tobytes()
                stay = np.concatenate(([0], np.cumsum(~gone)))[begin]
                kept = [left[a:b] for a, b in zip(stay[:-1].tolist(), stay[1:].tolist(), strict=True)]
                kept = [hashlib.sha256(x).hexdigest().encode() for x in kept] if digest else kept
                spans = pa.StructArray.from_arrays([pa.array(x - closed[text], pa.int64()) for x in (starts, ends)], ["start", "end"])
                n = np.diff(begin)
                columns = [pa.array(n, pa.int64()), pa.array(n - np.diff(stay), pa.int64()), pa.ListArray.from_arrays(pa.array(runs), spans), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), *columns], schema=_OUT)

    return cut


def _gone(texts: list[bytes], heard: pa.StructArray, settled: pa.StructArray, width: int, gram: int, buckets: int) -> np.ndarray:
    """Which bytes of some texts, one behind another, go."""
    found = Fragments(texts, width, gram)
    held, contested, crowded = Answers(heard).read(found.hash, found.text, buckets, found.place)
    # a bucket's bits tell of the strings of what it got, in order; those found on the spot tell of all single strings
    told = Answers(settled)
    which = np.flatnonzero(contested & (told.n > 0)[found.text])
    first, last, text, key, single = _parts(found, which, crowded[which], width)
    before = told.on_the_spot(np.bincount(text[single], minlength=len(texts)))
    alone = first[single][before]
    single[single] = before
    first, last, text, key = (x[~single] for x in (first, last, text, key))
    counts = last - first + 1
    items, flags = told.dealt(text, bucket_of(key, FINER * buckets), counts, 1, FINER * buckets)
    strings = np.concatenate((alone, kernel.ramps(first[items], counts[items])[flags[:, 0]]))
    starts, ends = (np.concatenate((x[held], strings)) for x in (found.first, found.last))
    n = len(found.data) + 1
    step = np.bincount(starts, minlength=n) - np.bincount(ends + width, minlength=n)
    return np.cumsum(step[:-1]) > 0


def repeated_bytes(documents: DataFrame, width: int = WIDTH, gram: int = GRAM, digest: bool = False, crowd: int = CROWD) -> DataFrame:
    """Per document: the byte spans that repeat smaller documents, and the bytes left.

    kept holds the bytes left; with ``digest``, the text of their SHA-256. crowd:
    fragments beyond which an anchor is dealt by single strings.
    """
    spark = documents.sparkSession
    ship(spark)
    # the filter keeps all rows; with it both joins below read one and the same shuffle of the texts
    docs = row_keyed(documents).where("row_key is not null")
    buckets = buckets_for(spark, text_bytes(docs), BUCKET_BYTES)
    heard = answers(docs, _phrases(width, gram), buckets, crowd)
    sent = docs.join(heard, "row_key").select("row_key", "doc_id", "text", "answers").mapInArrow(_send(width, gram, buckets), _SENT_SQL)
    settled = sent.groupBy("bucket").applyInArrow(_merge(width, buckets), MAIL_SQL).groupBy("mailbox").applyInArrow(deliver, FOUND_SQL)
    both = docs.join(heard, "row_key", "left").join(settled.withColumnRenamed("answers", "settled"), "row_key", "left")
    return both.select("doc_id", "text", "answers", "settled").mapInArrow(_cut(width, gram, buckets, digest), _OUT_SQL)


def op8_bwt_merge_dedup(spark, sf_dir: str) -> DataFrame:
    out = repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.col("kept").cast("string").alias("kept_sha256"))
