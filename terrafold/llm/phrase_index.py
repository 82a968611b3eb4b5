"""An exact index of hashed phrases, dealt over buckets of the hash.

A map step cuts each chunk of documents into phrases and sends every bucket its
phrases, packed; the bucket finds for each phrase the smallest document that
holds it and answers with one bit for each phrase sent. The bits stand in the
order of the phrases in their document, so that no position travels. Phrases
that a smaller document of those sent together holds are answered on the spot, which
leaves at most one document for each phrase to send: a phrase that a third of all
documents share costs one entry for each sending, not each document.

Chunks are sent together when they hold SEND_BYTES of text, so that a bucket's row
is many phrases however many buckets there are. What is done for each document and
bucket, whose pairs are soon as many as the phrases, is done on arrays of them.

Phrases can have a place besides their identity, such as the anchor that a
fragment of text is found by. They then meet by place, and a second bit says
that a phrase is contested: no smaller document holds it, but its place holds
other phrases. A place that holds more open phrases than a bound is crowded, which both
bits together say of its phrases that no smaller document holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terrafold.llm import kernel
from terrafold.llm.rows import NO_ID

#: texts -> (hash of each phrase, index of its text, hash of its place or None), texts in order
Phrases = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray | None]]

#: Bytes of text that are worked on at a time: arrays of eight bytes for each stay in the processor's cache.
CHUNK_BYTES = 1 << 18
#: Bytes of text whose phrases are sent together.
SEND_BYTES = 8 << 20

LOCAL = -1
_SENT = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary()), ("packed", pa.binary()), ("places", pa.binary())])
_SENT_SQL = "bucket int, docs binary, keys binary, counts binary, packed binary, places binary"
MAIL = pa.schema([("mailbox", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("packed", pa.binary())])
MAIL_SQL = "mailbox int, bucket int, keys binary, counts binary, packed binary"
_FOUND = pa.schema([("row_key", pa.int64()), ("answers", pa.struct([("buckets", pa.binary()), ("bits", pa.binary())]))])
FOUND_SQL = "row_key long, answers struct<buckets: binary, bits: binary>"


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


class Narrow:
    """Integers as the smallest of them and the distances from it, in as few bytes each as the largest needs; packed slice by slice."""

    def __init__(self, values: np.ndarray) -> None:
        base = int(values.min()) if len(values) else 0
        off = values.astype(np.uint64) - np.uint64(base % (1 << 64))
        most = int(off.max()) if len(off) else 0
        self.off = off.astype(next(kind for kind in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(kind).max))
        self.head = bytes([self.off.itemsize]) + np.int64(base).tobytes()

    def packed(self, a: int, b: int) -> bytes:
        return self.head + self.off[a:b].tobytes()


def widened(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(integers that ``Narrow`` packed, one slice behind another; how many each slice has)."""
    parts = [np.frombuffer(x, f"u{x[0]}", offset=9) for x in packed]
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    base = np.fromiter((int.from_bytes(x[1:9], "little") for x in packed), np.uint64, len(packed))
    return (np.concatenate([*parts, np.zeros(0, np.uint64)]).astype(np.uint64) + np.repeat(base, n)).view(np.int64), n


class Owners:
    """Of items in order of bucket and then text: documents and row keys of each run of a text, and how many items it has."""

    def __init__(self, bucket: np.ndarray, text: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        self.begins = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (bucket[1:] != bucket[:-1])))) if len(text) else np.zeros(0, np.int64)
        which = text[self.begins]
        docs, names = ids[which], keys[which]
        self.columns = Narrow(docs), None if (docs == names).all() else Narrow(names), Narrow(np.diff(np.append(self.begins, len(text))))

    def packed(self, a: int, b: int) -> tuple[bytes | None, ...]:
        """(documents, their row keys where those differ, items of each) of the items from a to b."""
        a, b = np.searchsorted(self.begins, (a, b)).tolist()
        return tuple(None if x is None else x.packed(a, b) for x in self.columns)


def unpacked_owners(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    docs, keys, counts = (table.column(c).to_pylist() for c in ("docs", "keys", "counts"))
    return widened(docs)[0], widened([k or d for d, k in zip(docs, keys, strict=True)])[0], widened(counts)[0]


def whole(table: pa.Table, name: str, kind: type) -> np.ndarray:
    """The arrays of a binary column, one behind another."""
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _runs(values: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)


def runs_of(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    edges = np.append(_runs(values), len(values)).tolist()
    return zip(edges[:-1], edges[1:], strict=True)


def _in_order(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the phrases in order of hash, where a hash begins in that order, whether a smaller document has the phrase in that order)."""
    order = np.argsort(hashes)
    starts = _runs(hashes[order])
    own = doc[order]
    least = np.minimum.reduceat(own, starts) if len(starts) else own
    return order, starts, np.repeat(least, np.diff(np.append(starts, len(order)))) < own


def held_before(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each phrase: whether a smaller document has it."""
    order, _, held = _in_order(hashes, doc)
    before = np.empty(len(order), bool)
    before[order] = held
    return before


def _settled(hashes: np.ndarray, doc: np.ndarray, place: np.ndarray, crowd: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each phrase: whether a smaller document has it; if none has, whether its place holds other phrases too, and then whether over ``crowd`` that are not held."""
    order, starts, held = _in_order(hashes, doc)
    if not len(order):
        return held, held, held
    per_hash = np.diff(np.append(starts, len(order)))
    where = place[order[starts]]
    by_place = np.argsort(where)
    begins = _runs(where[by_place])
    n = np.diff(np.append(begins, len(by_place)))
    free = np.add.reduceat(np.add.reduceat(~held, starts, dtype=np.int64)[by_place], begins)
    flags = np.empty((2, len(by_place)), bool)
    flags[0, by_place] = np.repeat(n > 1, n)
    flags[1, by_place] = np.repeat((n > 1) & (free > crowd), n)
    out = np.empty((3, len(order)), bool)
    out[0, order] = held
    out[1:, order] = np.repeat(flags, per_hash, axis=1) & ~held
    return out[0], out[1], out[2]


class Gathered:
    """Arrays of chunks that go out together: columns of items, of which ``text`` counts through all chunks, and row keys and ids of the texts."""

    def __init__(self) -> None:
        self.items: list[tuple] = []
        self.owners: list[tuple] = []
        self.texts = self.size = 0

    def add(self, keys: np.ndarray, ids: np.ndarray, size: int, text: np.ndarray, *columns: np.ndarray) -> None:
        self.items.append((text + self.texts, *columns))
        self.owners.append((keys, ids))
        self.texts += len(keys)
        self.size += size

    def taken(self) -> tuple[np.ndarray, ...]:
        """(row keys, ids, columns), and empty again."""
        out = (*map(np.concatenate, zip(*self.owners, strict=True)), *map(np.concatenate, zip(*self.items, strict=True)))
        self.__init__()
        return out


def gathered(batches: Iterator[pa.RecordBatch], found: Callable[[Gathered, pa.RecordBatch, int, list[bytes], np.ndarray, np.ndarray], None], out: Callable[..., pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """``found`` adds what it finds in each chunk of texts, and its size; ``out`` makes a batch of it whenever that is ``most``."""
    held = Gathered()
    for batch in batches:
        keys, ids = batch.column("row_key").to_numpy(), batch.column("doc_id").fill_null(NO_ID).to_numpy()
        for at, texts in kernel.chunks(batch, size_of=CHUNK_BYTES):
            own = slice(at, at + len(texts))
            found(held, batch, at, texts, keys[own], ids[own])
            if held.size >= most:
                yield out(*held.taken())
    if held.items:
        yield out(*held.taken())


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _send(phrases: Phrases, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def found(held, batch, at, texts, keys, ids):
        hashes, text, place = phrases(texts)
        if len(hashes):
            low = np.zeros(0, np.uint32) if place is None else place.astype(np.uint32)
            held.add(keys, ids, sum(map(len, texts)), text, hashes, bucket_of(hashes if place is None else place, buckets), low)

    def out(keys, ids, text, hashes, bucket, low):
        before = held_before(hashes, ids[text])
        begins = _runs(text)
        rows = [(LOCAL - mailbox, None, *own, None) for mailbox, own in mail(keys[text[begins]], np.diff(np.append(begins, len(text))), before, buckets)]
        kept = np.flatnonzero(~before)
        kept = kept[np.argsort(bucket[kept], kind="stable")]
        bucket, hashes, text = bucket[kept], hashes[kept], text[kept]
        low = low[kept] if len(low) else None
        owners = Owners(bucket, text, ids, keys)
        for a, b in runs_of(bucket):
            rows.append((int(bucket[a]), *owners.packed(a, b), hashes[a:b].tobytes(), None if low is None else low[a:b].tobytes()))
        return as_batch(rows, _SENT)

    return lambda batches: gathered(batches, found, out, SEND_BYTES)


def mail(keys: np.ndarray, counts: np.ndarray, flag: np.ndarray, mailboxes: int) -> Iterator[tuple[int, tuple[bytes, bytes, bytes]]]:
    """The flags of each text that has one set, as bits, packed by the mailbox of its key. counts: how many of the flags each text has, one at least."""
    if not len(keys):
        return
    begins = np.cumsum(counts) - counts
    some = np.flatnonzero(np.logical_or.reduceat(flag, begins))
    if not len(some):
        return
    mailbox = (kernel.mix(keys[some].astype(np.uint64)) % np.uint64(mailboxes)).astype(np.int32)
    order = np.argsort(mailbox, kind="stable")
    mailbox, some = mailbox[order], some[order]
    keys, begins, counts = keys[some], begins[some], counts[some]
    size = (counts + 7) // 8
    ends = np.cumsum(size)
    bits = np.zeros(8 * int(ends[-1]), bool)
    bits[kernel.ramps(8 * (ends - size), counts)] = flag[kernel.ramps(begins, counts)]
    packed, at = np.packbits(bits), np.concatenate(([0], ends)).tolist()
    keys, size = Narrow(keys), Narrow(size)
    for a, b in runs_of(mailbox):
        yield int(mailbox[a]), (keys.packed(a, b), size.packed(a, b), packed[at[a] : at[b]].tobytes())


def passed_on(table: pa.Table, packed: str) -> pa.Table:
    """Answers found on the spot, which ride along in buckets below zero."""
    n, bucket = table.num_rows, table.column("bucket")[0].as_py()
    kept = [table.column(name) for name in ("keys", "counts", packed)]
    return pa.table([pa.array([LOCAL - bucket] * n, pa.int32()), pa.array([LOCAL] * n, pa.int32()), *kept], schema=MAIL)


def mailed(bucket: int, keys: np.ndarray, counts: np.ndarray, flag: np.ndarray, mailboxes: int) -> pa.Table:
    return pa.Table.from_batches([as_batch([(mailbox, bucket, *own) for mailbox, own in mail(keys, counts, flag, mailboxes)], MAIL)])


def _answer(buckets: int, crowd: int) -> Callable[[pa.Table], pa.Table]:
    def answer(table: pa.Table) -> pa.Table:
        """One bucket: which of its phrases a smaller document holds."""
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:
            return passed_on(table, "packed")
        docs, keys, counts = unpacked_owners(table)
        hashes, doc = whole(table, "packed", np.uint64), np.repeat(docs, counts)
        if not table.column("places")[0].is_valid:
            return mailed(bucket, keys, counts, held_before(hashes, doc), buckets)
        held, contested, crowded = _settled(hashes, doc, whole(table, "places", np.uint32), crowd)
        return mailed(bucket, keys, 2 * counts, np.stack([held | crowded, contested], 1).ravel(), buckets)

    return answer


def deliver(table: pa.Table) -> pa.Table:
    """One mailbox: the answers of each of its documents, in order of bucket."""
    key, n = widened(table.column("keys").to_pylist())
    size, packed = widened(table.column("counts").to_pylist())[0], whole(table, "packed", np.uint8)
    bucket = np.repeat(table.column("bucket").to_numpy(), n)
    order = np.lexsort((bucket, key))
    packed = packed[kernel.ramps((np.cumsum(size) - size)[order], size[order])]
    key, bucket, size = key[order], bucket[order].astype(np.int32), size[order]
    begins = _runs(key)
    ends = np.append(begins, len(key))
    columns = [_binary(bucket, 4 * ends), _binary(packed, np.concatenate(([0], np.cumsum(size)))[ends])]
    return pa.table([pa.array(key[begins], pa.int64()), pa.StructArray.from_arrays(columns, ["buckets", "bits"])], schema=_FOUND)


def _binary(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes between each two edges."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def answers(docs: DataFrame, phrases: Phrases, buckets: int, crowd: int = 0) -> DataFrame:
    """(row_key, answers): for each document with a phrase that a smaller one holds, its bits by bucket.

    docs: row_key, doc_id, text, as ``row_keyed`` gives them. crowd: open phrases beyond which a place is crowded.
    """
    sent = docs.mapInArrow(_send(phrases, buckets), _SENT_SQL)
    # one pass over the texts: answers found on the spot ride along in buckets below zero
    mail = sent.groupBy("bucket").applyInArrow(_answer(buckets, crowd), MAIL_SQL)
    return mail.groupBy("mailbox").applyInArrow(deliver, FOUND_SQL)


class Answers:
    """The answers to some texts, in order, as ``deliver`` gave them: what was found on the spot and what buckets found."""

    def __init__(self, column: pa.StructArray) -> None:
        buckets, bits = ([x or b"" for x in part.to_pylist()] for part in column.flatten())
        self.n = np.fromiter(map(len, buckets), np.int64, len(buckets)) // 4
        self.bucket = np.frombuffer(b"".join(buckets), np.int32)
        self.size = np.fromiter(map(len, bits), np.int64, len(bits))
        self.bits = np.frombuffer(b"".join(bits), np.uint8)

    def local(self) -> np.ndarray:
        """Which texts have answers found on the spot; they come first."""
        out = np.zeros(len(self.n), bool)
        out[self.n > 0] = self.bucket[(np.cumsum(self.n) - self.n)[self.n > 0]] == LOCAL
        return out

    def _any(self, flag: np.ndarray) -> np.ndarray:
        """Which texts have a byte of bits that is marked."""
        marked = np.concatenate(([0], np.cumsum(flag)))
        ends = np.cumsum(self.size)
        return marked[ends] > marked[ends - self.size]

    def any_held(self) -> np.ndarray:
        """Of answers of two flags: which texts have a phrase that a smaller document holds; those found on the spot all do."""
        return self.local() | self._any((self.bits & ~(self.bits << 1) & 0b10101010) != 0)

    def any_contested(self) -> np.ndarray:
        """Of answers of two flags: which texts can have a contested phrase."""
        return (self.n > self.local()) & self._any((self.bits & 0b01010101) != 0)

    def on_the_spot(self, n: np.ndarray) -> np.ndarray:
        """The flags found on the spot, of ``n`` phrases of each text; these answers are gone then."""
        local = self.local()
        size = np.where(local, (n + 7) // 8, 0)
        begins = np.cumsum(self.size) - self.size
        out = np.zeros(int(n.sum()), bool)
        flags = np.unpackbits(self.bits[kernel.ramps(begins, size)])
        out[kernel.ramps((np.cumsum(n) - n)[local], n[local])] = flags[kernel.ramps(8 * (np.cumsum(size) - size)[local], n[local])]
        self.bits = self.bits[kernel.ramps(begins + size, self.size - size)]
        self.bucket = self.bucket[self.bucket != LOCAL]
        self.size, self.n = self.size - size, self.n - local
        return out

    def dealt(self, text: np.ndarray, bucket: np.ndarray, counts: np.ndarray, planes: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(items, flags): the dealt items that a bucket has answered, and ``planes`` flags of each of their phrases; after ``on_the_spot``.

        Of each item: its text, its bucket of ``buckets``, and how many phrases it has. Items of one text and bucket stand in the order they were sent in.
        """
        item = text * buckets + bucket
        order = np.argsort(item, kind="stable")
        asked = np.repeat(np.arange(len(self.n)), self.n) * buckets + self.bucket
        ordered = item[order]
        first, last = np.searchsorted(ordered, asked), np.searchsorted(ordered, asked, "right")
        sums = np.concatenate(([0], np.cumsum(counts[order])))
        n = planes * (sums[last] - sums[first])
        padded = (n + 7) // 8 * 8
        flags = np.unpackbits(self.bits)[kernel.ramps(np.cumsum(padded) - padded, n)].astype(bool)
        return order[kernel.ramps(first, last - first)], flags.reshape(-1, planes)

    def read(self, hashes: np.ndarray, text: np.ndarray, buckets: int, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(held by a smaller document, contested, in a crowded place) for the phrases of the texts, in their order; arguments as ``phrases`` gave them."""
        out = self.on_the_spot(np.bincount(text, minlength=len(self.n)))
        contested, crowded = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
        sent = np.flatnonzero(~out)
        bucket = bucket_of((hashes if place is None else place)[sent], buckets)
        items, flags = self.dealt(text[sent], bucket, np.ones(len(sent), np.int64), 1 if place is None else 2, buckets)
        out[sent[items]] = flags[:, 0]
        if place is not None:
            contested[sent[items]] = flags[:, 1]
            crowded = out & contested
            out &= ~crowded
        return out, contested, crowded
