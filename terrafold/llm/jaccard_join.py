"""Jaccard join of word shingles by size: a light way for small sets, a heavy one for large.

Documents with equal shingle sets are one node. Two nodes of sizes s and t link
when they share at least c(s, t) = ceil(3 (s + t) / 7) shingles, which is a
Jaccard similarity of 0.75 or more.

Light: where both sizes are at most the boundary, each set enumerates its
subsets of exactly c(s, t) shingles for each partner size t; two sets link just
when they share one. Heavy: other pairs meet in inverted lists of shingles,
kept for the first s - ceil(0.75 s) + 1 shingles of a set in one global order;
linked sets share one of those. The order is by how often a shingle occurs, so
passages that many documents share come last; the counts are a sketch of fixed
size, which may be off without loss, since any one order is exact. The boundary
is the size where both ways together cost least for the sizes at hand.

Keys of both ways are dealt over buckets of their hash. Each bucket gives the
lists of two or more nodes. First every node is compared with one hub of its
lists, the node that stands in the most lists, exactly, on the texts. The links
found are contracted; only lists that still hold different components are
compared further, and there only the members outside a list's largest component
with those of other components, so a group of near copies costs a comparison for each
member, not for each pair.
Before any text is read, pairs go through a bound that never drops a link: each
set has SIGNATURE_WORDS x 64 bits, each the parity of the shingles hashed to it,
and two sets differ in at least as many shingles as their bits differ.

Nodes are 64-bit digests of a set: two sets among n share one with probability
below n^2 / 2^65.

Cases: fewer than five words make one shingle; null, empty and white texts have
none and link with nothing; a document without an id can join others, its
component is named by the smallest id there is; repeated rows are equal sets; texts of
any length are read whole; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import kernel, sketch
from terrafold.llm.components import connected_components
from terrafold.llm.phrase_index import bucket_of
from terrafold.llm.rows import buckets_for, row_keyed
from terrafold.llm.sketch import CellCounts, summed
from terrafold.runtime import materialise, release, ship

SHINGLE = 5
#: Counters of the frequency sketch, whatever the input's size.
SKETCH_CELLS = 1 << 22
#: Sets beyond this are never light: their subsets number too many.
MOST_LIGHT = 16
#: 64-bit words of a set's parity signature.
SIGNATURE_WORDS = 16
#: Bytes of keys that one bucket of inverted lists gets, about.
BUCKET_BYTES = 16 << 20
#: Shingles that one block of comparisons holds, about.
BLOCK_SHINGLES = 400_000

_U = np.uint64


def needed(s: int, t: int) -> int:
    """Shingles that sets of sizes s and t must share."""
    return -(-3 * (s + t) // 7)


def prefix_length(s: int) -> int:
    return s - -(-3 * s // 4) + 1


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingles of each text, as sorted 64-bit hashes."""
    words = kernel.words_of(texts, kernel.PLAIN_WORD, lower=True)
    windows = words.windows(k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(windows[a : b - k + 1]))
        elif b > a:
            one = words.hash[a : a + 1].copy()
            for j in range(a + 1, b):
                one = one * _U(kernel._STEP) + words.hash[j]
            out.append(kernel.mix(one + _U(b - a)))
        else:
            out.append(np.zeros(0, _U))
    return out


def node_of(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


# ---- sizes, nodes and the frequency sketch: one pass over the texts

_PROFILE = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("signature", pa.list_(pa.int64())), *sketch.FIELDS])
_PROFILE_SQL = f"row_key long, doc_id long, n long, node long, signature array<long>, {sketch.SQL}"


def signature_of(own: np.ndarray) -> list[int]:
    bits = np.bincount((own >> _U(20) & _U(64 * SIGNATURE_WORDS - 1)).astype(np.int64), minlength=64 * SIGNATURE_WORDS) & 1
    return np.packbits(bits.astype(bool)).view(np.int64).tolist()


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = CellCounts(SKETCH_CELLS)
    for batch in batches:
        for at, texts in kernel.chunks(batch):
            sets = shingle_sets(texts)
            seen.add(np.concatenate(sets) & _U(SKETCH_CELLS - 1))
            n = len(texts)
            columns = [batch.column("row_key").slice(at, n), batch.column("doc_id").slice(at, n), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([signature_of(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(n, f.type) for f in sketch.SCHEMA)], schema=_PROFILE)
    for part in seen.batches():
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(_PROFILE)[:5]), *part.columns], schema=_PROFILE)


# ---- the boundary between light and heavy sets


def _partners(s: int) -> range:
    return range(-(-3 * s // 4), 4 * s // 3 + 1)


def light_boundary(sizes: dict[int, int], counts: np.ndarray) -> int:
    """The size up to which subsets cost less than lists; sizes: nodes of each small size.

    A subset is one key. A prefix shingle is one key and meets a list, whose
    mean length is the sketch's size-biased load against its even load.
    """
    c = counts.astype(float)
    total = c.sum()
    length = max(1.0, (c * c).sum() / total / (total / len(c))) if total else 1.0
    light = lambda s, b: sum(comb(s, needed(s, t)) for t in _partners(s) if t <= b)
    heavy = lambda s: prefix_length(s) * (1 + length)

    def cost(b: int) -> float:
        return sum(n * ((light(s, b) if s <= b else 0) + (heavy(s) if 4 * s // 3 > b else 0)) for s, n in sizes.items())

    return min(range(MOST_LIGHT + 1), key=lambda b: (cost(b), b))


@cache
def _choose(s: int, c: int) -> np.ndarray:
    return np.array(list(combinations(range(s), c)), np.int64).reshape(-1, c)


def subset_keys(own: np.ndarray, boundary: int) -> np.ndarray:
    """One key for each fixed-size subset of a light set and each size of partner."""
    s, out = len(own), []
    for t in _partners(s):
        if t > boundary:
            continue
        picked = own[_choose(s, needed(s, t))]
        key = np.full(len(picked), min(s, t) * 1000 + max(s, t), _U)
        for j in range(picked.shape[1]):
            key = key * _U(kernel._STEP) + picked[:, j]
        out.append(kernel.mix(key))
    return np.concatenate(out) if out else np.zeros(0, _U)


# ---- inverted lists

_SENT = pa.schema([("bucket", pa.int32()), ("nodes", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary())])
_SENT_SQL = "bucket int, nodes binary, sizes binary, counts binary, keys binary"

def set_keys(own: np.ndarray, boundary: int, counts: np.ndarray) -> np.ndarray:
    """All keys of one set."""
    s = len(own)
    out = subset_keys(own, boundary) if s <= boundary else np.zeros(0, _U)
    if 4 * s // 3 > boundary:
        order = np.lexsort((own, counts[own & _U(SKETCH_CELLS - 1)]))
        out = np.concatenate((out, own[order[: prefix_length(s)]]))
    return out


def _send(shared, boundary: int, buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = shared.value
        for batch in batches:
            for _, texts in kernel.chunks(batch):
                sets = {node_of(s): s for s in shingle_sets(texts) if len(s)}
                if not sets:
                    continue
                nodes = np.fromiter(sets, np.int64, len(sets))
                sizes = np.fromiter(map(len, sets.values()), np.int32, len(sets))
                keys = [set_keys(s, boundary, frequency) for s in sets.values()]
                which = np.repeat(np.arange(len(keys)), list(map(len, keys)))
                keys = np.concatenate(keys)
                bucket = bucket_of(keys, buckets)
                order = np.argsort(bucket, kind="stable")
                keys, which, bucket = keys[order], which[order], bucket[order]
                edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
                rows = []
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    begins = np.flatnonzero(np.diff(which[a:b], prepend=-1))
                    own = which[a:b][begins]
                    counts = np.diff(np.append(begins, b - a)).astype(np.int32)
                    rows.append((int(bucket[a]), nodes[own].tobytes(), sizes[own].tobytes(), counts.tobytes(), keys[a:b].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT)

    return send


def _lists(table: pa.Table) -> pa.Table:
    """The lists of one bucket with two or more nodes, a row for each member; equal lists once."""
    whole = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    counts, keys = whole("counts", np.int32), whole("keys", np.uint64)
    node, size = np.repeat(whole("nodes", np.int64), counts), np.repeat(whole("sizes", np.int32), counts)
    order = np.argsort(keys)
    ordered = keys[order]
    same = np.concatenate(([False], ordered[1:] == ordered[:-1]))
    again = same | np.concatenate((same[1:], [False]))
    order = order[again]
    keys, node, size = keys[order], node[order], size[order]
    order = np.lexsort((node, keys))
    keys, node, size = keys[order], node[order], size[order]
    fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (node[1:] != node[:-1]))) if len(keys) else np.zeros(0, bool)
    keys, node, size = keys[fresh], node[fresh], size[fresh]
    begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    ends = np.append(begins[1:], len(keys))
    if len(begins):
        names = np.add.reduceat(kernel.mix(node.view(_U).copy()), begins)
        _, first = np.unique(names, return_index=True)
        first = first[ends[first] - begins[first] > 1]
        count = ends[first] - begins[first]
        picks, names = kernel.ramps(begins[first], count), np.repeat(names[first].view(np.int64), count)
    else:
        picks, names = np.zeros(0, np.int64), np.zeros(0, np.int64)
    return pa.table([pa.array(names), pa.array(node[picks]), pa.array(size[picks])], names=["list", "node", "n"])


# ---- exact comparison

_SIZES_FIT = "4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)"
#: Linked sets share c(s, t) shingles or more, so they differ in s + t - 2 c(s, t) at most.
def _bits_fit(a: str, b: str) -> str:
    bits = " + ".join(f"bit_count({a}{i} ^ {b}{i})" for i in range(SIGNATURE_WORDS))
    return f"{bits} <= n_{a} + n_{b} - 2 * ceil(3 * (n_{a} + n_{b}) / 7)"


def _signed(signatures: DataFrame, side: str) -> DataFrame:
    """(side, side0, side1, ...): the words of each node's signature."""
    return signatures.select(F.col("node").alias(side), *(F.col("signature")[i].alias(f"{side}{i}") for i in range(SIGNATURE_WORDS)))


def _compare(table: pa.Table) -> pa.Table:
    """Links among the pairs (hub, node) of one block."""
    hub, node, text = table.column("hub").to_pylist(), table.column("node").to_pylist(), [x or b"" for x in table.column("text").cast(pa.binary()).to_pylist()]
    first = {}
    for i, x in enumerate(node):
        first.setdefault(x, i)
    sets, at = {}, list(first.items())
    while at:
        size, take = 0, 0
        while take < len(at) and size < kernel.CHUNK_BYTES:
            size += len(text[at[take][1]])
            take += 1
        sets |= zip((x for x, _ in at[:take]), shingle_sets([text[i] for _, i in at[:take]]), strict=True)
        at = at[take:]
    linked = [(a, b) for a, b in zip(hub, node, strict=True) if a != b and _linked(sets[a], sets[b])]
    return pa.table([pa.array([x for x, _ in linked], pa.int64()), pa.array([x for _, x in linked], pa.int64())], names=["a", "b"])


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    if not len(x) or not len(y):
        return False
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) >= needed(len(x), len(y))


def _verified(docs: DataFrame, profile: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, n_a, b, n_b) that link. a's pairs are dealt over blocks of bounded size; a goes to each."""
    salts = pairs.groupBy("a").agg(F.ceil(F.sum("n_b") / BLOCK_SHINGLES).cast("int").alias("salts"))
    dealt = pairs.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")))
    units = dealt.groupBy("a", "n_a", "salt").agg(F.sum("n_b").alias("load"))
    total = units.agg(F.sum(F.col("load") + F.col("n_a"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_SHINGLES))
    block = F.pmod(F.xxhash64("hub", "salt"), F.lit(blocks)).alias("block")
    seats = dealt.select(F.col("a").alias("hub"), "salt", F.col("b").alias("node")).union(units.select(F.col("a").alias("hub"), "salt", F.col("a").alias("node")))
    seats = materialise(seats.select(block, "hub", "node"), "seats")
    wanted = seats.select("node").distinct()
    copies = profile.where("row_key is not null").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("row_key").alias("row_key"))
    texts = docs.select("row_key", "text").join(copies, "row_key").select("node", "text")
    return texts.join(seats, "node").select("block", "hub", "node", "text").groupBy("block").applyInArrow(_compare, "a long, b long")


def _stars(lists: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): for each node b a hub a. The hub of a list is the node that the most lists hold, which among copies is the least edited; a node takes the best hub of its lists."""
    rank = lists.groupBy("node").agg(F.count("*").alias("lists"))
    ranked = lists.join(rank, "node")
    hubs = ranked.groupBy("list").agg(F.max(F.struct("lists", "node", "n")).alias("hub"))
    pairs = lists.join(hubs, "list").select(F.col("hub.node").alias("a"), F.col("hub.n").alias("n_a"), "hub", F.col("node").alias("b"), F.col("n").alias("n_b"))
    best = pairs.where(f"a <> b and {_SIZES_FIT}").groupBy("b", "n_b").agg(F.max("hub").alias("hub"))
    return best.select(F.col("hub.node").alias("a"), F.col("hub.n").alias("n_a"), "b", "n_b")


#: Sizes that can link are at most a factor of 4/3 apart, hence in the same class of this base or in neighbouring ones.
_CLASS = "cast(floor(ln(n) / ln(1.4)) as int)"
#: Members of one list that meet the rest of it in one task, about.
_SALTED = 20_000


def _pairs_across(lists: DataFrame, roots: DataFrame, tried: DataFrame, signatures: DataFrame) -> DataFrame:
    """Pairs of a list whose components differ and which are not tried yet.

    One side is always outside the list's largest component, so the pairs inside that
    are never made; sides meet by class of size, with their signatures, so that only
    pairs that may link come out, and long lists in several tasks.
    """
    held = lists.join(roots, "node", "left").select("list", "node", "n", F.coalesce("root", "node").alias("root"))
    parts = held.groupBy("list", "root").agg(F.count("*").alias("size"))
    mixed = parts.groupBy("list").agg(F.max(F.struct("size", "root"))["root"].alias("main"), F.count("*").alias("roots"), F.ceil(F.sum("size") / _SALTED).cast("int").alias("salts"))
    held = materialise(held.join(mixed.where("roots > 1").drop("roots"), "list"), "mixed")
    outside = held.where("root <> main").select("list", F.col("node").alias("x"), F.col("n").alias("n_x"), F.col("root").alias("root_x"), F.expr(f"sequence({_CLASS} - 1, {_CLASS} + 1)").alias("classes"), F.expr("sequence(0, salts - 1)").alias("salts"))
    outside = outside.join(_signed(signatures, "x"), "x").withColumn("class", F.explode("classes")).withColumn("salt", F.explode("salts")).drop("classes", "salts")
    rest = held.select("list", F.col("node").alias("y"), F.col("n").alias("n_y"), F.col("root").alias("root_y"), F.expr(_CLASS).alias("class"), F.expr("cast(pmod(xxhash64(node), salts) as int)").alias("salt"))
    rest = rest.join(_signed(signatures, "y"), "y")
    met = outside.join(rest, ["list", "class", "salt"]).where(f"root_x <> root_y and 4 * least(n_x, n_y) >= 3 * greatest(n_x, n_y) and {_bits_fit('x', 'y')}")
    pair = lambda *names: [F.expr(f"if(x < y, {a}, {b})").alias(c) for a, b, c in names]
    across = met.select(*pair(("x", "y", "a"), ("n_x", "n_y", "n_a"), ("y", "x", "b"), ("n_y", "n_x", "n_b"))).distinct()
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return across.join(done, ["a", "b"], "left_anti")


def near_duplicates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents: row_key, doc_id, n_shingles, root, component_id; links: a, b between nodes, enough to join each component).

    docs: row_key, doc_id, text, as ``row_keyed`` gives them. Documents of one
    component have one root; component_id is its smallest doc_id.
    """
    spark: SparkSession = docs.sparkSession
    ship(spark)
    profile = materialise(docs.mapInArrow(_profile, _PROFILE_SQL), "profile")
    plain = profile.where("row_key is not null").select("row_key", "doc_id", "n", "node")
    frequency = np.minimum(summed(profile.where("block is not null").select(*sketch.SCHEMA.names), SKETCH_CELLS), 0xFFFFFFFF).astype(np.uint32)
    sizes = {r.n: r.nodes for r in plain.where(f"n between 1 and {2 * MOST_LIGHT}").groupBy("n").agg(F.count_distinct("node").alias("nodes")).collect()}
    boundary = light_boundary(sizes, frequency)
    keys = plain.agg(F.sum(F.expr("n div 4 + 1"))).first()[0] or 0
    buckets = buckets_for(spark, 8 * keys, BUCKET_BYTES)
    shared = spark.sparkContext.broadcast(frequency)
    sent = docs.select("text").mapInArrow(_send(shared, boundary, buckets), _SENT_SQL)
    found = sent.groupBy("bucket").applyInArrow(_lists, "list long, node long, n int")
    lists = materialise(found.distinct(), "lists")

    signatures = materialise(profile.where("n > 0").groupBy("node").agg(F.first("signature").alias("signature")), "signatures")
    stars = _stars(lists).join(_signed(signatures, "a"), "a").join(_signed(signatures, "b"), "b")
    stars = materialise(stars.where(_bits_fit("a", "b")).select("a", "n_a", "b", "n_b"), "stars")
    links = materialise(_verified(docs, profile, stars), "links")
    across = materialise(_pairs_across(lists, connected_components(links), stars, signatures), "across")
    release(lists, signatures, stars)
    if not across.isEmpty():
        links = links.union(materialise(_verified(docs, profile, across), "links"))
    roots = connected_components(links)

    named = plain.groupBy("node").agg(F.min("doc_id").alias("least")).join(roots, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(least, "root").select("node", "root", "component_id")
    out = plain.join(labels, "node").select("row_key", "doc_id", F.col("n").alias("n_shingles"), "root", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out, links


def superseded(docs: DataFrame) -> DataFrame:
    """row_key of the documents that another of their component stands for: all but the first by doc_id, then row_key."""
    found, _ = near_duplicates(docs)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    first = found.where("n_shingles > 0").groupBy("root").agg(F.min(place)["row_key"].alias("kept"))
    return found.where("n_shingles > 0").join(first, "root").where("row_key <> kept").select("row_key")


def op5_heavy_light_jaccard(spark, sf_dir: str) -> DataFrame:
    found, _ = near_duplicates(row_keyed(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("doc_id", "n_shingles", "component_id")
