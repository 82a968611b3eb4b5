"""I-Match fingerprints over several randomised lexicons.

Terms are words (letters, digits and everything beyond ASCII; A-Z lower-cased)
hashed to one of TERM_CELLS cells; document frequencies are counted by cell over
all documents, in memory of fixed size. The lexicon holds the cells whose
frequency lies in a band, that is, whose inverse document frequency does. The band
is a share of the documents, and so is what rare terms add to a cell: with d rare
terms a document, d / (TERM_CELLS x the band's lower end), which is 8 % of the lower
end for d = 100 at any size of the corpus.

Each of the SUBSETS random lexicons keeps a share of the lexicon, from all terms to
one in 2048, so that some react to any change and some only to large ones. A
fingerprint is the sequence of the subsets' 32-bit hashes of a document's distinct
terms in order; zeros where a subset has no term of it. A text without any term in
the band takes all its terms, by the same draws. The likeness of two fingerprints
is the share of equal hashes among the subsets that have a term in either; 1 for
equal fingerprints.

Documents are dealt by ranges of their place in order of id, and each range also
gets the first document of the next one, so that every document meets its successor.

Cases: null is the empty text, with no terms and a fingerprint of zeros, as any
text without a term; a single document is its own successor; rows without an id
come first; rows that share an id follow each other by a hash of their text; an
empty table gives an empty result; texts of any length are read whole, in chunks
that hold one text at least; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm import kernel, sketch
from terrafold.llm.rows import texts_of, unique_ids
from terrafold.llm.sketch import CellCounts, summed
from terrafold.runtime import materialise, ship, shuffle_partitions

TERM_CELLS = 1 << 22
#: The band of document frequency, as shares of all documents; at least two documents.
BAND = (0.0003, 0.1)
#: Each random lexicon keeps one term in so many; the first keeps all.
SHARES = (1, *[8] * 3, *[32] * 4, *[128] * 8, *[512] * 8, *[2048] * 8)
SUBSETS = len(SHARES)

_U = np.uint64


def distinct_terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(cells, text index): the distinct term cells of each text, in order."""
    words = kernel.words_of(texts, kernel.FOLDED_WORD, lower=True)
    text = np.repeat(np.arange(len(texts), dtype=_U), np.diff(words.first))
    both = np.unique(text << _U(32) | words.hash & _U(TERM_CELLS - 1))
    return (both & _U(0xFFFFFFFF)).astype(np.int64), (both >> _U(32)).astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = CellCounts(TERM_CELLS)
    for batch in batches:
        for _, texts in kernel.chunks(batch):
            seen.add(distinct_terms(texts)[0])
    yield from seen.batches()


def draws(cells: np.ndarray) -> np.ndarray:
    """For each cell a mask of the random lexicons that would keep it."""
    out = np.zeros(len(cells), np.uint32)
    for j, share in enumerate(SHARES):
        draw = kernel.mix(cells.astype(_U) * _U(SUBSETS) + _U(j) + _U(0x51F15EED << 24))
        out[draw % _U(share) == 0] |= np.uint32(1 << j)
    return out


def lexicons(documents: DataFrame, n: int, band: tuple[float, float] = BAND) -> np.ndarray:
    """For each term cell a mask of the subsets that keep it; zero outside the band of the ``n`` documents."""
    frequency = summed(documents.select("text").mapInArrow(_frequencies, sketch.SQL), TERM_CELLS)
    inside = np.flatnonzero((frequency >= max(2, band[0] * n)) & (frequency <= max(2, band[1] * n)))
    masks = np.zeros(TERM_CELLS, np.uint32)
    masks[inside] = draws(inside)
    return masks


def subset_hashes(texts: list[bytes], masks: np.ndarray) -> np.ndarray:
    """One row of SUBSETS 32-bit hashes for each text: a polynomial hash of its distinct terms of each lexicon, in order."""
    cells, text = distinct_terms(texts)
    out = np.zeros((len(texts), SUBSETS), np.uint32)
    mask = masks[cells]
    banded = np.zeros(len(texts), bool)
    banded[text[mask != 0]] = True
    bare = ~banded[text]
    mask[bare] = draws(cells[bare])
    value = kernel.mix(cells.astype(_U) + _U(0xA5A5 << 40))
    powers, inverses = kernel.tables(len(cells) + 1)
    for j in range(SUBSETS):
        at = np.flatnonzero(mask >> np.uint32(j) & np.uint32(1))
        if not len(at):
            continue
        own = text[at]
        begins = np.flatnonzero(np.diff(own, prepend=-1))
        sums = np.add.reduceat(value[at] * powers[: len(at)], begins) * inverses[begins]
        out[own[begins], j] = (kernel.mix(sums + _U(j + 1)) >> _U(32)).astype(np.uint32) | np.uint32(1)
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal hashes, row by row, among the subsets that either has."""
    either = ((x != 0) | (y != 0)).sum(1)
    equal = ((x == y) & (x != 0)).sum(1)
    return np.where(either == 0, 1.0, equal / np.maximum(either, 1))


def _dealt(bounds: list[float]):
    """Adds the range of each row's id."""
    edges = np.array(bounds, np.float64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("place").to_numpy().astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(edges, ids, "right").astype(np.int32)), *batch.columns], names=["range", *batch.schema.names])

    return deal


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_OUT_SQL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _hex(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows.astype(">u4")]


def _fingerprint(shared):
    def some(held: list[tuple[int | None, str]], last: str) -> pa.RecordBatch:
        masks = shared.value
        texts = [t for _, t in held] + [last]
        edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for t, after in zip(texts, texts[1:], strict=False)]
        own = subset_hashes([t.encode() for t in texts], masks)
        raw = [t.encode() for t in edited]
        other = subset_hashes(raw, masks)
        columns = [[d for d, _ in held], [len(t) for _, t in held], [hashlib.sha256(x).hexdigest() for x in raw], _hex(own[:-1]), _hex(other), likeness(own[:-1], other), likeness(own[:-1], own[1:])]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                for guest, doc_id, text in zip(*(part.column(c).to_pylist() for c in ("guest", "doc_id", "text")), strict=True):
                    text = text or ""
                    if held and (guest or size >= kernel.CHUNK_BYTES):
                        yield some(held, text)
                        held, size = [], 0
                    if not guest:
                        held.append((doc_id, text))
                        size += len(text)
        assert not held, "each range ends with a guest"

    return run


def placed(documents: DataFrame) -> DataFrame:
    """(place, doc_id, text): place numbers the rows in order of their id, without ties.

    The doc_id serves where it is unique and never null. Other tables are numbered in
    order and written; rows of one id then stand by a hash of their text.
    """
    docs = texts_of(documents)
    if unique_ids(docs):
        return docs.select(F.col("doc_id").alias("place"), "doc_id", "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64(F.coalesce("text", F.lit(""))).asc(), F.col("row").asc()]
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    ordered = numbered.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return materialise(ordered.select(F.monotonically_increasing_id().alias("place"), "doc_id", "text"), "placed")


def fingerprints(documents: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """Fingerprints of each document and of its edit by its successor, and their likeness."""
    spark = documents.sparkSession
    ship(spark)
    docs = placed(documents)
    shared = spark.sparkContext.broadcast(lexicons(docs, docs.count(), band))
    ranges = 4 * shuffle_partitions(spark)
    bounds = sorted(set(docs.approxQuantile("place", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)))) if ranges > 1 else []
    deal = _dealt(bounds)
    # the first row of each range; there are at most as many as ranges
    firsts = docs.select("place").mapInArrow(deal, "range int, place long").groupBy("range").agg(F.min("place").alias("first")).orderBy("range").collect()
    guests = [(nxt["first"], own["range"]) for own, nxt in zip(firsts, firsts[1:] + firsts[:1], strict=True)]
    named = spark.createDataFrame(guests, "place long, to int")
    visiting = docs.join(F.broadcast(named), "place").select(F.col("to").alias("range"), F.lit(True).alias("guest"), "place", "doc_id", "text")
    own = docs.mapInArrow(deal, "range int, place long, doc_id long, text string").select("range", F.lit(False).alias("guest"), "place", "doc_id", "text")
    ordered = own.unionByName(visiting).repartition(shuffle_partitions(spark), "range").sortWithinPartitions("range", "guest", "place")
    return ordered.select("guest", "doc_id", "text").mapInArrow(_fingerprint(shared), _OUT_SQL)


def op9_imatch_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
