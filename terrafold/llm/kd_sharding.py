"""Shards from a k-d tree over document metadata, near equal in bytes.

A cell is split at the weighted median (the weight is a document's bytes) along
its widest dimension, each measured against its extent over all documents,
until each leaf holds its share. The dimensions are size, source, language and
id. Equal coordinates are ordered by the text's CRC, so equal texts of a cell
stand together, then by row, so a group of any size can be cut and the two sides
differ by at most one document.

A median is found without sorting the rows: histograms of a cell's coordinates narrow
the range until few rows are left in it, and only those are put in order. Both are
added up and searched on the executors; a round brings the driver one row of numbers
for each cell, and cells are as many as shards. Each level of the tree is written once.

Cases: null text weighs one byte; null metadata, also of columns that are not there,
is the smallest coordinate; repeated rows are rows of their own; very long texts are
rows like others and cannot be cut; ties stand by the text's CRC, then by row; other
columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrafold.runtime import materialise, release

HISTOGRAM_BINS = 4096
FEW_ROWS = 2048
#: Rows that one window task numbers at once.
_ROWS_BITS = 13

DIMENSIONS = ("size", "source", "lang", "doc")


def _metadata(documents: DataFrame) -> DataFrame:
    """One row of numbers for each document; no text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    has = set(documents.columns)
    name = lambda c: F.col(c).cast("string") if c in has else F.lit(None).cast("string")
    base = documents.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), name("source").alias("source"), name("lang").alias("lang"))
    low = F.shiftright("text_crc32", 1)
    coarse = lambda c: F.when(F.col(c).isNull(), F.lit(-1)).otherwise(F.crc32(F.col(c).cast("binary")))
    return base.select("uid", "doc_id", "size", "text_crc32", (F.col("size") * F.lit(1 << 31) + low).alias("at_size"), (coarse("source") * F.lit(1 << 31) + low).alias("at_source"), (coarse("lang") * F.lit(1 << 31) + low).alias("at_lang"), F.coalesce(F.col("doc_id"), F.lit(-(1 << 62))).alias("at_doc"))


@dataclass
class Cell:
    """A cell of the tree on its way to being split: the median is in [low, high] of its axis, then of the row numbers."""

    node: int
    first: int
    shards: int
    axis: str = ""
    weight: int = 0
    low: int = 0
    high: int = 0
    row_low: int = 0
    row_high: int = 1 << 62
    need: float = 0.0
    cut: tuple[int, int] | None = None

    def narrow_to(self, lo: int, hi: int) -> None:
        if self.low < self.high:
            self.low, self.high = lo, hi
        else:
            self.row_low, self.row_high = lo, hi

    def span(self) -> tuple[int, int]:
        return (self.low, self.high) if self.low < self.high else (self.row_low, self.row_high)


_RANGE = "node long, axis string, low long, high long, row_low long, row_high long"


def _inside(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """The rows in the range of their cell; as many ranges as cells, so they are sent to all."""
    return rows.join(F.broadcast(ranges), "node").withColumn("at", _axis()).where("at between low and high and uid between row_low and row_high")


def _axis() -> Column:
    out = F.col("at_size")
    for d in DIMENSIONS[1:]:
        out = F.when(F.col("axis") == d, F.col(f"at_{d}")).otherwise(out)
    return out


def _extents(rows: DataFrame, by: str) -> dict[int, dict]:
    aggs = [F.sum("size").alias("weight"), F.count("*").alias("n")] + [f(F.col(f"at_{d}")).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max)]
    return {r[by]: r.asDict() for r in rows.groupBy(by).agg(*aggs).collect()}


def _find_cuts(spark: SparkSession, rows: DataFrame, cells: list[Cell]) -> None:
    """Sets the cut of each cell: the last (coordinate, row) that goes left. A round brings one row a cell to the driver."""
    open_cells = {c.node: c for c in cells}
    while open_cells:
        ranges = []
        for c in open_cells.values():
            lo, hi = c.span()
            ranges.append((c.node, c.axis, c.low, c.high, c.row_low, c.row_high, lo, max(1, -(-(hi - lo + 1) // HISTOGRAM_BINS)), c.low < c.high, float(c.need)))
        params = spark.createDataFrame(ranges, f"{_RANGE}, lo long, step long, by_axis boolean, need double")
        bins = _inside(rows, params).withColumn("bin", F.expr("(case when by_axis then at else uid end - lo) div step"))
        sums = bins.groupBy("node", "need", "bin").agg(F.sum("size").alias("w"), F.count("*").alias("n"))
        own = Window.partitionBy("node")
        run = sums.withColumn("upto", F.sum("w").over(own.orderBy("bin"))).withColumn("last", F.max("bin").over(own))
        picked = run.where("upto > need or bin = last").groupBy("node").agg(F.min(F.struct("bin", F.expr("upto - w").alias("before"), "n")).alias("pick"))
        steps, few = {node: (lo, step) for node, *_, lo, step, _, _ in ranges}, []
        for node, (k, before, n) in picked.collect():
            c, (lo, step) = open_cells[node], steps[node]
            _, hi = c.span()
            c.need -= before
            c.narrow_to(lo + k * step, min(hi, lo + (k + 1) * step - 1))
            if n <= FEW_ROWS:
                few.append(c)
        if few:
            _cut_few(spark, rows, few)
        open_cells = {c.node: c for c in open_cells.values() if c.cut is None}


def _cut_few(spark: SparkSession, rows: DataFrame, cells: list[Cell]) -> None:
    """The cuts of cells with few rows left: rows go left in order until the next one would lead further from what is needed."""
    params = spark.createDataFrame([(c.node, c.axis, c.low, c.high, c.row_low, c.row_high, float(c.need)) for c in cells], f"{_RANGE}, need double")
    order = Window.partitionBy("node").orderBy("at", "uid")
    run = _inside(rows, params).withColumn("upto", F.sum("size").over(order)).withColumn("stop", F.expr("abs(need - (upto - size)) <= abs(need - upto)"))
    left = run.withColumn("stopped", F.max("stop").over(order)).where("not stopped").groupBy("node").agg(F.max(F.struct("at", "uid")).alias("cut"))
    cuts = {node: tuple(cut) for node, cut in left.collect()}
    for c in cells:
        c.cut = cuts.get(c.node, (c.low, c.row_low - 1) if c.low == c.high else (c.low - 1, 1 << 62))


def kd_shards(documents: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): shards of near equal bytes, slots gapless from 0."""
    spark = documents.sparkSession
    meta = materialise(_metadata(documents), "metadata")
    whole = _extents(meta.withColumn("node", F.lit(0)), "node").get(0)
    if shards is None:
        shards = max(1, -(-(whole["weight"] if whole else 0) // (target_bytes or 1 << 30)))
    rows = meta.withColumn("node", F.lit(0).cast("long"))
    cells = [Cell(0, 0, shards)] if whole else []
    leaves: list[tuple[int, int]] = []
    extents = {0: whole}
    wide = {d: max(1, whole[f"max_{d}"] - whole[f"min_{d}"]) for d in DIMENSIONS} if whole else {}
    while cells:
        leaves += [(c.node, c.first) for c in cells if c.shards == 1 or c.node not in extents]
        cells = [c for c in cells if c.shards > 1 and c.node in extents]
        if not cells:
            break
        for c in cells:
            e = extents[c.node]
            c.axis = max(DIMENSIONS, key=lambda d: (e[f"max_{d}"] - e[f"min_{d}"]) / wide[d])
            c.low, c.high, c.weight = e[f"min_{c.axis}"], e[f"max_{c.axis}"], e["weight"]
            c.need = c.weight * (c.shards // 2) / c.shards
        _find_cuts(spark, rows, cells)
        cuts = spark.createDataFrame([(c.node, c.axis, *c.cut) for c in cells], "node long, axis string, cut long, cut_row long")
        right = (F.col("at") > F.col("cut")) | ((F.col("at") == F.col("cut")) & (F.col("uid") > F.col("cut_row")))
        split = rows.join(F.broadcast(cuts), "node", "left").withColumn("at", _axis())
        moved = split.withColumn("node", F.when(F.col("axis").isNull(), F.col("node")).when(right, F.col("node") * 2 + 2).otherwise(F.col("node") * 2 + 1)).drop("axis", "cut", "cut_row", "at")
        before, rows = rows, materialise(moved, "cells")
        release(before)
        extents = _extents(rows, "node")
        cells = [Cell(c.node * 2 + 1 + side, c.first + side * (c.shards // 2), (c.shards // 2, c.shards - c.shards // 2)[side]) for c in cells for side in (0, 1)]
    named = spark.createDataFrame(leaves, "node long, shard int")
    placed = rows.join(F.broadcast(named), "node").select("uid", "doc_id", "size", "text_crc32", "shard")
    return _slots(placed)


def _slots(placed: DataFrame) -> DataFrame:
    """Numbers the rows of each shard from 0, a block of rows at a time."""
    placed = placed.withColumn("block", F.shiftright("uid", _ROWS_BITS))
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("shard", "block").orderBy("uid"))
    numbered = placed.withColumn("within", within).join(offsets, ["shard", "block"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("within") - 1).cast("long").alias("slot"))


def op2_kd_sharding(spark, sf_dir: str) -> DataFrame:
    out = kd_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
