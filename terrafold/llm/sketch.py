"""Counters over hashed cells: filled in tasks, summed by Spark in bounded memory.

A task sends the cells that it has seen, packed by block of cells, so that small
tasks send little. The parts of a block are added up as they stream by, in two
steps where tasks are many: first over shares of the tasks, then over the shares.
No step holds more than one array of counters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from terrafold.runtime import shuffle_partitions

BLOCK = 1 << 16
#: Cells that a task holds before it adds them to its counters.
_HELD = 1 << 19

FIELDS = [("block", pa.int32()), ("share", pa.int32()), ("width", pa.int32()), ("at", pa.binary()), ("counts", pa.binary())]
SCHEMA = pa.schema(FIELDS)
SQL = "block int, share int, width int, at binary, counts binary"


class CellCounts:
    """Counts of cells 0 .. cells - 1 in one task; dense only once the task has seen many."""

    def __init__(self, cells: int) -> None:
        self.cells = cells
        self.total: np.ndarray | None = None
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, cells: np.ndarray) -> None:
        self.held.append(cells.astype(np.int32))
        self.size += len(cells)
        if self.size > _HELD:
            self._settle()

    def _settle(self) -> None:
        if self.total is None:
            self.total = np.zeros(self.cells, np.uint32)
        cells, counts = self._unique()
        self.total[cells] += counts.astype(np.uint32)

    def _unique(self) -> tuple[np.ndarray, np.ndarray]:
        both = np.unique(np.concatenate(self.held) if self.held else np.zeros(0, np.int32), return_counts=True)
        self.held, self.size = [], 0
        return both

    def batches(self) -> Iterator[pa.RecordBatch]:
        """What was counted, a row for each block of cells that has some."""
        if self.total is None:
            cells, counts = self._unique()
        else:
            self._settle()
            cells = np.flatnonzero(self.total)
            counts = self.total[cells]
        yield from _packed(cells, counts, TaskContext.get().partitionId())


def _packed(cells: np.ndarray, counts: np.ndarray, share: int) -> Iterator[pa.RecordBatch]:
    edges = np.searchsorted(cells, np.arange(0, (int(cells[-1]) if len(cells) else -1) + BLOCK + 1, BLOCK)).tolist()
    for block, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if b > a:
            most = int(counts[a:b].max())
            width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 8
            packed = [(cells[a:b] - block * BLOCK).astype(np.uint16).tobytes(), counts[a:b].astype(f"<u{width}").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((block, share, width, *packed), SCHEMA, strict=True)], schema=SCHEMA)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the parts of each block as they come."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, width, at, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "width", "at", "counts")), strict=True):
            own = sums.setdefault(block, np.zeros(BLOCK, np.int64))
            own[np.frombuffer(at, np.uint16)] += np.frombuffer(counts, f"<u{width}").astype(np.int64)
    for block, own in sorted(sums.items()):
        at = np.flatnonzero(own)
        yield from _packed(at + block * BLOCK, own[at], 0)


def summed(parts: DataFrame, cells: int) -> np.ndarray:
    """The counters over all tasks: ``cells`` numbers, whatever the corpus. parts: rows of SCHEMA."""
    blocks = -(-cells // BLOCK)
    tasks = shuffle_partitions(parts.sparkSession)
    shares = -(-tasks // blocks)
    if shares > 1:
        parts = parts.selectExpr("block", f"pmod(share, {shares}) as share", "width", "at", "counts")
        parts = parts.repartition(tasks, "block", "share").mapInArrow(_add, SQL)
    out = np.zeros(cells, np.int64)
    for r in parts.repartition(min(tasks, blocks), "block").mapInArrow(_add, SQL).collect():
        out[np.frombuffer(r["at"], np.uint16).astype(np.int64) + r["block"] * BLOCK] = np.frombuffer(r["counts"], f"<u{r['width']}")
    return out
