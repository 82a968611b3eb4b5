"""Vectorised word and window hashing over batches of texts, used inside Spark tasks.

Texts are cut into chunks of a bounded number of bytes; each chunk is one flat
byte array, and every hash is a numpy expression over it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1_000_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]

WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
#: ``[^\x20\x09-\x0D]+``
PLAIN_WORD = ~WHITE
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, after lower-casing A-Z
FOLDED_WORD = np.zeros(256, bool)
FOLDED_WORD[48:58] = FOLDED_WORD[97:123] = FOLDED_WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LOWER_BYTES = _LOWER.tobytes()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def tables(n: int) -> list[np.ndarray]:
    """At least ``n`` powers of the base, and of its inverse."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums of byte values times powers of the base, with a leading zero."""
    power = tables(len(data) + 1)[0]
    out = np.empty(len(data) + 1, _U)
    out[0] = 0
    terms = _BYTE[data]
    terms *= power[: len(data)]
    np.cumsum(terms, out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; equal for equal bytes, wherever they stand."""
    out = prefix[end]
    out -= prefix[start]
    out *= tables(len(prefix))[1][start]
    return mix(out)


@dataclass
class Words:
    """The words of some texts: word i of the chunk has hash[i] and stands at start[i]:end[i]; text d has words first[d]:first[d + 1]."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def windows(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; see ``whole`` for which count."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, _U)
        out = self.hash[:n].copy()
        for j in range(1, k):
            out *= _U(_STEP)
            out += self.hash[j : j + n]
        return mix(out)

    def window_counts(self, k: int) -> np.ndarray:
        """How many windows of k words each text has."""
        return np.maximum(np.diff(self.first) - (k - 1), 0)

    def window_starts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Word indices that start a window inside one text, and the index of that text."""
        counts = self.window_counts(k)
        text = np.repeat(np.arange(len(counts)), counts)
        return ramps(self.first[:-1], counts), text


def ramps(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] of them), start[1], ..."""
    total = int(count.sum())
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(start - (np.cumsum(count) - count), count)


def words_of(texts: list[bytes], is_word: np.ndarray, lower: bool) -> Words:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if lower:
        data = _LOWER[data]
    inside = is_word[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    begins = np.concatenate(([0], np.cumsum(lengths)))
    hashes = slice_hash(prefix_hash(data), start, end)
    return Words(hashes, start, end, np.searchsorted(start, begins))


def binary(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(batch: pa.RecordBatch, text: str = "text", size_of: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Slices of a batch: index of the first row, texts as UTF-8, about ``size_of`` bytes each."""
    column = batch.column(text)
    at, held, size = 0, [], 0
    for i in range(0, batch.num_rows, 256):
        for x in binary(column.slice(i, 256)):
            held.append(x)
            size += len(x)
            if size >= size_of:
                yield at, held
                at, held, size = at + len(held), [], 0
    if held:
        yield at, held


def segments(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    step = np.diff(flag.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in starts[i] : starts[i] + width."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.subtract.at(step, starts + width, 1)
    return np.cumsum(step[:-1]) > 0
