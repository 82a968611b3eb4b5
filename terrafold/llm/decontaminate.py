"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton holds every substring of every benchmark item; each training text
is streamed through it and the longest match that ends at each word is kept. A
word is hit when it lies in a match of at least ``min_words`` words, or in an
occurrence of a whole item that is shorter than that.

The benchmark is a fixed test set: its automaton goes to the workers with the
task, as flat arrays, after a check of its size (``MAX_BENCHMARK_BYTES``).

Cases: null and empty texts have no words; an item without words matches
nothing; items with equal words are all counted; items are named by item_id, and
the words of an item without one are hit like any other's, but it has no name to
list or count; an empty benchmark hits nothing
and an empty table of documents gives an empty result; texts of any length are
streamed whole; repeated rows each get their count; other columns, whatever their
names, pass by.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm import kernel
from terrafold.llm.rows import texts_of
from terrafold.runtime import ship

MIN_WORDS = 10
#: A benchmark beyond this is refused: while built, it takes the driver about 120 times as many bytes, and flat, each worker about 10 times.
MAX_BENCHMARK_BYTES = 8 << 20

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class _Builder:
    """The automaton while it grows: a dictionary of steps for each state."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[int]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _new(self, length: int, link: int, step: dict[int, int]) -> int:
        self.next.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A copy of q for the matches that end in p and w."""
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, w: int) -> int:
        known = self.next[last].get(w)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, w, known)
        state, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return state


def _ints(values) -> array:
    return array("i", np.asarray(values, np.int32).tobytes())


class Automaton:
    """A generalised suffix automaton in flat arrays, 4 bytes a number; a state knows the items that hold its words.

    The steps of a state stand in order of their word. Suffix links make a tree; its
    states are numbered so that those below a state are a range, hence so are the
    items that end there.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], min_words: int) -> None:
        self.min_words = min_words
        self.vocabulary: dict[bytes, int] = {}
        coded = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]) for name, words in items if words]
        self.names = [name for name, _ in coded]
        built = _Builder()
        for _, words in coded:
            built.add(words)
        self._flatten(built, coded)
        self.short: dict[tuple[int, ...], set[str | None]] = {}
        for name, words in coded:
            if len(words) < min_words:
                self.short.setdefault(tuple(words), set()).add(name)
        self.short_lengths = sorted({len(w) for w in self.short})
        self.shortest = min([min_words, *self.short_lengths])

    def _flatten(self, built: _Builder, coded: list[tuple[str | None, list[int]]]) -> None:
        n = len(built.next)
        self.link, self.length = _ints(built.link), _ints(built.length)
        self.first = _ints(np.cumsum([0, *map(len, built.next)]))
        steps = [pair for step in built.next for pair in sorted(step.items())]
        self.word, self.to = _ints([w for w, _ in steps]), _ints([to for _, to in steps])
        self.root = array("i", bytes(4 * (len(self.vocabulary) + 1)))
        for w, to in built.next[0].items():
            self.root[w] = to
        # below: how many states hang from each; at: its number, those below follow
        by_length = np.argsort(built.length, kind="stable").tolist()
        below, at, free = [1] * n, [0] * n, [0] * n
        for s in reversed(by_length[1:]):
            below[built.link[s]] += below[s]
        free[0] = 1
        for s in by_length[1:]:
            up = built.link[s]
            at[s] = free[up]
            free[up] += below[s]
            free[s] = at[s] + 1
        ends = []
        for item, (_, words) in enumerate(coded):
            state = 0
            for w in words:
                state = built.next[state][w]
                ends.append((at[state], item))
        ends.sort()
        place = np.array([p for p, _ in ends], np.int64)
        self.ending = _ints([item for _, item in ends])
        self.low, self.high = _ints(np.searchsorted(place, at)), _ints(np.searchsorted(place, np.add(at, below)))

    @property
    def array_bytes(self) -> int:
        return sum(4 * len(x) for x in vars(self).values() if isinstance(x, array))

    def _step(self, state: int, w: int) -> int:
        """The state after one more word; 0 where there is none."""
        if not state:
            return self.root[w]
        i = bisect_left(self.word, w, self.first[state], end := self.first[state + 1])
        return self.to[i] if i < end and self.word[i] == w else 0

    def scan(self, words: list[int]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Spans of the hit words, and the items with an occurring window, None for those without a name; words are codes, 0 unknown."""
        spans: list[tuple[int, int]] = []
        names: set[str | None] = set()
        seen: set[int] = set()
        link, length, least = self.link, self.length, self.min_words
        state = matched = 0
        for i, w in enumerate(words):
            to = self._step(state, w)
            while state and not to:
                state = link[state]
                matched = length[state]
                to = self._step(state, w)
            if not to:
                continue
            state, matched = to, matched + 1
            if matched >= least:
                begin = i - matched + 1
                if spans and spans[-1][1] >= begin:
                    spans[-1] = (min(begin, spans[-1][0]), i + 1)
                else:
                    spans.append((begin, i + 1))
                holder = state
                while length[link[holder]] >= least:
                    holder = link[holder]
                if holder not in seen:
                    seen.add(holder)
                    names.update(self.names[k] for k in set(self.ending[self.low[holder] : self.high[holder]]))
            for n in self.short_lengths:
                if n <= matched and (own := self.short.get(tuple(words[i + 1 - n : i + 1]))):
                    spans.append((i + 1 - n, i + 1))
                    names |= own
        return spans, names


def _runs_known(codes: list[int], least: int) -> list[tuple[int, int]]:
    """Runs of at least ``least`` words that the benchmark has; only there can a window match."""
    known = np.fromiter(codes, np.int64, len(codes)) > 0
    a, b = kernel.segments(known)
    keep = b - a >= least
    return list(zip(a[keep].tolist(), b[keep].tolist(), strict=True))


def _hits(automaton: Automaton, raw: bytes) -> tuple[int, np.ndarray | None, set[str | None], list[bytes]]:
    words = _WORD.findall(raw.translate(kernel.LOWER_BYTES))
    known = automaton.vocabulary.get
    codes = [known(w, 0) for w in words]
    hit, names = None, set()
    for a, b in _runs_known(codes, automaton.shortest):
        spans, some = automaton.scan(codes[a:b])
        if spans:
            hit = np.zeros(len(words), bool) if hit is None else hit
            names |= some
            for s, e in spans:
                hit[a + s : a + e] = True
    return len(words), hit, names, words


def automaton_of(benchmark: DataFrame, min_words: int = MIN_WORDS) -> Automaton:
    """The automaton of a benchmark (item_id, text), whose size is checked first."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MAX_BENCHMARK_BYTES:
        raise ValueError(f"the benchmark has {size} bytes; at most {MAX_BENCHMARK_BYTES} go to each task")
    rows = items.where("text is not null").collect()
    return Automaton([(r.item_id, _WORD.findall(r.text.encode().translate(kernel.LOWER_BYTES))) for r in rows], min_words)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string()))])
_SQL = "doc_id long, n_words long, n_hit long, items array<string>"


def contamination(documents: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per document: its words, how many are hit, and the named items with occurring windows, sorted."""
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(automaton_of(benchmark, min_words))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            n, hit, items = [], [], []
            for _, texts in kernel.chunks(batch):
                for raw in texts:
                    count, mask, names, _ = _hits(automaton, raw)
                    n.append(count)
                    hit.append(0 if mask is None else int(mask.sum()))
                    items.append(sorted(names - {None}))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, f.type) for x, f in zip((n, hit, items), list(_SCHEMA)[1:], strict=True))], schema=_SCHEMA)

    return texts_of(documents).mapInArrow(scan, _SQL)


def without_spans(automaton: Automaton, max_coverage: float) -> Callable[[str | None], str | None]:
    """A function of a text: the text without hit spans; None where more than max_coverage of its words are hit.

    A span runs from its first hit word to its last and goes with the characters between.
    """

    def clean(text: str | None) -> str | None:
        raw = (text or "").encode()
        n, hit, _, _ = _hits(automaton, raw)
        if hit is None:
            return text
        if hit.sum() > max_coverage * n:
            return None
        places = [m.span() for m in _WORD.finditer(raw.translate(kernel.LOWER_BYTES))]
        left, at = [], 0
        for a, b in zip(*kernel.segments(hit), strict=True):
            left.append(raw[at : places[a][0]])
            at = places[b - 1][1]
        return b"".join([*left, raw[at:]]).decode()

    return clean


def op7_suffix_automaton(spark, sf_dir: str) -> DataFrame:
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
