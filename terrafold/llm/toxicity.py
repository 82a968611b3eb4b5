"""Toxicity scores from a factorization machine over hashed terms.

Terms are words (letters, digits and everything beyond ASCII; A-Z lower-cased)
hashed to TERM_CELLS cells. A factorization machine is fitted over the presence of
every cell that LEAST_ROWS labelled rows hold: a weight for each, and FACTORS
numbers for each whose products weigh every pair, so that an insult beside a
mention of a group can count for more, or less, than both alone. Pairs count as
their mean over a text, so that long texts do not outweigh the rest.

The fit runs over all rows of the sample at once, as sums over the sparse pairs of
row and cell. Weights start; a weight stays zero unless its gradient stands NOISE
standard deviations out of what chance gives a cell as frequent. Factors follow,
by gradients that are held back in the same way, so that what grows is what many
rows share and not what one row has; a share of the rows is kept apart meanwhile,
and factors stay as they were when its loss was least, or out if they do not help.
Weights are then fitted beside them once more, and last without being held back.

The fit uses at most MAX_TRAINING_ROWS labelled rows, those of the smallest
hashes of their id, and of these as many as have MAX_TRAINING_TERMS distinct terms
in all; a labelled row of more than MAX_ROW_TERMS terms is no example, so that no single
text takes the place of many; the rows held out (crc32 of the id as text is 0 modulo 5) are never among
them. Only the text is an input of a score.

Cases: null is the empty text, scored by the bias alone; a term counts once
however often it occurs; without labelled rows of both classes, every score is
the share of toxic rows (0 without rows); rows and labels that share an id count
each; labels other than 0 and 1, or null, or without an id are left out; texts of any
length are read whole; an empty table gives an empty result; columns of any other
name pass by, and the score stands under a name that the caller picks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.llm import kernel
from terrafold.llm.rows import texts_of
from terrafold.runtime import materialise, ship

TERM_CELLS = 1 << 22
MAX_TRAINING_ROWS = 20_000
MAX_TRAINING_TERMS = 2_000_000
MAX_ROW_TERMS = 50_000
#: Labelled rows that must hold a cell.
LEAST_ROWS = 5
FACTORS = 4
ROUNDS = {"weights": 60, "factors": 80, "last": 60}
#: Standard deviations by which a gradient must stand out of chance, for weights and for factors.
NOISE = (2.5, 2.0)
#: One row in so many is kept apart while factors grow.
APART = 6

_U = np.uint64


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no fit may see."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass
class Terms:
    """Texts as sparse rows of 0 and 1: text[i] holds feature[i]; n texts."""

    feature: np.ndarray
    text: np.ndarray
    n: int

    def rows(self, kept: np.ndarray) -> Terms:
        """The texts whose flag is set."""
        place, own = np.cumsum(kept) - 1, kept[self.text]
        return Terms(self.feature[own], place[self.text[own]], int(kept.sum()))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class FactorizationMachine:
    """bias + sum of weights + mean over pairs of factor products, over the known cells of a text; cells in order."""

    cells: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    places: np.ndarray | None = None

    def sums(self, x: Terms) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the factors of each text, one over its number of features)."""
        both = np.stack([np.bincount(x.text, self.factors[x.feature, j], x.n) for j in range(FACTORS)], 1)
        return both, 1 / np.maximum(np.bincount(x.text, minlength=x.n), 1)

    def margin(self, x: Terms) -> np.ndarray:
        out = self.bias + np.bincount(x.text, self.weights[x.feature], x.n)
        if not self.factors.any():
            return out
        both, share = self.sums(x)
        own = np.bincount(x.text, (self.factors**2).sum(1)[x.feature], x.n)
        return out + 0.5 * share * ((both**2).sum(1) - own)

    def scores(self, x: Terms) -> np.ndarray:
        return _sigmoid(self.margin(x))

    def loss(self, x: Terms, y: np.ndarray) -> float:
        p = np.clip(self.scores(x), 1e-9, 1 - 1e-9)
        return float(-np.where(y, np.log(p), np.log(1 - p)).mean())

    def features(self, cells: np.ndarray, text: np.ndarray, n: int) -> Terms:
        """Distinct cells of some texts as features; unknown cells go."""
        at = self._places()[cells]
        known = at >= 0
        return Terms(at[known].astype(np.int64), text[known], n)

    def _places(self) -> np.ndarray:
        """Cell -> feature, -1 for none; made once where it is used."""
        if self.places is None:
            self.places = np.full(TERM_CELLS, -1, np.int32)
            self.places[self.cells] = np.arange(len(self.cells))
        return self.places

    @classmethod
    def fit(cls, cells: np.ndarray, text: np.ndarray, y: np.ndarray, seed: int = 7) -> FactorizationMachine:
        """cells, text: the distinct cells of the rows; y: the label of each row."""
        rate = float(y.mean()) if len(y) else 0.0
        prior = float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6)))
        known, own, rows = np.unique(cells, return_inverse=True, return_counts=True)
        frequent = (rows >= LEAST_ROWS) & (0 < rate < 1)
        kept = frequent[own]
        x = Terms((np.cumsum(frequent) - 1)[own[kept]], text[kept].astype(np.int64), len(y))
        known = known[frequent].astype(np.int64)
        del own, kept
        machine = cls(known, prior, np.zeros(len(known)), np.zeros((len(known), FACTORS)))
        if not len(known):
            return machine
        machine._fit_weights(x, y, ROUNDS["weights"], NOISE[0])
        apart = np.arange(len(y)) % APART == 0
        machine._fit_factors(x.rows(~apart), y[~apart], x.rows(apart), y[apart], seed)
        if machine.factors.any():  # beside pairs, other weights can matter
            machine._fit_weights(x, y, ROUNDS["weights"], NOISE[0])
        machine._fit_weights(x, y, ROUNDS["last"], 0.0)
        return machine

    def _fit_weights(self, x: Terms, y: np.ndarray, rounds: int, noise: float) -> None:
        """Adam on the log loss; without ``noise`` only weights that are not zero move."""
        rows = np.bincount(x.feature, minlength=len(self.weights))
        hold = noise * np.sqrt(rows * y.mean() * (1 - y.mean())) / x.n
        free = np.ones(len(rows), bool) if noise else self.weights != 0
        start, self.weights = self.bias, np.append(self.weights, 0.0)  # the bias is a last weight of every row
        hold, free = np.append(hold, 0.0), np.append(free, True)
        mean, square = np.zeros(len(hold)), np.zeros(len(hold))
        pairs = self.margin(x) - start - np.bincount(x.text, self.weights[x.feature], x.n)
        for t in range(1, rounds + 1):
            margin = start + self.weights[-1] + pairs + np.bincount(x.text, self.weights[x.feature], x.n)
            error = (_sigmoid(margin) - y) / x.n
            g = np.append(np.bincount(x.feature, error[x.text], len(rows)), error.sum()) * free + (0.0 if noise else 1e-5 * self.weights)
            mean += 0.1 * (g - mean)
            square += 0.01 * (g * g - square)
            rate = 0.1 / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
            moved = self.weights - rate * mean / (1 - 0.9**t)
            self.weights = np.sign(moved) * np.maximum(np.abs(moved) - rate * hold, 0) * free
        self.bias, self.weights = start + float(self.weights[-1]), self.weights[:-1]

    def _fit_factors(self, x: Terms, y: np.ndarray, apart: Terms, y_apart: np.ndarray, seed: int) -> None:
        """Gradient steps whose largest row has a given length; the factors of the least loss apart stay."""
        best = (self.loss(apart, y_apart) if apart.n else 0.0) - 1e-4, self.factors
        size = self.factors.shape
        self.factors = np.random.default_rng(seed).normal(0, 0.01, size)
        mean, base = np.zeros(size), 1e-12
        for t in range(1, ROUNDS["factors"] + 1):
            both, share = self.sums(x)
            error = (self.scores(x) - y) / x.n * share
            g = np.stack([np.bincount(x.feature, (error * both[:, j])[x.text], size[0]) for j in range(FACTORS)], 1)
            g -= self.factors * np.bincount(x.feature, error[x.text], size[0])[:, None]
            chance = np.sqrt(np.bincount(x.feature, (error**2 * (both**2).sum(1))[x.text], size[0]))
            g *= np.maximum(0, 1 - NOISE[1] * chance / (np.sqrt((g**2).sum(1)) + 1e-300))[:, None]
            mean += 0.2 * (g - mean)
            length = np.sqrt((mean**2).sum(1)).max()
            base = max(base, length)
            step = 0.3 * min(1.0, 2 * (1 - t / ROUNDS["factors"]) + 0.05) * min(1.0, length / base) / max(length, 1e-12)
            self.factors = self.factors * 0.999 - step * mean
            if t % 10 == 0 and apart.n and (now := self.loss(apart, y_apart)) < best[0]:
                best = now, self.factors
        self.factors = best[1]


def distinct_cells(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(cells, text): the distinct cells of each text, in order."""
    words = kernel.words_of(texts, kernel.FOLDED_WORD, lower=True)
    text = np.repeat(np.arange(len(texts), dtype=_U), np.diff(words.first))
    both = np.unique(text << _U(32) | words.hash & _U(TERM_CELLS - 1))
    return (both & _U(0xFFFFFFFF)).astype(np.int64), (both >> _U(32)).astype(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in kernel.chunks(batch):
            cells, text = distinct_cells(texts)
            edges = np.searchsorted(text, np.arange(len(texts) + 1))
            packed = [cells[a:b].astype(np.int32).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), batch.column("toxic").slice(at, len(texts)), pa.array(np.diff(edges)), pa.array(packed, pa.binary())], names=["doc_id", "toxic", "n", "cells"])


def sample_of(documents: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS, most_terms: int = MAX_TRAINING_TERMS) -> DataFrame:
    """(toxic, cells): the labelled rows that a fit may use, with their distinct cells packed.

    Rows stand in order of the hash of their id; ``most`` rows are taken, then those
    whose terms, added up in that order, come to ``most_terms`` at most. Rows of more than
    MAX_ROW_TERMS, or than fit at all, are passed over, and the next ones take their place.
    """
    ship(documents.sparkSession)
    marks = labels.where(~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("toxic")]
    # at most ``most`` ids and labels: they go to each task
    wanted = texts_of(documents).join(F.broadcast(marks.orderBy(*order).limit(most)), "doc_id")
    found = wanted.select("doc_id", "toxic", "text").mapInArrow(_features, "doc_id long, toxic int, n long, cells binary").where(F.col("n") <= min(MAX_ROW_TERMS, most_terms))
    rows = materialise(found.withColumns({"row": F.monotonically_increasing_id(), "same": F.xxhash64("cells")}), "features")
    # rows that share an id can still be more than ``most``; only their sizes come to one task
    sizes = rows.select("row", "doc_id", "toxic", "same", "n").orderBy(*order, "same", "row").limit(most)
    before = Window.orderBy(*order, "same", "row").rowsBetween(Window.unboundedPreceding, 0)
    taken = sizes.withColumns({"so_far": F.sum("n").over(before), "place": F.row_number().over(before)}).where(F.col("so_far") <= most_terms)
    return rows.select("row", "cells", "toxic").join(F.broadcast(taken.select("row", "place")), "row").orderBy("place").select("toxic", "cells")


def train(documents: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> FactorizationMachine:
    """The machine fitted on at most ``most`` labelled rows."""
    sample = sample_of(documents, labels, most).collect()
    toxic = np.array([r.toxic == 1 for r in sample], bool)
    counts = [len(r.cells) // 4 for r in sample]
    cells = np.frombuffer(b"".join(r.cells for r in sample), np.int32)
    del sample
    return FactorizationMachine.fit(cells, np.repeat(np.arange(len(counts), dtype=np.int32), counts), toxic)


def scored(documents: DataFrame, model: FactorizationMachine, name: str = "score") -> DataFrame:
    """The documents, all their columns, with the score of their text under ``name``."""
    spark = documents.sparkSession
    ship(spark)
    # features without weight and factors only count in the number of features, so all go along
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = [own.scores(own.features(*distinct_cells(texts), len(texts))) for _, texts in kernel.chunks(batch)]
            yield batch.append_column(name, pa.array(np.concatenate(scores) if scores else [], pa.float64()))

    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField(name, T.DoubleType())]))


def op10_factorization_toxicity(spark, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = scored(texts_of(documents), train(documents, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
