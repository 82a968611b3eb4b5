"""A training corpus from the documents: five stages, each written as Parquet and read again.

Stages take (spark, docs, sf_dir). All but the last give the columns of
documents; decisions take effect: rejected documents go, and texts change.

Cases, for every stage: a null text is the empty text to its decisions and stays null
where the document stays; ids may be missing or repeat, and each row is a document of
its own; texts of any length are read whole; extra columns pass by unchanged, whatever
their names; an empty table gives an empty one with the same columns. n_chars, where there
is such a column, follows the text wherever a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm.bpe import encode_decode
from terrafold.llm.decontaminate import automaton_of, without_spans
from terrafold.llm.jaccard_join import superseded
from terrafold.llm.pii import redacted
from terrafold.llm.rows import fresh_name, keyed_table, map_texts
from terrafold.llm.toxicity import scored, train
from terrafold.runtime import materialise, release, ship

#: A document goes when its score is this high.
TOXIC_SCORE = 0.5
#: A document goes when more than this share of its words stands in the benchmark; else only those passages go.
MAX_COVERAGE = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the factorization machine finds toxic.

    Without labels of both classes the score of all is the share of toxic labels. A text
    without words is scored by the bias; scores below TOXIC_SCORE stay.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh_name(docs, "score")
    return scored(docs, model, score).where(F.col(score) < TOXIC_SCORE).drop(score)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that of the smallest id.

    Rows that share an id, or have none, count after each other by row; documents without
    words are in no group and all stay.
    """
    whole, key, keyed = keyed_table(docs)
    gone = superseded(keyed).withColumnRenamed("row_key", key)
    return whole.join(gone, key, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out; drops documents that mostly consist of them.

    Items without a text or an id match nothing; an empty benchmark changes nothing.
    """
    ship(spark)
    shared = spark.sparkContext.broadcast(automaton_of(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return map_texts(docs, lambda: without_spans(shared.value, MAX_COVERAGE))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind: fixed forms, and what their contexts and labels give away."""
    return redacted(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text and the text decoded from them, as digests; a null text has no ids."""
    out = encode_decode(docs, full=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("decontamination", decontamination),
    ("pii", pii),
    ("bpe", bpe),
]

#: A fitted model and ids of a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
