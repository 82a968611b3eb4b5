"""Row keys and word-window exchange shared by the duplicate finders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.runtime import materialise, shuffle_partitions

#: Orders documents without an id after all others.
NO_ID = np.iinfo(np.int64).max


def texts_of(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text, whatever other columns the table has."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def unique_ids(docs: DataFrame) -> bool:
    """Whether each row has an id of its own."""
    return docs.groupBy(F.col("doc_id").alias("id")).count().where("count > 1 or id is null").isEmpty()


def buckets_for(spark: SparkSession, total_bytes: int, each: int) -> int:
    """So many buckets that none holds much over ``each`` bytes; as many as shuffle partitions at least."""
    return max(shuffle_partitions(spark), -(-int(total_bytes) // each))


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def row_keyed(df: DataFrame) -> DataFrame:
    """(row_key, doc_id, text) with a row_key for each row.

    The doc_id serves where it is unique and never null; other tables are
    numbered once and written to the shared folder, so that the numbers hold.
    """
    docs = texts_of(df)
    if unique_ids(docs):
        return docs.select(F.col("doc_id").alias("row_key"), "doc_id", "text")
    return materialise(docs.select(F.monotonically_increasing_id().alias("row_key"), "doc_id", "text"), "rows")


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def keyed_table(df: DataFrame) -> tuple[DataFrame, str, DataFrame]:
    """(table with all columns and a row key, the key's name, its (row_key, doc_id, text)), for stages that pass rows on."""
    key = fresh_name(df, "row_key")
    if unique_ids(df):
        whole = df.withColumn(key, F.col("doc_id").cast("long"))
    else:
        whole = materialise(df.withColumn(key, F.monotonically_increasing_id()), "rows")
    docs = whole.select(F.col(key).alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return whole, key, docs


def map_texts(df: DataFrame, make: Callable[[], Callable[[str | None], str | None]]) -> DataFrame:
    """The rows with their text replaced, in Arrow batches; ``make`` gives the function, once for each task.

    Rows whose text becomes null although it was not are dropped. n_chars, where
    there is such a column, follows the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = make()
        for batch in batches:
            i = batch.schema.get_field_index("text")
            old = batch.column(i).to_pylist()
            new = [change(t) for t in old]
            kept = pa.array([b is not None or a is None for a, b in zip(old, new, strict=True)], pa.bool_())
            yield batch.set_column(i, batch.schema.field(i), pa.array(new, batch.schema.field(i).type)).filter(kept)

    out = df.mapInArrow(run, df.schema)
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType))
    return out
