"""What each quality filter does in every order of the filters.

Each document gets a mask of the filters that it fails; equal documents of a part meet in
one cell (part, mask, labels) before anything else happens, so a part has a few dozen
cells however many documents it has. The cells are unpivoted against the steps of all
orders; a running bit-or over the earlier steps says what was removed before, conditional
sums give the counts of a step, and a window over a filter's rows its Shapley total.

Texts are read once and never shuffled. Identical texts meet by their digest, summed in
the tasks first, and the smallest id of a digest comes from a window over those sums: a
text that a third of all documents share has one row for each part and pair of labels.

Cases: null is the empty text, equal to other empty texts; a null language is the part ''.
Documents that share the smallest id of a text are all first; documents without an id come
after all that have one, and none of them is first where another holder has an id. Several
labels of a document count once (any toxic, any good one); documents without labels are
neither. Extra columns, whatever their names, are not read; an empty table has no part and
gives no row.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: A: least words. B: least distinct words in a hundred. C: most capitals in a hundred. D: symbols that a text may not hold.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 100, 80, 10, "[#$%&*|]"
_WORD = r"[^\x20\x09-\x0D]+"


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def failed(documents: DataFrame) -> DataFrame:
    """(doc_id, part, text_key, mask) for each document; the mask has the filters A to D."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))
    measured = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text")).select(
        "doc_id",
        "part",
        F.unhex(F.sha2("text", 256)).alias("text_key"),
        F.length("text").cast("long").alias("chars"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("capitals"),
        F.col("text").rlike(SYMBOLS).alias("symbols"),
        F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("distinct")))[0].alias("words"),
    )
    fails = {
        "A": F.col("words.n") < LEAST_WORDS,
        "B": 100 * F.col("words.distinct") < LEAST_DISTINCT * F.col("words.n"),
        "C": 100 * F.col("capitals") > MOST_CAPITALS * F.col("chars"),
        "D": F.col("symbols"),
    }
    mask = sum((F.when(c, bit(x)).otherwise(0) for x, c in fails.items()), F.lit(0))
    return measured.select("doc_id", "part", "text_key", mask.cast("int").alias("mask"))


def cells(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents that fail just the filters of a mask, all five among them."""
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    marked = failed(documents).join(marks, "doc_id", "left").select("doc_id", "part", "text_key", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    alike = ["text_key", "part", "mask", "good", "toxic"]
    by_id = marked.groupBy("doc_id", *alike).agg(F.count("*").alias("n"))
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    held = by_id.groupBy(*alike).agg(F.sum("n").alias("n"), F.min(named).alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("text_key"))
    n_first = F.when(first.isNull(), F.col("n")).when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0)
    either = F.array(F.struct("mask", F.col("n_first").alias("n")), F.struct((F.col("mask") + bit("E")).alias("mask"), (F.col("n") - F.col("n_first")).alias("n")))
    split = held.withColumn("n_first", n_first).select("part", "good", "toxic", F.explode(either).alias("cell")).select("part", "good", "toxic", "cell.mask", "cell.n")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), _sum_where("good").alias("good"), _sum_where("toxic").alias("toxic"))


def _sum_where(condition: Column | str) -> Column:
    return F.sum(F.when(condition if isinstance(condition, Column) else F.col(condition), F.col("n")).otherwise(0))


def interactions(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step of that order."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = (
        cells(documents, labels)
        .withColumn("filter_order", F.explode(F.lit(orders)))
        .select("*", F.posexplode(F.split("filter_order", "")).alias("place", "filter"))
        .withColumn("step", (F.col("place") + 1).cast("int"))
        .withColumn("own", F.expr("shiftleft(1, ascii(filter) - ascii('A'))"))
    )
    # The window's running bit-or is over what the mask fails at each step, so one cell has five rows.
    before = Window.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    hit = F.col("mask").bitwiseAND(F.col("own"))
    seen = steps.withColumn("hit", hit).withColumn("earlier", F.coalesce(F.bit_or("hit").over(before), F.lit(0)))
    here = (F.col("hit") != 0) & (F.col("earlier") == 0)
    by_step = seen.groupBy("part", "filter_order", "step", "filter").agg(
        _sum_where((F.col("hit") == 0) & (F.col("earlier") == 0)).alias("kept"),
        _sum_where(here).alias("removed"),
        _sum_where((F.col("hit") != 0) & (F.col("earlier") != 0)).alias("redundant"),
        _sum_where(F.col("mask") == F.col("own")).alias("unique_fails"),
        F.sum(F.when(here, F.col("good")).otherwise(0)).alias("good_lost"),
        F.sum(F.when(here, F.col("toxic")).otherwise(0)).alias("toxic_lost"),
    )
    return by_step.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def op11_filter_interaction_audit(spark, sf_dir: str) -> DataFrame:
    out = interactions(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.drop("filter")
