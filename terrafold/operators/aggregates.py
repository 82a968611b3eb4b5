"""Counts, ratios, quantiles and states of groups. Zero, missing and withheld stay three things."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zero_filled(counts: DataFrame, vocabulary: list[str], key: str, value: str = "n") -> DataFrame:
    """Every term of a closed vocabulary, with its count or zero."""
    terms = counts.sparkSession.createDataFrame([(v,) for v in vocabulary], f"{key} string")
    return terms.join(counts, key, "left").select(key, F.coalesce(value, F.lit(0).cast("long")).alias(value))


def weighted_mean(value: str, weight: str) -> list[Column]:
    """mean weighted by observations, their sum, and whether there are any."""
    held = F.when(F.col(weight) > 0, F.col(weight))
    total = F.sum(held)
    return [(F.sum(F.col(value) * held) / total).alias("mean"), F.coalesce(total, F.lit(0).cast("long")).alias("observations"), F.when(total > 0, "OBSERVED").otherwise("NONE").alias("evidence")]


def ratio_state(numerator: Column, denominator: Column, per: float = 1000.0) -> tuple[Column, Column]:
    """(ratio, state): abstains on a missing or negative numerator and on a missing or empty denominator."""
    state = F.when(numerator.isNull(), "NUMERATOR_MISSING").when(numerator < 0, "NUMERATOR_INVALID").when(denominator.isNull(), "DENOMINATOR_MISSING").when(denominator <= 0, "DENOMINATOR_EMPTY").otherwise("AVAILABLE")
    return F.when(state == "AVAILABLE", numerator * per / denominator), state


def values_at(df: DataFrame, value: str, places: dict[str, Column], *by: str) -> DataFrame:
    """For each group the values at places of its sorted rows; a place counts from 0 and may use ``total``, the rows of the group.

    Equal values are counted first and only running sums are kept, so no group is held as a list.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("rows_"))
    own = Window.partitionBy(*by)
    steps = counts.withColumns({"upto": F.sum("rows_").over(own.orderBy(value)), "total": F.sum("rows_").over(own)})
    return steps.groupBy(*by).agg(*(F.min(F.when(F.col("upto") > place, F.col(value))).alias(name) for name, place in places.items()))


def nearest_rank(p: float) -> Column:
    """The place round(p (n - 1)), halves up."""
    return F.floor(F.lit(p) * (F.col("total") - 1) + 0.5)


def class_break(k: int, classes: int = 5) -> Column:
    """The place ceil(k n / classes), the last row beyond the end."""
    return F.least(F.ceil(F.col("total") * F.lit(k / classes)), F.col("total") - 1)


def break_class(value: Column, cuts: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c <= value))


def distribution(value: str) -> list[Column]:
    return [F.count(value).alias("n"), F.min(value).alias("least"), F.percentile(value, 0.1).alias("p10"), F.median(value).alias("median"), F.percentile(value, 0.9).alias("p90"), F.max(value).alias("most"), F.avg(value).alias("mean"), (F.stddev_pop(value) / F.avg(value)).alias("cv")]


def average_rank(value: str, *by: str) -> Column:
    """Rank from 1, ties share their mean."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def spearman(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    ranked = df.select(*by, average_rank(x, *by).alias("rx"), average_rank(y, *by).alias("ry"))
    product = F.avg(F.col("rx") * F.col("ry")) - F.avg("rx") * F.avg("ry")
    rho = F.try_divide(product, F.stddev_pop("rx") * F.stddev_pop("ry"))  # null where all are equal
    return ranked.groupBy(*by).agg(rho.alias("rho"), F.avg(F.abs(F.col("rx") - F.col("ry"))).alias("mean_shift"), F.max(F.abs(F.col("rx") - F.col("ry"))).alias("max_shift"))


def min_max(value: str, *by: str) -> Column:
    """To 0..1 within a group; one half where all are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high == low, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - low) / (high - low))))


def oldest_date(date: str, precision: str) -> Column:
    """The oldest of the dates; one missing date makes it missing. A month stands on its first day and wins ties against a day."""
    return F.when(F.count_if(F.col(date).isNull()) > 0, None).otherwise(F.min(F.struct(F.col(date).alias("d"), F.when(F.col(precision) == "month", 0).otherwise(1).alias("rank")))["d"])


#: States from best to worst.
STATUS_ORDER = ("live", "published", "snapshot", "unavailable")


def worst_status(status: str) -> Column:
    order = F.array(*map(F.lit, STATUS_ORDER))
    return F.element_at(order, F.max(F.array_position(order, F.col(status))).cast("int"))


def multiplicity(value: str) -> Column:
    """Verdict on the rows of a key; they are never summed."""
    return F.when(F.count("*") == 1, "SINGLE").when(F.count_distinct(value) == F.count("*"), "DISTINCT").otherwise("UNRESOLVED")


def rollup_levels(df: DataFrame, value: str, levels: list[str]) -> DataFrame:
    """Sums at each level of a hierarchy, from the finest list to the whole, with the level's name."""
    named = F.lit("ALL")
    for c in reversed(levels):
        named = F.when(F.grouping(c) == 0, c).otherwise(named)
    order = levels[::-1]
    return df.rollup(*order).agg(F.sum(value).alias(value), named.alias("level"))


def missing_months(df: DataFrame, period: str, *by: str) -> DataFrame:
    """Months without a row between the first and the last of a group, and months with several."""
    span = df.groupBy(*by).agg(F.min(period).alias("a"), F.max(period).alias("b")).select(*by, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias(period))
    held = df.groupBy(*by, period).agg(F.count("*").alias("rows"))
    return span.join(held, [*by, period], "left").withColumn("problem", F.when(F.col("rows").isNull(), "MISSING").when(F.col("rows") > 1, "DUPLICATE")).where("problem is not null").select(*by, period, "problem")


def mean_at_key(df: DataFrame, values: str, at: str, *by: str) -> DataFrame:
    """Mean and number of the finite samples that a map column has at a key; NONE and no mean without any."""
    v = F.try_element_at(F.col(values), F.lit(at))
    held = F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v)
    return df.groupBy(*by).agg(F.avg(held).alias("mean"), F.count(held).alias("samples"), F.when(F.count(held) > 0, "MODEL_DERIVED").otherwise("NONE").alias("evidence"))


def composition(a: str, b: str) -> tuple[Column, Column, Column]:
    """(state, share of a, share of b) in whole percent of a + b; abstains where a part is missing or nothing is there."""
    total = F.col(a) + F.col(b)
    state = F.when(total.isNull(), "CURRENT_MISSING").when(total <= 0, "NOTHING_TO_SHARE").otherwise("AVAILABLE")
    share = lambda c: F.when(state == "AVAILABLE", F.floor(F.col(c) * 100.0 / total + 0.5))
    return state, share(a), share(b)


def newest(df: DataFrame, date: str, key: str, most: int) -> DataFrame:
    """The newest rows, ties by the smaller key, with their place from 1; ``most`` of them."""
    top = df.orderBy(F.desc(date), key).limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc(date), key)))  # so few rows are left
