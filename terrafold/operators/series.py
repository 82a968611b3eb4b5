"""Monthly series: comparisons that abstain by name instead of guessing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def year_over_year(series: DataFrame, period: str, value: str) -> DataFrame:
    """Change against the same month a year before; that very month or none."""
    prior = series.select(F.add_months(period, 12).alias(period), F.col(value).alias("prior"), F.lit(True).alias("known"))
    both = series.join(prior, period, "left")
    state = F.when(F.col(value).isNull(), "CURRENT_MISSING").when(F.col("known").isNull(), "NO_PRIOR_MONTH").when(F.col("prior").isNull(), "PRIOR_MISSING").when(F.col("prior") == 0, "PRIOR_ZERO").otherwise("AVAILABLE")
    return both.select(period, value, "prior", state.alias("state"), F.when(state == "AVAILABLE", (F.col(value) - F.col("prior")) * 100.0 / F.col("prior")).alias("pct"))


def against_previous_month(df: DataFrame, month: str, key: str, value: str) -> DataFrame:
    """Each key of a month or the one before it: SHARED, NEWLY_PRESENT or NO_LONGER_PRESENT. The series' ends have no neighbour and give nothing."""
    now = df.select(month, key, F.col(value).alias("now"))
    before = df.select(F.add_months(month, 1).alias(month), key, F.col(value).alias("before"))
    months = df.select(month).distinct()
    both = now.join(before, [month, key], "full_outer").join(months, month, "left_semi").join(months.select(F.add_months(month, 1).alias(month)), month, "left_semi")
    state = F.when(F.col("before").isNull(), "NEWLY_PRESENT").when(F.col("now").isNull(), "NO_LONGER_PRESENT").otherwise("SHARED")
    return both.select(month, key, "now", "before", state.alias("state"), (F.col("now") - F.col("before")).alias("change"))


def trend(series: DataFrame, period: str, value: str, last: int, *by: str) -> DataFrame:
    """The last rows of a series with the least and the most of them; gaps stay gaps."""
    recent = series.withColumn("back", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(period)))).where(F.col("back") <= last)
    w = Window.partitionBy(*by)
    return recent.select(*by, period, value, F.min(value).over(w).alias("least"), F.max(value).over(w).alias("most"), (F.count(value).over(w) < F.count("*").over(w)).alias("has_gaps"))


def first_of_duplicates(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("nth = 1").drop("nth")


def gaps(df: DataFrame, date: str, *by: str) -> DataFrame:
    """Months between neighbouring distinct dates."""
    return df.select(*by, date).distinct().withColumn("months", F.months_between(date, F.lag(date).over(Window.partitionBy(*by).orderBy(date))))


def inverted(df: DataFrame, order: str, date: str, *by: str) -> DataFrame:
    """Rows whose date lies before the date of an earlier row."""
    before = F.max(date).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("latest_before", before).where(F.col(date) < F.col("latest_before"))
