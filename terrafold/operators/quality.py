"""Data-quality gates: (source, check, ok, bad) rows, one for each rule; nothing is repaired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.operators import rings
from terrafold.sources.sinks import fingerprint


def gates(df: DataFrame, source: str, rules: dict[str, Column]) -> DataFrame:
    """Counts, in one pass, the rows for which a rule is not true; an unknown rule value is a failure."""
    counted = df.agg(*(F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()))
    tall = counted.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("bad")) for n in rules))).alias("r"))
    return tall.select(F.lit(source).alias("source"), "r.check", (F.col("r.bad") == 0).alias("ok"), F.col("r.bad").alias("bad"))


def unique(df: DataFrame, source: str, *keys: str) -> DataFrame:
    bad = df.groupBy(*keys).count().agg(F.count_if(F.col("count") > 1).alias("bad"))
    return bad.select(F.lit(source).alias("source"), F.lit("unique_key").alias("check"), (F.col("bad") == 0).alias("ok"), "bad")


def references(df: DataFrame, dim: DataFrame, source: str, key: str) -> DataFrame:
    """Keys that the dimension does not have."""
    bad = df.select(key).distinct().join(dim.select(key), key, "left_anti").agg(F.count("*").alias("bad"))
    return bad.select(F.lit(source).alias("source"), F.lit(f"known_{key}").alias("check"), (F.col("bad") == 0).alias("ok"), "bad")


def valid_rings(edges: DataFrame) -> DataFrame:
    """For each area: whether its rings close, are three edges or more, and meet themselves nowhere else."""
    return rings.validity(edges)


def sums_match(parts: DataFrame, wholes: DataFrame, source: str, key: str, value: str) -> DataFrame:
    """Wholes that differ from the sum of their parts, exactly; a whole without parts must be zero."""
    summed = parts.groupBy(key).agg(F.sum(value).alias("parts"))
    both = wholes.select(key, F.col(value).alias("whole")).join(summed, key, "full_outer")
    bad = both.agg(F.count_if(~F.coalesce("parts", F.lit(0)).eqNullSafe(F.col("whole"))).alias("bad"))
    return bad.select(F.lit(source).alias("source"), F.lit(f"{key}_sums").alias("check"), (F.col("bad") == 0).alias("ok"), "bad")


def complete(df: DataFrame, universe: DataFrame, source: str, key: str) -> DataFrame:
    """Keys of the universe that the table has no row for."""
    bad = universe.select(key).distinct().join(df.select(key), key, "left_anti").agg(F.count("*").alias("bad"))
    return bad.select(F.lit(source).alias("source"), F.lit(f"every_{key}").alias("check"), (F.col("bad") == 0).alias("ok"), "bad")


def expected_count(df: DataFrame, source: str, check: str, wanted: int) -> DataFrame:
    """How far the number of rows is from the expected one."""
    bad = df.agg(F.abs(F.count("*") - wanted).alias("bad"))
    return bad.select(F.lit(source).alias("source"), F.lit(check).alias("check"), (F.col("bad") == 0).alias("ok"), "bad")


def chronological(df: DataFrame, source: str, period: str, *by: str) -> DataFrame:
    """Months that do not follow the one before by exactly one, within a series."""
    w = Window.partitionBy(*by).orderBy(period)
    steps = df.select(F.months_between(F.col(period), F.lag(period).over(w)).alias("step"))
    bad = steps.agg(F.count_if(F.col("step").isNotNull() & (F.col("step") != 1)).alias("bad"))
    return bad.select(F.lit(source).alias("source"), F.lit("chronological").alias("check"), (F.col("bad") == 0).alias("ok"), "bad")


def pinned_rows(df: DataFrame, source: str, wanted: str) -> DataFrame:
    """Whether a table's fingerprint is the pinned one."""
    bad = fingerprint(df).select(F.when(F.col("fingerprint") == wanted, 0).otherwise(1).cast("long").alias("bad"))
    return bad.select(F.lit(source).alias("source"), F.lit("fingerprint").alias("check"), (F.col("bad") == 0).alias("ok"), "bad")


def outcomes_total(changes: DataFrame, source: str, codes: DataFrame, key: str, outcome: str, known: tuple[str, ...]) -> DataFrame:
    """Codes of a union that have no outcome, more than one, or one of no known name."""
    per = codes.select(key).distinct().join(changes.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col(outcome).isin(*known)).alias("good")), key, "full_outer")
    bad = per.agg(F.count_if(~F.coalesce((F.col("n") == 1) & (F.col("good") == 1), F.lit(False))).alias("bad"))
    return bad.select(F.lit(source).alias("source"), F.lit("one_outcome").alias("check"), (F.col("bad") == 0).alias("ok"), "bad")


#: How a source's freshness may be stated.
FRESHNESS_STATES = ("live", "published", "snapshot", "unavailable")
PRECISIONS = ("day", "month", "year")


def freshness_rules() -> dict[str, Column]:
    """The contract of a source's five freshness fields: closed vocabularies, and a missing date that says so."""
    date, precision = F.col("reference_date"), F.col("precision")
    forms = {"day": "^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "month": "^[0-9]{4}-(0[1-9]|1[0-2])$", "year": "^[0-9]{4}$"}
    fits = F.lit(False)
    for name, form in forms.items():
        fits = fits | ((precision == name) & date.rlike(form))
    return {
        "known_state": F.col("state").isin(*FRESHNESS_STATES),
        "known_precision": precision.isNull() | precision.isin(*PRECISIONS),
        "date_fits_precision": F.when(date.isNull(), precision.isNull()).otherwise(fits),
        "unavailable_has_no_date": (F.col("state") != "unavailable") | date.isNull(),
        "has_publisher": F.trim("publisher") != "",
    }


def manifest(gated: DataFrame, facts: DataFrame) -> DataFrame:
    """One row for each source: its rows, period and verdict, and the checks that failed. facts: source, rows, first, last."""
    per = gated.groupBy("source").agg(F.count("*").alias("checks"), F.count_if(~F.col("ok")).alias("failed"))
    verdict = F.when(F.coalesce("rows", F.lit(0)) == 0, "UNAVAILABLE").when(F.col("failed") > 0, "FAIL").otherwise("PASS")
    return facts.join(per, "source", "left").select("source", "rows", "first", "last", "checks", "failed", verdict.alias("verdict"))
