"""Audits: pairs of editions by two row policies, reprojections against an authority, coverage, and series that must be whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.functions.text import cosmetic_key

OUTCOMES = ("NEW", "ABSENT", "CAUSE_UNRESOLVED", "QUANTITY_CHANGE", "NO_CHANGE")


def _membership(a: str, b: str, else_: Column) -> Column:
    return F.when(F.col(a).isNull(), "NEW").when(F.col(b).isNull(), "ABSENT").otherwise(else_)


def row_preserving_audit(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(code, outcome, cosmetic_only, previous_rows, current_rows) of rows (code, situation, row, name, quantity): all rows count.

    Rows of a code correspond by their situation, if each stands once in either edition;
    where one is repeated or has no counterpart, no cause is read from the difference. A name
    that differs only in case, accents or blanks is cosmetic, if nothing else changed.
    """
    side = lambda df, p: df.groupBy("code", "situation").agg(F.count("*").alias(f"{p}_n"), F.max("quantity").alias(f"{p}_quantity"), F.max("name").alias(f"{p}_name"))
    both = side(previous, "a").join(side(current, "b"), ["code", "situation"], "full_outer")
    matched = (F.col("a_n") == 1) & (F.col("b_n") == 1)
    other_name = ~F.col("a_name").eqNullSafe(F.col("b_name"))
    per = both.groupBy("code").agg(
        F.sum("a_n").alias("a"), F.sum("b_n").alias("b"),
        F.count_if(~F.coalesce(matched, F.lit(False))).alias("unmatched"),
        F.count_if(matched & ~F.col("a_quantity").eqNullSafe(F.col("b_quantity"))).alias("changed"),
        F.count_if(matched & other_name).alias("renamed"),
        F.count_if(matched & other_name & cosmetic_key(F.col("a_name")).eqNullSafe(cosmetic_key(F.col("b_name")))).alias("cosmetic"),
    )
    outcome = _membership("a", "b", F.when(F.col("unmatched") > 0, "CAUSE_UNRESOLVED").when(F.col("changed") > 0, "QUANTITY_CHANGE").otherwise("NO_CHANGE"))
    only = (outcome == "NO_CHANGE") & (F.col("renamed") > 0) & (F.col("renamed") == F.col("cosmetic"))
    none = F.lit(0).cast("long")
    return per.select("code", outcome.alias("outcome"), only.alias("cosmetic_only"), F.coalesce("a", none).alias("previous_rows"), F.coalesce("b", none).alias("current_rows"))


def first_row_audit(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(code, outcome, cosmetic_only): the older policy, which reads the first row of a code and no other. For audits only."""
    side = lambda df, p: df.groupBy("code").agg(F.min_by(F.struct("quantity", "name"), "row").alias(p))
    both = side(previous, "a").join(side(current, "b"), "code", "full_outer")
    changed = ~F.col("a.quantity").eqNullSafe(F.col("b.quantity"))
    outcome = _membership("a", "b", F.when(changed, "QUANTITY_CHANGE").otherwise("NO_CHANGE"))
    only = (outcome == "NO_CHANGE") & ~F.col("a.name").eqNullSafe(F.col("b.name")) & cosmetic_key(F.col("a.name")).eqNullSafe(cosmetic_key(F.col("b.name")))
    return both.select("code", outcome.alias("outcome"), only.alias("cosmetic_only"))


def reconciled(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(code, legacy, production, legacy_cosmetic, production_cosmetic, diverges): both audits beside each other, code by code."""
    old = first_row_audit(previous, current).select("code", F.col("outcome").alias("legacy"), F.col("cosmetic_only").alias("legacy_cosmetic"))
    new = row_preserving_audit(previous, current).select("code", F.col("outcome").alias("production"), F.col("cosmetic_only").alias("production_cosmetic"))
    differs = (F.col("legacy") != F.col("production")) | (F.col("legacy_cosmetic") != F.col("production_cosmetic")) | (F.col("production") == "CAUSE_UNRESOLVED")
    return old.join(new, "code").withColumn("diverges", differs)


def audit_counts(both: DataFrame) -> DataFrame:
    """(audit, outcome, codes, cosmetic, diverging) of all outcomes, those with no code too."""
    of = lambda audit: F.struct(F.lit(audit).alias("audit"), F.col(audit).alias("outcome"), F.col(f"{audit}_cosmetic").alias("cosmetic"))
    tall = both.select(F.explode(F.array(of("legacy"), of("production"))).alias("r"), "diverges")
    counted = tall.groupBy("r.audit", "r.outcome").agg(F.count("*").alias("codes"), F.count_if("r.cosmetic").alias("cosmetic"), F.count_if("diverges").alias("diverging"))
    every = both.sparkSession.createDataFrame([(a, o) for a in ("legacy", "production") for o in OUTCOMES], "audit string, outcome string")
    none = F.lit(0).cast("long")
    return every.join(counted, ["audit", "outcome"], "left").select("audit", "outcome", *(F.coalesce(c, none).alias(c) for c in ("codes", "cosmetic", "diverging")))


def reprojection_check(ours: DataFrame, theirs: DataFrame, tolerance: float) -> DataFrame:
    """(code, vertices, deviation, state) of vertices (code, x, y) against an authority's own reprojection of them.

    Vertices of a code correspond by their place in order of x and y, as multisets, and the deviation is
    the largest of either axis. NOT_COMPARED where the authority lacks the code or has
    another number of vertices; else WITHIN or BEYOND the tolerance.
    """
    w = Window.partitionBy("code").orderBy("x", "y")
    side = lambda df, p: df.select("code", "x", "y", F.row_number().over(w).alias("place")).select("code", "place", F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
    both = side(ours, "a").join(side(theirs, "b"), ["code", "place"], "full_outer")
    apart = F.greatest(F.abs(F.col("ax") - F.col("bx")), F.abs(F.col("ay") - F.col("by")))
    per = both.groupBy("code").agg(F.count("ax").alias("vertices"), F.count("bx").alias("authority"), F.max(apart).alias("deviation"))
    own = per.where("vertices > 0")
    state = F.when(F.col("vertices") != F.col("authority"), "NOT_COMPARED").when(F.col("deviation") <= tolerance, "WITHIN").otherwise("BEYOND")
    return own.select("code", "vertices", F.when(state != "NOT_COMPARED", F.col("deviation")).alias("deviation"), state.alias("state"))


def reprojection_report(checked: DataFrame) -> DataFrame:
    """One row: vertices compared, the worst code and its deviation, codes not compared, and whether all is within the tolerance."""
    done = F.col("state") != "NOT_COMPARED"
    worst = F.max(F.when(done, F.struct("deviation", (-F.col("code")).alias("code"))))
    return checked.agg(
        F.sum(F.when(done, F.col("vertices")).otherwise(0)).alias("vertices_compared"), worst["deviation"].alias("max_deviation"), (-worst["code"]).alias("max_deviation_code"),
        F.count_if(~done).alias("codes_not_compared"), F.every(F.col("state") == "WITHIN").alias("within_tolerance"),
    )


def coverage(df: DataFrame, resolved: Column, *by: str) -> DataFrame:
    """(by, total, resolved, unresolved, share): how many records of each kind found what they refer to."""
    per = df.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(resolved).alias("resolved"))
    return per.select(*by, "total", "resolved", (F.col("total") - F.col("resolved")).alias("unresolved"), (F.col("resolved") / F.col("total")).alias("share"))


def set_agreement(whole: DataFrame, ids: DataFrame, features: DataFrame, key: str = "id") -> DataFrame:
    """One row: a service's count, its ids and its features, what each lacks, and whether they are one set without repeats."""
    side = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    sides = side(whole, "w").join(side(ids, "i"), key, "full_outer").join(side(features, "f"), key, "full_outer")
    out = sides.agg(
        F.coalesce(F.sum("w"), F.lit(0)).alias("count"), F.count("i").alias("ids"), F.count("f").alias("features"),
        F.count_if(F.col("i").isNotNull() & F.col("f").isNull()).alias("without_feature"), F.count_if(F.col("f").isNotNull() & F.col("i").isNull()).alias("without_id"),
        F.count_if((F.col("w") > 1) | (F.col("i") > 1) | (F.col("f") > 1)).alias("repeated"),
    )
    return out.withColumn("consistent", F.expr("count = ids and ids = features and without_feature = 0 and without_id = 0 and repeated = 0"))


def destination(months: DataFrame, period: str, total: str, components: dict[str, str]) -> DataFrame:
    """(component, value, share, state) of the latest month that publishes the total: its composition, or why a part cannot be told.

    A part that is missing is NOT_PUBLISHED; parts that add up to another number than the
    total are INCOHERENT and get no share; a total of zero has no shares either.
    """
    last = months.where(F.col(total).isNotNull()).agg(F.max_by(F.struct(period, total, *components.values()), period).alias("m")).select("m.*")
    parts = F.explode(F.array(*(F.struct(F.lit(n).alias("component"), F.col(c).alias("value")) for n, c in components.items())))
    added = sum((F.coalesce(F.col(c), F.lit(0)) for c in components.values()), F.lit(0))
    whole = last.select(F.col(period).alias("period"), F.col(total).alias("total"), (added == F.col(total)).alias("adds_up"), parts.alias("p")).select("period", "total", "adds_up", "p.*")
    state = F.when(F.col("total").isNull(), "NO_MONTH").when(F.col("value").isNull(), "NOT_PUBLISHED").when(~F.col("adds_up"), "INCOHERENT").when(F.col("total") == 0, "ZERO_TOTAL").otherwise("PUBLISHED")
    return whole.select("period", "component", "value", F.when(state == "PUBLISHED", F.col("value") / F.col("total")).alias("share"), state.alias("state"))
