"""A/B comparison: a state decides first, in a fixed order; a number follows only where the state lets it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions.text import fold


def count_state(a: str, b: str, a_ok: str, b_ok: str, a_area: str, b_area: str) -> Column:
    """Extraction withheld, then unavailable, then areas of different size (density), else raw."""
    return F.when(~F.col(a_ok) | ~F.col(b_ok), "WITHHELD_EXTRACTION").when(F.col(a).isNull() | F.col(b).isNull(), "UNAVAILABLE").when(F.abs(F.col(a_area) - F.col(b_area)) > 1e-6, "DENSITY").otherwise("RAW")


def compare_counts(sides: DataFrame) -> DataFrame:
    """sides: metric, a, b, a_ok, b_ok, a_area, b_area (km2). Adds state, basis and delta."""
    state = count_state("a", "b", "a_ok", "b_ok", "a_area", "b_area")
    delta = F.when(state == "RAW", (F.col("b") - F.col("a")).cast("double")).when(state == "DENSITY", F.col("b") / F.col("b_area") - F.col("a") / F.col("a_area"))
    direction = F.when(delta > 0, "HIGHER").when(delta < 0, "LOWER").when(delta == 0, "EQUAL").otherwise("NONE")
    return sides.select("metric", "a", "b", state.alias("state"), delta.alias("delta"), direction.alias("direction"))


def sensitivity(baseline: DataFrame, scenario: DataFrame) -> DataFrame:
    """How each metric's reading moves between two comparisons. The basis is compared before the direction."""
    a = baseline.select("metric", F.col("state").alias("a_state"), F.col("delta").alias("a_delta"), F.col("direction").alias("a_dir"))
    b = scenario.select("metric", F.col("state").alias("b_state"), F.col("delta").alias("b_delta"), F.col("direction").alias("b_dir"))
    open_ = lambda s: F.col(s).isin("RAW", "DENSITY")
    transition = (
        F.when(F.col("a_state").isNull(), "ONLY_SCENARIO").when(F.col("b_state").isNull(), "ONLY_BASELINE")
        .when(~open_("a_state") & ~open_("b_state"), "STILL_WITHHELD").when(~open_("a_state"), "BECAME_AVAILABLE").when(~open_("b_state"), "BECAME_WITHHELD")
        .when(F.col("a_state") != F.col("b_state"), "BASIS_CHANGED").when(F.col("a_dir") != F.col("b_dir"), "DIRECTION_CHANGED").otherwise("STABLE")
    )
    shift = F.when(transition.isin("STABLE", "DIRECTION_CHANGED"), F.col("b_delta") - F.col("a_delta"))
    return a.join(b, "metric", "full_outer").select("metric", transition.alias("transition"), shift.alias("delta_of_delta"))


def compare_areas(left: DataFrame, right: DataFrame, categorical: list[str], numeric: list[str]) -> DataFrame:
    """Metric by metric for pairs of rows (pair; one row a side). A missing side withholds; categories are equal or not."""
    def tall(df: DataFrame, p: str) -> DataFrame:
        items = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("text"), F.lit(None).cast("double").alias("value")) for c in categorical]
        items += [F.struct(F.lit(c).alias("metric"), F.lit(None).cast("string").alias("text"), F.col(c).cast("double").alias("value")) for c in numeric]
        return df.select("pair", F.explode(F.array(*items)).alias("m")).select("pair", F.col("m.metric").alias("metric"), F.col("m.text").alias(f"{p}_text"), F.col("m.value").alias(f"{p}_value"))

    both = tall(left, "a").join(tall(right, "b"), ["pair", "metric"], "full_outer")
    is_text = F.col("metric").isin(*categorical)
    state = F.when(F.coalesce(F.col("a_text"), F.col("a_value").cast("string")).isNull() | F.coalesce(F.col("b_text"), F.col("b_value").cast("string")).isNull(), "WITHHELD").when(is_text & (F.col("a_text") == F.col("b_text")), "EQUAL").when(is_text, "DIFFERENT").otherwise("MEASURED")
    return both.select("pair", "metric", state.alias("state"), F.when(state == "MEASURED", F.col("b_value") - F.col("a_value")).alias("delta"))


def area_relation(a_area: str, b_area: str, a_district: str, b_district: str) -> Column:
    return F.when(F.col(a_area).isNull() | F.col(b_area).isNull(), "PARTIAL").when(F.col(a_area) == F.col(b_area), "SAME_AREA").when(F.col(a_district) == F.col(b_district), "SAME_DISTRICT").otherwise("DIFFERENT")


def governing_outcome(a: Column, b: Column) -> Column:
    """Continuity of two families of records: a break in either governs; a sign in neither is no evidence."""
    return F.when((a == "BREAK") | (b == "BREAK"), "BREAK").when((a == "CONTINUOUS") | (b == "CONTINUOUS"), "CONTINUOUS").otherwise("NO_EVIDENCE")


def insight(compared: DataFrame) -> DataFrame:
    """One row: whether the metrics of a comparison speak at all, and whether they agree in direction."""
    spoken = F.col("state").isin("RAW", "DENSITY")
    agg = compared.agg(F.count_if(spoken).alias("available"), F.count("*").alias("metrics"), F.count_if(spoken & (F.col("direction") == "HIGHER")).alias("higher"), F.count_if(spoken & (F.col("direction") == "LOWER")).alias("lower"))
    status = F.when(F.col("available") == 0, "UNAVAILABLE").when(F.col("available") < F.col("metrics"), "LIMITED").otherwise("AVAILABLE")
    direction = F.when((F.col("higher") > 0) & (F.col("lower") == 0), "HIGHER").when((F.col("lower") > 0) & (F.col("higher") == 0), "LOWER").when(F.col("higher") + F.col("lower") > 0, "MIXED").otherwise("NONE")
    return agg.select("metrics", "available", status.alias("status"), direction.alias("direction"))


def withheld_unless(df: DataFrame, state: str, allowed: list[str], columns: list[str]) -> DataFrame:
    """The columns become missing where the state does not allow them; the state stays and says why."""
    return df.withColumns({c: F.when(F.col(state).isin(*allowed), F.col(c)) for c in columns})


def same_scope(df: DataFrame, *columns: str) -> DataFrame:
    """The frame, if the columns' metadata name one scope; figures of different scopes are not combined."""
    scopes = {df.schema[c].metadata.get("scope") for c in columns}
    if len(scopes) != 1 or None in scopes:
        raise ValueError(f"columns {columns} have scopes {sorted(map(str, scopes))}")
    return df


def in_scope(column: Column, name: str, scope: str) -> Column:
    return column.alias(name, metadata={"scope": scope})


def activity_state(enabled: Column, source_state: Column, period: Column, a: str, b: str) -> Column:
    """State of two observed activities, columns {a,b}_mean and {a,b}_n: the source, the layer, the evidence and the period decide in this order."""
    observed = lambda s: F.coalesce((F.col(f"{s}_mean") >= 0) & ~F.isnan(f"{s}_mean") & (F.col(f"{s}_n") > 0), F.lit(False))
    return (
        F.when(~F.coalesce(source_state.isin("live", "published", "snapshot"), F.lit(False)), "UNAVAILABLE").when(~enabled, "OFF")
        .when(~observed(a) | ~observed(b), "NO_EVIDENCE").when(period.isNull() | (period == ""), "INCOMPATIBLE")
        .when(source_state == "snapshot", "VALID_PARTIAL").when(source_state == "published", "VALID_DEPLOYMENT").otherwise("VALID")
    )


def temperature_state(enabled: Column, a: str, b: str) -> Column:
    """State of two modelled temperatures, columns {a,b}_mean, {a,b}_n and {a,b}_step; those of different hours are not compared."""
    valid = lambda s: F.coalesce(F.col(f"{s}_mean").isNotNull() & ~F.isnan(f"{s}_mean") & (F.col(f"{s}_n") > 0), F.lit(False))
    return F.when(~enabled, "OFF").when(~valid(a) | ~valid(b), "NO_EVIDENCE").when(~F.col(f"{a}_step").eqNullSafe(F.col(f"{b}_step")), "INCOMPATIBLE").otherwise("VALID")


def bridge(compared: DataFrame) -> DataFrame:
    """What may be said across two sides: the kind of difference and its basis, or why there is none. compared: as ``compare_counts`` gives it."""
    open_ = F.col("state").isin("RAW", "DENSITY") & F.col("delta").isNotNull()
    kind = F.when(~open_, None).when(F.col("state") == "DENSITY", "density").otherwise("count")
    basis = F.when(~open_, None).when(F.col("state") == "DENSITY", "density").otherwise("raw-counts")
    reason = F.when(open_, None).when(F.col("state") == "WITHHELD_EXTRACTION", "extraction-bounds").otherwise("source-incompatible")
    side = lambda c: F.when(F.col("state") == "WITHHELD_EXTRACTION", "WITHHELD_EXTRACTION").when(F.col(c).isNull(), "N_A").when(F.col(c) == 0, "ZERO").otherwise("VALID")
    return compared.select("metric", side("a").alias("a_evidence"), side("b").alias("b_evidence"), kind.alias("delta_kind"), basis.alias("basis"), F.when(open_, F.col("delta")).alias("delta"), reason.alias("withheld_reason"))


def readings_compared(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two sessions' readings (side, metric, value): SAME, CHANGED, or of one session only."""
    a, b = left.select("side", "metric", F.col("value").alias("was"), F.lit(True).alias("in_a")), right.select("side", "metric", F.col("value").alias("is"), F.lit(True).alias("in_b"))
    state = F.when(F.col("in_a").isNull(), "ONLY_SECOND").when(F.col("in_b").isNull(), "ONLY_FIRST").when(F.col("was").eqNullSafe(F.col("is")), "SAME").otherwise("CHANGED")
    return a.join(b, ["side", "metric"], "full_outer").select("side", "metric", "was", "is", state.alias("state"))


def published_metrics(sides: DataFrame) -> DataFrame:
    """Two areas metric by metric: pair, metric, kind, and for each side {a,b}_state, _text, _value and _edition.

    Categories are the same, different or indeterminate and never get a number.
    Quantities differ by a number only within one edition, where both sides publish one value.
    """
    same_edition = F.col("a_edition").eqNullSafe(F.col("b_edition"))
    both = (F.col("a_state") == "PUBLISHED") & (F.col("b_state") == "PUBLISHED")
    category = F.col("kind") == "CATEGORY"
    several = (F.col("a_state") == "MULTIPLE_ROWS_NOT_COMBINED") | (F.col("b_state") == "MULTIPLE_ROWS_NOT_COMBINED")
    relation = F.when(~category, None).when(~same_edition | ~both, "INDETERMINATE").when(fold(F.col("a_text")) == fold(F.col("b_text")), "SAME").otherwise("DIFFERENT")
    withheld = F.when(~same_edition, "CROSS_EDITION").when(category, None).when(several, "MULTIPLE_ROWS_NOT_COMBINED").when(~both, "VALUE_NOT_PUBLISHED")
    delta = F.when(~category & withheld.isNull(), F.col("b_value") - F.col("a_value"))
    return sides.select("pair", "metric", "kind", relation.alias("relation"), delta.alias("delta"), withheld.alias("withheld"))
