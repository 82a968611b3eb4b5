"""Predicates and classes of records. A class is text; what fits no rule is named, not dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions.text import fold

#: Ways that people walk on, and those that they may not.
WALKABLE = (
    "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential",
    "living_street", "pedestrian", "footway", "path", "steps", "service", "track", "road", "cycleway",
)
BARRED = (
    "motorway", "motorway_link", "trunk", "trunk_link", "construction", "proposed", "raceway", "bus_guideway", "busway",
    "escape", "corridor", "platform", "rest_area", "services", "elevator",
)
#: Access that bars a way, and tags for walkers that open it again.
ACCESS_BARS = ("no", "private")
FOOT_OPENS = ("yes", "designated", "permissive", "official")
#: Families of planning codes; each ends at a dot, and no code is rewritten.
AREA_FAMILIES = ("APE", "API", "APR", "AOE", "AOD", "AE", "UZP", "UZPp", "UZI", "UNP", "UNS", "US")
#: Words of a free text that tell a kind of stay, in order.
STAY_WORDS = (("hostel", "hostel"), ("apart", "apartment"), ("pensi", "guest house"), ("camping", "campsite"), ("hotel", "hotel"))


def only_kind(type_: str, kind: str, of_type: str, wanted: str | None) -> Column:
    """Rows of one type must be of the wanted kind; other types always pass."""
    return F.lit(True) if wanted is None else (F.col(type_) != of_type) | (F.col(kind) == wanted)


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def is_total_row(code: Column) -> Column:
    return F.lower(F.trim(code)).startswith("total")


def record_class(code: Column) -> Column:
    """Planning areas, zonal norms and land that is not for building, by the form of their code, which is never changed."""
    return (
        F.when(code.isNull() | (F.trim(code) == ""), "BLANK")
        .when(code.rlike(rf"(?i)^({'|'.join(AREA_FAMILIES)})\."), "PLANNING_AREA")
        .when(code.rlike(r"^(NZ ?[0-9].*|[0-9]+(\.[0-9]+)*(\.[A-Za-z]+)?)$"), "ZONAL_NORM")
        .when(code.rlike("^NP ?[0-9]"), "PROTECTION")
        .when(code.rlike(r"(?i)^(NUC|NUP)(\.[0-9]+)?$"), "NON_DEVELOPABLE")
        .otherwise("OTHER")
    )


def stay_kind(s: Column) -> Column:
    """The first word that the text contains decides."""
    low, out = F.lower(s), F.lit("other")
    for word, kind in reversed(STAY_WORDS):
        out = F.when(low.contains(word), kind).otherwise(out)
    return F.when(s.isNull(), "unknown").otherwise(out)


def way_retention(tags: str, with_private: bool = False) -> tuple[Column, Column]:
    """(kept, reason) of a way by its tags."""
    at = lambda k: F.try_element_at(F.col(tags), F.lit(k))
    reason = (
        F.when(at("highway").isNull(), "NOT_A_HIGHWAY").when(at("highway").isin(*BARRED), "BARRED").when(at("foot").isin("no"), "FOOT_NO")
        .when(~F.coalesce(at("access").isin(*ACCESS_BARS) & ~F.coalesce(at("foot").isin(*FOOT_OPENS), F.lit(False)), F.lit(False)) | F.lit(with_private), F.when(at("highway").isin(*WALKABLE), "KEPT").otherwise("UNKNOWN_CLASS"))
        .otherwise("PRIVATE")
    )
    return reason == "KEPT", reason


def publishable(df: DataFrame, count: str, above: int = 30) -> DataFrame:
    """Rows whose count may be published: above the threshold, never at it."""
    return df.where(F.col(count) > above)


def licence_family(kind: Column, families: dict[str, str]) -> Column:
    """The family of a licence by a closed table of kinds; a kind that is not in it fails the job, and a missing one stays missing."""
    table = F.create_map(*(F.lit(x) for kv in families.items() for x in kv))
    found = F.try_element_at(table, kind)
    return F.when(kind.isNull() | found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown kind of licence: "), kind)))


def must_be(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """The rows unchanged; the job fails on a value outside the closed set."""
    ok = F.col(column).isin(*allowed)
    return df.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"{column}: "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))))


def granted_universe(df: DataFrame, status: str, date: str, granted: str = "GRANTED") -> DataFrame:
    """The records, if the whole table holds granted ones only, each with a date; the job fails on any other row, whichever columns are read."""
    wrong = F.when(~F.col(status).eqNullSafe(granted), F.concat(F.lit("status "), F.coalesce(F.col(status).cast("string"), F.lit("null")))).when(F.col(date).isNull(), "no date")
    return df.where(F.when(wrong.isNull(), True).otherwise(F.raise_error(F.concat(F.lit("not a granted universe: "), wrong)).cast("boolean")))


def surfaces_for(surfaces: DataFrame, mode: str, flags: tuple[str, ...] = ()) -> DataFrame:
    """The surfaces (surface, mode, flag) that a mode shows; those with a flag only where it is set."""
    shown = F.col("flag").isNull() | F.col("flag").isin(*flags)
    return surfaces.where((F.col("mode") == mode) & shown)


def surfaces_of_sessions(sessions: DataFrame, surfaces: DataFrame, key: str = "id") -> DataFrame:
    """(key, surface) of all sessions (key, mode, flags): those of a session's mode, and of these the ones with a flag where it is set."""
    met = sessions.select(key, "mode", "flags").join(surfaces.select("surface", "mode", "flag"), "mode")
    return met.where(F.col("flag").isNull() | F.array_contains("flags", F.col("flag"))).select(key, "surface")


#: Degrees of the felt temperature from which a class holds.
THERMAL_CLASSES = ((46.0, "EXTREME"), (38.0, "VERY_STRONG"), (32.0, "STRONG"))


def thermal_class(value: Column) -> Column:
    out = F.when(value.isNull() | F.isnan(value), "NO_VALUE")
    for least, name in THERMAL_CLASSES:
        out = out.when(value >= least, name)
    return out.otherwise("MODERATE_OR_BELOW")


def phase_value(raw: Column, documented: dict[str, str], variants: dict[str, str], markers: list[str], unresolved: list[str]) -> Column:
    """(source_value, state, kind, vocabulary, documented_as) of a published phase cell; phases are never ranked nor rewritten.

    documented and variants: folded text -> documented spelling.
    """
    value, folded = F.trim(raw), fold(raw)
    table = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    known, other = F.try_element_at(table(documented), folded), F.try_element_at(table(variants), folded)
    blank = value.isNull() | (value == "")
    kind = F.when(folded.isin(*markers), "PLAN_ORIGIN_MARKER").when(folded.isin(*unresolved), "UNRESOLVED_MEANING").otherwise("PHASE_VALUE")
    words = F.when(known.isNotNull(), "SOURCE_DOCUMENTED").when(other.isNotNull(), "SOURCE_DOCUMENTED_SPELLING_VARIANT").otherwise("SOURCE_OBSERVED_NOT_DOCUMENTED")
    return F.struct(
        F.when(~blank, value).alias("source_value"),
        F.when(blank, "NOT_PUBLISHED").otherwise("PUBLISHED").alias("state"),
        F.when(~blank, kind).alias("kind"),
        F.when(~blank, words).alias("vocabulary"),
        F.when(~blank, F.coalesce(known, other)).alias("documented_as"),
    )


def activity_class(division: Column, section: Column, override: dict[str, str], default: dict[str, str]) -> Column:
    """A division's own class, else its section's, else AMBIGUOUS."""
    table = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    return F.coalesce(F.try_element_at(table(override), division), F.try_element_at(table(default), section), F.lit("AMBIGUOUS"))
