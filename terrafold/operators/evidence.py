"""The query registry: ten named questions, each answered by one evidence row or one reasoned abstention."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions import geo
from terrafold.operators import linkage, series, spatial

EVIDENCE = "kind string, shape string, value string, scope string, unit string, source_id string, reference_date string, source_state string, ceiling string, derivation string, applied string, reason string, message string"

#: Families of licences.
FAMILIES = ("ACTIVITY", "BUILDING", "TEMPORARY")

#: What the registry refuses, by the flag that asks for it.
PROHIBITED = {
    "causal": "no cause is read from a difference",
    "predictive": "nothing is forecast",
    "ranking": "places are not ranked",
    "individual": "no person or household is described",
    "recommendation": "nothing is recommended",
    "composite": "no composite score is formed",
    "cross_scope": "figures of different scopes are not combined",
    "imputation": "missing figures are not filled in",
}

#: A register of sources: id, scope, unit, reference date, state, ceiling. This one fits the demonstration views.
SOURCES = [
    ("licences", "licence register", "licences", "2001-08-01", "published", "counts of granted licences only"),
    ("areas", "administrative areas", "areas", None, "published", "membership, never a share"),
    ("population", "area", "residents", "2001-01-01", "published", "residents on the reference date"),
    ("monthly", "city", "travellers", "2001-08-01", "published", "the city as a whole"),
    ("editions", "planning area", "phase", "2000-12-31", "published", "published states only"),
]


@dataclass(frozen=True)
class Window:
    """A date window as it was applied."""

    first: dt.date
    last: dt.date
    clamped: bool


def clamp_window(first: dt.date | None, last: dt.date | None, low: dt.date, high: dt.date) -> Window | None:
    """Bounds in order and inside the extent; None where they miss it. No bounds: the extent's last year."""
    if first is None or last is None:
        first = first or dt.date(high.year - 1, high.month, min(high.day, 28)) + dt.timedelta(days=1 + high.day - min(high.day, 28))
        last = last or high
    first, last = min(first, last), max(first, last)
    if last < low or first > high:
        return None
    return Window(max(first, low), min(last, high), first < low or last > high)


def intent(question: str) -> str | None:
    """The first named question whose words fit."""
    import re

    table_ = [
        ("licen[cs]e", "LICENCES_IN_LENS"), ("compare|versus", "AREA_COMPARE"), ("edition|changed|diff", "EDITION_DIFF"), ("phase|stage", "AREA_PHASE"), ("source|origin of", "SOURCE_PROVENANCE"),
        ("hotel|traveller|visitor", "CITY_DEMAND"), ("profile|live|resident", "AREA_PROFILE"), ("around|circle|within", "AREAS_IN_LENS"), ("where|which area", "AREA_AT_POINT"),
    ]
    return next((shape for words, shape in table_ if re.search(words, question.lower())), None)


class Registry:
    """query(shape, **params) -> one row. Flags are screened before any data is read.

    view: gives the tables licences, area_edges, editions, population and monthly by name.
    sources: the register that answers take their scope, unit, date, state and ceiling from.
    """

    def __init__(self, spark: SparkSession, view: Callable[[str], DataFrame], sources: list[tuple] = SOURCES) -> None:
        self.spark, self.view = spark, view
        self.sources = {s[0]: s for s in sources}
        self.shapes: dict[str, Callable[..., DataFrame]] = {
            "LICENCES_IN_LENS": self.licences_in_lens, "AREA_AT_POINT": self.area_at_point, "AREAS_IN_LENS": self.areas_in_lens, "AREA_PHASE": self.area_phase, "AREA_QUANTITY": self.area_quantity,
            "EDITION_DIFF": self.edition_diff, "AREA_COMPARE": self.area_compare, "SOURCE_PROVENANCE": self.source_provenance, "AREA_PROFILE": self.area_profile, "CITY_DEMAND": self.city_demand,
        }

    def query(self, shape: str, flags: tuple[str, ...] = (), **params) -> DataFrame:
        if shape not in self.shapes:
            return self._abstain(shape, "UNKNOWN_SHAPE", "the question is not one of the registry's")
        for f in flags:
            if f in PROHIBITED:
                return self._abstain(shape, "PROHIBITED", PROHIBITED[f])
        return self.shapes[shape](**params)

    def _abstain(self, shape: str, reason: str, message: str) -> DataFrame:
        return self.spark.createDataFrame([("ABSTENTION", shape, *[None] * 9, reason, message)], EVIDENCE)

    def _answer(self, shape: str, source: str, df: DataFrame, derivation: str, applied: str = "{}") -> DataFrame:
        """df: one row; value (null: nothing was found) and optionally reason."""
        id_, scope, unit, date, state, ceiling = self.sources[source]
        none = F.col("value").isNull()
        pick = lambda v: F.when(~none, F.lit(v))
        return df.select(
            F.when(none, "ABSTENTION").otherwise("EVIDENCE").alias("kind"), F.lit(shape).alias("shape"), F.col("value").cast("string").alias("value"), pick(scope).alias("scope"), pick(unit).alias("unit"),
            pick(id_).alias("source_id"), pick(date).alias("reference_date"), pick(state).alias("source_state"), pick(ceiling).alias("ceiling"), pick(derivation).alias("derivation"), pick(applied).alias("applied"),
            F.when(none, "NO_RECORD").alias("reason"), F.when(none, "the source has no such record").alias("message"),
        )

    def licences_in_lens(self, lat: float, lon: float, radius_m: float, first: dt.date | None = None, last: dt.date | None = None, families: tuple[str, ...] = ()) -> DataFrame:
        licences = self.view("licences")
        low, high = licences.agg(F.min("grant_date"), F.max("grant_date")).first()
        window = clamp_window(first, last, low, high) if low else None
        if window is None:
            return self._abstain("LICENCES_IN_LENS", "OUTSIDE_COVERAGE", "the register does not cover the window")
        held = licences.where(F.col("grant_date").between(window.first, window.last) & geo.in_circle(F.col("lat"), F.col("lon"), lat, lon, radius_m))
        named = [f for f in FAMILIES if not families or f in families]
        value = F.to_json(F.struct(*(F.count_if(F.col("family") == f).alias(f) for f in named)))
        return self._answer("LICENCES_IN_LENS", "licences", held.agg(value.alias("value")), "COUNT", f'{{"first":"{window.first}","last":"{window.last}","clamped":{str(window.clamped).lower()}}}')

    def _areas(self) -> DataFrame:
        return spatial.polygons(self.view("area_edges"), "district_id")

    def _point(self, lat: float, lon: float) -> DataFrame:
        return self.spark.createDataFrame([(0, lat, lon)], "id long, lat double, lon double")

    def area_at_point(self, lat: float, lon: float) -> DataFrame:
        return self._answer("AREA_AT_POINT", "areas", spatial.locate(self._point(lat, lon), self._areas()).select(F.col("area_id").alias("value")), "MEMBERSHIP")

    def areas_in_lens(self, lat: float, lon: float, radius_m: float) -> DataFrame:
        met = spatial.circles_meet_areas(self._point(lat, lon), self._areas(), radius_m)
        return self._answer("AREAS_IN_LENS", "areas", met.agg(F.when(F.count("*") > 0, F.to_json(F.sort_array(F.collect_list("area_id")))).alias("value")), "MEMBERSHIP")

    def _edition(self, edition: str) -> DataFrame:
        return self.view("editions").where(F.col("edition") == edition)

    def area_phase(self, code: int, edition: str = "current") -> DataFrame:
        return self._answer("AREA_PHASE", "editions", self._edition(edition).where(F.col("code") == code).agg(F.max("phase").alias("value")), "LOOKUP")

    def area_quantity(self, code: int, edition: str = "current") -> DataFrame:
        return self._answer("AREA_QUANTITY", "editions", self._edition(edition).where(F.col("code") == code).agg(F.max("quantity").alias("value")), "LOOKUP")

    def edition_diff(self) -> DataFrame:
        found = linkage.classify_editions(self._edition("previous"), self._edition("current"), "code", "phase", "quantity")
        value = F.to_json(F.struct(*(F.count_if(F.col("outcome") == o).alias(o) for o in linkage.EDITION_OUTCOMES)))
        return self._answer("EDITION_DIFF", "editions", found.agg(value.alias("value")), "EDITION_COMPARISON")

    def area_compare(self, a: int, b: int) -> DataFrame:
        both = self.view("population").where(F.col("area_id").isin(a, b)).agg(F.count("*").alias("n"), F.max(F.when(F.col("area_id") == b, F.col("residents"))).alias("b"), F.max(F.when(F.col("area_id") == a, F.col("residents"))).alias("a"))
        return self._answer("AREA_COMPARE", "population", both.select((F.col("b") - F.col("a")).alias("value")), "DIFFERENCE")

    def source_provenance(self, source: str) -> DataFrame:
        if source not in self.sources:
            return self._abstain("SOURCE_PROVENANCE", "UNKNOWN_SOURCE", "no such source is registered")
        return self._answer("SOURCE_PROVENANCE", source, self.spark.createDataFrame([(source,)], "value string"), "LOOKUP")

    def area_profile(self, lat: float, lon: float) -> DataFrame:
        at = spatial.locate(self._point(lat, lon), self._areas())
        return self._answer("AREA_PROFILE", "population", at.join(self.view("population"), "area_id", "left").select(F.when(F.col("area_id").isNotNull(), F.to_json(F.struct("area_id", "district_id", "residents"))).alias("value")), "LOOKUP")

    def city_demand(self) -> DataFrame:
        """The latest month, with its change over a year."""
        yoy = series.year_over_year(self.view("monthly"), "period", "travellers")
        last = yoy.agg(F.max_by(F.struct("period", "travellers", F.col("state").alias("change_state")), "period").alias("v"))
        return self._answer("CITY_DEMAND", "monthly", last.select(F.to_json("v").alias("value")), "LATEST_PERIOD")
