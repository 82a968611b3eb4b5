"""The registry's questions asked by the table: one evidence row, or one reasoned abstention, for each row of questions.

Rows of one shape are answered together by joins, so a million circles cost a spatial join
and no loop, and licences are counted in them without a row for each pair. The rules are those of ``evidence.Registry``: flags are screened first, a window
is put in order and clamped, zero is an answer and a missing record is not.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.operators import circles, linkage, series, spatial
from terrafold.operators.evidence import FAMILIES, PROHIBITED, clamp_window
from terrafold.runtime import materialise

#: What a row of questions may hold; a shape reads its own columns only.
QUESTIONS = "id long, shape string, flags array<string>, families array<string>, lat double, lon double, radius_m double, first date, last date, code int, edition string, a int, b int, source string"

#: The source of each shape's answers, and how they are derived.
SHAPES = {
    "LICENCES_IN_LENS": ("licences", "COUNT"), "AREA_AT_POINT": ("areas", "MEMBERSHIP"), "AREAS_IN_LENS": ("areas", "MEMBERSHIP"), "AREA_PHASE": ("editions", "LOOKUP"), "AREA_QUANTITY": ("editions", "LOOKUP"),
    "EDITION_DIFF": ("editions", "EDITION_COMPARISON"), "AREA_COMPARE": ("population", "DIFFERENCE"), "SOURCE_PROVENANCE": (None, "LOOKUP"), "AREA_PROFILE": ("population", "LOOKUP"), "CITY_DEMAND": ("monthly", "LATEST_PERIOD"),
}
MESSAGES = {"NO_RECORD": "the source has no such record", "OUTSIDE_COVERAGE": "the register does not cover the window", "UNKNOWN_SOURCE": "no such source is registered", "UNKNOWN_SHAPE": "the question is not one of the registry's"}


class Answers:
    """view: gives licences, area_edges, editions, population and monthly by name; sources: the register (id, scope, unit, reference_date, state, ceiling)."""

    def __init__(self, view: Callable[[str], DataFrame], sources: list[tuple]) -> None:
        self.view, self.sources, self.written = view, sources, {}

    def _once(self, name: str) -> DataFrame:
        """A view that several shapes read, worked out once: the plan of ten shapes would hold it many times."""
        if name not in self.written:
            self.written[name] = materialise(self.view(name), name)
        return self.written[name]

    def answer(self, questions: DataFrame) -> DataFrame:
        """(id and the columns of evidence) for each question."""
        first_flag = F.get(F.filter("flags", lambda f: f.isin(*PROHIBITED)), F.lit(0))
        asked = questions.withColumn("barred", F.when(F.col("shape").isin(*SHAPES), first_flag))
        heard = asked.where(F.col("shape").isin(*SHAPES) & F.col("barred").isNull())
        of = {s: heard.where(F.col("shape") == s) for s in SHAPES}
        found = [
            self._licences(of["LICENCES_IN_LENS"]), self._area(of["AREA_AT_POINT"]), self._areas_met(of["AREAS_IN_LENS"]),
            self._edition(of["AREA_PHASE"], "phase"), self._edition(of["AREA_QUANTITY"], "quantity"), self._whole(of["EDITION_DIFF"], "EDITION_DIFF", self._diff()),
            self._compare(of["AREA_COMPARE"]), self._provenance(of["SOURCE_PROVENANCE"]), self._profile(of["AREA_PROFILE"]), self._whole(of["CITY_DEMAND"], "CITY_DEMAND", self._demand()),
        ]
        valued = reduce(DataFrame.unionByName, found)
        refused = asked.where(~F.col("shape").isin(*SHAPES) | F.col("barred").isNotNull())
        why = F.create_map(*(F.lit(x) for pair in PROHIBITED.items() for x in pair))
        no = F.lit(None).cast("string")
        barred = F.col("barred").isNotNull()
        refusals = refused.select("id", "shape", no.alias("source_id"), no.alias("value"), no.alias("applied"), F.when(barred, "PROHIBITED").otherwise("UNKNOWN_SHAPE").alias("reason"), F.when(barred, why[F.col("barred")]).alias("message"))
        return self._evidence(valued, refusals)

    def _evidence(self, valued: DataFrame, refusals: DataFrame) -> DataFrame:
        """Answers with the register's word on their source; rows without a value with the reason why."""
        spark = valued.sparkSession
        register = spark.createDataFrame(self.sources, "source_id string, scope string, unit string, reference_date string, source_state string, ceiling string")
        how = F.create_map(*(F.lit(x) for s, (_, d) in SHAPES.items() for x in (s, d)))
        text = F.create_map(*(F.lit(x) for pair in MESSAGES.items() for x in pair))
        why = F.when(F.col("value").isNull(), F.coalesce("reason", F.lit("NO_RECORD")))
        every = valued.withColumn("reason", why).withColumn("message", F.lit(None).cast("string")).unionByName(refusals)
        none = F.col("value").isNull()
        known = every.withColumn("source_id", F.when(~none, F.col("source_id"))).join(F.broadcast(register), "source_id", "left")  # the register of sources is given
        return known.select(
            "id", F.when(none, "ABSTENTION").otherwise("EVIDENCE").alias("kind"), "shape", "value", "scope", "unit", "source_id", "reference_date", "source_state", "ceiling",
            F.when(~none, how[F.col("shape")]).alias("derivation"), F.when(~none, F.coalesce("applied", F.lit("{}"))).alias("applied"), "reason", F.coalesce("message", text[F.col("reason")]).alias("message"),
        )

    def _of(self, df: DataFrame, shape: str, value: Column, applied: Column | None = None, reason: Column | None = None, source: Column | None = None) -> DataFrame:
        none = F.lit(None).cast("string")
        given = F.lit(SHAPES[shape][0]).cast("string") if source is None else source
        return df.select("id", F.lit(shape).alias("shape"), given.alias("source_id"), value.cast("string").alias("value"), (none if applied is None else applied).alias("applied"), (none if reason is None else reason).alias("reason"))

    def _licences(self, q: DataFrame) -> DataFrame:
        licences = self.view("licences")
        low, high = licences.agg(F.min("grant_date"), F.max("grant_date")).first()
        if low is None:
            return self._of(q, "LICENCES_IN_LENS", F.lit(None), reason=F.lit("OUTSIDE_COVERAGE"))
        usual = clamp_window(None, None, low, high)
        open_ = F.col("first").isNull() | F.col("last").isNull()
        ends = q.withColumns({"d0": F.when(open_, F.coalesce("first", F.lit(usual.first))).otherwise(F.col("first")), "d1": F.when(open_, F.coalesce("last", F.lit(high))).otherwise(F.col("last"))})
        put = ends.withColumns({"d0": F.least("d0", "d1"), "d1": F.greatest("d0", "d1")})
        low_, high_ = F.lit(low), F.lit(high)
        covered = (F.col("d1") >= low_) & (F.col("d0") <= high_)
        window = put.withColumns({"covered": covered, "from": F.greatest("d0", low_), "to": F.least("d1", high_), "clamped": (F.col("d0") < low_) | (F.col("d1") > high_)})
        every = F.array(*map(F.lit, FAMILIES))
        asked = F.when(F.coalesce(F.size("families") <= 0, F.lit(True)), every).otherwise(F.array_intersect(every, F.col("families")))
        lenses = window.where("covered").select("id", F.explode(asked).alias("kind"), "lat", "lon", "radius_m", F.col("from").alias("first"), F.col("to").alias("last"))
        held = circles.count_in_circles(lenses, licences.withColumnsRenamed({"family": "kind", "grant_date": "day"}))
        counts = held.groupBy("id").agg(*(F.sum(F.when(F.col("kind") == f, F.col("n"))).alias(f"n_{f}") for f in FAMILIES))
        named = lambda f: F.when(F.coalesce(F.size("families") <= 0, F.lit(True)) | F.array_contains("families", f), F.concat(F.lit(f'"{f}":'), F.coalesce(f"n_{f}", F.lit(0)).cast("string")))
        value = F.concat(F.lit("{"), F.concat_ws(",", *map(named, FAMILIES)), F.lit("}"))
        applied = F.format_string('{"first":"%s","last":"%s","clamped":%s}', F.col("from").cast("string"), F.col("to").cast("string"), F.col("clamped").cast("string"))
        out = window.join(counts, "id", "left")
        return self._of(out, "LICENCES_IN_LENS", F.when(F.col("covered"), value), F.when(F.col("covered"), applied), F.when(~F.col("covered"), "OUTSIDE_COVERAGE"))

    def _polygons(self) -> DataFrame:
        return spatial.polygons(self._once("area_edges"), "district_id")

    def _located(self, q: DataFrame) -> DataFrame:
        return spatial.locate(q.select("id", "lat", "lon"), self._polygons())

    def _area(self, q: DataFrame) -> DataFrame:
        return self._of(self._located(q), "AREA_AT_POINT", F.col("area_id"))

    def _areas_met(self, q: DataFrame) -> DataFrame:
        met = spatial.circles_meet_areas(q, self._polygons(), "radius_m").groupBy("id").agg(F.to_json(F.sort_array(F.collect_list("area_id"))).alias("value"))
        return self._of(q.select("id").join(met, "id", "left"), "AREAS_IN_LENS", F.col("value"))

    def _edition(self, q: DataFrame, column: str) -> DataFrame:
        e = self._once("editions").groupBy("edition", "code").agg(F.max(column).alias("value"))
        asked = q.select("id", "code", F.coalesce("edition", F.lit("current")).alias("edition"))
        return self._of(asked.join(e, ["edition", "code"], "left"), f"AREA_{column.upper()}", F.col("value"))

    def _diff(self) -> DataFrame:
        side = lambda name: self._once("editions").where(F.col("edition") == name)
        found = linkage.classify_editions(side("previous"), side("current"), "code", "phase", "quantity")
        return found.agg(F.to_json(F.struct(*(F.count_if(F.col("outcome") == o).alias(o) for o in linkage.EDITION_OUTCOMES))).alias("value"))

    def _demand(self) -> DataFrame:
        yoy = series.year_over_year(self._once("monthly"), "period", "travellers")
        return yoy.agg(F.max_by(F.struct("period", "travellers", F.col("state").alias("change_state")), "period").alias("v")).select(F.to_json("v").alias("value"))

    def _whole(self, q: DataFrame, shape: str, one: DataFrame) -> DataFrame:
        """Questions about the city as a whole, which one row answers."""
        return self._of(q.select("id", F.lit(1).alias("k")).join(F.broadcast(one.withColumn("k", F.lit(1))), "k", "left"), shape, F.col("value"))

    def _compare(self, q: DataFrame) -> DataFrame:
        p = self._once("population").select("area_id", "residents")
        side = lambda name: p.select(F.col("area_id").alias(name), F.col("residents").alias(f"{name}_residents"))
        both = q.select("id", "a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left")
        return self._of(both, "AREA_COMPARE", F.col("b_residents") - F.col("a_residents"))

    def _provenance(self, q: DataFrame) -> DataFrame:
        known = F.when(F.col("source").isin(*(s[0] for s in self.sources)), F.col("source"))
        return self._of(q, "SOURCE_PROVENANCE", known, reason=F.when(known.isNull(), "UNKNOWN_SOURCE"), source=known)

    def _profile(self, q: DataFrame) -> DataFrame:
        at = self._located(q).select("id", "area_id").join(self._once("population"), "area_id", "left")
        return self._of(at, "AREA_PROFILE", F.when(F.col("area_id").isNotNull(), F.to_json(F.struct("area_id", "district_id", "residents"))))
