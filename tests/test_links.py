"""Links of states: written in one order, read without failing."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from terrafold.functions import links


def read(spark, texts, **known):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "i int, text string, state int")
    return sorted(links.read_links(df, "text", **known).collect(), key=lambda r: r.i)


def test_a_state_comes_back_as_it_was(spark):
    ring = F.array(*(F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in ((40.1, -3.7), (40.2, -3.7), (40.1, -3.6))))
    base = F.struct(F.lit(500.0).alias("radius_a"), F.lit(900.0).alias("radius_b"), F.lit("UNEQUAL_RADIUS").alias("mode"), F.lit("k & k").alias("evidence_key"))
    state = {
        "snapshot": F.lit("s 1"), "mode": F.lit("COMPARE"), "lens_a": links.lens(F.lit(40.41684), F.lit(-3.7038), F.lit(900)), "ring_b": ring, "b_enabled": F.lit(True), "active": F.lit("B"),
        "layers": F.array(F.lit("rail"), F.lit("museum")), "timestep": F.lit("14:00"), "stay_kind": F.lit("hotel"), "origin_month": F.lit("2024-05"), "premises_metric": F.lit("open"), "premises_area": F.lit("011"),
        "window": F.struct(F.lit("2023-01-01").alias("first"), F.lit("2023-12-31").alias("last")), "scope": F.lit("AMBITO"), "code_a": F.lit("A.01"), "code_b": F.lit("Ñ+1"),
        "metric": F.struct(F.lit("ambito_surface").alias("id"), F.lit(True).alias("locked")), "reading": F.lit("analyst"), "language": F.lit("es"), "baseline": base,
    }
    text = spark.range(1).select(links.link(**state)).first()[0]
    assert [p.partition("=")[0] for p in text.split("&")] == [k for k in links.KEYS if k not in ("b", "ga", "gx")]
    [r] = read(spark, [f"https://place.example/?{text}#top"], snapshot="s 1")
    assert (r.outcome, r.snapshot_status, r.issues) == ("EXACT", "MATCH", [])
    s = r.state.asDict(True)
    assert s["lens_a"] == {"lat": 40.41684, "lon": -3.7038, "radius_m": 900.0} and s["lens_b"] is None and s["ring_a"] is None and s["ring_b"][2] == {"lat": 40.1, "lon": -3.6}
    assert s["layers"] == ["museum", "rail"] and s["code_b"] == "Ñ+1" and s["baseline"] == {"radius_a": 500.0, "radius_b": 900.0, "mode": "UNEQUAL_RADIUS", "evidence_key": "k & k"}
    assert s["metric"] == {"id": "ambito_surface", "locked": True} and s["window"]["last"] == "2023-12-31" and s["snapshot"] == "s 1" and s["active"] == "B" and s["b_enabled"]


def test_an_empty_state_has_its_defaults(spark):
    text = spark.range(1).select(links.link()).first()[0]
    assert text == "v=1&m=PLACE&be=0&al=A&ly=&sc=LENS&rd=citizen&lg=en"
    assert read(spark, [text])[0].outcome == "EXACT"
    null = F.lit(None).cast("string")
    nothing = links.link(mode=null, lens_a=F.when(F.lit(False), links.lens(F.lit(1), F.lit(1), F.lit(1))), layers=F.lit(None).cast("array<string>"), window=F.struct(null.alias("first"), null.alias("last")), metric=F.struct(null.alias("id"), F.lit(True).alias("locked")))
    assert spark.range(1).select(nothing).first()[0] == text
    with pytest.raises(ValueError):
        links.link(colour=F.lit("red"))


def test_refused_links(spark):
    codes = [(r.outcome, r.issues[0].code, r.state) for r in read(spark, [None, "", "m=CITY", "v=2", "v=x", "?v=&m=CITY"])]
    assert codes == [("REFUSED", c, None) for c in ["VERSION_MISSING"] * 3 + ["VERSION_UNSUPPORTED"] * 3]


def issue(r):
    return [(i.dimension, i.code, i.raw) for i in r.issues]


def test_what_cannot_be_used_is_left_out_and_listed(spark):
    cases = {
        "m=ATLAS": ("mode", "INVALID_MODE", "ATLAS"),
        "a=40.4,-3.7": ("lensA", "MALFORMED", "40.4,-3.7"),
        "a=40.4,,900": ("lensA", "INVALID_COORDINATES", "40.4,,900"),
        "a=40.4,-3.7,NaN": ("lensA", "INVALID_RADIUS", "40.4,-3.7,NaN"),
        "b=40.4,-3.7,5050": ("lensB", "INVALID_RADIUS", "40.4,-3.7,5050"),
        "b=40.4,-3.7,925": ("lensB", "RADIUS_NOT_ON_STEP", "40.4,-3.7,925"),
        "ga=40.1,-3.7;40.1,-3.7;40.1,-3.6": ("geometryA", "INVALID_GEOMETRY", "40.1,-3.7;40.1,-3.7;40.1,-3.6"),
        "gb=40.1,-3.7;40.2,-3.7": ("geometryB", "INVALID_GEOMETRY", "40.1,-3.7;40.2,-3.7"),
        "gx=AB": ("geometry", "GEOMETRY_NOT_IN_LINK", "AB"),
        "ly=rail.tram.bike": ("layers", "UNKNOWN_LAYER", "tram"),
        "ts=24:00": ("timestep", "INVALID_TIMESTEP", "24:00"),
        "om=2024-13": ("originMonth", "INVALID_ORIGIN_MONTH", "2024-13"),
        "lw=2024-02-01,2024-01-01": ("licenceWindow", "INVALID_LICENCE_WINDOW", "2024-02-01,2024-01-01"),
        "lw=2024-02-01": ("licenceWindow", "INVALID_LICENCE_WINDOW", "2024-02-01"),
        "lw=2014-02-01,2024-01-01": ("licenceWindow", "INVALID_LICENCE_WINDOW", "2014-02-01,2024-01-01"),
        "sc=AMBITO&fm=stays": ("metric", "UNKNOWN_METRIC", "stays"),
        "aa=Z": ("ambitoA", "UNKNOWN_AMBITO", "Z"),
        "bl=900,925,EQUAL_RADIUS": ("baseline", "INVALID_BASELINE", "900,925,EQUAL_RADIUS"),
        "rd=%zz": ("reading", "INVALID_READING", "%zz"),
        "lg=en&lg=fr": None,
        "lg=fr&lg=en": ("language", "INVALID_LANGUAGE", "fr"),
    }
    rows = read(spark, [f"v=1&{q}" for q in cases], known={"code": ["A", "B"]}, extent=("2015-01-01", "2025-12-31"))
    for r, (q, want) in zip(rows, cases.items(), strict=True):
        assert issue(r) == ([want] if want else []), q
        assert r.outcome == ("PARTIAL" if want else "EXACT"), q
        assert all(r.state[f] is None for f in ("lens_a", "lens_b", "ring_a", "ring_b", "window", "metric", "baseline")), q
    assert rows[list(cases).index("ly=rail.tram.bike")].state.layers == ["bike", "rail"]


def test_another_snapshot_is_told_but_exact(spark):
    old, new, none = read(spark, ["v=1&s=old", "v=1&s=new", "v=1"], snapshot="new")
    assert (old.outcome, old.snapshot_status, issue(old), old.state.snapshot) == ("EXACT", "MISMATCH", [("snapshot", "SNAPSHOT_MISMATCH", "old")], "old")
    assert (new.snapshot_status, none.snapshot_status) == ("MATCH", "UNKNOWN")


def test_rings_that_do_not_fit_are_named(spark):
    def drawn(n_a, n_b):
        ring = lambda n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct((40 + i / 1000).alias("lat"), (-3.5 - i / 1000).alias("lon"))) if n else F.lit(None).cast("array<struct<lat: double, lon: double>>")
        text = spark.range(1).select(links.link(ring_a=ring(n_a), ring_b=ring(n_b), premises_area=F.repeat(F.lit("x"), F.lit(1000)))).first()[0]
        return {p.partition("=")[0]: p.partition("=")[2] for p in text.split("&") if p[0] == "g"}

    assert set(drawn(24, 0)) == {"ga"} and drawn(25, 3) == {"gx": "AB"} and drawn(0, 25) == {"gx": "B"} and drawn(0, 0) == {}
    assert drawn(24, 24) == {"gx": "AB"}  # both fit, but not together


def test_states_of_one_split_are_dealt(spark):
    from terrafold.plans.catalog import QUERIES

    assert QUERIES["shared_states"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
