"""Boundary rules, radii, rounding and other semantics that differ by operator."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from terrafold.functions import geo, text
from terrafold.operators import aggregates, graph, linkage, quality, series, spatial

SQUARE = [(0, 0, 0.0, 0.0, 1.0, 0.0), (0, 1, 1.0, 0.0, 1.0, 1.0), (0, 2, 1.0, 1.0, 0.0, 1.0), (0, 3, 0.0, 1.0, 0.0, 0.0)]
HOLE = [(0, 10, 0.4, 0.4, 0.6, 0.4), (0, 11, 0.6, 0.4, 0.6, 0.6), (0, 12, 0.6, 0.6, 0.4, 0.6), (0, 13, 0.4, 0.6, 0.4, 0.4)]
EDGE = "area_id int, seq int, x0 double, y0 double, x1 double, y1 double"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_ray_cast_is_half_open_and_holes_are_outside(spark):
    areas = spatial.polygons(spark.createDataFrame(SQUARE + HOLE, EDGE))
    places = [(1, 0.2, 0.2), (2, 0.5, 0.5), (3, 0.0, 0.0), (4, 1.0, 0.5), (5, 0.5, 1.0), (6, 2.0, 2.0)]
    points = spark.createDataFrame(places, "id long, lat double, lon double")
    assert {r.id for r in spatial.in_areas(points, areas).collect()} == {1, 3}
    states = {r.id: r.state for r in spatial.locate(points, areas).collect()}
    assert states[1] == "RESOLVED" and states[2] == states[6] == "OUTSIDE_ALL"


def test_two_covering_areas(spark):
    twice = SQUARE + [(7, *e[1:]) for e in SQUARE]
    areas = spatial.polygons(spark.createDataFrame(twice, EDGE))
    point = spark.createDataFrame([(1, 0.5, 0.5)], "id long, lat double, lon double")
    assert spatial.locate(point, areas).first()["area_id"] == 0
    row = spatial.locate(point, areas, first=False).first()
    assert (row["area_id"], row["state"]) == (None, "BOUNDARY_OR_AMBIGUOUS")


def test_circle_is_inclusive(spark):
    d = one(spark, geo.haversine_m(40.0, -3.0, 40.01, -3.0))
    assert abs(d - 6371000 * math.radians(0.01)) < 1e-6
    at = spark.createDataFrame([(40.01, -3.0)], "lat double, lon double")
    assert at.where(geo.in_circle(F.col("lat"), F.col("lon"), 40.0, -3.0, d)).count() == 1
    assert at.where(geo.in_circle(F.col("lat"), F.col("lon"), 40.0, -3.0, d - 1e-6)).count() == 0


def test_within_agrees_with_all_pairs(spark):
    pts = spark.range(200).select("id", (40 + (F.col("id") * 7919 % 1009) / 5000.0).alias("lat"), (-3 + (F.col("id") * 104729 % 997) / 5000.0).alias("lon"))
    other = pts.select(F.col("id").alias("r_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    got = {(r.id, r.r_id) for r in spatial.within(pts, other, 1500.0).collect()}
    rows = [(r.id, r.lat, r.lon) for r in pts.collect()]

    def hav(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h))

    assert got == {(a[0], b[0]) for a in rows for b in rows if hav(a, b) <= 1500}


def test_rounding_and_radius(spark):
    assert [one(spark, geo.js_round(F.lit(x))) for x in (0.5, 1.5, -0.5, -1.5)] == [1, 2, 0, -1]
    assert [one(spark, geo.clamped_radius(F.lit(x))) for x in (10.0, 1024.0, 9999.0, float("nan"))] == [100.0, 1000.0, 5000.0, 900.0]


def test_projection_and_order(spark):
    x, y = geo.utm30n(F.lit(40.4168), F.lit(-3.0))
    assert abs(one(spark, x) - 500_000) < 1e-6 and abs(one(spark, y) - 4_474_050) < 1500
    east = geo.utm30n(F.lit(40.4168), F.lit(-3.7038))[0]
    assert abs(one(spark, east) - 440_290) < 300
    fixed = geo.repaired_order(F.lit(-3.7), F.lit(40.4), (40.0, 41.0), (-4.0, -3.0))
    assert tuple(one(spark, fixed)) == (40.4, -3.7)


def test_ring_normalisation(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (None, 2.0), (1.0, 1.0), (0.0, 0.0)]
    df = spark.createDataFrame([(1, ring), (2, [(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]), (3, [])], "area_id int, ring array<struct<lon: double, lat: double>>")
    edges = spatial.edges_of_rings(df).orderBy("seq").collect()
    assert [(e.area_id, e.x0, e.y0, e.x1, e.y1) for e in edges] == [(1, 0, 0, 1, 0), (1, 1, 0, 1, 1), (1, 1, 1, 0, 0)]
    bow = [(9, 0, 0.0, 0.0, 1.0, 1.0), (9, 1, 1.0, 1.0, 1.0, 0.0), (9, 2, 1.0, 0.0, 0.0, 1.0), (9, 3, 0.0, 1.0, 0.0, 0.0)]
    valid = {r.area_id: r.valid for r in quality.valid_rings(spark.createDataFrame(SQUARE + bow, EDGE)).collect()}
    assert valid == {0: True, 9: False}


@pytest.mark.parametrize(("numerator", "denominator", "state"), [(5, 10, "AVAILABLE"), (0, 10, "AVAILABLE"), (None, 10, "NUMERATOR_MISSING"), (-1, 10, "NUMERATOR_INVALID"), (5, None, "DENOMINATOR_MISSING"), (5, 0, "DENOMINATOR_EMPTY")])
def test_ratio_states(spark, numerator, denominator, state):
    ratio, s = aggregates.ratio_state(F.lit(numerator).cast("long"), F.lit(denominator).cast("long"))
    row = spark.range(1).select(ratio.alias("r"), s.alias("s")).first()
    assert row.s == state and (row.r is None) == (state != "AVAILABLE")


def test_null_absorbs_in_the_oldest_date(spark):
    df = spark.sql("select * from values (1, date '2024-05-01', 'month'), (1, date '2024-05-01', 'day'), (2, date '2024-01-01', 'day'), (2, null, 'day') t(g, d, p)")
    assert {r.g: str(r.v) for r in df.groupBy("g").agg(aggregates.oldest_date("d", "p").alias("v")).collect()} == {1: "2024-05-01", 2: "None"}


def test_series_states(spark):
    df = spark.sql("select * from values (date '2023-01-01', 10L), (date '2024-01-01', 15L), (date '2023-02-01', 0L), (date '2024-02-01', 4L), (date '2023-03-01', null), (date '2024-03-01', 4L), (date '2024-04-01', 4L), (date '2023-05-01', 3L), (date '2024-05-01', null) t(m, v)")
    got = {str(r.m): (r.state, r.pct) for r in series.year_over_year(df, "m", "v").collect()}
    assert got["2024-01-01"] == ("AVAILABLE", 50.0) and got["2024-02-01"][0] == "PRIOR_ZERO" and got["2024-03-01"][0] == "PRIOR_MISSING" and got["2024-04-01"][0] == "NO_PRIOR_MONTH" and got["2024-05-01"][0] == "CURRENT_MISSING"


def test_edition_outcomes(spark):
    a = spark.sql("select * from values ('1','x',1L),('2','x',1L),('3','x',1L),('4',null,1L),('6','x',1L) t(code, phase, q)")
    b = spark.sql("select * from values ('2','y',1L),('3','x',2L),('4','x',1L),('5','x',1L),('6','x',1L) t(code, phase, q)")
    got = {r.code: r.outcome for r in linkage.classify_editions(a, b, "code", "phase", "q").collect()}
    assert got == {"1": "ABSENT", "2": "STATE_TRANSITION", "3": "QUANTITY_CHANGE", "4": "NON_COMPARABLE", "5": "NEW", "6": "NO_CHANGE"}


def test_cells_dates_and_folding(spark):
    cells = [one(spark, text.cell_state(F.lit(x).cast("string"))) for x in (None, " ", "0", "12,5", "n.d.")]
    assert [(c.state, c.value) for c in cells] == [("NOT_PUBLISHED", None), ("NOT_PUBLISHED", None), ("PUBLISHED", 0.0), ("PUBLISHED", 12.5), ("NOT_PUBLISHED_NON_NUMERIC", None)]
    assert one(spark, text.fold(F.lit("  Tetuán  Ñora "))) == "tetuan nora"
    assert one(spark, text.street_key(F.lit("de la  Cañada"))) == "CANADA"
    assert str(one(spark, text.spanish_date(F.lit("3 de mayo de 2024")))) == "2024-05-03" and one(spark, text.spanish_date(F.lit("3 de moyo de 2024"))) is None
    assert one(spark, text.thousands(F.lit("1.234.567"))) == 1234567 and one(spark, text.thousands(F.lit("1.23"))) is None
    assert str(one(spark, text.any_date(F.lit("03/05/2024"), "yyyy-MM-dd", "dd/MM/yyyy"))) == "2024-05-03"
    assert one(spark, text.unescape(F.lit("a &amp;lt; b"))) == "a &lt; b"


def test_graph(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)] + [(100, 101, 5.0), (0, 40, 3.5)], "a long, b long, length_m double")
    parts = {r.node: r.component for r in graph.components(edges).collect()}
    assert {parts[i] for i in range(41)} == {0} and parts[101] == 100
    seeds = spark.createDataFrame([(0, 0.0, "b"), (20, 0.0, "a")], "node long, cost_m double, label string")
    far = {r.node: (r.distance_m, r.label) for r in graph.distances(edges, seeds).collect()}
    assert far[10] == (10.0, "a") and far[40] == (3.5, "b") and far[38] == (5.5, "b") and 100 not in far
    near = {r.node for r in graph.distances(edges, seeds, most_m=2.0).collect()}
    assert near == {0, 1, 2, 18, 19, 20, 21, 22}
