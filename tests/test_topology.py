"""Unions, coverage, circles in areas and classes of records."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from terrafold.operators import filters, spatial, topology

EDGE = "area_id int, district_id int, seq int, x0 double, y0 double, x1 double, y1 double"


def square(area, x, y, size=1.0, district=0):
    corners = [(x, y), (x + size, y), (x + size, y + size), (x, y + size)]
    return [(area, district, i, *a, *b) for i, (a, b) in enumerate(zip(corners, corners[1:] + corners[:1]))]


def test_union_drops_shared_borders(spark):
    edges = spark.createDataFrame(square(1, 0.0, 0.0) + square(2, 1.0, 0.0) + square(3, 5.0, 5.0, district=1), EDGE)
    out = topology.union_boundary(edges, "district_id").groupBy("district_id").count().collect()
    assert {r.district_id: r["count"] for r in out} == {0: 6, 1: 4}


def test_children_outside_their_parent(spark):
    parent = spatial.polygons(spark.createDataFrame(square(9, 0.0, 0.0, 2.0), EDGE))
    children = spark.createDataFrame(square(1, 0.5, 0.5) + square(2, 1.5, 0.5), EDGE).withColumn("parent_id", F.lit(9))
    assert {r.area_id: r.outside for r in topology.uncovered_vertices(children, parent, 1.0).collect()} == {1: 0, 2: 2}


def test_circles_and_boxes(spark):
    area = spatial.polygons(spark.createDataFrame(square(1, 0.0, 0.0), EDGE)).crossJoin(spark.createDataFrame([(0.5, 0.5), (0.001, 0.5), (0.5, 1.5)], "lat double, lon double"))
    states = [r.s for r in area.orderBy("lon", F.desc("lat")).select(topology.circle_in_area(F.col("lat"), F.col("lon"), F.col("edges"), 1000.0).alias("s")).collect()]
    assert sorted(states) == ["CROSSES", "INSIDE", "OUTSIDE"]
    places = spark.createDataFrame([(0.5, 0.5), (0.0, 0.5), (-2.0, 0.5), (None, 0.5)], "lat double, lon double")
    got = [r.s for r in places.select(topology.box_eligibility(F.col("lat"), F.col("lon"), 5000.0, 0.0, 1.0, 0.0, 1.0).alias("s")).collect()]
    assert got == ["WITHIN", "PARTIAL", "OUTSIDE", "UNKNOWN"]


def test_splits_and_rounding(spark):
    segments, cuts = spark.createDataFrame([(1,), (2,)], "segment long"), spark.createDataFrame([(1, 0.25), (1, 0.75), (1, 0.25), (1, 1.0)], "segment long, t double")
    got = [tuple(r) for r in topology.split_at(segments, cuts).orderBy("segment", "part").collect()]
    assert got == [(1, 1, 0.0, 0.25), (1, 2, 0.25, 0.75), (1, 3, 0.75, 1.0), (2, 1, 0.0, 1.0)]
    thin = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 0.0000001, 0.0), (1, 0, 1, 0.0000001, 0.0, 1.0, 1.0)], EDGE)
    assert topology.simplified_digits(thin, 5).count() == 1


def test_classes(spark):
    codes = ["APE.01.02", "NZ 3", "NP2", " ", None, "x", "Total"]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    assert [r.v for r in df.select(filters.record_class(F.col("c")).alias("v")).collect()] == ["PLANNING_AREA", "ZONAL_NORM", "PROTECTION", "BLANK", "BLANK", "OTHER", "OTHER"]
    assert df.where(filters.is_total_row(F.col("c"))).count() == 1
    assert df.where(filters.finite(F.lit(float("nan")))).count() == 0
    ways = spark.createDataFrame([({"highway": "footway"},), ({"highway": "service", "access": "private"},), ({"highway": "service", "access": "private", "foot": "yes"},), ({"highway": "motorway"},), ({},)], "tags map<string, string>")
    assert [r.v for r in ways.select(filters.way_retention("tags")[1].alias("v")).collect()] == ["KEPT", "PRIVATE", "KEPT", "BARRED", "NOT_A_HIGHWAY"]
    assert ways.where(filters.way_retention("tags", with_private=True)[0]).count() == 3


def test_closed_vocabulary_fails(spark):
    df = spark.createDataFrame([("a",), ("z",)], "f string")
    assert filters.must_be(df.where("f = 'a'"), "f", ["a", "b"]).count() == 1
    with pytest.raises(Exception, match="f: z"):
        filters.must_be(df, "f", ["a", "b"]).collect()


def test_kind_filter_leaves_other_types(spark):
    df = spark.createDataFrame([("stay", "hotel"), ("stay", "hostel"), ("rail", None)], "type string, kind string")
    assert df.where(filters.only_kind("type", "kind", "stay", "hotel")).count() == 2
    assert df.where(filters.only_kind("type", "kind", "stay", None)).count() == 3


def test_scopes_and_withholding(spark):
    from terrafold.operators import compare

    df = spark.range(1).select(compare.in_scope(F.lit(1), "a", "city"), compare.in_scope(F.lit(2), "b", "city"), compare.in_scope(F.lit(3), "c", "area"))
    assert compare.same_scope(df, "a", "b") is df
    with pytest.raises(ValueError):
        compare.same_scope(df, "a", "c")
    states = spark.createDataFrame([("WITHIN", 1), ("PARTIAL", 2)], "s string, n int")
    assert [r.n for r in compare.withheld_unless(states, "s", ["WITHIN"], ["n"]).collect()] == [1, None]
    signs = spark.createDataFrame([("BREAK", "CONTINUOUS"), ("CONTINUOUS", "NONE"), ("NONE", "NONE")], "a string, b string")
    assert [r.v for r in signs.select(compare.governing_outcome(F.col("a"), F.col("b")).alias("v")).collect()] == ["BREAK", "CONTINUOUS", "NO_EVIDENCE"]


def test_overlay_of_any_shapes(spark):
    ring = lambda area, points: [(area, 0, i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(points, points[1:] + points[:1]))]
    hollow = ring(1, [(0, 0), (4, 0), (4, 4), (0, 4)]) + ring(1, [(1, 1), (3, 1), (3, 3), (1, 3)])
    left = spatial.polygons(spark.createDataFrame(hollow + ring(2, [(10, 0), (14, 0), (12, 4)]), EDGE))
    right = spatial.polygons(spark.createDataFrame(ring(5, [(2, -1), (6, -1), (6, 5), (2, 5)]) + ring(6, [(10, 4), (14, 4), (12, 0)]) + ring(7, [(1.5, 1.5), (2, 1.5), (2, 2)]), EDGE))
    got = {(r.area_id, r.other_id): round(r.overlap, 9) for r in topology.overlay(left, right, size=0.8).collect()}
    # half of the hollow square, and two triangles upside down to each other
    assert got == {(1, 5): 6.0, (2, 6): 4.0}
    draw = __import__("random").Random(5)
    stars = [[(i % 7 * 3 + draw.random() * 2, draw.random() * 2) for _ in range(3)] for i in range(12)]
    a = spatial.polygons(spark.createDataFrame([e for i, p in enumerate(stars) for e in ring(i, p)], EDGE))
    both = {(r.area_id, r.other_id): r.overlap for r in topology.overlay(a, a, size=0.5).collect()}
    area = lambda p: abs(sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(p, p[1:] + p[:1]))) / 2
    assert all(abs(both[i, i] - area(p)) < 1e-9 for i, p in enumerate(stars))
    assert all(abs(v - both[j, i]) < 1e-9 for (i, j), v in both.items())
