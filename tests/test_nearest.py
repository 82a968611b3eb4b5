"""The k nearest without a radius against all pairs, at poles, across the 180th meridian and beside crowds."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from terrafold.operators import nearest, spatial

LEFT, RIGHT = "key int, lat double, lon double", "id int, r_lat double, r_lon double"


def metres(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371000 * math.asin(min(1.0, math.sqrt(h)))


def places(n, seed):
    draw = random.Random(seed)
    world = [(math.degrees(math.asin(draw.uniform(-1, 1))), draw.uniform(-180, 180)) for _ in range(n // 2)]
    crowd = [(40 + draw.gauss(0, 0.02), -3 + draw.gauss(0, 0.02)) for _ in range(n // 2)]
    return world + crowd + [(90.0, 0.0), (-90.0, 50.0), (89.9, 170.0), (0.0, 180.0), (0.0, -180.0), (10.0, 179.999), (10.0, -179.999)]


def check(got, left, right, k):
    by = {}
    for r in got:
        by.setdefault(r.key, []).append((r["rank"], r.distance_m, r.id))
    for key, lat, lon in left:
        want = sorted((metres(lat, lon, a, b), i) for i, a, b in right)[:k]
        own = sorted(by[key])
        assert [r for r, _, _ in own] == list(range(1, len(want) + 1))
        assert [d for _, d, _ in own] == pytest.approx([d for d, _ in want], abs=1e-3)


@pytest.mark.parametrize("k", [1, 5])
def test_all_over_the_world(spark, k):
    right = [(i, *p) for i, p in enumerate(places(3000, 1))]
    left = [(i, *p) for i, p in enumerate(places(120, 2))]
    got = nearest.k_nearest(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), k, "key", "id")
    check(got.collect(), left, right, k)


def test_what_was_missed_before(spark):
    left, right = [(1, 80.0, 0.0)], [(1, 80.0, 40.0), (2, 71.5, 0.0)]
    r = spatial.nearest_anywhere(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), 1, 500.0, "key", "id").first()
    assert r.id == 1


def test_many_at_one_place(spark):
    right = [(i, 40.0, -3.0) for i in range(400)] + [(1000, 41.0, -3.0), (1001, None, -3.0)]
    left = [(1, 40.0, -3.0), (2, -60.0, 100.0), (3, None, None)]
    got = nearest.k_nearest(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), 3, "key", "id").collect()
    assert sorted((r.key, r["rank"], r.id) for r in got) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 1, 0), (2, 2, 1), (2, 3, 2)]


def test_fewer_than_k_and_none(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0)], LEFT)
    assert nearest.k_nearest(left, spark.createDataFrame([(1, 5.0, 5.0)], RIGHT), 4, "key", "id").count() == 1
    assert nearest.k_nearest(left, spark.createDataFrame([], RIGHT), 4, "key", "id").count() == 0


@pytest.mark.parametrize("radius", [300.0, 40_000.0, 3_000_000.0, 15_000_000.0])
def test_pairs_within_any_radius(spark, radius):
    right = [(i, *p) for i, p in enumerate(places(300, 3))]
    left = [(i, *p) for i, p in enumerate(places(100, 4) + [(70.0, 179.99), (-75.0, -179.99), (88.0, 10.0)])]
    got = spatial.within(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), radius).select("key", "id").collect()
    want = {(i, j) for i, a, b in left for j, c, d in right if metres(a, b, c, d) <= radius}
    assert len(got) == len(want) and {(r.key, r.id) for r in got} == want
    assert want or radius < 1000


def test_a_crowd_is_met_at_its_edge(spark):
    """A row far from a crowd opens few of its cells."""
    right = spark.range(20_000).selectExpr("cast(id as int) as id", "40 + (id * 7919 % 10007) / 20000 as r_lat", "-3 + (id * 104729 % 10009) / 20000 as r_lon")
    places_ = right.withColumns(nearest._space("r_lat", "r_lon"))
    levels = nearest._levels(places_)
    assert levels[0].count() <= 4 and levels[-1].where("not leaf").isEmpty()
    left = spark.createDataFrame([(1, 10.0, 60.0)], LEFT).select(F.col("key").alias("row"), *(c.alias(n) for n, c in nearest._space("lat", "lon").items()))
    frontier = left.crossJoin(levels[0].drop("parent"))
    for level in levels[1:]:
        frontier = nearest._pruned(frontier, 5)
        opened = frontier.where("not leaf").select("row", "x", "y", "z", F.col("node").alias("parent")).join(level, "parent").drop("parent")
        frontier = frontier.where("leaf").unionByName(opened)
    assert nearest._pruned(frontier, 5).agg(F.sum("n")).first()[0] < 1000


def test_a_crowd_within_the_radius_is_left_to_the_tree(spark, monkeypatch):
    met = []
    keep = spatial.within
    monkeypatch.setattr(spatial, "within", lambda *a: met.append(keep(*a)) or met[-1])
    right = [(i, 40 + i / 1e6, -3.0) for i in range(spatial.CROWD + 1)] + [(10_000 + i, 50 + i / 1000, 5.0) for i in range(5)]
    left = [(i, 40.0, -3 + i / 1e6) for i in range(20)] + [(100, 50.0, 5.0)]
    got = spatial.nearest_anywhere(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), 3, 3000.0, "key", "id").collect()
    check(got, left, right, 3)
    assert {r.key for r in met[0].select("key").distinct().collect()} == {100}
