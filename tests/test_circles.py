"""Counts in circles against every pair."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest

from terrafold.operators import circles
from terrafold.operators.answers import QUESTIONS, Answers
from terrafold.operators.evidence import SOURCES

DAY = dt.date(2000, 1, 1)
POINT = "id long, kind string, lat double, lon double, day date"
CIRCLE = "id long, kind string, lat double, lon double, radius_m double, first date, last date"


def later(n: int) -> dt.date:
    return DAY + dt.timedelta(days=n)


def by_pairs(lenses: list[tuple], points: list[tuple]) -> dict:
    """The SQL's formula over all pairs."""
    out = {}
    good = [p for p in points if None not in p]
    kind, day = np.array([p[1] for p in good]), np.array([(p[4] - DAY).days for p in good])
    lat, lon = np.radians([p[2] for p in good]), np.radians([p[3] for p in good])
    for i, k, y, x, radius, first, last in lenses:
        half = np.sin((lat - np.radians(y)) / 2) ** 2 + np.cos(np.radians(y)) * np.cos(lat) * np.sin((lon - np.radians(x)) / 2) ** 2
        held = (2 * 6371000.0 * np.arcsin(np.sqrt(half)) <= radius) & (kind == k) & ((first - DAY).days <= day) & (day <= (last - DAY).days)
        if held.any():
            out[i, k] = int(held.sum())
    return out


def counted(spark, lenses, points, size=circles.CELL) -> dict:
    return {(r.id, r.kind): r.n for r in circles.count_in_circles(spark.createDataFrame(lenses, CIRCLE), spark.createDataFrame(points, POINT), size).collect()}


def lens(rng, i, y, x, radius) -> tuple:
    a, b = sorted((rng.randrange(400), rng.randrange(400)))
    return (i, rng.choice("AB"), y, x, radius, later(a), later(b))


@pytest.mark.parametrize("part", [1 << 16, 100])
def test_a_town(spark, monkeypatch, part):
    monkeypatch.setattr(circles, "PART", part)
    rng = random.Random(7)
    spot = lambda: (40.4 + rng.gauss(0, 0.02), -3.7 + rng.gauss(0, 0.02))
    points = [(i, rng.choice("ABC"), *spot(), later(rng.randrange(400))) for i in range(3000)]
    points += [(3000 + i, "A", 40.4, -3.7, later(i % 9)) for i in range(800)]  # one building
    points += [(9000, "A", None, -3.7, DAY), (9001, "A", 40.4, -3.7, None), (9002, None, 40.4, -3.7, DAY)]
    lenses = [lens(rng, i, *spot(), rng.choice([0.0, 50.0, 700.0, 2500.0, 9000.0])) for i in range(400)]
    lenses += [(500, "A", 40.4, -3.7, 0.0, DAY, later(3)), (501, "C", 0.0, 0.0, 5000.0, DAY, later(400)), (502, "A", 40.4, -3.7, -1.0, DAY, later(9))]
    got = counted(spark, lenses, points)
    assert got == by_pairs(lenses, points) and (500, "A") in got


def test_the_whole_earth(spark):
    rng = random.Random(8)
    spot = lambda: (rng.choice([rng.uniform(-90, 90), 90 - rng.random(), rng.random() - 90, 90.0, -90.0]), rng.choice([rng.uniform(-180, 180), 180 - rng.random(), rng.random() - 180, -180.0]))
    points = [(i, rng.choice("AB"), *spot(), later(rng.randrange(400))) for i in range(4000)]
    radii = [1e3, 1e5, 1e6, 5e6, 1.2e7, 1.9e7, 3e7]
    lenses = [lens(rng, i, *spot(), rng.choice(radii) * rng.uniform(0.9, 1.1)) for i in range(300)]
    assert counted(spark, lenses, points, 30.0) == by_pairs(lenses, points)


def test_licences_across_the_180th_meridian_are_counted(spark):
    day = dt.date(2024, 5, 1)
    views = {
        "licences": spark.createDataFrame([(1, "ACTIVITY", day, 0.0, -179.999), (2, "ACTIVITY", day, 0.0, 179.999), (3, "BUILDING", day, 0.0, 179.9)], "id long, family string, grant_date date, lat double, lon double"),
        "area_edges": spark.createDataFrame([], "area_id int, district_id int, seq int, x0 double, y0 double, x1 double, y1 double"),
        "editions": spark.createDataFrame([], "edition string, code int, phase string, quantity long"),
        "population": spark.createDataFrame([], "area_id int, district_id int, residents long"),
        "monthly": spark.createDataFrame([], "period date, travellers long"),
    }
    q = spark.createDataFrame([(1, "LICENCES_IN_LENS", None, None, 0.0, 179.9995, 500.0, day, day, None, None, None, None, None)], QUESTIONS)
    (row,) = Answers(views.__getitem__, SOURCES).answer(q).collect()
    assert row.value == '{"ACTIVITY":2,"BUILDING":0,"TEMPORARY":0}'
