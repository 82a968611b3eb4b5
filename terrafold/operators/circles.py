"""Points counted in circles, by kind and by a window of days for each circle, without a row for each pair."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions.geo import EARTH_RADIUS
from terrafold.operators.spatial import CELL, _cell, _cells
from terrafold.runtime import ship

#: Points, and circles, that a task meets at once; cells with more are dealt to several.
PART = 1 << 16
#: Rows of numbers that a task works on at once.
BATCH = 1 << 19
#: Degrees by which a stretch that lies inside for sure is drawn in, and one that may be inside drawn out; relative slack of the squared chords.
MARGIN, SLACK = 1e-9, 1e-12


def count_in_circles(circles: DataFrame, points: DataFrame, size: float = CELL) -> DataFrame:
    """(id, kind, n): the points (kind, lat, lon, day and others) in each circle (id, kind, lat, lon, radius_m, first, last) on its days, all inclusive; none, no row.

    Circles go to the cells that they touch and that hold points. There the points lie in
    strips of latitude, each in the order of longitude: of a strip, the stretch that is
    inside for sure is counted by its days, and only the points at the circle's edge are
    measured. So a circle costs the square root of the points around it, not their number.
    """
    ship(points.sparkSession)
    there = points.where("lat is not null and lon is not null and day is not null and not isnan(lat) and not isnan(lon)")
    row = F.xxhash64(*points.columns)
    placed = there.select(_cell(F.col("lon"), size).alias("cell_x"), _cell(F.col("lat"), size).alias("cell_y"), "kind", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.unix_date("day").alias("day"), row.alias("row"))
    cell = ["cell_x", "cell_y", "kind"]
    spread = _spread(circles, size)
    parts = lambda df, name: df.groupBy(*cell).agg(F.ceil(F.count("*") / PART).cast("int").alias(name))
    tiles = parts(placed, "p_parts").join(parts(spread, "c_parts"), cell)
    each = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    here = spread.join(tiles, cell).withColumn("c", F.pmod(F.xxhash64("id"), F.col("c_parts")).cast("int")).withColumn("p", each("p_parts")).drop("p_parts", "c_parts")
    dealt = placed.join(tiles, cell).withColumn("p", F.pmod("row", "p_parts").cast("int")).withColumn("c", each("c_parts")).drop("p_parts", "c_parts", "row")
    key = [*cell, "p", "c"]
    given = circles.schema
    found = here.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(_counted, f"id {given['id'].dataType.simpleString()}, kind {given['kind'].dataType.simpleString()}, n long")
    return found.groupBy("id", "kind").agg(F.sum("n").alias("n"))


def _spread(circles: DataFrame, size: float) -> DataFrame:
    """Circles in each cell that their box touches; across the 180th meridian they stand a turn further too."""
    arc = F.col("radius_m") / EARTH_RADIUS
    polar = F.abs("lat") + F.degrees(arc) >= 90.0 - MARGIN
    wide = F.when(polar, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(arc) / F.cos(F.radians("lat"))))) + MARGIN)
    own = circles.where("radius_m >= 0 and not isnan(radius_m) and not isnan(lat) and not isnan(lon)").select(
        "id", "kind", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.least("radius_m", F.lit(4 * EARTH_RADIUS)).cast("double").alias("radius_m"), F.unix_date("first").alias("first"), F.unix_date("last").alias("last")
    ).where("first <= last")
    own = own.withColumns({"wide": wide, "high": F.least(F.degrees(arc), F.lit(180.0)) + MARGIN})
    turns = F.array_compact(F.array(F.lit(0.0), F.when(F.col("lon") - F.col("wide") < -180.0, 360.0), F.when(F.col("lon") + F.col("wide") >= 180.0, -360.0)))
    own = own.withColumn("turn", F.explode(turns)).withColumn("lon", F.col("lon") + F.col("turn"))
    xs, ys = _cells(F.col("lon") - F.col("wide"), F.col("lon") + F.col("wide"), F.col("lat") - F.col("high"), F.col("lat") + F.col("high"), size)
    return own.withColumn("cell_x", F.explode(xs)).withColumn("cell_y", F.explode(ys)).drop("wide", "high", "turn")


def _runs(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which range, number in it) of all numbers in the ranges, about BATCH at a time."""
    n = np.maximum(ends - starts, 0)
    before = np.cumsum(n) - n
    for some in np.split(np.arange(n.size), np.flatnonzero(np.diff(before // BATCH)) + 1):
        if some.size and (total := int(n[some].sum())):
            yield np.repeat(some, n[some]), np.arange(total) + np.repeat(starts[some] - before[some] + before[some[0]], n[some])


class _Days:
    """How many of a stretch of rows have a day before another: a bit of the days' ranks at a time, rows with a zero first."""

    def __init__(self, days: np.ndarray) -> None:
        self.known, ranks = np.unique(days, return_inverse=True)
        self.levels = []
        for bit in reversed(range(self.known.size.bit_length())):
            one = (ranks >> bit & 1).astype(bool)
            self.levels.append((bit, np.concatenate([[0], np.cumsum(~one, dtype=np.int32)])))
            ranks = np.concatenate([ranks[~one], ranks[one]])

    def before(self, low: np.ndarray, high: np.ndarray, day: np.ndarray) -> np.ndarray:
        rank, n = np.searchsorted(self.known, day), np.zeros(low.size, np.int64)
        for bit, zeros in self.levels:
            one, z_low, z_high = (rank >> bit & 1).astype(bool), zeros[low], zeros[high]
            n += np.where(one, z_high - z_low, 0)
            low, high = np.where(one, zeros[-1] + low - z_low, z_low), np.where(one, zeros[-1] + high - z_high, z_high)
        return n


def _counted(circles: pa.Table, points: pa.Table) -> pa.Table:
    """(id, kind, n) of the circles of a cell over its points."""
    column = lambda t, *names: [t[c].to_numpy() for c in names]
    lat, lon, day = column(points, "lat", "lon", "day")
    # strips of equal counts, west to east in each
    strips = math.isqrt(lat.size - 1) + 1
    strip = np.empty(lat.size, np.int64)
    strip[np.argsort(lat, kind="stable")] = np.arange(lat.size) * strips // lat.size
    order = np.lexsort((lon, strip))
    lat, lon, day, strip = lat[order], lon[order], day[order], strip[order]
    edges = np.searchsorted(strip, np.arange(strips))
    south, north = np.minimum.reduceat(lat, edges), np.maximum.reduceat(lat, edges)
    west_most, span = lon.min(), lon.max() - lon.min()
    place = strip * (span + 2) + (lon - west_most)  # one order of all rows, found by strip and longitude
    days, cos = _Days(day), np.cos(np.radians(lat))
    c_lat, c_lon, radius, first, last = column(circles, "lat", "lon", "radius_m", "first", "last")
    arc = radius / EARTH_RADIUS
    c_cos, chord = np.cos(np.radians(c_lat)), np.sin(np.minimum(arc, math.pi) / 2) ** 2
    polar = np.abs(c_lat) + np.degrees(arc) >= 90 - MARGIN
    with np.errstate(invalid="ignore"):
        top = np.degrees(np.arcsin(np.sin(np.radians(c_lat)) / np.cos(arc)))  # the latitude at which a circle is widest
        widest = np.where(polar, 180.0, np.degrees(np.arcsin(np.minimum(1.0, np.sin(arc) / c_cos))))
    reach = np.degrees(arc) + MARGIN
    n = np.zeros(c_lat.size, np.int64)

    def add(which: np.ndarray, more: np.ndarray) -> None:
        n[:] += np.bincount(which, more, n.size).astype(np.int64)

    def half_width(c: np.ndarray, at: np.ndarray, slack: float) -> np.ndarray:
        """Degrees of longitude to either side of the centre within the circle, on a latitude; less than none outside."""
        left = chord[c] * (1 + slack) - np.sin(np.radians(at - c_lat[c]) / 2) ** 2 * (1 - slack)
        share = np.clip(left / np.maximum(c_cos[c] * np.cos(np.radians(at)), 1e-300), 0, 1)
        return np.where(left < 0, -1.0, 2 * np.degrees(np.arcsin(np.sqrt(share))))

    for c, s in _runs(np.searchsorted(north, c_lat - reach), np.searchsorted(south, c_lat + reach, "right")):
        # a circle is widest at one latitude and narrows to both sides, so its least width in a strip is at one of the strip's ends
        inner = np.minimum(half_width(c, south[s], -SLACK), half_width(c, north[s], -SLACK)) - MARGIN
        inner = np.where(arc[c] < math.pi / 2, inner, -1.0)
        outer = np.maximum(half_width(c, south[s], SLACK), half_width(c, north[s], SLACK))
        outer = np.where(polar[c] | ((south[s] <= top[c]) & (top[c] <= north[s])), widest[c], outer)
        outer = np.maximum(outer, 0) + MARGIN
        find = lambda x, side: np.searchsorted(place, s * (span + 2) + np.clip(x - west_most, -0.5, span + 0.5), side)  # noqa: B023, E731
        west, east = find(c_lon[c] - outer, "left"), find(c_lon[c] + outer, "right")
        sure = inner >= 0
        low, high = np.where(sure, find(c_lon[c] - inner, "left"), east), np.where(sure, find(c_lon[c] + inner, "right"), east)
        add(c, days.before(low, high, last[c] + 1) - days.before(low, high, first[c]))
        for starts, ends in ((west, low), (high, east)):
            for pair, at in _runs(starts, ends):
                of = c[pair]
                kept = (first[of] <= day[at]) & (day[at] <= last[of])
                of, at = of[kept], at[kept]
                off = lon[at] - c_lon[of]
                half = np.sin(np.radians(lat[at] - c_lat[of]) / 2) ** 2 + c_cos[of] * cos[at] * np.sin(np.radians(off) / 2) ** 2
                with np.errstate(invalid="ignore"):
                    add(of, (2 * EARTH_RADIUS * np.arcsin(np.sqrt(half)) <= radius[of]) & (-180 <= off) & (off < 180))
    held = n > 0
    return pa.table({"id": circles["id"].filter(pa.array(held)), "kind": circles["kind"].filter(pa.array(held)), "n": pa.array(n[held])})
