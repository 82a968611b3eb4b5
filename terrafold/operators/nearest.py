"""The k nearest rows without a radius: a tree of cells on the sphere, searched for all rows at once, level by level.

Places are points of a sphere in space, so neither poles nor the 180th meridian are special.
A cell splits into SPLIT parts along each axis while it holds more than LEAF rows; it knows its
number of rows and the box around them. A row keeps the cells that may hold one of its k
nearest: from the farthest corners of cells that hold k rows together follows a distance that
no answer exceeds, and cells that begin beyond it go. Each level opens the cells that are
left, so a row far from everything meets the near edge of a crowd, not all of it.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.functions import geo
from terrafold.runtime import materialise, release

#: Levels, parts along an axis at each, and rows that a cell keeps unsplit. Three axes of 18 bits and the level fit a long.
LEVELS, BITS = 6, 3
LEAF = 64
_RADIUS = geo.EARTH_RADIUS
_HALF = _RADIUS * 1.001
_NODE = "node long, n long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double, leaf boolean"
_BOX = ("x0", "x1", "y0", "y1", "z0", "z1")


def _space(lat: str, lon: str) -> dict[str, Column]:
    """Metres in space of a place on the sphere."""
    p, q = F.radians(lat), F.radians(lon)
    return {"x": F.cos(p) * F.cos(q) * _RADIUS, "y": F.cos(p) * F.sin(q) * _RADIUS, "z": F.sin(p) * _RADIUS}


def _node_at(level: int) -> Column:
    """The cell of a level that a point of space lies in."""
    cells = 1 << (BITS * level)
    at = lambda c: F.least(F.lit(cells - 1), F.floor((F.col(c) + _HALF) / (2 * _HALF) * cells)).cast("long")
    out = F.lit(level).cast("long")
    for c in ("x", "y", "z"):
        out = F.shiftleft(out, BITS * LEVELS).bitwiseOR(at(c))
    return out


def _parent(level: int) -> Column:
    """The cell one level up, of a cell of this level."""
    mask, width = (1 << (BITS * LEVELS)) - 1, BITS * LEVELS
    out = F.lit(level - 1).cast("long")
    for i in (2, 1, 0):
        out = F.shiftleft(out, width).bitwiseOR(F.shiftright(F.shiftright("node", i * width).bitwiseAND(F.lit(mask)), BITS))
    return out


def _levels(points: DataFrame) -> list[DataFrame]:
    """(parent, node, n, box, leaf) for each level from 1 on; a level is added up from the one below."""
    box = [f(c).alias(f"{c}{i}") for c in ("x", "y", "z") for i, f in enumerate((F.min, F.max))]
    again = [(F.max if c[1] == "1" else F.min)(c).alias(c) for c in _BOX]
    level = materialise(points.groupBy(_node_at(LEVELS).alias("node")).agg(F.count("*").alias("n"), *box), "cells")
    out = []
    for depth in range(LEVELS, 0, -1):
        last = F.lit(depth == LEVELS) | (F.col("n") <= LEAF)
        out.append(level.select(_parent(depth).alias("parent"), "node", "n", *_BOX, last.alias("leaf")))
        if depth > 1:
            level = materialise(level.groupBy(_parent(depth).alias("node")).agg(F.sum("n").alias("n"), *again), "cells")
    return out[::-1]


def _bounds(p: dict[str, Column], cell) -> tuple[Column, Column]:
    """(least, greatest) distance in space from a point to the box of a cell."""
    near, far = F.lit(0.0), F.lit(0.0)
    for c in ("x", "y", "z"):
        low, high = cell(f"{c}0"), cell(f"{c}1")
        gap = F.greatest(low - p[c], p[c] - high, F.lit(0.0))
        reach = F.greatest(F.abs(p[c] - low), F.abs(p[c] - high))
        near, far = near + gap * gap, far + reach * reach
    return F.sqrt(near), F.sqrt(far)


def _pruned(frontier: DataFrame, k: int) -> DataFrame:
    """The cells of each row that may hold one of its k nearest; frontier: row, x, y, z and a cell."""
    near, far = _bounds({c: F.col(c) for c in ("x", "y", "z")}, F.col)
    own = Window.partitionBy("row")
    seen = frontier.withColumns({"near": near, "far": far}).withColumn("held", F.sum("n").over(own.orderBy("far").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    limit = F.min(F.when(F.col("held") >= k, F.col("far"))).over(own)
    # no rounding may lose a row
    kept = seen.withColumn("limit", limit).where(F.col("limit").isNull() | (F.col("near") <= F.col("limit") * (1 + 1e-9) + 0.001))
    return kept.drop("near", "far", "held", "limit")


def k_nearest(left: DataFrame, right: DataFrame, k: int, key: str, tie: str) -> DataFrame:
    """The k nearest right rows (r_lat, r_lon) of each left row (lat, lon), with distance_m and rank from 1, ties by ``tie``.

    Fewer only where the right side has fewer. The first level, which geometry holds to a few
    hundred cells, goes to every task; of right rows at one place only the first k by ``tie`` take part.
    """
    alike = Window.partitionBy("r_lat", "r_lon").orderBy(tie)
    there = right.where("r_lat is not null and r_lon is not null").withColumn("_same", F.row_number().over(alike)).where(F.col("_same") <= k).drop("_same")
    there = materialise(there.withColumns(_space("r_lat", "r_lon")), "places")
    levels = _levels(there)
    here = left.where("lat is not null and lon is not null").select(F.col(key).alias("row"), *(c.alias(n) for n, c in _space("lat", "lon").items()))
    top = [r.asDict() for r in levels[0].drop("parent").collect()]
    cell = F.explode(F.from_json(F.lit(json.dumps(top)), f"array<struct<{_NODE.replace(' ', ': ').replace(',: ', ', ')}>>"))
    frontier = materialise(_pruned(here.select("*", cell.alias("c")).select("row", "x", "y", "z", "c.*"), k), "frontier")
    for level in levels[1:]:
        open_ = frontier.where("not leaf")
        if open_.isEmpty():
            break
        opened = open_.select("row", "x", "y", "z", F.col("node").alias("parent")).join(level, "parent").drop("parent")
        new = materialise(_pruned(frontier.where("leaf").unionByName(opened), k), "frontier")
        release(frontier)
        frontier = new
    wanted = materialise(frontier.select("row", "node"), "leaves")
    release(frontier)
    at = there.withColumn("node", F.explode(F.array(*(_node_at(d) for d in range(1, LEVELS + 1))))).drop("x", "y", "z")
    met = wanted.join(at, "node").drop("node").withColumnRenamed("row", key).join(left, key)
    far = met.withColumn("distance_m", geo.haversine_m(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")))
    w = Window.partitionBy(key).orderBy("distance_m", tie)
    return far.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*left.columns, *right.columns, "distance_m", "rank")


def band_cells(lat: str, lon: str, radius_m: float) -> tuple[Column, float]:
    """(latitude band, height of a band in degrees) for cells whose neighbours hold all within a radius."""
    height = radius_m / geo.METRES_PER_DEGREE
    return F.floor((F.col(lat) + 90) / height), height


def cells_round(band: Column, height: float, radius_m: float) -> Column:
    """How many cells a band has around the earth, each so wide that a radius reaches only into the next one; one near a pole."""
    highest = F.least(F.lit(90.0), F.greatest(F.abs((band - 1) * height - 90), F.abs((band + 2) * height - 90)))
    half = math.sin(min(math.pi / 2, radius_m / (2 * _RADIUS)))
    share = half / F.greatest(F.cos(F.radians(highest)), F.lit(1e-12))
    width = F.degrees(2 * F.asin(F.least(F.lit(1.0), share))) * (1 + 1e-9)
    return F.when(share >= 1, 1).otherwise(F.greatest(F.lit(1), F.floor(F.lit(360.0) / width))).cast("long")
