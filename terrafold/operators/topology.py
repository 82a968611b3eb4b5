"""Unions, coverage and splits on edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.functions import geo
from terrafold.operators import rings, spatial
from terrafold.runtime import materialise


def union_boundary(edges: DataFrame, group: str, digits: int = 9) -> DataFrame:
    """The outer edges of areas that share their borders: an edge that two areas of a group have goes."""
    r = lambda c: F.round(c, digits)
    a, b = F.struct(r("x0").alias("x"), r("y0").alias("y")), F.struct(r("x1").alias("x"), r("y1").alias("y"))
    keyed = edges.select(group, "x0", "y0", "x1", "y1", F.least(a, b).alias("p"), F.greatest(a, b).alias("q"))
    return keyed.groupBy(group, "p", "q").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("x0", "y0", "x1", "y1"))).where("n = 1").drop("p", "q", "n")


def simplified_digits(edges: DataFrame, digits: int) -> DataFrame:
    """Rounded coordinates; edges that shrink to a point go, so rings stay closed."""
    return edges.withColumns({c: F.round(c, digits) for c in ("x0", "y0", "x1", "y1")}).where("x0 <> x1 or y0 <> y1")


def uncovered_vertices(children: DataFrame, parents: DataFrame, tolerance_m: float) -> DataFrame:
    """(area_id, outside): vertices of each child that lie outside its parent by more than a tolerance. children: edges with parent_id; parents: polygons."""
    v = children.select("area_id", "parent_id", F.col("x0").alias("lon"), F.col("y0").alias("lat"))
    both = v.join(parents.select(F.col("area_id").alias("parent_id"), "edges"), "parent_id", "left")
    out = F.col("edges").isNull() | ~(geo.inside(F.col("lat"), F.col("lon"), F.col("edges")) | (geo.boundary_m(F.col("lat"), F.col("lon"), F.col("edges")) <= tolerance_m))
    return both.groupBy("area_id").agg(F.count_if(out).alias("outside"))


def declared_agreement(points: DataFrame, areas: DataFrame, tolerance_m: float) -> DataFrame:
    """Points (id, lat, lon, declared) against the area they declare: INSIDE, EDGE (within a tolerance), OTHER_AREA, OUTSIDE_ALL or UNDECLARED."""
    at = spatial.locate(points, areas)
    own = at.join(areas.select(F.col("area_id").alias("declared"), F.col("edges").alias("own_edges")), "declared", "left")
    near = geo.boundary_m(F.col("lat"), F.col("lon"), F.col("own_edges")) <= tolerance_m
    state = F.when(F.col("own_edges").isNull(), "UNDECLARED").when(F.col("area_id") == F.col("declared"), "INSIDE").when(near, "EDGE").when(F.col("area_id").isNull(), "OUTSIDE_ALL").otherwise("OTHER_AREA")
    return own.select("id", "declared", "area_id", state.alias("state"))


def split_at(segments: DataFrame, cuts: DataFrame) -> DataFrame:
    """(segment, part, t0, t1): each segment cut at all its places t in (0, 1), which all refer to the whole segment."""
    marks = cuts.where("t > 0 and t < 1").select("segment", "t").union(segments.select("segment", F.lit(0.0))).distinct()
    w = Window.partitionBy("segment").orderBy("t")
    return marks.withColumn("t1", F.coalesce(F.lead("t").over(w), F.lit(1.0))).withColumn("part", F.row_number().over(w)).select("segment", "part", F.col("t").alias("t0"), "t1")


def circle_in_area(lat: Column, lon: Column, edges: Column, radius_m: float, margin_m: float = 2.0) -> Column:
    """INSIDE, CROSSES or OUTSIDE, with a margin."""
    boundary = geo.boundary_m(lat, lon, edges)
    return F.when(edges.isNull(), "UNAVAILABLE").when(boundary <= radius_m + margin_m, "CROSSES").when(geo.inside(lat, lon, edges), "INSIDE").otherwise("OUTSIDE")


def box_eligibility(lat: Column, lon: Column, radius_m: float, south: float, north: float, west: float, east: float, tolerance_m: float = 100.0) -> Column:
    """Whether a circle lies WITHIN a box, to a tolerance, PARTIAL or OUTSIDE; UNKNOWN without a place."""
    dlat = radius_m / geo.METRES_PER_DEGREE
    slack = tolerance_m / geo.METRES_PER_DEGREE
    dlon, slack_lon = dlat / F.cos(F.radians(lat)), slack / F.cos(F.radians(lat))
    whole = (lat - dlat >= south - slack) & (lat + dlat <= north + slack) & (lon - dlon >= west - slack_lon) & (lon + dlon <= east + slack_lon)
    near_lat, near_lon = F.greatest(F.lit(south), F.least(F.lit(north), lat)), F.greatest(F.lit(west), F.least(F.lit(east), lon))
    return F.when(lat.isNull() | lon.isNull(), "UNKNOWN").when(whole, "WITHIN").when(geo.haversine_m(lat, lon, near_lat, near_lon) <= radius_m, "PARTIAL").otherwise("OUTSIDE")


def circles_overlap(lat1: Column, lon1: Column, lat2: Column, lon2: Column, r1: float, r2: float) -> Column:
    return geo.haversine_m(lat1, lon1, lat2, lon2) <= r1 + r2


def dominant_overlap(current: DataFrame, historical: DataFrame, step: float) -> DataFrame:
    """(area_id, historical_id, share) of the historical area that covers most of each current one.

    Overlap is counted on the points of a grid ``step`` degrees apart, so it is
    exact to about the perimeter times the step; ties go to the smaller id.
    """
    at = lambda i: (F.col(i) + 0.5) * step
    xs, ys = F.sequence(F.floor(F.col("west") / step), F.floor(F.col("east") / step)), F.sequence(F.floor(F.col("south") / step), F.floor(F.col("north") / step))
    grid = current.select("area_id", "edges", F.explode(xs).alias("i"), ys.alias("ys")).select("area_id", "edges", "i", F.explode("ys").alias("j"))
    held = grid.withColumns({"lon": at("i"), "lat": at("j")}).where(geo.inside(F.col("lat"), F.col("lon"), F.col("edges"))).select(F.col("area_id").alias("current_id"), "lat", "lon")
    met = spatial.in_areas(held, historical).groupBy("current_id", "area_id").agg(F.count("*").alias("n"))
    total = held.groupBy("current_id").agg(F.count("*").alias("total"))
    best = met.groupBy("current_id").agg(F.max(F.struct("n", (-F.col("area_id")).alias("id"))).alias("b"))
    return best.join(total, "current_id").select(F.col("current_id").alias("area_id"), (-F.col("b.id")).alias("historical_id"), (F.col("b.n") / F.col("total")).alias("share"))


def overlay(left: DataFrame, right: DataFrame, size: float = spatial.CELL) -> DataFrame:
    """(area_id, other_id, overlap, share): the exact area that two areas have in common, in square degrees, and its share of area_id.

    left, right: as ``polygons`` gives them, of any shape, holes and parts included; pairs
    without common area are left out. The edges of a pair cut the plane into
    horizontal slabs at every vertex and every crossing of two edges. Inside a slab no
    edges cross, so the common width changes evenly and its value at half height,
    times the height, is the slab's common area.

    Slabs are rows, and an edge is sent to those that it passes; a task holds the edges of
    one slab, however many a pair has. Crossings are found by cells that fit the pair.
    """
    sides = ("west", "east", "south", "north")
    other = right.select(F.col("area_id").alias("other_id"), *(F.col(c).alias(f"o_{c}") for c in sides))
    there = spatial.covering(right, size).select(F.col("area_id").alias("other_id"), "cell_x", "cell_y")
    pairs = spatial.covering(left, size).join(there, ["cell_x", "cell_y"]).select("area_id", "other_id").distinct()
    met = pairs.join(left.select("area_id", *sides), "area_id").join(other, "other_id").where("west < o_east and o_west < east and south < o_north and o_south < north")
    box = materialise(met.select("area_id", "other_id", F.greatest("south", "o_south").alias("low"), F.least("north", "o_north").alias("high")), "pairs")
    pair = ["area_id", "other_id"]
    both = materialise(_active(box, left, "area_id", 1).unionByName(_active(box, right, "other_id", 2)), "active")
    ends = both.select(*pair, F.explode(F.array("y0", "y1")).alias("y")).unionByName(_crossing_heights(both, pair))
    levels = ends.unionByName(box.select(*pair, F.explode(F.array("low", "high")).alias("y"))).join(box, pair).where("y between low and high").select(*pair, "y").distinct()
    w = Window.partitionBy(*pair).orderBy("y")
    placed = materialise(levels.select(*pair, "y", F.row_number().over(w).alias("place"), F.lead("y").over(w).alias("above")), "levels")
    # an edge's part inside the box begins and ends on levels of its own
    clip = lambda y: F.greatest("low", F.least("high", y))
    clipped = both.join(box, pair).withColumns({"from_y": clip(F.least("y0", "y1")), "to_y": clip(F.greatest("y0", "y1"))}).where("from_y < to_y")
    at = lambda name, y: placed.select(*pair, F.col("y").alias(y), F.col("place").alias(name))
    spans = clipped.join(at("first", "from_y"), [*pair, "from_y"]).join(at("last", "to_y"), [*pair, "to_y"])
    passed = spans.select(*pair, "which", "x0", "y0", "x1", "y1", F.explode(F.sequence(F.col("first"), F.col("last") - 1)).alias("place"))
    slabs = placed.where("above is not null").select(*pair, "place", ((F.col("y") + F.col("above")) / 2).alias("y"), (F.col("above") - F.col("y")).alias("height"))
    x = (F.col("x1") - F.col("x0")) * (F.col("y") - F.col("y0")) / (F.col("y1") - F.col("y0")) + F.col("x0")
    cuts = passed.join(slabs, [*pair, "place"]).groupBy(*pair, "place", "height").agg(F.collect_list(F.struct(x.alias("x"), "which")).alias("cuts"))
    common = cuts.groupBy(*pair).agg(F.sum(_common_width(F.col("cuts")) * F.col("height")).alias("overlap")).where("overlap > 0")
    whole = left.select("area_id", _planar_area("edges").alias("whole"))
    return common.join(whole, "area_id").select("area_id", "other_id", "overlap", (F.col("overlap") / F.col("whole")).alias("share"))


def _active(box: DataFrame, areas: DataFrame, key: str, which: int) -> DataFrame:
    """The edges of one side of each pair that reach into the heights both have."""
    edges = areas.select(F.col("area_id").alias(key), F.explode("edges").alias("e")).select(key, "e.*").where("y0 <> y1")
    reach = box.join(edges, key).where("least(y0, y1) < high and greatest(y0, y1) > low")
    return reach.select("area_id", "other_id", F.lit(which).alias("which"), "x0", "y0", "x1", "y1")


def _crossing_heights(both: DataFrame, pair: list[str]) -> DataFrame:
    """(pair, y) where an edge of one area crosses an edge of the other."""
    there = rings.laid(both.join(rings.fitting_size(both, *pair), pair), F.col("size")).drop("size")
    cell = [*pair, "cell_x", "cell_y"]
    ends = ("x0", "y0", "x1", "y1")
    e = there.where("which = 1").select(*cell, *ends)
    f = there.where("which = 2").select(*cell, *(F.col(c).alias(f"f_{c}") for c in ends))
    ex, ey, fx, fy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("f_x1") - F.col("f_x0"), F.col("f_y1") - F.col("f_y0")
    turn = ex * fy - ey * fx
    t = F.try_divide((F.col("f_x0") - F.col("x0")) * fy - (F.col("f_y0") - F.col("y0")) * fx, turn)
    u = F.try_divide((F.col("f_x0") - F.col("x0")) * ey - (F.col("f_y0") - F.col("y0")) * ex, turn)
    return e.join(f, cell).where(t.between(0, 1) & u.between(0, 1)).select(*pair, (F.col("y0") + t * ey).alias("y"))


def _common_width(cuts: Column) -> Column:
    """The length of a line that lies in both areas, from its cuts by either."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(False).alias("a"), F.lit(False).alias("b"), F.lit(0.0).alias("x"))

    def step(at: Column, c: Column) -> Column:
        more = F.when(at["a"] & at["b"], c["x"] - at["x"]).otherwise(0.0)
        return F.struct((at["sum"] + more).alias("sum"), (at["a"] != (c["which"] == 1)).alias("a"), (at["b"] != (c["which"] == 2)).alias("b"), c["x"].alias("x"))

    return F.aggregate(F.array_sort(cuts), start, step, lambda at: at["sum"])


def _planar_area(edges: str) -> Column:
    return F.abs(F.aggregate(F.transform(edges, lambda e: e["x0"] * e["y1"] - e["x1"] * e["y0"]), F.lit(0.0), lambda a, x: a + x)) / 2
