"""Spatial joins on grid cells: candidates meet by equal cells, then an exact test runs inside codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.functions import geo
from terrafold.operators import nearest as nearest_rows
from terrafold.runtime import materialise, shuffle_partitions

#: Degrees of a cell; an area is found in every cell that its box touches.
CELL = 0.02
#: Rows around a row beyond which its nearest are sought by the tree.
CROWD = 2048


def edges_of_rings(areas: DataFrame, key: str = "area_id", ring: str = "ring") -> DataFrame:
    """Edges of rings (array of struct lon, lat): invalid vertices and a repeated closing vertex go; fewer than three vertices make no polygon."""
    good = F.filter(ring, lambda v: v["lon"].isNotNull() & v["lat"].isNotNull() & ~F.isnan(v["lon"]) & ~F.isnan(v["lat"]))
    opened = F.when(F.element_at("v", 1) == F.element_at("v", -1), F.slice("v", 1, F.size("v") - 1)).otherwise(F.col("v"))
    rings = areas.select(key, good.alias("v")).where("size(v) > 0").select(key, opened.alias("v")).where("size(array_distinct(v)) >= 3")
    turned = F.concat(F.slice("v", 2, F.size("v") - 1), F.slice("v", 1, 1))
    each = rings.select(key, F.posexplode(F.arrays_zip(F.col("v").alias("a"), turned.alias("b"))).alias("seq", "e"))
    return each.select(key, "seq", F.col("e.a.lon").alias("x0"), F.col("e.a.lat").alias("y0"), F.col("e.b.lon").alias("x1"), F.col("e.b.lat").alias("y1"))


def polygons(edges: DataFrame, *keep: str) -> DataFrame:
    """One row for each area: its edges in order and its box."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x0", "y0", "x1", "y1"))), lambda e: F.struct(e["x0"].alias("x0"), e["y0"].alias("y0"), e["x1"].alias("x1"), e["y1"].alias("y1")))
    box = [F.min(F.least("x0", "x1")).alias("west"), F.max(F.greatest("x0", "x1")).alias("east"), F.min(F.least("y0", "y1")).alias("south"), F.max(F.greatest("y0", "y1")).alias("north")]
    return edges.groupBy("area_id", *keep).agg(ordered.alias("edges"), *box)


def _cell(c, size: float) -> Column:
    return F.floor(c / size)


def _cells(low_x, high_x, low_y, high_y, size: float) -> tuple[Column, Column]:
    return F.sequence(_cell(low_x, size), _cell(high_x, size)), F.sequence(_cell(low_y, size), _cell(high_y, size))


def covering(areas: DataFrame, size: float = CELL) -> DataFrame:
    """(area_id, box), once for each cell the box touches; edges stay behind."""
    xs, ys = _cells(F.col("west"), F.col("east"), F.col("south"), F.col("north"), size)
    return areas.select("area_id", "west", "east", "south", "north").withColumn("cell_x", F.explode(xs)).withColumn("cell_y", F.explode(ys))


def in_areas(points: DataFrame, areas: DataFrame, size: float = CELL) -> DataFrame:
    """Each point with each area that holds it; areas as ``polygons`` gives them.

    Points meet boxes by cell; only pairs whose box holds the point meet the area's edges.
    """
    placed = points.withColumn("cell_x", _cell(F.col("lon"), size)).withColumn("cell_y", _cell(F.col("lat"), size))
    met = placed.join(covering(areas, size), ["cell_x", "cell_y"])
    boxed = met.where(F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north")))
    edged = boxed.select(*points.columns, "area_id").join(areas.drop("west", "east", "south", "north"), "area_id")
    return edged.where(geo.inside(F.col("lat"), F.col("lon"), F.col("edges")))


def locate(points: DataFrame, areas: DataFrame, key: str = "id", first: bool = True) -> DataFrame:
    """Each point with its area and a state. first: the smallest area_id of several; else several are AMBIGUOUS and name none."""
    hits = in_areas(points.select(key, "lat", "lon"), areas).groupBy(key).agg(F.min("area_id").alias("area_id"), F.count("*").alias("hits"))
    state = F.when(F.col("hits").isNull(), "OUTSIDE_ALL").when((F.col("hits") > 1) & F.lit(not first), "BOUNDARY_OR_AMBIGUOUS").otherwise("RESOLVED")
    return points.join(hits, key, "left").withColumn("state", state).withColumn("area_id", F.when(F.col("state") == "RESOLVED", F.col("area_id"))).drop("hits")


def locate_in_hierarchy(points: DataFrame, areas: DataFrame, parent: str, whole: str, key: str = "id") -> DataFrame:
    """(key, area_id, parent, whole, via) of points with a column ``hint``, an area they may lie in.

    The hint decides where the point does lie there (HINT), else the smallest area that
    holds it (SEARCH), else none (NONE); a point outside all areas has no parent, and the
    whole is named for those inside only.
    """
    hits = in_areas(points.select(key, "lat", "lon", "hint"), areas).groupBy(key).agg(F.max(F.when(F.col("area_id") == F.col("hint"), F.col("area_id"))).alias("hinted"), F.min("area_id").alias("found"))
    chosen = hits.select(key, F.coalesce("hinted", "found").alias("area_id"), F.when(F.col("hinted").isNotNull(), "HINT").otherwise("SEARCH").alias("via"))
    named = chosen.join(areas.select("area_id", parent), "area_id")
    out = points.select(key).join(named, key, "left")
    return out.select(key, "area_id", parent, F.when(F.col("area_id").isNotNull(), whole).alias("whole"), F.coalesce("via", F.lit("NONE")).alias("via"))


def circles_meet_areas(circles: DataFrame, areas: DataFrame, radius_m: float | str, key: str = "id", size: float = CELL) -> DataFrame:
    """(key, area_id): the centre lies in the area, or an edge comes within the radius. Membership, never a share.

    radius_m: metres, or the column of the circles that has them.
    """
    radius = F.col(radius_m) if isinstance(radius_m, str) else F.lit(float(radius_m))
    reach = radius / geo.METRES_PER_DEGREE
    wide = reach / F.greatest(F.cos(F.radians("lat")), F.lit(0.01))
    xs, ys = _cells(F.col("lon") - wide, F.col("lon") + wide, F.col("lat") - reach, F.col("lat") + reach, size)
    own = circles.select(key, "lat", "lon", radius.alias("radius"), reach.alias("reach"), wide.alias("wide"), xs.alias("xs"), ys.alias("ys"))
    spread = own.withColumn("cell_x", F.explode("xs")).withColumn("cell_y", F.explode("ys")).drop("xs", "ys")
    near = F.col("lon").between(F.col("west") - F.col("wide"), F.col("east") + F.col("wide")) & F.col("lat").between(F.col("south") - F.col("reach"), F.col("north") + F.col("reach"))
    pairs = spread.join(covering(areas, size), ["cell_x", "cell_y"]).where(near).select(key, "lat", "lon", "radius", "area_id").distinct()
    pairs = pairs.join(areas.select("area_id", "edges"), "area_id")
    meets = geo.inside(F.col("lat"), F.col("lon"), F.col("edges")) | (geo.boundary_m(F.col("lat"), F.col("lon"), F.col("edges")) <= F.col("radius"))
    return pairs.where(meets).select(key, "area_id")


def _celled(left: DataFrame, right: DataFrame, radius_m: float) -> tuple[DataFrame, DataFrame]:
    """Both sides with cells (cell_x, cell_y) in which all pairs at most radius_m apart meet, once each.

    Cells lie in bands of latitude, each with as many around the earth as its latitude
    allows, so the radius reaches into the next cell at most, at any latitude and across the
    180th meridian. The right side is spread over its cell and the ones around it.
    """
    band, height = nearest_rows.band_cells("lat", "lon", radius_m)
    turn = lambda c: F.pmod(F.col(c) + 180.0, F.lit(360.0)) / 360.0
    in_round = lambda c, n: F.least(n - 1, F.floor(turn(c) * n))
    around = lambda b: nearest_rows.cells_round(b, height, radius_m)
    here = left.withColumn("cell_y", band).withColumn("cell_x", in_round("lon", around(F.col("cell_y"))))
    own, _ = nearest_rows.band_cells("r_lat", "r_lon", radius_m)
    there = right.withColumn("cell_y", F.explode(F.array(own - 1, own, own + 1))).withColumn("_n", around(F.col("cell_y"))).withColumn("_at", in_round("r_lon", F.col("_n")))
    there = there.withColumn("cell_x", F.explode(F.array_distinct(F.array(*(F.pmod(F.col("_at") + i, F.col("_n")) for i in (-1, 0, 1)))))).drop("_n", "_at")
    return here, there


def within(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """Pairs of left and right rows at most radius_m apart, with distance_m. right: r_lat, r_lon and other columns of its own."""
    here, there = _celled(left, right, radius_m)
    met = here.join(there, ["cell_x", "cell_y"]).withColumn("distance_m", geo.haversine_m(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")))
    return met.where(F.col("distance_m") <= radius_m).drop("cell_x", "cell_y")


def nearest(left: DataFrame, right: DataFrame, k: int, radius_m: float, key: str, tie: str) -> DataFrame:
    """The k nearest right rows within a radius of each left row, ties by ``tie``; rank from 1."""
    w = Window.partitionBy(key).orderBy("distance_m", tie)
    return within(left, right, radius_m).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_anywhere(left: DataFrame, right: DataFrame, k: int, start_m: float, key: str, tie: str) -> DataFrame:
    """The k nearest right rows of each left row, however far; fewer only where the right side has fewer.

    Rows that find k within start_m are done, since nothing outside is nearer; the others,
    and those that would meet more than CROWD rows there, search the tree of
    ``nearest.k_nearest``, so that no row meets more and more as the right side grows.
    """
    here, there = _celled(left, right, start_m)
    crowded = there.groupBy("cell_x", "cell_y").count().where(F.col("count") > CROWD).select("cell_x", "cell_y")
    quiet = here.join(crowded, ["cell_x", "cell_y"], "left_anti").select(*left.columns)
    found = materialise(nearest(quiet, right, k, start_m, key, tie), "nearest")
    full = found.groupBy(key).count().where(F.col("count") == k).select(key)
    rest = materialise(left.join(full, key, "left_anti"), "unanswered")
    done = found.join(full, key, "left_semi")
    return done if rest.isEmpty() else done.unionByName(nearest_rows.k_nearest(rest, right, k, key, tie))


def nearest_segment(points: DataFrame, segments: DataFrame, radius_m: float, key: str = "id", size: float = 0.01) -> DataFrame:
    """(key, segment, offset_m): the nearest segment (segment, x0, y0, x1, y1) within a radius; ties, to a micrometre, go to the lowest number.

    Segments are laid through all cells that the radius reaches from their box, points stand
    in one, so a point meets a segment once.
    """
    reach = radius_m / geo.METRES_PER_DEGREE
    south, north = F.least("y0", "y1") - reach, F.greatest("y0", "y1") + reach
    # degrees of longitude are shortest at the highest latitude that the radius reaches
    wide = F.lit(reach) / F.greatest(F.cos(F.radians(F.least(F.lit(90.0), F.greatest(F.abs(south), F.abs(north))))), F.lit(0.01))
    boxed = segments.withColumns({"west": F.least("x0", "x1") - wide, "east": F.greatest("x0", "x1") + wide, "south": south, "north": north})
    sx, sy = _cells(F.col("west"), F.col("east"), F.col("south"), F.col("north"), size)
    laid = boxed.withColumn("cell_x", F.explode(sx)).withColumn("cell_y", F.explode(sy))
    placed = points.select(key, "lat", "lon", _cell(F.col("lon"), size).alias("cell_x"), _cell(F.col("lat"), size).alias("cell_y"))
    # distances take long and points few bytes; what is grouped later is dealt now
    placed = placed.repartition(shuffle_partitions(points.sparkSession), key)
    near = F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north"))
    offset = F.element_at(geo.edge_distances_m(F.col("lat"), F.col("lon"), F.array(F.struct("x0", "y0", "x1", "y1"))), 1)
    met = placed.join(laid, ["cell_x", "cell_y"]).where(near).withColumn("offset_m", offset).where(F.col("offset_m") <= radius_m)
    return met.groupBy(key).agg(F.min(F.struct(F.round("offset_m", 6).alias("near"), "segment", "offset_m")).alias("best")).select(key, "best.segment", "best.offset_m")


def clusters(points: DataFrame, zoom: int, pixels: int) -> DataFrame:
    """Counts and mean places on a pixel grid of a zoom level."""
    x, y = geo.mercator_pixel(F.col("lat"), F.col("lon"), zoom)
    cells = points.groupBy(F.floor(x / pixels).alias("cell_x"), F.floor(y / pixels).alias("cell_y"))
    return cells.agg(F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.min("id").alias("first_id"))


def interior_span(areas: DataFrame, rungs: int = 33) -> DataFrame:
    """The widest stretch of a horizontal scanline inside each area: a place for a label."""
    lines = areas.select("area_id", "edges", "south", "north", F.explode(F.sequence(F.lit(1), F.lit(rungs))).alias("rung"))
    lines = lines.withColumn("y", F.col("south") + (F.col("north") - F.col("south")) * F.col("rung") / (rungs + 1))
    hit = F.filter("edges", lambda e: (e["y0"] > F.col("y")) != (e["y1"] > F.col("y")))
    xs = F.array_sort(F.transform(hit, lambda e: (e["x1"] - e["x0"]) * (F.col("y") - e["y0"]) / (e["y1"] - e["y0"]) + e["x0"]))
    spans = lines.select("area_id", "rung", "y", F.posexplode(F.arrays_zip(xs.alias("a"), F.slice(xs, 2, F.size(xs)).alias("b"))).alias("i", "s")).where("i % 2 = 0 and s.b is not null")
    width = F.round(F.col("s.b") - F.col("s.a"), 12)
    return spans.groupBy("area_id").agg(F.max(F.struct(width.alias("width"), (-F.col("rung")).alias("rung"), "y", ((F.col("s.a") + F.col("s.b")) / 2).alias("x"))).alias("best")).select("area_id", "best.width", "best.x", "best.y")
