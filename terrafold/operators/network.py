"""Points snapped onto planar segments, and the graph that they split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.operators import graph, rings
from terrafold.runtime import materialise

#: Stretches of a segment whose cuts are put in order apart from each other.
BLOCKS = 1024


def snapped(points: DataFrame, segments: DataFrame, radius: float, key: str = "id", size: float | None = None) -> DataFrame:
    """(key, segment, t, offset) of the nearest place on a segment within a radius, ties to the smaller segment; points without one are left out.

    points: key, x, y; segments: segment, x0, y0, x1, y1, in one plane. t runs from 0 to 1 along
    the segment. Points meet the segments laid through their cell.
    """
    size = size or 2 * radius
    here = points.select(key, "x", "y", F.floor(F.col("x") / size).alias("cell_x"), F.floor(F.col("y") / size).alias("cell_y"))
    there = rings.laid(segments.select("segment", "x0", "y0", "x1", "y1"), size, radius)
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    px, py = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / square)))
    # beside the segment the offset is that of its line, which no rounding of t disturbs
    end = F.when(F.col("t") == 0, F.sqrt(px * px + py * py)).when(F.col("t") == 1, F.sqrt((px - dx) * (px - dx) + (py - dy) * (py - dy)))
    offset = F.coalesce(end, F.abs(px * dy - py * dx) / F.sqrt(square))
    met = here.join(there, ["cell_x", "cell_y"]).withColumn("t", t).withColumn("offset", offset).where(F.col("offset") <= radius)
    return met.groupBy(key).agg(F.min(F.struct("offset", "segment", "t")).alias("best")).select(key, "best.segment", "best.t", "best.offset")


def node_name(segment: str, t: str, a: str, b: str) -> Column:
    """The node at a place of a segment: one of its ends, or a new one that all points at this place share."""
    own = F.concat(F.lit("s"), F.col(segment).cast("string"), F.lit("@"), F.col(t).cast("string"))
    end = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    return F.when(F.col(t) <= 0, end(a)).when(F.col(t) >= 1, end(b)).otherwise(own)


def split(segments: DataFrame, hits: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(edges a, b, length_m; places key, node, offset) of the graph whose segments are cut at all places snapped onto them.

    segments: segment, a, b, x0, y0, x1, y1; hits: as ``snapped`` gives them, which all refer to the
    whole segments, so nothing depends on an order. Equal places of a segment are one node.
    A segment that many points lie on is put in order stretch by stretch.
    """
    cuts = hits.where("t > 0 and t < 1").select("segment", "t").distinct()
    marks = segments.select("segment", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t")).unionByName(cuts).withColumn("block", F.least(F.lit(BLOCKS - 1), F.floor(F.col("t") * BLOCKS)))
    marks = materialise(marks, "cuts")
    inner = Window.partitionBy("segment", "block").orderBy("t")
    first = marks.groupBy("segment", "block").agg(F.min("t").alias("t"))
    across = first.select("segment", "block", F.lead("t").over(Window.partitionBy("segment").orderBy("block")).alias("later"))
    runs = marks.withColumn("t1", F.lead("t").over(inner)).join(across, ["segment", "block"]).select("segment", F.col("t").alias("t0"), F.coalesce("t1", "later").alias("t1")).where("t1 is not null")
    whole = segments.select("segment", "a", "b", F.sqrt(F.pow(F.col("x1") - F.col("x0"), F.lit(2.0)) + F.pow(F.col("y1") - F.col("y0"), F.lit(2.0))).alias("whole"))
    named = runs.join(whole, "segment")
    edges = named.select(node_name("segment", "t0", "a", "b").alias("a"), node_name("segment", "t1", "a", "b").alias("b"), ((F.col("t1") - F.col("t0")) * F.col("whole")).alias("length_m"))
    places = hits.join(segments.select("segment", "a", "b"), "segment").select(key, node_name("segment", "t", "a", "b").alias("node"), "offset")
    return edges, places


def distances_to_places(segments: DataFrame, hits: DataFrame, seeds: DataFrame, key: str = "id") -> DataFrame:
    """(key, distance_m, offset): the exact distance from the nearest seed (node, cost_m, label) to each place on a segment.

    Seeds are ends of segments, so a place is reached from one end of its segment or the
    other: distances are found on the unsplit segments, whose paths have fewer steps, and equal
    those of the graph that ``split`` gives. Places that no seed reaches are left out.
    """
    length = F.sqrt(F.pow(F.col("x1") - F.col("x0"), F.lit(2.0)) + F.pow(F.col("y1") - F.col("y0"), F.lit(2.0)))
    whole = segments.select("segment", "a", "b", length.alias("length_m"))
    far = graph.distances(whole.select("a", "b", "length_m"), seeds).select("node", "distance_m")
    either = F.explode(F.array(F.struct(F.col("a").alias("node"), (F.col("t") * F.col("length_m")).alias("rest")), F.struct(F.col("b").alias("node"), ((1 - F.col("t")) * F.col("length_m")).alias("rest"))))
    ends = hits.join(whole, "segment").select(key, "offset", either.alias("end")).select(key, "offset", "end.node", "end.rest")
    return ends.join(far, "node").groupBy(key).agg(F.min(F.col("distance_m") + F.col("rest")).alias("distance_m"), F.first("offset").alias("offset"))
