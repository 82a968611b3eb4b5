"""Rings on edge tables: nodes where edges touch, outlines of unions, validity of rings.

An edge is a row (x0, y0, x1, y1) with the keys of its area. Edges meet by the grid cells
that they run through, never all with all; rings are closed by pointer jumping, so the
number of rounds is the logarithm of the longest ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.runtime import materialise, release

_ENDS = ("x0", "y0", "x1", "y1")


def laid(edges: DataFrame, size: Column | float, reach: float = 0.0) -> DataFrame:
    """Each edge once for each cell (cell_x, cell_y) that it comes within ``reach`` of, by the columns of cells that it crosses.

    A long edge takes about as many cells as it is long, not as its box is large. ``size`` may
    differ from row to row, as long as rows that shall meet have the same one.
    """
    size = size if isinstance(size, Column) else F.lit(float(size))
    near = reach * (1 + 1e-9)
    xs = F.sequence(F.floor((F.least("x0", "x1") - near) / size), F.floor((F.greatest("x0", "x1") + near) / size))
    spread = edges.withColumn("cell_x", F.explode(xs))
    # the stretch of the edge inside the column, with some slack against rounding
    slack = near + 1e-9 * size
    low_x, high_x = F.col("cell_x") * size - slack, (F.col("cell_x") + 1) * size + slack
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    at = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - F.col("x0")) / dx))
    flat = dx == 0
    ya, yb = F.when(flat, F.col("y0")).otherwise(F.col("y0") + at(low_x) * dy), F.when(flat, F.col("y1")).otherwise(F.col("y0") + at(high_x) * dy)
    ys = F.sequence(F.floor((F.least(ya, yb) - slack) / size), F.floor((F.greatest(ya, yb) + slack) / size))
    return spread.withColumn("cell_y", F.explode(ys))


def fitting_size(edges: DataFrame, *keys: str) -> DataFrame:
    """(keys, size): cells for the edges of each key, so large that an edge of middling length meets few others."""
    extent = F.greatest(F.max(F.greatest("x0", "x1")) - F.min(F.least("x0", "x1")), F.max(F.greatest("y0", "y1")) - F.min(F.least("y0", "y1")))
    per = F.when(extent > 0, extent / F.ceil(F.sqrt(F.count("*").cast("double")))).otherwise(1.0)
    return edges.groupBy(*keys).agg(per.alias("size"))


def wound(edges: DataFrame, ring: list[str], hole: Column) -> DataFrame:
    """Edges turned so that their area lies on their left: outer rings run counter-clockwise, holes clockwise."""
    turn = F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0"))
    turned = edges.groupBy(*ring).agg((turn < 0).alias("clockwise"))
    both = edges.join(turned, ring).withColumn("turn", F.col("clockwise") != hole)
    swap = {a: F.when(F.col("turn"), F.col(b)).otherwise(F.col(a)) for a, b in (("x0", "x1"), ("y0", "y1"), ("x1", "x0"), ("y1", "y0"))}
    return both.withColumns(swap).select(*edges.columns)


def noded(edges: DataFrame, group: str, tolerance: float = 1e-9) -> DataFrame:
    """(group, x0, y0, x1, y1): the edges of a group, cut at each vertex of the group that lies on them.

    A vertex lies on an edge that it is within ``tolerance`` of; the parts run through it exactly.
    """
    numbered = materialise(edges.select(group, *_ENDS, F.monotonically_increasing_id().alias("edge")).where("x0 <> x1 or y0 <> y1"), "edges")
    sizes = fitting_size(numbered, group)
    vertices = numbered.select(group, F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("v")).select(group, "v.x", "v.y").distinct()
    placed = vertices.join(sizes, group).select(group, "x", "y", F.floor(F.col("x") / F.col("size")).alias("cell_x"), F.floor(F.col("y") / F.col("size")).alias("cell_y"))
    there = laid(numbered.join(sizes, group), F.col("size"), tolerance).drop("size")
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    px, py = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    length = F.sqrt(dx * dx + dy * dy)
    t, off = (px * dx + py * dy) / (length * length), F.abs(px * dy - py * dx) / length
    inner = (off <= tolerance) & (t * length > tolerance) & ((1 - t) * length > tolerance)
    cuts = there.join(placed, [group, "cell_x", "cell_y"]).where(inner).select(group, "edge", t.alias("t"), "x", "y").distinct()
    end = lambda t, i: F.struct(F.lit(t).alias("t"), F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y"))
    ends = numbered.select(group, "edge", F.explode(F.array(end(0.0, 0), end(1.0, 1))).alias("v")).select(group, "edge", "v.t", "v.x", "v.y")
    w = Window.partitionBy("edge").orderBy("t")
    parts = ends.unionByName(cuts).select(group, F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"))
    return parts.where("x1 is not null")


def boundary(edges: DataFrame, group: str, tolerance: float = 1e-9) -> DataFrame:
    """The edges of a group's outline, its area on their left: what two areas run along in opposite directions goes.

    edges: of areas that tile without overlap, wound as ``wound`` leaves them.
    """
    parts = noded(edges, group, tolerance)
    a, b = F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))
    net = parts.select(group, F.least(a, b).alias("p"), F.greatest(a, b).alias("q"), F.when(a < b, 1).otherwise(-1).alias("sign")).groupBy(group, "p", "q").agg(F.sum("sign").alias("net"))
    along = F.col("net") > 0
    end = lambda first, c: F.when(along == F.lit(first), F.col(f"p.{c}")).otherwise(F.col(f"q.{c}"))
    return net.where("net <> 0").select(group, end(True, "x").alias("x0"), end(True, "y").alias("y0"), end(False, "x").alias("x1"), end(False, "y").alias("y1"))


def _following(outline: DataFrame, group: str) -> DataFrame:
    """(edge, next): at its end each edge goes on along the next edge clockwise from the way it came, so areas that touch in a point stay apart."""
    start = outline.select(group, F.col("edge").alias("next"), F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")).alias("out"))
    back = F.atan2(F.col("y0") - F.col("y1"), F.col("x0") - F.col("x1"))
    met = outline.withColumn("back", back).join(start, [group, "x1", "y1"])
    turn = F.pmod(F.col("back") - F.col("out"), F.lit(2 * 3.141592653589793))
    return met.groupBy("edge").agg(F.min(F.struct(F.when(turn < 1e-12, 7.0).otherwise(turn).alias("turn"), "next")).alias("best")).select("edge", "best.next")


def _jumped(table: DataFrame, step, done: Column, name: str) -> DataFrame:
    """Pointer jumping: (edge, to, value) with value and pointer of the edge pointed to, until ``done`` holds for all rows."""
    now = materialise(table, name)
    while True:
        ahead = now.select(F.col("edge").alias("to"), F.col("to").alias("onward"), F.col("value").alias("far"))
        new = materialise(now.join(ahead, "to").select("edge", F.col("onward").alias("to"), step.alias("value"), done.alias("done")), name)
        still = not new.where("not done").isEmpty()
        release(now)
        now = new.select("edge", "to", "value")
        now.written_to = new.written_to
        if not still:
            return now


def rings(outline: DataFrame, group: str) -> DataFrame:
    """(group, ring, seq, x0, y0, x1, y1): closed rings of directed edges in order; a ring has the name of its first edge.

    Every vertex must end as many edges as it starts, as those of ``boundary`` do.
    """
    edges = materialise(outline.withColumn("edge", F.monotonically_increasing_id()), "outline")
    following = materialise(_following(edges, group), "following")
    # The least edge of a ring: each edge learns the least of twice as many edges ahead in every round.
    low = F.least("value", "far")
    first = _jumped(following.select("edge", F.col("next").alias("to"), F.least("edge", "next").alias("value")), low, low == F.col("value"), "least")
    # Steps from each edge to that one; it points to itself.
    head = F.col("edge") == F.col("ring")
    ahead = following.join(first.select("edge", F.col("value").alias("ring")), "edge")
    steps = _jumped(ahead.select("edge", F.when(head, F.col("edge")).otherwise(F.col("next")).alias("to"), F.when(head, 0).otherwise(1).cast("long").alias("value")), F.col("value") + F.col("far"), F.col("to") == F.col("onward"), "steps")
    named = edges.join(first.select("edge", F.col("value").alias("ring")), "edge").join(steps.select("edge", F.col("value").alias("left")), "edge")
    length = F.count("*").over(Window.partitionBy("ring"))
    return named.select(group, "ring", F.pmod(length - F.col("left"), length).alias("seq"), *_ENDS)


def ring_measures(ringed: DataFrame, group: str) -> DataFrame:
    """(group, ring, edges, area, perimeter, hole, west, south) of each ring, in the units of the coordinates; a hole runs clockwise."""
    turn = F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2
    length = F.sum(F.sqrt(F.pow(F.col("x1") - F.col("x0"), F.lit(2.0)) + F.pow(F.col("y1") - F.col("y0"), F.lit(2.0))))
    per = ringed.groupBy(group, "ring").agg(F.count("*").alias("edges"), turn.alias("turn"), length.alias("perimeter"), F.min("x0").alias("west"), F.min("y0").alias("south"))
    return per.select(group, "ring", "edges", F.abs("turn").alias("area"), "perimeter", (F.col("turn") < 0).alias("hole"), "west", "south")


def coherence(edges: DataFrame, measures: DataFrame, group: str) -> DataFrame:
    """One row for each group: the area of its union beside the sum of its areas, and how far they are apart.

    Areas that tile give the same; an overlap makes the union smaller, so COHERENT becomes
    OVERLAPPING; a group without area is EMPTY.
    """
    summed = edges.groupBy(group).agg((F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2).alias("sum_area"))
    signed = F.sum(F.when(F.col("hole"), -F.col("area")).otherwise(F.col("area")))
    union = measures.groupBy(group).agg(F.count_if(~F.col("hole")).alias("parts"), F.count_if("hole").alias("holes"), signed.alias("union_area"))
    apart = F.try_divide(F.abs(F.col("union_area") - F.col("sum_area")), F.col("sum_area"))
    state = F.when(~(F.coalesce("sum_area", F.lit(0.0)) > 0), "EMPTY").when(apart <= 1e-9, "COHERENT").otherwise("OVERLAPPING")
    both = summed.join(union, group, "left").withColumn("union_area", F.coalesce("union_area", F.lit(0.0))).withColumn("relative_difference", apart)
    none = F.lit(0).cast("long")
    return both.select(group, F.coalesce("parts", none).alias("parts"), F.coalesce("holes", none).alias("holes"), "sum_area", "union_area", "relative_difference", state.alias("state"))


def validity(edges: DataFrame) -> DataFrame:
    """(area_id, edges, loose, crossings, touches, pinches, valid) of the rings of each area; nothing is repaired.

    loose: ends that no other edge goes on from. crossings: pairs of edges that cross.
    touches: pairs where one ends inside the other or runs along it. pinches: vertices that a
    ring (a column ``ring``, else all edges of an area) comes through more than once. Edges
    meet by cells of a size that fits their area.
    """
    edges = edges if "ring" in edges.columns else edges.withColumn("ring", F.lit(0))
    start, end = F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))
    ends = edges.select("area_id", "ring", start.alias("p"), F.lit(1).alias("starts"), F.lit(0).alias("ends")).union(edges.select("area_id", "ring", end, F.lit(0), F.lit(1)))
    at = ends.groupBy("area_id", "ring", "p").agg(F.sum("starts").alias("starts"), F.sum("ends").alias("ends"))
    per = at.groupBy("area_id").agg(F.sum("starts").alias("edges"), F.sum(F.abs(F.col("starts") - F.col("ends"))).alias("loose"), F.count_if(F.col("starts") > 1).alias("pinches"))
    there = laid(edges.select("area_id", "seq", *_ENDS).join(fitting_size(edges, "area_id"), "area_id"), F.col("size")).drop("size")
    named = lambda p: there.select("area_id", "cell_x", "cell_y", *(F.col(c).alias(f"{p}_{c}") for c in ("seq", *_ENDS)))
    pairs = named("a").join(named("b"), ["area_id", "cell_x", "cell_y"]).where("a_seq < b_seq").drop("cell_x", "cell_y").distinct()
    met = pairs.select("area_id", *(c.alias(n) for n, c in _meeting("a", "b").items()))
    found = met.groupBy("area_id").agg(F.count_if("crosses").alias("crossings"), F.count_if("touches").alias("touches"))
    none = F.lit(0).cast("long")
    out = per.join(found, "area_id", "left").withColumns({c: F.coalesce(c, none) for c in ("crossings", "touches")})
    valid = (F.col("edges") >= 3) & (F.col("loose") + F.col("crossings") + F.col("touches") + F.col("pinches") == 0)
    return out.select("area_id", "edges", "loose", "crossings", "touches", "pinches", valid.alias("valid"))


def _meeting(a: str, b: str) -> dict[str, Column]:
    """How two edges meet, beyond a common end."""
    x, y = (lambda e, i: F.col(f"{e}_x{i}")), (lambda e, i: F.col(f"{e}_y{i}"))
    side = lambda e, f, i: F.signum((x(e, 1) - x(e, 0)) * (y(f, i) - y(e, 0)) - (y(e, 1) - y(e, 0)) * (x(f, i) - x(e, 0)))
    same = lambda e, i, f, j: (x(e, i) == x(f, j)) & (y(e, i) == y(f, j))
    # a point on the line of an edge lies inside it where it looks at its ends in opposite directions
    within = lambda e, f, i: (side(e, f, i) == 0) & ((x(f, i) - x(e, 0)) * (x(f, i) - x(e, 1)) + (y(f, i) - y(e, 0)) * (y(f, i) - y(e, 1)) < 0)
    crosses = (side(a, b, 0) * side(a, b, 1) < 0) & (side(b, a, 0) * side(b, a, 1) < 0)
    equal = (same(a, 0, b, 0) & same(a, 1, b, 1)) | (same(a, 0, b, 1) & same(a, 1, b, 0))
    return {"crosses": crosses, "touches": within(a, b, 0) | within(a, b, 1) | within(b, a, 0) | within(b, a, 1) | equal}
