"""Queries on rings, outlines, overlays and split networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.operators import graph, network, rings, spatial, topology
from terrafold.plans.registry import query

_OUTLINE = """
, half as (
 select brick, band, x0, y0, case when y0 = y1 then (x0 + x1)/2 else x1 end as x1, y1, x0 <> x1 as flat, x1 as far from brick_edges),
u as (
 select band, x0, y0, x1, y1 from half
 union all select band, x1, y1, far, y1 from half where flat),
border as (
 select * from u where not exists (select 1 from u v where v.band = u.band and v.x0 = u.x1 and v.y0 = u.y1 and v.x1 = u.x0 and v.y1 = u.y0)),
reach(band, sx, sy, x, y) as (
 select distinct band, x0, y0, x0, y0 from border
 union select r.band, r.sx, r.sy, b.x1, b.y1 from reach r join border b on b.band = r.band and b.x0 = r.x and b.y0 = r.y),
label as (select band, x, y, min(sy*100000 + sx) as ring from reach group by band, x, y),
ringed as (select b.*, l.ring from border b join label l on l.band = b.band and l.x = b.x0 and l.y = b.y0),
measure as (
 select band, ring, sum(x0*y1 - x1*y0)/2 as turn, sum(abs(x1 - x0) + abs(y1 - y0)) as perimeter, min(x0) as west, min(y0) as south from ringed group by band, ring)"""


def _outlines(view):
    edges = view("brick_edges")
    return edges, rings.ring_measures(rings.rings(rings.boundary(edges, "band"), "band"), "band")


@query("brick_edges", f"{_OUTLINE} select band, abs(turn) as area, perimeter, turn < 0 as hole, west, south from measure")
def outlines_of_bands(view):
    """The rings of the outline of each band of bricks, holes apart; the bricks of two rows have different corners on their common line."""
    return _outlines(view)[1].select("band", "area", "perimeter", "hole", "west", "south")


@query("brick_edges", f"""{_OUTLINE}
select m.band, count(case when turn > 0 then 1 end) as parts, count(case when turn < 0 then 1 end) as holes, any_value(s.sum_area) as sum_area,
 sum(turn) as union_area, abs(sum(turn) - any_value(s.sum_area)) / any_value(s.sum_area) as relative_difference, 'COHERENT' as state
from measure m join (select band, 2e0*count(distinct brick) as sum_area from brick_edges group by band) s on s.band = m.band group by m.band""")
def outline_coherence(view):
    """The area of each band's outline beside the sum of its bricks."""
    edges, measures = _outlines(view)
    return rings.coherence(edges, measures, "band")


_SIDE = "sign(({0}.x1-{0}.x0)*({1}.y{2}-{0}.y0)-({0}.y1-{0}.y0)*({1}.x{2}-{0}.x0))"
_WITHIN = "({s} = 0 and ({1}.x{2}-{0}.x0)*({1}.x{2}-{0}.x1)+({1}.y{2}-{0}.y0)*({1}.y{2}-{0}.y1) < 0)"
_side = _SIDE.format
_inside = lambda e, f, i: _WITHIN.format(e, f, i, s=_side(e, f, i))


@query("shape_edges", f"""
, pair as (
 select a.area_id, {_side('a', 'b', 0)}*{_side('a', 'b', 1)} < 0 and {_side('b', 'a', 0)}*{_side('b', 'a', 1)} < 0 as crosses,
  {_inside('a', 'b', 0)} or {_inside('a', 'b', 1)} or {_inside('b', 'a', 0)} or {_inside('b', 'a', 1)}
  or (a.x0 = b.x1 and a.y0 = b.y1 and a.x1 = b.x0 and a.y1 = b.y0) or (a.x0 = b.x0 and a.y0 = b.y0 and a.x1 = b.x1 and a.y1 = b.y1) as touches
 from shape_edges a join shape_edges b on b.area_id = a.area_id and a.seq < b.seq),
met as (select area_id, count(*) filter (crosses) as crossings, count(*) filter (touches) as touches from pair group by area_id),
ends as (
 select area_id, ring, x0 as x, y0 as y, 1 as s, 0 as e from shape_edges
 union all select area_id, ring, x1, y1, 0, 1 from shape_edges),
p as (select area_id, ring, x, y, sum(s) as s, sum(e) as e from ends group by all),
per as (select area_id, sum(s) as edges, sum(abs(s - e)) as loose, count(*) filter (s > 1) as pinches from p group by area_id)
select per.area_id, cast(edges as bigint) as edges, cast(loose as bigint) as loose, crossings, touches, pinches,
 edges >= 3 and loose + crossings + touches + pinches = 0 as valid from per join met on met.area_id = per.area_id""")
def flawed_rings(view):
    """Rings that are open, cross, touch or pinch themselves, or fold back, beside valid ones with holes and parts."""
    return rings.validity(view("shape_edges"))


_IN_SHAPE = "sum(case when ((e.y0>p.y)<>(e.y1>p.y)) and p.x < (e.x1-e.x0)*(p.y-e.y0)/(e.y1-e.y0)+e.x0 then 1 else 0 end) % 2 = 1"
_SPOTS = "spot as (select p_partkey as id, (p_partkey%1000)*10e0 + (p_partkey*37%80)/10e0 + 0.05e0 as x, cast(floor(p_partkey/1000e0) as int)*10e0 + (p_partkey*61%80)/10e0 + 0.05e0 as y from part)"


@query("shape_edges", f"""
, {_SPOTS}
select p.id, e.area_id from spot p join shape_edges e on floor(e.x0/10e0) = floor(p.x/10e0) and floor(e.y0/10e0) = floor(p.y/10e0)
where e.kind in (0, 5) group by p.id, e.area_id having {_IN_SHAPE}""")
def spots_in_shapes(view):
    """Points in areas that have holes, parts and concave rings."""
    row = F.floor(F.col("p_partkey") / 1000.0) * 10.0
    spots = view("part").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") % 1000) * 10.0 + (F.col("p_partkey") * 37 % 80) / 10.0 + 0.05).alias("lon"), (row + (F.col("p_partkey") * 61 % 80) / 10.0 + 0.05).alias("lat"))
    return spatial.in_areas(spots, spatial.polygons(view("shape_edges").where("kind in (0, 5)")), size=5.0).select("id", "area_id")


@query("shape_edges", f"""
, tile as (
 select distinct area_id, cast(floor(x0/10e0)*10e0 + 1 + area_id%3 as double) as w, cast(floor(x0/10e0)*10e0 + 5 + area_id%2 as double) as e,
  cast(floor(y0/10e0)*10e0 + area_id%2 as double) as s, cast(floor(y0/10e0)*10e0 + 5 + area_id%3 as double) as n from shape_edges where kind in (0, 5)),
p as (
 select t.area_id, t.w + i + 0.5e0 as x, t.s + j + 0.5e0 as y, t.e, t.n from tile t, unnest(range(0, 8)) a(i), unnest(range(0, 8)) b(j)
 where t.w + i < t.e and t.s + j < t.n),
cell as (
 select p.area_id, p.x, p.y from p join shape_edges e on e.area_id = p.area_id group by p.area_id, p.x, p.y having {_IN_SHAPE})
select area_id, area_id as other_id, cast(count(*) as double) as overlap, round(count(*) / case when area_id%7 = 0 then 16e0 else 31e0 end, 9) as share
from cell group by area_id""")
def shape_overlays(view):
    """What shapes with holes and parts have in common with tiles laid over them."""
    shapes = view("shape_edges").where("kind in (0, 5)")
    ox, oy = F.floor(F.min("x0") / 10) * 10.0, F.floor(F.min("y0") / 10) * 10.0
    tile = shapes.groupBy("area_id").agg(ox.alias("ox"), oy.alias("oy"))
    k = F.col("area_id")
    tile = tile.select("area_id", (F.col("ox") + 1 + k % 3).alias("w"), (F.col("ox") + 5 + k % 2).alias("e"), (F.col("oy") + k % 2).alias("s"), (F.col("oy") + 5 + k % 3).alias("n"))
    corner = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    ringed = tile.select("area_id", F.array(corner("w", "s"), corner("e", "s"), corner("e", "n"), corner("w", "n")).alias("ring"))
    out = topology.overlay(spatial.polygons(shapes), spatial.polygons(spatial.edges_of_rings(ringed)), size=5.0)
    return out.select("area_id", "other_id", F.round("overlap", 9).alias("overlap"), F.round("share", 9).alias("share"))


_T = "greatest(0e0, least(1e0, ((p.x-s.x0)*(s.x1-s.x0)+(p.y-s.y0)*(s.y1-s.y0))/((s.x1-s.x0)*(s.x1-s.x0)+(s.y1-s.y0)*(s.y1-s.y0))))"
_SPLIT = f"""
, near as (
 select p.id, s.segment, s.a, s.b, {_T} as t, case when {_T} = 0 then sqrt((p.x-s.x0)*(p.x-s.x0)+(p.y-s.y0)*(p.y-s.y0))
  when {_T} = 1 then sqrt((p.x-s.x1)*(p.x-s.x1)+(p.y-s.y1)*(p.y-s.y1)) else abs((p.x-s.x0)*(s.y1-s.y0)-(p.y-s.y0)*(s.x1-s.x0))/100e0 end as d
 from doors p cross join street_segments s),
hit as (
 select id, segment, t, d, case when t <= 0 then 'n' || a when t >= 1 then 'n' || b else 's' || segment || '@' || t end as node from near where d <= 40e0
 qualify row_number() over (partition by id order by d, segment) = 1),
mark as (
 select segment, t, node from hit where t > 0 and t < 1
 union select segment, 0e0, 'n' || a from street_segments union select segment, 1e0, 'n' || b from street_segments)"""
_SNAP = f"""{_SPLIT},
step as (
 select node as a, lead(node) over (partition by segment order by t) as b, (lead(t) over (partition by segment order by t) - t)*100e0 as m from mark),
ways as (select a, b, m from step where b is not null union all select b, a, m from step where b is not null),
dist(node, d) using key (node) as (
 select 'n0', 0e0
 union
 select e.b, min(dist.d + e.m) from dist join ways e on e.a = dist.node left join recurring.dist r on r.node = e.b
 where r.d is null or dist.d + e.m < r.d - 1e-9 group by e.b)"""


@query("street_segments doors", f"{_SNAP} select id, segment, round(t, 9) as t, round(d, 9) as offset_m from hit")
def doors_on_streets(view):
    """The street place nearest to each door; doors too far from all are left out."""
    hits = network.snapped(view("doors"), view("street_segments"), 40.0)
    return hits.select("id", F.col("segment").cast("long").alias("segment"), F.round("t", 9).alias("t"), F.round("offset", 9).alias("offset_m"))


@query("street_segments doors", f"""{_SPLIT}
select segment, round(t, 9) as t0, round(lead(t) over (partition by segment order by t), 9) as t1,
 round((lead(t) over (partition by segment order by t) - t)*100e0, 9) as length_m from mark qualify t1 is not null""")
def split_streets(view):
    """The pieces of each street between the doors on it; doors at one place cut it once."""
    streets = view("street_segments")
    edges, _ = network.split(streets, network.snapped(view("doors"), streets, 40.0))
    at = lambda c, end: F.when(F.col(c).startswith("s"), F.split_part(c, F.lit("@"), F.lit(2)).cast("double")).otherwise(end)
    of_cut = lambda c: F.when(F.col(c).startswith("s"), F.split_part(F.substring(c, 2, 99), F.lit("@"), F.lit(1)).cast("long"))
    whole = streets.select(F.col("segment").alias("own"), F.concat(F.lit("n"), F.col("a")).alias("wa"), F.concat(F.lit("n"), F.col("b")).alias("wb"))
    uncut = F.when(F.col("a").startswith("n") & F.col("b").startswith("n"), True)
    named = edges.withColumn("segment", F.coalesce(of_cut("a"), of_cut("b")))
    direct = named.where(uncut).join(whole, (F.col("a") == F.col("wa")) & (F.col("b") == F.col("wb"))).withColumn("segment", F.col("own").cast("long"))
    every = named.where("segment is not null").unionByName(direct.select(*named.columns))
    return every.select("segment", F.round(at("a", 0.0), 9).alias("t0"), F.round(at("b", 1.0), 9).alias("t1"), F.round("length_m", 9).alias("length_m"))


@query("street_segments doors", f"{_SNAP} select id, round(dist.d + hit.d, 6) as distance_m from hit join dist on dist.node = hit.node")
def walks_to_doors(view):
    """Distances from a corner to each door, the last steps off the street counted; the SQL walks the streets as split at the doors."""
    streets = view("street_segments")
    seed = view("nation").where("n_nationkey = 0").select(F.col("n_nationkey").cast("int").alias("node"), F.lit(0.0).alias("cost_m"), F.lit("corner").alias("label"))
    far = network.distances_to_places(streets, network.snapped(view("doors"), streets, 40.0), seed)
    return far.select("id", F.round(F.col("distance_m") + F.col("offset"), 6).alias("distance_m"))
