"""Queries on places."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from terrafold.functions import geo
from terrafold.operators import aggregates, spatial
from terrafold.operators.evidence import FAMILIES
from terrafold.plans.registry import query

LAT, LON, RADIUS = 40.4168, -3.7038, 5000.0

_HAVERSINE = "2*6371000e0*asin(sqrt(power(sin(radians({b}-{a})/2),2)+cos(radians({a}))*cos(radians({b}))*power(sin(radians({d}-{c})/2),2)))"
_FROM_CENTRE = _HAVERSINE.format(a="40.4168e0", b="lat", c="(-3.7038e0)", d="lon")
_CROSSINGS = "sum(case when ((e.y0>p.lat)<>(e.y1>p.lat)) and p.lon < (e.x1-e.x0)*(p.lat-e.y0)/(e.y1-e.y0)+e.x0 then 1 else 0 end)"


def areas(view):
    return spatial.polygons(view("area_edges"), "district_id")


@query("licences", f"""
, f(family) as (values ('ACTIVITY'),('BUILDING'),('TEMPORARY'))
select f.family, count(l.id) as n from f left join (select * from licences
 where {_FROM_CENTRE} <= 5000 and grant_date between date '1996-01-01' and date '1999-12-31') l on l.family = f.family group by f.family""")
def licences_in_lens(view):
    """Licences by family in a circle and a window; each family is listed, none summed over."""
    held = view("licences").where(F.col("grant_date").between(dt.date(1996, 1, 1), dt.date(1999, 12, 31)) & geo.in_circle(F.col("lat"), F.col("lon"), LAT, LON, RADIUS))
    return aggregates.zero_filled(held.groupBy("family").agg(F.count("*").alias("n")), list(FAMILIES), "family")


@query("poi area_edges", f"""
, par as (select p.id, e.area_id, {_CROSSINGS} as crossings from poi p cross join area_edges e group by p.id, e.area_id)
select a.area_id, count(h.id) as n from (select distinct area_id from area_edges) a left join (select * from par
 where crossings % 2 = 1) h on h.area_id = a.area_id group by a.area_id""")
def points_by_area(view):
    """Points of each area, areas without one too."""
    hits = spatial.in_areas(view("poi"), areas(view)).groupBy("area_id").agg(F.count("*").alias("n"))
    return areas(view).select("area_id").join(hits, "area_id", "left").select("area_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("poi area_edges", f"""
, par as (select p.id, e.area_id, {_CROSSINGS} as crossings from poi p cross join area_edges e group by p.id, e.area_id)
select p.id, h.area_id, d.district_id, case when h.area_id is null then 'OUTSIDE_ALL' else 'RESOLVED' end as state
from poi p left join (select id, min(area_id) as area_id from par where crossings % 2 = 1 group by id) h on h.id = p.id left
 join (select distinct area_id, district_id from area_edges) d on d.area_id = h.area_id""")
def area_and_district_of_points(view):
    """The area of each point, its district from the area's parent, and a state."""
    at = spatial.locate(view("poi"), areas(view))
    return at.join(areas(view).select("area_id", "district_id"), "area_id", "left").select("id", "area_id", "district_id", "state")


@query("poi area_edges", f"""
, par as (select p.id, e.area_id, {_CROSSINGS} as crossings from poi p cross join area_edges e where e.area_id % 3 <> 0 group by p.id, e.area_id),
h as (select id, count(*) as hits from par where crossings % 2 = 1 group by id)
select case when h.hits is null then 'OUTSIDE_ALL' when h.hits > 1 then 'BOUNDARY_OR_AMBIGUOUS' else 'RESOLVED' end as state, count(*) as n
 from poi p left join h on h.id = p.id group by 1""")
def unique_area_states(view):
    """States of points where several covering areas name none."""
    some = areas(view).where("area_id % 3 <> 0")
    return spatial.locate(view("poi"), some, first=False).groupBy("state").agg(F.count("*").alias("n"))


@query("stations area_edges", """
, s as (select station_id, area_id, lat, lon, y0, x0, y1, x1 from stations cross join area_edges),
l as (select station_id, area_id, lat, lon, y0, x0, y1, x1,
 acos(greatest(-1e0, least(1e0, sin(radians(lat))*sin(radians(y0))+cos(radians(lat))*cos(radians(y0))*cos(radians(x0-lon))))) as c0,
 acos(greatest(-1e0, least(1e0, sin(radians(lat))*sin(radians(y1))+cos(radians(lat))*cos(radians(y1))*cos(radians(x1-lon))))) as c1 from s),
m as (select station_id, area_id, lat, lon, y0, x0, y1, x1,
 c0/sin(c0)*6371008.8e0*cos(radians(y0))*sin(radians(x0-lon)) as ax,
 c0/sin(c0)*6371008.8e0*(cos(radians(lat))*sin(radians(y0))-sin(radians(lat))*cos(radians(y0))*cos(radians(x0-lon))) as ay,
 c1/sin(c1)*6371008.8e0*cos(radians(y1))*sin(radians(x1-lon)) as bx,
 c1/sin(c1)*6371008.8e0*(cos(radians(lat))*sin(radians(y1))-sin(radians(lat))*cos(radians(y1))*cos(radians(x1-lon))) as b_y from l),
t as (select *, greatest(0e0, least(1e0, -(ax*(bx-ax)+ay*(b_y-ay))/((bx-ax)*(bx-ax)+(b_y-ay)*(b_y-ay)))) as t from m),
d as (select station_id, area_id, min(sqrt(power(ax+t*(bx-ax),2)+power(ay+t*(b_y-ay),2))) as dist, sum(case
 when ((y0>lat)<>(y1>lat)) and lon < (x1-x0)*(lat-y0)/(y1-y0)+x0 then 1 else 0 end) % 2 as inside from t group by station_id, area_id)
select area_id, count(*) as n from d where inside = 1 or dist <= 900 group by area_id""")
def areas_met_by_circles(view):
    """How many of the stations' circles meet each area."""
    stations = view("stations").select(F.col("station_id").alias("id"), "lat", "lon")
    return spatial.circles_meet_areas(stations, areas(view), 900.0).groupBy("area_id").agg(F.count("*").alias("n"))


@query("licences area_edges", """
, p as (select id, lat, lon, cast(floor((lon+3.889e0)/0.0742e0) as bigint) as gx, cast(floor((lat-40.312e0)/0.0504e0) as bigint) as gy from licences
 where family = 'BUILDING'),
s as (select p.id, e.area_id, lat, lon, y0, x0, y1, x1 from p join area_edges e on e.area_id % 5 = p.gx and cast(floor(e.area_id/5e0) as bigint) = p.gy),
l as (select *, acos(greatest(-1e0, least(1e0, sin(radians(lat))*sin(radians(y0))+cos(radians(lat))*cos(radians(y0))*cos(radians(x0-lon))))) as c0,
 acos(greatest(-1e0, least(1e0, sin(radians(lat))*sin(radians(y1))+cos(radians(lat))*cos(radians(y1))*cos(radians(x1-lon))))) as c1 from s),
m as (select id, area_id, c0/sin(c0)*6371008.8e0*cos(radians(y0))*sin(radians(x0-lon)) as ax,
 c0/sin(c0)*6371008.8e0*(cos(radians(lat))*sin(radians(y0))-sin(radians(lat))*cos(radians(y0))*cos(radians(x0-lon))) as ay,
 c1/sin(c1)*6371008.8e0*cos(radians(y1))*sin(radians(x1-lon)) as bx,
 c1/sin(c1)*6371008.8e0*(cos(radians(lat))*sin(radians(y1))-sin(radians(lat))*cos(radians(y1))*cos(radians(x1-lon))) as b_y from l),
t as (select *, greatest(0e0, least(1e0, -(ax*(bx-ax)+ay*(b_y-ay))/((bx-ax)*(bx-ax)+(b_y-ay)*(b_y-ay)))) as t from m),
d as (select id, area_id, min(sqrt(power(ax+t*(bx-ax),2)+power(ay+t*(b_y-ay),2))) as dist from t group by id, area_id)
select area_id, count(*) as licences, count(case when dist <= 100 then 1 end) as near_boundary, round(min(dist), 3) as nearest_m from d group by area_id""")
def licences_by_area_near_boundary(view):
    """Building licences of each area, and how many stand within 100 m of its boundary."""
    hits = spatial.in_areas(view("licences").where("family = 'BUILDING'"), areas(view)).withColumn("m", geo.boundary_m(F.col("lat"), F.col("lon"), F.col("edges")))
    return hits.groupBy("area_id").agg(F.count("*").alias("licences"), F.count_if(F.col("m") <= 100).alias("near_boundary"), F.round(F.min("m"), 3).alias("nearest_m"))


@query("poi", f"""
, c as (select count(case when type='museum' then 1 end) museum, count(case when type='info' then 1 end) info, count(case
 when type='stay' then 1 end) stay, count(case when type='bike' then 1 end) bike, count(case when type='rail' then 1 end) rail from poi
 where {_FROM_CENTRE} <= 5000)
select *, bike+rail as mobility, museum+info as tourism, museum+info+stay+bike+rail as total, round((museum+info+stay+bike+rail)/(pi()*25),
 6) as per_km2 from c""")
def lens_counts(view):
    """Counts in a circle by kind, their sums and the density."""
    held = view("poi").where(geo.in_circle(F.col("lat"), F.col("lon"), LAT, LON, RADIUS))
    c = held.agg(*(F.count_if(F.col("type") == t).alias(t) for t in ("museum", "info", "stay", "bike", "rail")))
    total = F.col("museum") + F.col("info") + F.col("stay") + F.col("bike") + F.col("rail")
    return c.select("*", (F.col("bike") + F.col("rail")).alias("mobility"), (F.col("museum") + F.col("info")).alias("tourism"), total.alias("total"), F.round(total / (F.pi() * 25), 6).alias("per_km2"))


@query("stations", f"""
select round(sum(case when observation_count > 0 then mean_observed*observation_count end)/sum(case
 when observation_count > 0 then observation_count end), 6) as mean, cast(coalesce(sum(observation_count),0) as bigint) as observations,
 case when sum(observation_count) > 0 then 'OBSERVED' else 'NONE' end as evidence, min(date_min) as first_day, max(date_max) as last_day
 from stations where {_FROM_CENTRE} <= 5000""")
def weighted_activity(view):
    """Mean activity of the stations in a circle, weighted by their observations, with the days it spans."""
    held = view("stations").where(geo.in_circle(F.col("lat"), F.col("lon"), LAT, LON, RADIUS))
    mean, n, evidence = aggregates.weighted_mean("mean_observed", "observation_count")
    return held.agg(mean, n, evidence, F.min("date_min").alias("first_day"), F.max("date_max").alias("last_day")).withColumn("mean", F.round("mean", 6))


@query("stations poi", f"""
, d as (select s.station_id, p.id, {_HAVERSINE.format(a="s.lat", b="p.lat", c="s.lon", d="p.lon")} as distance_m from stations s cross join poi p)
, r as (select *, row_number() over (partition by station_id order by distance_m, id) as rank from d)
select station_id, id, rank, round(distance_m, 3) as distance_m from r where rank <= 5""")
def nearest_five(view):
    """The five nearest points of each station, however far."""
    right = view("poi").select("id", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    out = spatial.nearest_anywhere(view("stations").select("station_id", "lat", "lon"), right, 5, 3000.0, "station_id", "id")
    return out.select("station_id", "id", F.col("rank").cast("long").alias("rank"), F.round("distance_m", 3).alias("distance_m"))


@query("poi", f"""
, n as (select a.id, a.type, count(b.id) as n from poi a left
 join poi b on a.type = b.type and a.id <> b.id and {_HAVERSINE.format(a="a.lat", b="b.lat", c="a.lon", d="b.lon")} <= 800 group by a.id, a.type)
, o as (select type, n, row_number() over (partition by type order by n) as rn, count(*) over (partition by type) as k from n)
select type, max(n) as most, max(case when rn = cast(floor(0.95e0*(k-1)+0.5e0) as bigint)+1 then n end) as p95 from o group by type""")
def neighbours_of_kind(view):
    """Neighbours of the same kind within 800 m: the most, and the nearest-rank 95th percentile."""
    poi = view("poi")
    right = poi.select(F.col("id").alias("other"), F.col("type").alias("r_type"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    met = spatial.within(poi, right, 800.0).where("type = r_type and id <> other").groupBy("id").agg(F.count("*").alias("n"))
    counted = poi.select("id", "type").join(met, "id", "left").select("type", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    most = counted.groupBy("type").agg(F.max("n").alias("most"))
    return most.join(aggregates.values_at(counted, "n", {"p95": aggregates.nearest_rank(0.95)}, "type"), "type")


@query("poi", """
, c as (select id, lat, lon, cast(floor((lon+180e0)/360e0*(256e0*8192e0)/76) as bigint) as cell_x,
 cast(floor((0.5e0 - ln((1+sin(radians(lat)))/(1-sin(radians(lat))))/(4*pi()))*(256e0*8192e0)/76) as bigint) as cell_y from poi)
select cell_x, cell_y, count(*) as n, round(avg(lat), 9) as lat, round(avg(lon), 9) as lon, min(id) as first_id from c group by cell_x, cell_y""")
def pixel_clusters(view):
    """Points on a pixel grid of zoom 13: counts and mean places."""
    c = spatial.clusters(view("poi"), 13, 76)
    return c.select("cell_x", "cell_y", "n", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "first_id")


@query("area_edges", f"""
select area_id, count(*) as vertices, min(least(x0,x1)) as west, max(greatest(x0,x1)) as east, round(avg(x0), 9) as ref_lon, round(avg(y0), 9) as ref_lat,
 round(abs(sum(radians(x1-x0)*(2+sin(radians(y0))+sin(radians(y1)))))*6371000e0*6371000e0/2, 2) as area_m2,
 round(sum({_HAVERSINE.format(a="y0", b="y1", c="x0", d="x1")}), 4) as perimeter_m from area_edges group by area_id""")
def area_measures(view):
    """Box, reference point, area and perimeter."""
    e = F.col("edges")
    mean = lambda f: F.aggregate(F.transform(e, f), F.lit(0.0), lambda a, x: a + x) / F.size(e)
    return areas(view).select("area_id", F.size(e).cast("long").alias("vertices"), "west", "east", F.round(mean(lambda v: v["x0"]), 9).alias("ref_lon"), F.round(mean(lambda v: v["y0"]), 9).alias("ref_lat"), F.round(geo.ring_area_m2(e), 2).alias("area_m2"), F.round(geo.perimeter_m(e), 4).alias("perimeter_m"))


@query("poi area_edges", """
, s as (select row_number() over (order by area_id, seq) as segment, x0, y0, x1, y1 from area_edges),
l as (select p.id, s.segment, acos(greatest(-1e0, least(1e0,
 sin(radians(lat))*sin(radians(y0))+cos(radians(lat))*cos(radians(y0))*cos(radians(x0-lon))))) as c0,
 acos(greatest(-1e0, least(1e0, sin(radians(lat))*sin(radians(y1))+cos(radians(lat))*cos(radians(y1))*cos(radians(x1-lon))))) as c1, lat, lon, x0,
 y0, x1, y1 from poi p cross join s),
m as (select id, segment, c0/sin(c0)*6371008.8e0*cos(radians(y0))*sin(radians(x0-lon)) as ax,
 c0/sin(c0)*6371008.8e0*(cos(radians(lat))*sin(radians(y0))-sin(radians(lat))*cos(radians(y0))*cos(radians(x0-lon))) as ay,
 c1/sin(c1)*6371008.8e0*cos(radians(y1))*sin(radians(x1-lon)) as bx,
 c1/sin(c1)*6371008.8e0*(cos(radians(lat))*sin(radians(y1))-sin(radians(lat))*cos(radians(y1))*cos(radians(x1-lon))) as b_y from l),
t as (select *, greatest(0e0, least(1e0, -(ax*(bx-ax)+ay*(b_y-ay))/((bx-ax)*(bx-ax)+(b_y-ay)*(b_y-ay)))) as t from m),
d as (select id, segment, round(sqrt(power(ax+t*(bx-ax),2)+power(ay+t*(b_y-ay),2)), 3) as d from t)
select id, min(d) as offset_m from d where d <= 1500 group by id""")
def snapped_offsets(view):
    """How far each point stands from the nearest segment, up to 1.5 km."""
    segments = view("area_edges").select((F.col("area_id") * 4 + F.col("seq")).cast("long").alias("segment"), "x0", "y0", "x1", "y1")
    return spatial.nearest_segment(view("poi"), segments, 1500.0).select("id", F.round("offset_m", 3).alias("offset_m"))


@query("poi area_edges", """
, s as (select row_number() over (order by area_id, seq) - 1 as segment, x0, y0, x1, y1 from area_edges),
l as (select p.id, s.segment, acos(greatest(-1e0, least(1e0,
 sin(radians(lat))*sin(radians(y0))+cos(radians(lat))*cos(radians(y0))*cos(radians(x0-lon))))) as c0,
 acos(greatest(-1e0, least(1e0, sin(radians(lat))*sin(radians(y1))+cos(radians(lat))*cos(radians(y1))*cos(radians(x1-lon))))) as c1, lat, lon, x0,
 y0, x1, y1 from poi p cross join s),
m as (select id, segment, c0/sin(c0)*6371008.8e0*cos(radians(y0))*sin(radians(x0-lon)) as ax,
 c0/sin(c0)*6371008.8e0*(cos(radians(lat))*sin(radians(y0))-sin(radians(lat))*cos(radians(y0))*cos(radians(x0-lon))) as ay,
 c1/sin(c1)*6371008.8e0*cos(radians(y1))*sin(radians(x1-lon)) as bx,
 c1/sin(c1)*6371008.8e0*(cos(radians(lat))*sin(radians(y1))-sin(radians(lat))*cos(radians(y1))*cos(radians(x1-lon))) as b_y from l),
t as (select *, greatest(0e0, least(1e0, -(ax*(bx-ax)+ay*(b_y-ay))/((bx-ax)*(bx-ax)+(b_y-ay)*(b_y-ay)))) as t from m),
d as (select id, segment, sqrt(power(ax+t*(bx-ax),2)+power(ay+t*(b_y-ay),2)) as d from t)
select id, segment, round(d, 3) as offset_m from d where d <= 1500 qualify row_number() over (partition by id order by round(d, 6), segment) = 1""")
def snapped_segments(view):
    """The segment that each point stands nearest to, up to 1.5 km; the border of two areas is the lower number's."""
    segments = view("area_edges").select((F.col("area_id") * 4 + F.col("seq")).cast("long").alias("segment"), "x0", "y0", "x1", "y1")
    return spatial.nearest_segment(view("poi"), segments, 1500.0).select("id", "segment", F.round("offset_m", 3).alias("offset_m"))


@query("area_edges", """
, a as (select area_id, min(least(y0, y1)) as south, max(greatest(y0, y1)) as north from area_edges group by area_id),
l as (select area_id, rung, south + (north - south) * rung / 34e0 as y from a, unnest(range(1, 34)) u(rung)),
x as (
 select l.area_id, rung, y, (x1 - x0) * (y - y0) / (y1 - y0) + x0 as x
 from l join area_edges e on e.area_id = l.area_id and (y0 > y) <> (y1 > y)),
o as (
 select *, row_number() over (partition by area_id, rung order by x) as i, lead(x) over (partition by area_id, rung order by x) as b from x),
s as (select area_id, rung, y, round(b - x, 12) as width, (x + b) / 2 as x from o where i % 2 = 1 and b is not null),
r as (select *, row_number() over (partition by area_id order by width desc, rung) as nth from s)
select area_id, round(width, 9) as width, round(x, 9) as x, round(y, 9) as y from r where nth = 1""")
def label_places(view):
    """The widest interior stretch of each area."""
    out = spatial.interior_span(areas(view))
    return out.select("area_id", *(F.round(c, 9).alias(c) for c in ("width", "x", "y")))


@query("poi", f"""
, d as (select id, {_FROM_CENTRE} as d from poi)
, t(threshold) as (values (2000), (4000), (8000))
select threshold, count(case when d <= threshold then 1 end) as inside_straight, count(case when d*1.3e0 <= threshold then 1 end) as inside_network,
 count(case when d <= threshold and d*1.3e0 > threshold then 1 end) as false_inclusions from d cross join t group by threshold""")
def threshold_confusion(view):
    """Points inside by the straight line and by a longer way, and those only inside by the first."""
    d = view("poi").select(geo.haversine_m(LAT, LON, F.col("lat"), F.col("lon")).alias("d")).withColumn("threshold", F.explode(F.array(*map(F.lit, (2000, 4000, 8000)))))
    a, b = F.col("d") <= F.col("threshold"), F.col("d") * 1.3 <= F.col("threshold")
    return d.groupBy("threshold").agg(F.count_if(a).alias("inside_straight"), F.count_if(b).alias("inside_network"), F.count_if(a & ~b).alias("false_inclusions"))


@query("poi", """
, r as (select round(lon, 2) as lon2, round(lat, 2) as lat2, id from poi)
select lon2, lat2, min(id) as first_id, max(id) as last_id, count(*) as members from r group by lon2, lat2""")
def colocated_points(view):
    """One record for each place to two decimals, named by its lowest id."""
    g = view("poi").groupBy(F.round("lon", 2).alias("lon2"), F.round("lat", 2).alias("lat2"))
    return g.agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("members"))
