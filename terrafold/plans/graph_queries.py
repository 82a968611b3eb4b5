"""Queries on graphs, sources, gates and the registry."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from terrafold.operators import graph, quality
from terrafold.operators.evidence import Registry
from terrafold.plans.fixtures import table
from terrafold.plans.registry import QUERIES, query
from terrafold.plans.spatial_queries import LAT, LON, areas
from terrafold.sources.readers import tiered
from terrafold.sources.sinks import fingerprint


def _segments(view):
    """Customers and suppliers of one nation are joined to their nation's node; nations in a line of fives."""
    c = view("customer").select((F.col("c_custkey") + 1000).alias("a"), F.col("c_nationkey").cast("long").alias("b"), (F.col("c_custkey") % 97 + 1.0).alias("length_m"))
    n = view("nation").where("n_nationkey % 5 <> 4").select(F.col("n_nationkey").cast("long").alias("a"), (F.col("n_nationkey") + 1).cast("long").alias("b"), F.lit(50.0).alias("length_m"))
    return c.union(n)


def _streets(view):
    """A street net with cycles: suppliers in a row, chords that skip four or eleven of them, and a spur to each part."""
    s = view("supplier").select(F.col("s_suppkey").cast("long").alias("s"))
    last = view("supplier").agg(F.max("s_suppkey").alias("last"))
    row = lambda skip, least: s.crossJoin(F.broadcast(last)).where(F.col("s") + skip <= F.col("last")).select(F.col("s").alias("a"), (F.col("s") + skip).alias("b"), (F.col("s") * 13 % 17 + float(least)).alias("length_m"))  # noqa: E731  one row of last
    spurs = view("part").select((F.col("p_partkey") + 1_000_000).cast("long").alias("a"), (F.col("p_partkey") % 10 + 1).cast("long").alias("b"), (F.col("p_partkey") % 5 + 1.0).alias("length_m"))
    return row(1, 10).union(row(4, 20).where("a % 3 = 0")).union(row(11, 30).where("a % 5 = 0")).union(spurs)


_STREETS = """
last as (select max(s_suppkey) as last from supplier),
net as (
 select s_suppkey as a, s_suppkey + 1 as b, s_suppkey * 13 % 17 + 10e0 as m from supplier, last where s_suppkey + 1 <= last
 union all select s_suppkey, s_suppkey + 4, s_suppkey * 13 % 17 + 20e0 from supplier, last where s_suppkey + 4 <= last and s_suppkey % 3 = 0
 union all select s_suppkey, s_suppkey + 11, s_suppkey * 13 % 17 + 30e0 from supplier, last where s_suppkey + 11 <= last and s_suppkey % 5 = 0
 union all select p_partkey + 1000000, p_partkey % 10 + 1, p_partkey % 5 + 1e0 from part),
ways as (select a, b, m from net union all select b, a, m from net),
dist(node, d) using key (node) as (
 select cast(1 as bigint), 0e0
 union
 select e.b, min(dist.d + e.m) from dist join ways e on e.a = dist.node left join recurring.dist r on r.node = e.b
 where r.d is null or dist.d + e.m < r.d group by e.b)"""


@query("", f"with recursive {_STREETS} select node, d as distance_m from dist")
def street_distances(view):
    """Exact distances in a net with cycles from its first node."""
    return street_distances_of(view)


def street_distances_of(view):
    seeds = view("supplier").where("s_suppkey = 1").select(F.col("s_suppkey").cast("long").alias("node"), F.lit(0.0).alias("cost_m"), F.lit("first").alias("label"))
    return graph.distances(_streets(view), seeds).select("node", "distance_m")


@query("", f"""
with recursive {_STREETS}
select dist.node, case when dist.d >= 25e0 then round(dist.d / (10e0 * abs(dist.node - 1)), 6) end as ratio
from dist where dist.node > 1 and dist.node < 1000000""")
def detour_ratios(view):
    """Distance in the net over the straight one to each supplier; none where the net's is too short to tell."""
    far = street_distances_of(view).where("node > 1 and node < 1000000").withColumn("straight_m", 10.0 * F.abs(F.col("node") - 1))
    ratio = F.when(F.col("distance_m") >= 25.0, graph.detour_ratio("distance_m", "straight_m", 10.0))
    return far.select("node", F.round(ratio, 6).alias("ratio"))


@query("", """
with n as (
 select c_nationkey - c_nationkey % 5 as part, c_custkey % 97 + 1e0 as m from customer
 union all select n_nationkey - n_nationkey % 5, 50e0 from nation where n_nationkey % 5 <> 4),
p as (select part, sum(m) as m from n group by part)
select sum(m) as total_m, max(m) as largest_m, count(*) as parts, round(max(m) / sum(m), 9) as share from p""")
def length_shares(view):
    """The length of a net, and the share of its longest part."""
    return graph.lengths(_segments(view)).withColumn("share", F.round("share", 9))


@query("", """
with e as (select c_custkey + 1000 as node, c_nationkey - c_nationkey % 5 as component from customer
 union all select n_nationkey, n_nationkey - n_nationkey % 5 from nation)
select cast(component as bigint) as component, count(*) as nodes from e group by 1""")
def graph_components(view):
    """Connected parts and their sizes."""
    return graph.components(_segments(view)).groupBy("component").agg(F.count("*").alias("nodes"))


@query("", """
select c_custkey + 1000 as node, c_custkey % 97 + 1e0 + 50e0 * (c_nationkey % 5) as distance_m,
 'seed ' || cast(c_nationkey - c_nationkey % 5 as varchar) as label from customer
union all select n_nationkey, 50e0 * (n_nationkey % 5), 'seed ' || cast(n_nationkey - n_nationkey % 5 as varchar) from nation""")
def network_distances(view):
    """Exact distances along segments to the nearest seed."""
    seeds = view("nation").where("n_nationkey % 5 = 0").select(F.col("n_nationkey").cast("long").alias("node"), F.lit(0.0).alias("cost_m"), F.concat(F.lit("seed "), F.col("n_nationkey").cast("string")).alias("label"))
    return graph.distances(_segments(view), seeds)


@query("", """
with e as (
 select c_custkey + 1000 as node, c_nationkey - c_nationkey % 5 as component from customer
 union all select n_nationkey, n_nationkey - n_nationkey % 5 from nation),
s as (select cast(component as bigint) as component, count(*) as nodes from e group by 1)
select row_number() over (order by nodes desc, component) as place, component, nodes from s qualify place <= 3""")
def largest_parts(view):
    """The three largest connected parts, largest first."""
    return graph.largest_first(_segments(view), 3).withColumn("place", F.col("place").cast("long"))


@query("poi", """
, p as (select 'published' as tier, 0 as pr, * from poi where type in ('museum', 'stay')), s as (select 'snapshot' as tier, 1 as pr, * from poi
 where type in ('museum', 'info')), u as (select * from p union all select * from s), b as (select type, min(pr) as pr from u group by type)
, l(layer) as (values ('museum'),('info'),('stay'),('bike'))
select l.layer, coalesce(max(u.tier), 'unavailable') as status, count(u.id) as points from l left join b on b.type = l.layer left
 join u on u.type = b.type and u.pr = b.pr group by l.layer""")
def layers_with_fallback(view):
    """The best tier of each layer, and layers that have none."""
    poi = view("poi").withColumnRenamed("type", "layer")
    points, status = tiered(["museum", "info", "stay", "bike"], [("published", poi.where("layer in ('museum', 'stay')")), ("snapshot", poi.where("layer in ('museum', 'info')"))])
    counts = points.groupBy("layer").agg(F.count("*").alias("points"))
    return status.join(counts, "layer", "left").select("layer", "status", F.coalesce("points", F.lit(0).cast("long")).alias("points"))


@query("licences poi", """
select 'licences' as source, 'inside_scope' as check, count(case
 when not (lon between -3.889e0 and -3.518e0 and lat between 40.312e0 and 40.564e0) then 1 end) = 0 as ok, count(case
 when not (lon between -3.889e0 and -3.518e0 and lat between 40.312e0 and 40.564e0) then 1 end) as bad from licences
union all select 'licences', 'known_family', count(case when family not in ('ACTIVITY','BUILDING') then 1 end) = 0, count(case
 when family not in ('ACTIVITY','BUILDING') then 1 end) from licences
union all select 'licences', 'unique_key', count(case when n > 1 then 1 end) = 0, count(case when n > 1 then 1 end) from (select id, count(*) n
 from licences group by id) t
union all select 'licences', 'known_ndp', count(*) = 0, count(*) from (select distinct ndp from licences where ndp not in (select id from poi)) t""")
def licence_gates(view):
    """Quality rules of the licences, with how many rows break each."""
    licences = view("licences")
    rules = {"inside_scope": F.col("lon").between(-3.889, -3.518) & F.col("lat").between(40.312, 40.564), "known_family": F.col("family").isin("ACTIVITY", "BUILDING")}
    return quality.gates(licences, "licences", rules).union(quality.unique(licences, "licences", "id")).union(quality.references(licences, view("poi").select(F.col("id").alias("ndp")), "licences", "ndp"))


@query("area_edges", """
select area_id, count(*) as edges, cast(0 as bigint) as loose, cast(0 as bigint) as crossings, true as valid from area_edges group by area_id""")
def ring_validity(view):
    """Rings that close and do not cross themselves."""
    return quality.valid_rings(view("area_edges")).select("area_id", "edges", "loose", F.col("crossings").cast("long").alias("crossings"), "valid")


_WORDS = " || ',' || ".join(f"cast(sum(cast('0x' || substr(h, {8 * i + 1}, 8) as bigint)) as varchar)" for i in range(8))


@query("population", f"""
, h as (
 select sha256('{{{{"area_id":' || area_id || ',"district_id":' || district_id || ',"residents":' || residents || '}}}}') as h from population)
select sha256(cast(count(*) as varchar) || ',' || {_WORDS}) as fingerprint, count(*) as n from h""".replace("{{", "{").replace("}}", "}"))
def population_fingerprint(view):
    """One hash of a table's rows, in any order."""
    return fingerprint(view("population"))


@query("area_edges population", """
, b as (select area_id, min(least(x0, x1)) as west, min(least(y0, y1)) as south from area_edges group by area_id)
select p.area_id, residents, west, south from population p join b on b.area_id = p.area_id order by residents desc, p.area_id limit 10""")
def residents_of_areas_by_rank(view):
    """Areas by residents, for a map's labels."""
    return areas(view).join(view("population").select("area_id", "residents"), "area_id").select("area_id", "residents", "west", "south").orderBy(F.desc("residents"), "area_id").limit(10)


def evidence_rows(spark, sf_dir: str):
    """One row for each of the registry's questions, answered or not."""
    r = Registry(spark, lambda name: table(spark, sf_dir, name))
    asked = [
        r.query("LICENCES_IN_LENS", lat=LAT, lon=LON, radius_m=3000.0, first=dt.date(1990, 1, 1), last=dt.date(1996, 1, 1)), r.query("LICENCES_IN_LENS", lat=LAT, lon=LON, radius_m=3000.0, first=dt.date(1980, 1, 1), last=dt.date(1981, 1, 1)),
        r.query("AREA_AT_POINT", lat=LAT, lon=LON), r.query("AREA_AT_POINT", lat=0.0, lon=0.0), r.query("AREAS_IN_LENS", lat=LAT, lon=LON, radius_m=4000.0), r.query("AREA_PHASE", code=5), r.query("AREA_PHASE", code=999), r.query("AREA_QUANTITY", code=5),
        r.query("EDITION_DIFF"), r.query("AREA_COMPARE", a=1, b=2), r.query("SOURCE_PROVENANCE", source="areas"), r.query("SOURCE_PROVENANCE", source="none"), r.query("AREA_PROFILE", lat=LAT, lon=LON), r.query("CITY_DEMAND"), r.query("CITY_DEMAND", flags=("predictive",)), r.query("ELSE"),
    ]
    out = asked[0]
    for x in asked[1:]:
        out = out.union(x)
    return out


QUERIES["evidence_rows"] = evidence_rows
