"""Deterministic place-based views over the driver tables; each text runs in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages", "documents")

VIEWS = {
    "poi": """
select c_custkey as id,
 case c_mktsegment when 'AUTOMOBILE' then 'museum' when 'BUILDING' then 'info' when 'FURNITURE' then 'stay' when 'HOUSEHOLD' then 'bike' else 'rail' end as type,
 -3.889e0 + (cast((c_custkey*7919)%10007 as double)+0.5e0)/10007e0*0.371e0 as lon,
 40.312e0 + (cast((c_custkey*104729)%10009 as double)+0.5e0)/10009e0*0.252e0 as lat
from customer""",
    "area_edges": """
select n_nationkey as area_id, n_regionkey as district_id, k.seq as seq,
 -3.889e0 + (n_regionkey + k.x0)*0.0742e0 as x0, 40.312e0 + (cast(floor(n_nationkey/5e0) as int) + k.y0)*0.0504e0 as y0,
 -3.889e0 + (n_regionkey + k.x1)*0.0742e0 as x1, 40.312e0 + (cast(floor(n_nationkey/5e0) as int) + k.y1)*0.0504e0 as y1
from nation cross join (values (0,0,0,1,0),(1,1,0,1,1),(2,1,1,0,1),(3,0,1,0,0)) k(seq,x0,y0,x1,y1)""",
    "licences": """
select o_orderkey as id,
 case o_orderstatus when 'F' then 'BUILDING' when 'O' then 'ACTIVITY' else 'TEMPORARY' end as family,
 cast(o_orderdate as date) as grant_date, o_custkey as ndp,
 -3.889e0 + (cast((o_orderkey*7919)%10007 as double)+0.5e0)/10007e0*0.371e0 as lon,
 40.312e0 + (cast((o_orderkey*104729)%10009 as double)+0.5e0)/10009e0*0.252e0 as lat
from orders""",
    "population": """
select n_nationkey as area_id, n_regionkey as district_id, count(c_custkey)*100 + n_nationkey as residents
from nation left join customer on c_nationkey = n_nationkey group by n_nationkey, n_regionkey""",
    "monthly": """
select cast(date_trunc('month', o_orderdate) as date) as period,
 case when cast(date_trunc('month', o_orderdate) as date) = date '1996-05-01' then null else count(*) end as travellers,
 sum(cast(floor(o_totalprice) as bigint)) as overnight_stays,
 sum(case when o_orderstatus <> 'P' then 1 else 0 end) as residents_home,
 sum(case when o_orderstatus = 'P' then 1 else 0 end) as residents_abroad,
 case when cast(date_trunc('month', o_orderdate) as date) >= date '2001-06-01' then 'provisional' else 'definitive' end as status
from orders group by cast(date_trunc('month', o_orderdate) as date)""",
    "origins": """
select cast(date_trunc('month', l_shipdate) as date) as month, c_nationkey as origin_code, count(*) as tourists
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
group by cast(date_trunc('month', l_shipdate) as date), c_nationkey having count(*) > 30""",
    "editions": """
with c as (
 select e.edition, c_nationkey as code, o_orderstatus as phase, count(*) as n
 from orders join customer on o_custkey = c_custkey
 cross join (values ('previous', date '1998-06-30'), ('current', date '2000-12-31')) e(edition, cutoff)
 where cast(o_orderdate as date) <= e.cutoff
  and not (e.edition = 'previous' and c_nationkey % 11 = 0)
  and not (e.edition = 'current' and c_nationkey % 7 = 3)
 group by e.edition, c_nationkey, o_orderstatus),
r as (select edition, code, phase, n, row_number() over (partition by edition, code order by n desc, phase) as rn from c)
select edition, code, phase, n as quantity from r where rn = 1""",
    "address_versions": """
select c_custkey as ndp, v.version as version,
 case when v.version = 1 then null else date '1998-07-01' end as valid_from,
 case when v.version = 1 and c_custkey % 10 <> 0 then date '1998-06-30' else null end as valid_to
from customer cross join (values (1),(2)) v(version) where c_custkey % 4 = 0""",
    "brick_edges": """
with b as (
 select c_custkey as brick, cast(floor((c_custkey-1)/100e0) as int) as band, ((c_custkey-1)%20)*2e0 + cast(floor((c_custkey-1)/20e0) as int)%2 as x,
  cast(floor((c_custkey-1)/20e0) as int)*1e0 as y
 from customer where c_custkey%13 <> 0)
select brick, band, k.seq as seq, x + k.x0 as x0, y + k.y0 as y0, x + k.x1 as x1, y + k.y1 as y1
from b cross join (values (0,0,0,2,0),(1,2,0,2,1),(2,2,1,0,1),(3,0,1,0,0)) k(seq,x0,y0,x1,y1)""",
    "shape_edges": """
with o as (
 select c_custkey as area_id, c_custkey%7 as kind, (c_custkey%1000)*10e0 as ox, cast(floor(c_custkey/1000e0) as int)*10e0 as oy from customer)
select o.area_id, o.kind, k.ring, k.seq, ox + k.x0 as x0, oy + k.y0 as y0, ox + k.x1 as x1, oy + k.y1 as y1
from o join (values
 (0,0,0,0,0,4,0),(0,0,1,4,0,4,4),(0,0,2,4,4,0,4),(0,0,3,0,4,0,0),
 (1,0,0,0,0,4,4),(1,0,1,4,4,4,0),(1,0,2,4,0,0,4),(1,0,3,0,4,0,0),
 (2,0,0,0,0,4,0),(2,0,1,4,0,4,4),(2,0,2,4,4,0,4),
 (3,0,0,0,0,4,0),(3,0,1,4,0,4,4),(3,0,2,4,4,2,0),(3,0,3,2,0,0,4),(3,0,4,0,4,0,0),
 (4,0,0,0,0,2,2),(4,0,1,2,2,4,0),(4,0,2,4,0,4,4),(4,0,3,4,4,2,2),(4,0,4,2,2,0,4),(4,0,5,0,4,0,0),
 (5,0,0,0,0,6,0),(5,0,1,6,0,6,6),(5,0,2,6,6,4,6),(5,0,3,4,6,4,4),(5,0,4,4,4,0,4),(5,0,5,0,4,0,0),
 (5,1,6,1,1,1,2),(5,1,7,1,2,2,2),(5,1,8,2,2,2,1),(5,1,9,2,1,1,1),
 (5,2,10,0,5,2,5),(5,2,11,2,5,2,7),(5,2,12,2,7,0,7),(5,2,13,0,7,0,5),
 (6,0,0,0,0,4,0),(6,0,1,4,0,4,4),(6,0,2,4,4,4,6),(6,0,3,4,6,4,4),(6,0,4,4,4,0,4),(6,0,5,0,4,0,0)) k(kind,ring,seq,x0,y0,x1,y1) on k.kind = o.kind""",
    "street_segments": """
select n_nationkey*2 + k.way as segment, n_nationkey%5 + 6*cast(floor(n_nationkey/5e0) as int) as a,
 n_nationkey%5 + k.dx + 6*(cast(floor(n_nationkey/5e0) as int) + k.dy) as b, (n_nationkey%5)*100e0 as x0, cast(floor(n_nationkey/5e0) as int)*100e0 as y0,
 (n_nationkey%5 + k.dx)*100e0 as x1, (cast(floor(n_nationkey/5e0) as int) + k.dy)*100e0 as y1
from nation cross join (values (0,1,0),(1,0,1)) k(way,dx,dy)""",
    "doors": """
select c_custkey as id, cast((c_custkey*7919)%521 as double) as x, cast((c_custkey*104729)%499 as double) as y from customer""",
    "sources": """
with m as (select o_custkey, max(cast(o_orderdate as date)) as last from orders group by o_custkey),
o as (
 select c_custkey as o_custkey, coalesce(last, case when c_custkey%89 <> 0 then date '1992-01-01' end) as last
 from customer left join m on m.o_custkey = c_custkey)
select c_custkey as source, case c_custkey%4 when 0 then 'city ' when 1 then 'area ' when 2 then 'register ' else 'circle ' end || cast(c_nationkey as string) as scope, last,
 case when c_custkey%23 = 0 then 'old' when last is null then 'unavailable' when c_custkey%29 = 0 then 'unavailable' when c_custkey%3 = 0 then 'published'
  when c_custkey%3 = 1 then 'snapshot' else 'live' end as state,
 case when last is null or c_custkey%41 = 0 then null when c_custkey%31 = 0 then cast(last as string) when c_custkey%5 < 2 then cast(last as string)
  when c_custkey%5 < 4 then substr(cast(last as string), 1, 7) else substr(cast(last as string), 1, 4) end as reference_date,
 case when last is null then null when c_custkey%43 = 0 then 'week' when c_custkey%5 < 2 then 'day' when c_custkey%5 < 4 then 'month' else 'year' end as precision,
 case when c_custkey%37 = 0 then ' ' else c_name end as publisher
from customer left join o on o_custkey = c_custkey""",
    "questions": """
select cast(id as bigint) as id, case id%12 when 0 then 'LICENCES_IN_LENS' when 1 then 'AREA_AT_POINT' when 2 then 'AREAS_IN_LENS' when 3 then 'AREA_PHASE'
  when 4 then 'AREA_QUANTITY' when 5 then 'EDITION_DIFF' when 6 then 'AREA_COMPARE' when 7 then 'SOURCE_PROVENANCE' when 8 then 'AREA_PROFILE'
  when 9 then 'CITY_DEMAND' when 10 then 'LICENCES_IN_LENS' else 'RANK_AREAS' end as shape,
 case when id%17 = 0 then 'predictive' when id%19 = 0 then 'ranking' when id%23 = 0 then 'noted' end as flag,
 case when id%8 = 2 then 'BUILDING' end as family, lat, case when id%13 = 0 then lon + 1 else lon end as lon, 500e0 + (id%7)*300e0 as radius_m,
 case when id%5 <> 0 then make_date(cast(1988 + id%16 as int), cast(1 + id%11 as int), 1) end as first,
 case when id%5 <> 1 then make_date(cast(1990 + id%9 as int), cast(1 + (id*7)%12 as int), 28) end as last,
 cast(id%31 as int) as code, case when id%3 = 0 then 'previous' when id%3 = 1 then 'current' end as edition, cast(id%25 as int) as a, cast((id*7)%27 as int) as b,
 case cast(floor(id/12e0) as int)%6 when 0 then 'licences' when 1 then 'areas' when 2 then 'population' when 3 then 'monthly' when 4 then 'editions' else 'rumour' end as source
from poi""",
    "edition_manifest": """
select f.family, e.edition, f.family || ':' || e.edition || ':' || cast(count(*) as string) as snapshot
from editions x cross join (values ('state'), ('quantity')) f(family) cross join (values ('previous'), ('current')) e(edition)
where x.edition = e.edition group by f.family, e.edition""",
    "stations": """
select user_id as station_id,
 -3.889e0 + (cast((user_id*7919)%10007 as double)+0.5e0)/10007e0*0.371e0 as lon,
 40.312e0 + (cast((user_id*104729)%10009 as double)+0.5e0)/10009e0*0.252e0 as lat,
 round(avg(value), 6) as mean_observed, count(*) as observation_count,
 min(cast(ts as date)) as date_min, max(cast(ts as date)) as date_max
from events group by user_id""",
}


def _reads(view: str, name: str) -> bool:
    """Whether the text of a view has a table or view after one of its FROMs and JOINs."""
    return re.search(rf"\b(?:from|join)\s+{name}\b", VIEWS[view]) is not None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or one of the views over them."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for inner in VIEWS:
        if _reads(name, inner):
            table(spark, sf_dir, inner).createOrReplaceTempView(inner)
    for base in TABLES:
        if _reads(name, base):
            spark.read.parquet(f"{sf_dir}/{base}.parquet").createOrReplaceTempView(base)
    return spark.sql(VIEWS[name])


def with_views(names: str, body: str) -> str:
    """SQL text whose views stand before it as common table expressions."""
    parts = ", ".join(f"{n} as ({VIEWS[n]})" for n in names.split())
    recursive = "recursive " if " reach r " in body or " using key " in body else ""
    return f"with {recursive}{parts} {body}"
