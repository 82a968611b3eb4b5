"""Further queries: classes, topology, gates on series, scopes and sensitivity of editions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrafold.functions import geo
from terrafold.operators import aggregates, compare, filters, linkage, spatial, topology
from terrafold.plans.registry import query
from terrafold.plans.spatial_queries import LON, _HAVERSINE, areas


@query("", """
select user_id % 20 as station, round(user_id % 20 / 10e0, 6) as lat6, count(*) as n, round(sum(value),
 4) as total, min(cast(ts as date)) as first_day, max(cast(ts as date)) as last_day, count(case
 when value is null or value < 0 then 1 end) as rejected from events group by 1, 2""")
def station_readings(view):
    """Readings by station and place; rejected ones are counted apart."""
    e = view("events").withColumn("station", F.col("user_id") % 20)
    return e.groupBy("station", F.round(F.col("station") / 10, 6).alias("lat6")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min(F.col("ts").cast("date")).alias("first_day"), F.max(F.col("ts").cast("date")).alias("last_day"), F.count_if(F.col("value").isNull() | (F.col("value") < 0)).alias("rejected"))


@query("", """
with c as (select p_partkey as id, case p_partkey % 6 when 0 then 'APE.01.02' when 1 then 'NZ 3' when 2 then 'NP2' when 3 then ''
 when 4 then 'Total 7' else 'x' end as code from part)
select case when trim(code) = '' then 'BLANK' when regexp_matches(code, '^(AP[EIR]|UZ[IP]|UNP|AOE|UZPP)\\.[0-9]{2}\\.[0-9]{2}') then 'PLANNING_AREA'
 when regexp_matches(code, '^NZ ?[0-9]') then 'ZONAL_NORM' when regexp_matches(code, '^NP ?[0-9]') then 'PROTECTION' else 'OTHER' end as class,
 count(*) as n from c where not starts_with(lower(trim(code)), 'total') group by 1""")
def record_classes(view):
    """Records by the form of their code, without total rows."""
    codes = F.element_at(F.array(*map(F.lit, ("APE.01.02", "NZ 3", "NP2", "", "Total 7", "x"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    c = view("part").select(codes.alias("code")).where(~filters.is_total_row(F.col("code")))
    return c.groupBy(filters.record_class(F.col("code")).alias("class")).agg(F.count("*").alias("n"))


@query("", """
with s as (select p_partkey as id, case p_partkey % 4 when 0 then 'Apart-Hotel Sol' when 1 then 'HOSTEL uno'
 when 2 then 'Gran Hotel' else 'Casa' end as s from part)
select id, case when contains(lower(s), 'hostel') then 'hostel' when contains(lower(s), 'apart') then 'apartment' when contains(lower(s),
 'pensi') then 'guest house' when contains(lower(s), 'camping') then 'campsite' when contains(lower(s), 'hotel') then 'hotel' else 'other' end as kind
 from s""")
def stay_kinds(view):
    """Kinds of stay from a free text; the order of the words decides."""
    s = F.element_at(F.array(*map(F.lit, ("Apart-Hotel Sol", "HOSTEL uno", "Gran Hotel", "Casa"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return view("part").select(F.col("p_partkey").alias("id"), filters.stay_kind(s).alias("kind"))


@query("", """
with t as (select o_orderkey as id, case o_orderkey % 5 when 0 then null when 1 then 'motorway' when 2 then 'footway'
 when 3 then 'service' else 'odd' end as highway, case when o_orderkey % 7 = 0 then 'private' end as access, case when o_orderkey % 11 = 0 then 'no'
 when o_orderkey % 13 = 0 then 'yes' end as foot from orders)
select case when highway is null then 'NOT_A_HIGHWAY' when highway = 'motorway' then 'BARRED' when foot = 'no' then 'FOOT_NO'
 when access = 'private' and coalesce(foot, '') <> 'yes' then 'PRIVATE'
 when highway in ('footway','service') then 'KEPT' else 'UNKNOWN_CLASS' end as reason, count(*) as n from t group by 1""")
def way_reasons(view):
    """Why ways are kept or not."""
    k = F.col("o_orderkey")
    highway = F.element_at(F.array(F.lit(None).cast("string"), *map(F.lit, ("motorway", "footway", "service", "odd"))), (k % 5 + 1).cast("int"))
    access, foot = F.when(k % 7 == 0, "private"), F.when(k % 11 == 0, "no").when(k % 13 == 0, "yes")
    tags = F.map_from_arrays(F.array(*map(F.lit, ("highway", "access", "foot"))), F.array(highway, access, foot))
    ways = view("orders").select(F.map_filter(tags, lambda _, v: v.isNotNull()).alias("tags"))
    return ways.groupBy(filters.way_retention("tags")[1].alias("reason")).agg(F.count("*").alias("n"))


@query("", """
select o_orderpriority as division, o_orderstatus as section, coalesce(case o_orderpriority when '1-URGENT' then 'FOOD' end, case o_orderstatus
 when 'F' then 'TRADE' when 'O' then 'SERVICE' end, 'AMBIGUOUS') as class, count(*) as n from orders group by 1, 2""")
def activity_classes(view):
    """A division's own class goes before its section's."""
    c = filters.activity_class(F.col("o_orderpriority"), F.col("o_orderstatus"), {"1-URGENT": "FOOD"}, {"F": "TRADE", "O": "SERVICE"})
    return view("orders").groupBy(F.col("o_orderpriority").alias("division"), F.col("o_orderstatus").alias("section"), c.alias("class")).agg(F.count("*").alias("n"))


@query("area_edges", f"""
, k as (select district_id, x0, y0, x1, y1, least(round(x0,9), round(x1,9)) as lx, greatest(round(x0,9), round(x1,9)) as hx, least(round(y0,9),
 round(y1,9)) as ly, greatest(round(y0,9), round(y1,9)) as hy from area_edges),
 u as (select *, count(*) over (partition by district_id, lx, hx, ly, hy) as n from k)
select district_id, count(*) as edges, round(sum({_HAVERSINE.format(a="y0", b="y1", c="x0", d="x1")}), 3) as perimeter_m from u where n = 1
 group by district_id""")
def district_outlines(view):
    """Districts as the union of their areas: shared borders cancel."""
    outer = topology.union_boundary(view("area_edges"), "district_id")
    return outer.groupBy("district_id").agg(F.count("*").alias("edges"), F.round(F.sum(geo.haversine_m(F.col("y0"), F.col("x0"), F.col("y1"), F.col("x1"))), 3).alias("perimeter_m"))


@query("area_edges", "select area_id, cast(0 as bigint) as outside from area_edges group by area_id")
def vertices_outside_parent(view):
    """Vertices of an area that its district does not cover."""
    outline = topology.union_boundary(view("area_edges"), "district_id").select(F.col("district_id").alias("area_id"), F.monotonically_increasing_id().alias("seq"), "x0", "y0", "x1", "y1")
    return topology.uncovered_vertices(view("area_edges").withColumnRenamed("district_id", "parent_id"), spatial.polygons(outline), 1.0)


@query("poi", """
, g as (select id, cast(floor((lon+3.889e0)/0.0742e0) as bigint) + 5*cast(floor((lat-40.312e0)/0.0504e0) as bigint) as area_id, case
 when id % 9 = 0 then 77 when id % 4 = 0 then (id % 25) else cast(floor((lon+3.889e0)/0.0742e0) as bigint) + 5*cast(floor((lat-40.312e0)/0.0504e0) as bigint) end as declared
 from poi)
select case when declared = 77 then 'UNDECLARED' when declared = area_id then 'INSIDE' else 'OTHER_AREA' end as state, count(*) as n from g group by 1""")
def declared_area_agreement(view):
    """Whether points stand in the area that they declare."""
    grid = F.floor((F.col("lon") + 3.889) / 0.0742) + 5 * F.floor((F.col("lat") - 40.312) / 0.0504)
    declared = F.when(F.col("id") % 9 == 0, 77).when(F.col("id") % 4 == 0, F.col("id") % 25).otherwise(grid).cast("int")
    return topology.declared_agreement(view("poi").select("id", "lat", "lon", declared.alias("declared")), areas(view), 0.01).groupBy("state").agg(F.count("*").alias("n"))


@query("", """
with c as (select l_orderkey as segment, (l_linenumber % 5) / 5e0 as t from lineitem), m as (select segment, t from c
 where t > 0 and t < 1 union select distinct l_orderkey, 0e0 from lineitem)
select segment, row_number() over (partition by segment order by t) as part, t as t0, coalesce(lead(t) over (partition by segment order by t),
 1e0) as t1 from m""")
def split_segments(view):
    """Segments cut at all places that were found on the whole segment."""
    c = view("lineitem").select(F.col("l_orderkey").alias("segment"), (F.col("l_linenumber") % 5 / 5.0).alias("t"))
    return topology.split_at(c.select("segment").distinct(), c).withColumn("part", F.col("part").cast("long"))


@query("stations", f"""
, d as (select station_id, case when {_HAVERSINE.format(a="lat", b="greatest(40.35e0, least(40.5e0, lat))", c="lon", d="greatest(-3.8e0, least(-3.6e0, lon))")} <= 2000 then 1 else 0 end as near,
 lat - 2000e0/111000e0 >= 40.35e0 - 100e0/111000e0 and lat + 2000e0/111000e0 <= 40.5e0 + 100e0/111000e0 and lon - 2000e0/111000e0/cos(radians(lat)) >= -3.8e0 - 100e0/111000e0/cos(radians(lat)) and lon + 2000e0/111000e0/cos(radians(lat)) <= -3.6e0 + 100e0/111000e0/cos(radians(lat)) as whole
 from stations)
select case when whole then 'WITHIN' when near = 1 then 'PARTIAL' else 'OUTSIDE' end as state, count(*) as n from d group by 1""")
def extraction_eligibility(view):
    """Whether circles lie inside the extracted box."""
    state = topology.box_eligibility(F.col("lat"), F.col("lon"), 2000.0, 40.35, 40.5, -3.8, -3.6)
    return view("stations").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("stations", f"""
select a.station_id as a, count(*) as overlapping from stations a join stations b on a.station_id < b.station_id
 where {_HAVERSINE.format(a="a.lat", b="b.lat", c="a.lon", d="b.lon")} <= 4000 group by 1""")
def overlapping_circles(view):
    """Circles of 2 km that overlap others of a higher number."""
    right = view("stations").select(F.col("station_id").alias("b"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    met = spatial.within(view("stations").select(F.col("station_id").alias("a"), "lat", "lon"), right, 4000.0).where("a < b")
    return met.groupBy("a").agg(F.count("*").alias("overlapping"))


@query("monthly", """
, b as (select period, travellers, case when year(period) = 1998 then travellers + 1 else travellers end as other from monthly where period < date '2000-01-01')
select cast(year(period) as bigint) as year, count(*) as months, count(case when travellers is distinct from other then 1 end) as differing from b
 group by 1""")
def independent_series_gate(view):
    """A series against a second one, year by year."""
    m = view("monthly").where("period < date '2000-01-01'")
    other = m.select("period", F.when(F.year("period") == 1998, F.col("travellers") + 1).otherwise(F.col("travellers")).alias("other"))
    both = m.join(other, "period")
    return both.groupBy(F.year("period").cast("long").alias("year")).agg(F.count("*").alias("months"), F.count_if(~F.col("travellers").eqNullSafe(F.col("other"))).alias("differing"))


@query("editions", """
, t as (select edition, phase, count(*) as codes, min(code) as first_code from editions group by 1, 2)
select coalesce(a.phase, b.phase) as phase, a.codes as was, b.codes as now, case when a.phase is null then 'NEW' when b.phase is null then 'GONE'
 when a.first_code <> b.first_code then 'CHANGED' else 'SAME' end as drift from (select * from t where edition = 'previous') a full outer
 join (select * from t where edition = 'current') b on a.phase = b.phase""")
def taxonomy_drift(view):
    """Terms of two editions: new, gone, changed or the same."""
    t = view("editions").groupBy("edition", "phase").agg(F.count("*").alias("codes"), F.min("code").alias("first_code"))
    a = t.where("edition = 'previous'").select("phase", F.col("codes").alias("was"), F.col("first_code").alias("a_first"))
    b = t.where("edition = 'current'").select("phase", F.col("codes").alias("now"), F.col("first_code").alias("b_first"))
    drift = F.when(F.col("was").isNull(), "NEW").when(F.col("now").isNull(), "GONE").when(F.col("a_first") != F.col("b_first"), "CHANGED").otherwise("SAME")
    return a.join(b, "phase", "full_outer").select("phase", "was", "now", drift.alias("drift"))


@query("editions", """
select phase, count(*) as n, min(edition) as first_edition, max(edition) as last_edition from editions group by phase""")
def vocabulary_by_edition(view):
    """Terms with the first and the last edition that has them."""
    return view("editions").groupBy("phase").agg(F.count("*").alias("n"), F.min("edition").alias("first_edition"), F.max("edition").alias("last_edition"))


@query("", """
with k as (select p_partkey as id, p_brand as name from part), d as (select *, count(*) over (partition by lower(name)) as same
 from k) select id, same > 1 as ambiguous from d""")
def ambiguous_names(view):
    """Whether other records have the same folded name."""
    return view("part").select(F.col("p_partkey").alias("id"), (F.count("*").over(Window.partitionBy(F.lower("p_brand"))) > 1).alias("ambiguous"))


@query("", """
with q as (select p_partkey as id, p_name from part), e as (select * from q where p_name = 'bolt'), s as (select *, 0 as kind from e
 union all select *, 1 from q where not exists (select 1 from e) and contains(lower(p_name), 'bolt')),
 r as (select *, row_number() over (order by kind, id) as n from s) select id, p_name, kind from r where n <= 6""")
def exact_or_contains(view):
    """An exact match alone, else what contains the text."""
    q = view("part").select(F.col("p_partkey").alias("id"), "p_name")
    exact = q.where("p_name = 'bolt'").withColumn("kind", F.lit(0))
    some = exact.agg((F.count("*") > 0).alias("some"))
    rest = q.where(F.contains(F.lower("p_name"), F.lit("bolt"))).withColumn("kind", F.lit(1)).join(F.broadcast(some)).where("not some").drop("some")
    return exact.union(rest).orderBy("kind", "id").limit(6)


@query("editions population", """
select was, now, count(*) as pairs from (
 select p.pair, p.state as was, c.state as now from (select x.area_id as pair, case when x.phase is null or y.phase is null then 'WITHHELD'
 when x.phase = y.phase then 'EQUAL' else 'DIFFERENT' end as state from (select p.area_id, e.phase from population p left join (select * from editions
 where edition='previous') e on e.code = p.area_id) x join (select p.area_id, e.phase from population p left join (select * from editions
 where edition='previous') e on e.code = p.area_id) y on y.area_id = x.area_id + 1) p
 join (select x.area_id as pair, case when x.phase is null or y.phase is null then 'WITHHELD'
 when x.phase = y.phase then 'EQUAL' else 'DIFFERENT' end as state from (select p.area_id, e.phase from population p left join (select * from editions
 where edition='current') e on e.code = p.area_id) x join (select p.area_id, e.phase from population p left join (select * from editions
 where edition='current') e on e.code = p.area_id) y on y.area_id = x.area_id + 1) c on c.pair = p.pair) z group by 1, 2""")
def edition_sensitivity(view):
    """How the reading of a pair of areas moves from one edition to the next."""
    def states(edition: str, name: str):
        e = view("editions").where(F.col("edition") == edition).select(F.col("code").alias("area_id"), "phase")
        a = view("population").join(e, "area_id", "left")
        both = compare.compare_areas(a.withColumn("pair", F.col("area_id")), a.withColumn("pair", F.col("area_id") - 1), ["phase"], [])
        inner = a.select(F.col("area_id").alias("pair")).join(a.select((F.col("area_id") - 1).alias("pair")), "pair")
        return both.join(inner, "pair", "left_semi").select("pair", F.col("state").alias(name))

    return states("previous", "was").join(states("current", "now"), "pair").groupBy("was", "now").agg(F.count("*").alias("pairs"))


@query("editions", """
, u as (select code, edition, case when code % 5 = 0 then null else quantity end as q from editions),
 d as (select a.code, a.q as was, b.q as now, case when a.q is null or b.q is null then 'WITHHELD' else 'MEASURED' end as state from (select * from u
 where edition='previous') a join (select * from u where edition='current') b on a.code = b.code)
select state, count(*) as codes, cast(sum(now - was) as bigint) as change from d group by state""")
def quantity_difference(view):
    """Quantities of two editions; a blank is withheld, never zero."""
    q = F.when(F.col("code") % 5 != 0, F.col("quantity"))
    side = lambda e, n: view("editions").where(F.col("edition") == e).select("code", q.alias(n))
    both = side("previous", "was").join(side("current", "now"), "code")
    state = F.when(F.col("was").isNull() | F.col("now").isNull(), "WITHHELD").otherwise("MEASURED")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("codes"), F.sum(F.col("now") - F.col("was")).alias("change"))


@query("sources", """
select scope, count(*) as sources, count(case when state in ('live', 'published', 'snapshot') then 1 end) as contributing,
 case when count(*) filter (last is null or precision is null) > 0 then null
  else min(case precision when 'month' then date_trunc('month', last) when 'year' then date_trunc('year', last) else last end) end as oldest
from sources group by scope""")
def scope_rail(view):
    """Sources by scope, how many of them contribute, and the oldest reference date, which an undated source makes missing."""
    s = view("sources")
    day = F.when(F.col("precision").isNotNull(), F.when(F.col("precision") == "month", F.trunc("last", "month")).when(F.col("precision") == "year", F.trunc("last", "year")).otherwise(F.col("last")))
    dated = s.withColumn("d", day)
    return dated.groupBy("scope").agg(F.count("*").alias("sources"), F.count_if(F.col("state").isin("live", "published", "snapshot")).alias("contributing"), aggregates.oldest_date("d", "precision").alias("oldest"))


@query("address_versions", """
, c as (select c_custkey as id, c_custkey % 4 = 0 as by_register, c_nationkey % 4 = 0 as by_place
 from customer) select by_register, by_place, by_register = by_place as agree, count(*) as n from c group by 1, 2""")
def path_concordance(view):
    """Two independent ways to the same answer."""
    known = view("address_versions").select(F.col("ndp").alias("c_custkey")).distinct().withColumn("by_register", F.lit(True))
    c = view("customer").join(known, "c_custkey", "left").select(F.coalesce("by_register", F.lit(False)).alias("by_register"), (F.col("c_nationkey") % 4 == 0).alias("by_place"))
    return c.groupBy("by_register", "by_place").agg(F.count("*").alias("n")).withColumn("agree", F.col("by_register") == F.col("by_place"))


@query("origins", """
, t as (select origin_code, month, tourists, lag(tourists) over (partition by origin_code
 order by month) as before, lag(month) over (partition by origin_code order by month) as before_month from origins),
 c as (select *, tourists - before as change from t where before_month = cast(month - interval '1' month as date)),
 r as (select *, row_number() over (order by abs(change) desc, tourists desc, origin_code, month) as n from c)
select month, origin_code, tourists, change from r where n <= 10""")
def largest_changes(view):
    """The ten largest changes from one month to the next."""
    o = view("origins")
    before = o.select("origin_code", F.add_months("month", 1).alias("month"), F.col("tourists").alias("before"))
    c = o.join(before, ["origin_code", "month"]).withColumn("change", F.col("tourists") - F.col("before"))
    return c.orderBy(F.desc(F.abs("change")), F.desc("tourists"), "origin_code", "month").limit(10).select("month", "origin_code", "tourists", "change")


@query("editions", """
, x as (select code, phase from editions where edition = 'previous'), y as (select code, phase from editions where edition = 'current')
select count(case when x.code is not null and y.code is not null then 1 end) as matched, count(case when y.code is null then 1 end) as only_left,
 count(case when x.code is null then 1 end) as only_right from x full outer join y on x.code = y.code""")
def join_report(view):
    """Matched codes and those of one side."""
    side = lambda e: view("editions").where(F.col("edition") == e).select("code", F.col("phase").alias("v"))
    r = linkage.reconcile(side("previous"), side("current"), "code", ["v"])
    return r.agg(F.count_if(F.col("state").isin("MATCHED", "DIFFERS")).alias("matched"), F.count_if(F.col("state") == "LEFT_ONLY").alias("only_left"), F.count_if(F.col("state") == "RIGHT_ONLY").alias("only_right"))


@query("poi", f"""
, b as (select type, count(case when {_HAVERSINE.format(a="40.4168e0", b="lat", c=f"({LON}e0)", d="lon")} <= 3000 then 1 end) as base, count(case
 when {_HAVERSINE.format(a="40.4168e0", b="lat", c=f"({LON}e0)", d="lon")} <= 3300 then 1 end) as variant from poi group by type)
select type, base, variant, variant - base as change, case when base > 0 then round((variant-base)*100e0/base, 6) end as pct from b""")
def variant_against_baseline(view):
    """A run with a wider circle against the baseline."""
    near = lambda r: F.count_if(geo.in_circle(F.col("lat"), F.col("lon"), 40.4168, LON, r))
    b = view("poi").groupBy("type").agg(near(3000.0).alias("base"), near(3300.0).alias("variant"))
    return b.select("type", "base", "variant", (F.col("variant") - F.col("base")).alias("change"), F.when(F.col("base") > 0, F.round((F.col("variant") - F.col("base")) * 100 / F.col("base"), 6)).alias("pct"))


@query("area_edges", """
, a as (select area_id, min(least(x0,x1)) as w, max(greatest(x0,x1)) as e, min(least(y0,y1)) as s, max(greatest(y0,y1)) as n from area_edges
 group by area_id), h as (select area_id as hid, w + 0.03e0 as w, e + 0.03e0 as e, s, n from a),
g as (select a.area_id, (i.i + 0.5e0)*0.004e0 as lon, (j.j + 0.5e0)*0.004e0 as lat from a cross
 join (select unnest(generate_series(-980, -870)) as i) i cross join (select unnest(generate_series(10070, 10150)) as j) j
 where (i.i + 0.5e0)*0.004e0 > a.w and (i.i + 0.5e0)*0.004e0 < a.e and (j.j + 0.5e0)*0.004e0 > a.s and (j.j + 0.5e0)*0.004e0 < a.n),
m as (select g.area_id, h.hid, count(*) as c from g join h on g.lon > h.w and g.lon < h.e and g.lat > h.s and g.lat < h.n group by 1, 2),
 t as (select area_id, count(*) as total from g group by 1), r as (select m.area_id, hid, c, total, row_number() over (partition by m.area_id
 order by c desc, hid) as k from m join t on t.area_id = m.area_id)
select area_id, hid as historical_id, round(c*1e0/total, 6) as share from r where k = 1""")
def dominant_historical_areas(view):
    """The older area that covers most of each current one, on a grid."""
    moved = view("area_edges").withColumns({"x0": F.col("x0") + 0.03, "x1": F.col("x1") + 0.03})
    out = topology.dominant_overlap(areas(view), spatial.polygons(moved), 0.004)
    return out.select("area_id", "historical_id", F.round("share", 6).alias("share"))


@query("area_edges", """
, a as (select area_id, min(least(x0, x1)) as w, max(greatest(x0, x1)) as e, min(least(y0, y1)) as s, max(greatest(y0, y1)) as n from area_edges
 group by area_id),
h as (select area_id as hid, w + 0.0287e0 as w, e + 0.0287e0 as e, s - 0.0113e0 as s, n - 0.0113e0 as n from a),
o as (select area_id, hid, (least(a.e, h.e) - greatest(a.w, h.w)) * (least(a.n, h.n) - greatest(a.s, h.s)) / ((a.e - a.w) * (a.n - a.s)) as share
 from a join h on least(a.e, h.e) > greatest(a.w, h.w) and least(a.n, h.n) > greatest(a.s, h.s))
select area_id, hid as other_id, round(share, 6) as share from o where share > 1e-9""")
def overlay_shares(view):
    """The share of each area that each older area covers, exactly."""
    moved = view("area_edges").withColumns({c: F.col(c) + d for c, d in (("x0", 0.0287), ("x1", 0.0287), ("y0", -0.0113), ("y1", -0.0113))})
    out = topology.overlay(areas(view), spatial.polygons(moved))
    return out.where("share > 1e-9").select("area_id", "other_id", F.round("share", 6).alias("share"))


@query("poi", """
, c as (select type as metric, count(case when id % 2 = 0 then 1 end) as a, count(case when id % 2 = 1 then 1 end) as b from poi group by type),
 s as (select metric, a, b, case when metric = 'bike' then 'WITHHELD_EXTRACTION' else 'RAW' end as state, case
 when metric <> 'bike' then b - a end as d from c)
, i as (select count(*) as metrics, count(case when state = 'RAW' then 1 end) as available, count(case when d > 0 then 1 end) as hi, count(case
 when d < 0 then 1 end) as lo from s)
select metrics, available, case when available = 0 then 'UNAVAILABLE' when available < metrics then 'LIMITED' else 'AVAILABLE' end as status, case
 when hi > 0 and lo = 0 then 'HIGHER' when lo > 0 and hi = 0 then 'LOWER' when hi + lo > 0 then 'MIXED' else 'NONE' end as direction from i""")
def comparison_insight(view):
    """What a comparison says as a whole."""
    half = lambda k: F.count_if(F.col("id") % 2 == k)
    c = view("poi").groupBy(F.col("type").alias("metric")).agg(half(0).alias("a"), half(1).alias("b"))
    sides = c.select("metric", "a", "b", (F.col("metric") != "bike").alias("a_ok"), F.lit(True).alias("b_ok"), F.lit(1.0).alias("a_area"), F.lit(1.0).alias("b_area"))
    return compare.insight(compare.compare_counts(sides))
