"""Queries on published tables: gates, listings, linkage by code and name, states of areas and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.functions import geo, text
from terrafold.operators import aggregates, compare, filters, guardrails, linkage, quality, spatial
from terrafold.plans.registry import query
from terrafold.plans.spatial_queries import _FROM_CENTRE, LAT, LON, areas
from terrafold.plans.table_queries import _ONE, _sides
from terrafold.sources.sinks import numbered

# ---- listings


@query("licences", f"""
, h as (select id, grant_date from licences where {_FROM_CENTRE} <= 3000)
select row_number() over (order by grant_date desc, id) as place, id, grant_date from h qualify place <= 50""")
def newest_licences(view):
    """The fifty newest licences of a circle, newest first, then by number."""
    held = view("licences").where(geo.in_circle(F.col("lat"), F.col("lon"), LAT, LON, 3000.0)).select("id", "grant_date")
    return aggregates.newest(held, "grant_date", "id", 50).withColumn("place", F.col("place").cast("long"))


@query("", """
with s as (
 select n_name as surface, n_regionkey as mode, case n_nationkey % 3 when 1 then 'planning' when 2 then 'demand' end as flag from nation),
c as (
 select c_custkey as id, c_custkey % 5 as mode, c_custkey % 4 in (1, 3) as planning, c_custkey % 4 >= 2 as demand from customer)
select c.id, s.surface from c join s on s.mode = c.mode and (flag is null or flag = 'planning' and planning or flag = 'demand' and demand)""")
def shown_surfaces(view):
    """What each session's mode shows, with the flags that it has set."""
    n = view("nation")
    surfaces = n.select(F.col("n_name").alias("surface"), F.col("n_regionkey").alias("mode"), F.when(F.col("n_nationkey") % 3 == 1, "planning").when(F.col("n_nationkey") % 3 == 2, "demand").alias("flag"))
    c = F.col("c_custkey")
    flags = F.array_compact(F.array(F.when((c % 4).isin(1, 3), "planning"), F.when(c % 4 >= 2, "demand")))
    return filters.surfaces_of_sessions(view("customer").select(c.alias("id"), (c % 5).cast("int").alias("mode"), flags.alias("flags")), surfaces)


# ---- linkage

_SOURCES = """
with t as (
 select 'NOW' as era, lpad(cast(n_nationkey as varchar), 3, '0') as code, cast(n_regionkey as varchar) as district, n_name as name from nation
 union all select 'OLD', lpad(cast(n_nationkey as varchar), 3, '0'), cast(n_regionkey as varchar), n_name from nation where n_nationkey % 6 <> 5),
s as (
 select c_custkey as id, case when c_custkey % 3 = 0 then 'OLD' else 'NOW' end as era,
  case when c_custkey % 11 = 0 then null when c_custkey % 7 = 0 then '9' || n_nationkey else lpad(cast(n_nationkey as varchar), 3, '0') end as code,
  case when c_custkey % 13 = 0 then '99' else cast(n_regionkey as varchar) end as district,
  case when c_custkey % 22 = 0 then 'Valor nulo' when c_custkey % 5 = 0 then lower(n_name) when c_custkey % 17 = 0 then 'ELSE' else n_name end as name
 from customer join nation on c_nationkey = n_nationkey)"""


def _named_sources(view):
    c, n = F.col("c_custkey"), view("nation")
    code = F.lpad(F.col("n_nationkey").cast("string"), 3, "0")
    own = n.select(F.lit("NOW").alias("era"), code.alias("code"), F.col("n_regionkey").cast("string").alias("district"), F.col("n_name").alias("name"), "n_nationkey")
    target = own.union(own.where("n_nationkey % 6 <> 5").withColumn("era", F.lit("OLD"))).drop("n_nationkey")
    met = view("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    source = met.select(
        c.alias("id"),
        F.when(c % 3 == 0, "OLD").otherwise("NOW").alias("era"),
        F.when(c % 11 == 0, None).when(c % 7 == 0, F.concat(F.lit("9"), F.col("n_nationkey").cast("string"))).otherwise(code).alias("code"),
        F.when(c % 13 == 0, "99").otherwise(F.col("n_regionkey").cast("string")).alias("district"),
        F.when(c % 22 == 0, "Valor nulo").when(c % 5 == 0, F.lower("n_name")).when(c % 17 == 0, "ELSE").otherwise(F.col("n_name")).alias("name"),
    )
    return source, target


@query("", _SOURCES + """
select s.id, s.era,
 case when k.name is not null and k.district = s.district then 'CODE' when k.name is not null then 'CODE_DISTRICT_MISMATCH'
  when n.code is not null then 'DISTRICT_PLUS_NAME' when s.code is null and (s.name is null or contains(upper(s.name),
 'NULO')) then 'SOURCE_NULL' else 'UNMATCHED' end as method,
 case when k.name is not null and k.district = s.district then s.era || ':' || s.code
 when k.name is null and n.code is not null then s.era || ':' || n.code end as entity,
 case when s.name = k.name then 'EXACT' when upper(s.name) = upper(k.name) then 'NORMALISED_EQUAL' when k.name is not null then 'VARIANT'
 when n.code is not null then 'NORMALISED_EQUAL' end as name_relation
from s left join t k on k.era = s.era and k.code = s.code
left join t n on n.era = s.era and n.district = s.district and upper(n.name) = upper(s.name)""")
def code_then_name(view):
    """Sources by their code in the target of their era, else by district and name."""
    return linkage.code_then_name(*_named_sources(view))


@query("", """
with o as (select cast(year(o_orderdate) as bigint) as snapshot, cast(c_nationkey as varchar) as code from orders
 join customer on c_custkey = o_custkey where not (year(o_orderdate) < 1995 and c_nationkey in (3,
 4)) and not (year(o_orderdate) < 1997 and c_nationkey = 7)),
e as (select snapshot, count(distinct case when code in ('3', '4') then code end) as two, count(distinct case when code = '7' then code end) as one
 from o group by 1)
select snapshot, case when one = 1 then 'CURRENT' when two = 2 then 'TRANSITIONAL' else 'HISTORICAL' end as era from e""")
def eras_of_snapshots(view):
    """The era of each snapshot by the codes it holds."""
    year = F.year("o_orderdate").cast("long")
    o = view("orders").join(view("customer"), F.col("o_custkey") == F.col("c_custkey")).select(year.alias("snapshot"), F.col("c_nationkey").alias("n"))
    o = o.where("not (snapshot < 1995 and n in (3, 4)) and not (snapshot < 1997 and n = 7)").select("snapshot", F.col("n").cast("string").alias("code"))
    return linkage.era_of(o, "snapshot", {"CURRENT": ["7"], "TRANSITIONAL": ["3", "4"]}, "HISTORICAL")


@query("", """
with a as (select case when c_custkey % 4 = 0 then lower(c_mktsegment) || c_nationkey
 when c_custkey % 9 = 0 then 'none' || c_custkey else c_mktsegment || c_nationkey end as k from customer),
b as (select 'BUILDING' || n_nationkey as k from nation union all select 'MACHINERY' || n_nationkey from nation), k as (select distinct k from a)
select count(*) as keys, count(case when k in (select k from b) then 1 end) as exact, count(case when k not in (select k
 from b) and upper(k) in (select k from b) then 1 end) as gained from k""")
def gain_by_folding(view):
    """How many keys match as they are, and how many more would if folded."""
    c, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    key = F.when(c % 4 == 0, F.concat(F.lower("c_mktsegment"), n)).when(c % 9 == 0, F.concat(F.lit("none"), c.cast("string"))).otherwise(F.concat("c_mktsegment", n))
    right = view("nation").select(F.explode(F.array(*(F.concat(F.lit(x), F.col("n_nationkey").cast("string")) for x in ("BUILDING", "MACHINERY")))).alias("k"))
    return linkage.match_gain(view("customer").select(key.alias("k")), right, "k")


@query("area_edges", """
, a as (select cast(area_id as varchar) as code, 'n' || area_id as name, x0 as x, y0 as y from area_edges where area_id <> 4),
b as (select cast(area_id as varchar) as code, case when area_id = 6 then 'other' else 'n' || area_id end as name, case
 when area_id = 8 and seq = 2 then x0 + 1 else x0 end as x, y0 as y from area_edges where area_id <> 5),
d as (select coalesce(a.code, b.code) as code, count(*) as apart from (select code, x, y, count(*) n from a group by 1, 2, 3) a full outer
 join (select code, x, y, count(*) n from b group by 1, 2, 3) b on a.code = b.code and a.x = b.x and a.y = b.y where a.n is distinct from b.n
 group by 1),
c as (select coalesce(a.code, b.code) as code, a.name as a_name, b.name as b_name from (select distinct code, name from a) a full outer
 join (select distinct code, name from b) b on a.code = b.code)
select c.code, coalesce(d.apart, 0) as vertices_apart, case when b_name is null then 'ONLY_A' when a_name is null then 'ONLY_B'
 when a_name <> b_name then 'NAME_DIFFERS' when d.apart > 0 then 'VERTICES_DIFFER' else 'EQUIVALENT' end as state
from c left join d on d.code = c.code""")
def routes_to_geometry(view):
    """Two routes to the same areas: names and vertices agree, or which does not."""
    e = view("area_edges").select("area_id", "seq", F.col("area_id").cast("string").alias("code"), F.concat(F.lit("n"), F.col("area_id").cast("string")).alias("name"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    a = e.where("area_id <> 4")
    b = e.where("area_id <> 5").withColumns({"name": F.when(F.col("area_id") == 6, "other").otherwise(F.col("name")), "x": F.when(F.expr("area_id = 8 and seq = 2"), F.col("x") + 1).otherwise(F.col("x"))})
    return linkage.routes_agree(a, b)


@query("", "select count(*) as rows, count(o_totalprice) as joined, 'JOINED' as state from orders")
def joined_by_position(view):
    """Row by row, once both tables are known to hold the same rows."""
    a = view("orders").select(F.col("o_orderkey").alias("row_index"), "o_custkey")
    b = view("orders").select(F.col("o_orderkey").alias("row_index"), "o_custkey", F.col("o_totalprice").alias("price"))
    out = linkage.by_position(a, b, ["o_custkey"])
    return out.agg(F.count("*").alias("rows"), F.count("price").alias("joined"), F.min("state").alias("state"))


@query("", "select count(*) as rows, 0 as joined, 'FINGERPRINT_DIFFERS' as state from orders")
def refused_by_position(view):
    """Row by row is refused where one side has another row."""
    a = view("orders").select(F.col("o_orderkey").alias("row_index"), "o_custkey")
    b = view("orders").select(F.col("o_orderkey").alias("row_index"), F.when(F.col("o_orderkey") == 1, -1).otherwise(F.col("o_custkey")).alias("o_custkey"), F.col("o_totalprice").alias("price"))
    out = linkage.by_position(a, b, ["o_custkey"])
    return out.agg(F.count("*").alias("rows"), F.count("price").cast("int").alias("joined"), F.min("state").alias("state"))


@query("", """
with f as (select p_partkey as id from part where p_partkey % 10 <> 0), i as (select p_partkey as id from part where p_partkey % 10 <> 1)
select (select count(*) from part) as count, (select count(*) from i) as ids, (select count(*) from f) as features,
 (select count(*) from (select id from i except select id from f)) as without_feature, (select count(*) from (select id from f except select id
 from i)) as without_id, false as consistent""")
def service_counts(view):
    """A service's count, ids and features hold the same set, or how they differ."""
    p = view("part").select(F.col("p_partkey").alias("id"))
    ids, features = p.where("id % 10 <> 1"), p.where("id % 10 <> 0")
    sides = linkage.universes(whole=p, in_ids=ids, in_features=features)
    out = sides.agg(
        F.count_if("whole").alias("count"), F.count_if("in_ids").alias("ids"), F.count_if("in_features").alias("features"),
        F.count_if(F.col("in_ids") & ~F.col("in_features")).alias("without_feature"), F.count_if(~F.col("in_ids") & F.col("in_features")).alias("without_id"),
    )
    return out.withColumn("consistent", F.expr("count = ids and ids = features and without_feature = 0 and without_id = 0"))


@query("", """
with a as (select c_custkey as id, upper(c_mktsegment) as kind, 'CALLE' as name, cast(c_custkey % 30 as varchar) as number from customer),
b as (select c_custkey as id, case when c_custkey % 8 = 0 then 'OTHER' else upper(c_mktsegment) end as kind, 'CALLE' as name, case
 when c_custkey % 12 = 0 then '31' else cast(c_custkey % 30 as varchar) end as number from customer)
select a.kind = b.kind as kind, a.name = b.name as name, a.number = b.number as number, count(*) as n from a join b on a.id = b.id group by 1, 2, 3""")
def address_agreement(view):
    """Whether two records of one address agree in kind, name and number."""
    c, number = F.col("c_custkey"), (F.col("c_custkey") % 30).cast("string")
    a = text.address_signature(F.col("c_mktsegment"), F.lit("de la Calle"), number, F.lit(None).cast("string"))
    b = text.address_signature(F.when(c % 8 == 0, "other").otherwise(F.lower("c_mktsegment")), F.lit("La cálle"), F.when(c % 12 == 0, "31").otherwise(number), F.lit(""))
    same = [(a[f] == b[f]).alias(f) for f in ("kind", "name", "number")]
    return view("customer").select(*same).groupBy("kind", "name", "number").agg(F.count("*").alias("n"))


@query("area_edges", """
select area_id, round(max(sqrt(power((round(x0, 3) - x0) * 84000e0, 2) + power((round(y0, 3) - y0) * 111000e0, 2))),
 6) as deviation_m, count(*) as vertices from area_edges group by area_id""")
def reprojection_deviation(view):
    """The largest distance of a vertex from its place in another rendering of the same ring, vertex by vertex."""
    a = view("area_edges").select("area_id", "seq", "x0", "y0")
    b = a.select("area_id", "seq", F.round("x0", 3).alias("x1"), F.round("y0", 3).alias("y1"))
    apart = F.hypot((F.col("x1") - F.col("x0")) * 84000, (F.col("y1") - F.col("y0")) * 111000)
    return a.join(b, ["area_id", "seq"]).groupBy("area_id").agg(F.round(F.max(apart), 6).alias("deviation_m"), F.count("*").alias("vertices"))


@query("poi area_edges", """
, b as (
 select area_id, district_id, min(least(x0, x1)) as w, max(greatest(x0, x1)) as e, min(least(y0, y1)) as s, max(greatest(y0, y1)) as n
 from area_edges group by 1, 2),
p as (select id, case when id % 9 = 0 then lon + 1 else lon end as lon, lat, case when id % 2 = 0 then id % 25 end as hint from poi),
h as (select p.id, b.area_id, b.district_id from p join b on lon > w and lon < e and lat > s and lat < n)
select p.id, h.area_id, h.district_id, case when h.area_id is not null then 'city' end as whole,
 case when h.area_id is null then 'NONE' when h.area_id = p.hint then 'HINT' else 'SEARCH' end as via
from p left join h on h.id = p.id""")
def places_in_hierarchy(view):
    """Area, district and city of points that come with a hint, and whether the hint held."""
    far = F.when(F.col("id") % 9 == 0, F.col("lon") + 1).otherwise(F.col("lon"))
    points = view("poi").select("id", "lat", far.alias("lon"), F.when(F.col("id") % 2 == 0, F.col("id") % 25).alias("hint"))
    return spatial.locate_in_hierarchy(points, areas(view), "district_id", "city")


@query("", """
with a as (select s_suppkey as a, case s_suppkey % 3 when 0 then 'DE LA ' when 1 then 'El ' else '' end || 'Vía ' || s_nationkey as name from supplier),
b as (select n_nationkey as b, 'de vIa ' || n_nationkey as name from nation)
select 'VIA ' || b.b as street, a.a, b.b from a join supplier on s_suppkey = a.a join b on b.b = s_nationkey""")
def joined_by_street(view):
    """Two sides by their street names, folded and without particles."""
    n = F.col("s_suppkey") % 3
    name = F.concat(F.when(n == 0, "DE LA ").when(n == 1, "El ").otherwise(""), F.lit("Vía "), F.col("s_nationkey").cast("string"))
    left = view("supplier").select(F.col("s_suppkey").alias("a"), name.alias("name"))
    right = view("nation").select(F.col("n_nationkey").alias("b"), F.concat(F.lit("de vIa "), F.col("n_nationkey").cast("string")).alias("name"))
    return linkage.by_street(left, right, "name")


@query("", """
with o as (select l_returnflag as flag, l_suppkey as origin, count(*) as n from lineitem group by 1, 2)
select flag, origin, n from o where n > 30""")
def published_counts(view):
    """Counts above the publication threshold."""
    o = view("lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_suppkey").alias("origin")).agg(F.count("*").alias("n"))
    return filters.publishable(o, "n")


@query("", """
select case o_orderstatus when 'F' then 'BUILDING' when 'O' then 'ACTIVITY' else 'TEMPORARY' end as family, count(*) as n from orders group by 1""")
def licence_families(view):
    """Licences by the closed table of families."""
    family = filters.licence_family(F.col("o_orderstatus"), {"F": "BUILDING", "O": "ACTIVITY", "P": "TEMPORARY"})
    return view("orders").groupBy(family.alias("family")).agg(F.count("*").alias("n"))


# ---- states


@query("", """
with p as (select p_partkey as id, case p_partkey % 6 when 0 then 'Aprobado' when 1 then ' En tramite ' when 2 then 'PGOUM 97'
 when 3 then 'No Necesita' when 4 then '' else 'En curso' end as raw from part)
select case when trim(raw) = '' then 'NOT_PUBLISHED' else 'PUBLISHED' end as state,
 case when trim(raw) = '' then null when raw = 'PGOUM 97' then 'PLAN_ORIGIN_MARKER'
 when raw = 'No Necesita' then 'UNRESOLVED_MEANING' else 'PHASE_VALUE' end as kind,
 case when trim(raw) = '' then null when raw in ('Aprobado', 'PGOUM 97', 'No Necesita') then 'SOURCE_DOCUMENTED'
 when trim(raw) = 'En tramite' then 'SOURCE_DOCUMENTED_SPELLING_VARIANT' else 'SOURCE_OBSERVED_NOT_DOCUMENTED' end as vocabulary,
 case when raw in ('Aprobado', 'PGOUM 97', 'No Necesita') then raw when trim(raw) = 'En tramite' then 'En trámite' end as documented_as, count(*) as n
from p group by 1, 2, 3, 4""")
def phase_values(view):
    """Published phase cells: what kind of value each is, never ranked."""
    raw = F.element_at(F.array(*map(F.lit, ("Aprobado", " En tramite ", "PGOUM 97", "No Necesita", "", "En curso"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    documented = {"aprobado": "Aprobado", "pgoum 97": "PGOUM 97", "no necesita": "No Necesita"}
    phase = filters.phase_value(raw, documented, {"en tramite": "En trámite"}, ["pgoum 97"], ["no necesita"])
    return view("part").select(phase.alias("p")).groupBy("p.state", "p.kind", "p.vocabulary", "p.documented_as").agg(F.count("*").alias("n"))


@query("", """
with s as (select c_custkey as id, c_nationkey as g, case when c_custkey % 9 = 0 then null else 20 + c_acctbal / 300 end as noon,
 25 + c_acctbal / 300 as three from customer)
select g, round(avg(noon), 6) as mean, count(noon) as samples, case when count(noon) > 0 then 'MODEL_DERIVED' else 'NONE' end as evidence,
 case when avg(noon) is null then 'NO_VALUE' when avg(noon) >= 46 then 'EXTREME' when avg(noon) >= 38 then 'VERY_STRONG'
 when avg(noon) >= 32 then 'STRONG' else 'MODERATE_OR_BELOW' end as class
from s group by g""")
def thermal_classes(view):
    """Mean felt temperature at an hour, over the samples that have one, and its class."""
    noon = F.when(F.col("c_custkey") % 9 != 0, 20 + F.col("c_acctbal").cast("double") / 300)
    hours = F.map_from_arrays(F.array(F.lit("12:00"), F.lit("15:00")), F.array(noon, 25 + F.col("c_acctbal").cast("double") / 300))
    out = aggregates.mean_at_key(view("customer").select(F.col("c_nationkey").alias("g"), hours.alias("hours")), "hours", "12:00", "g")
    return out.select("g", F.round("mean", 6).alias("mean"), "samples", "evidence", filters.thermal_class(F.col("mean")).alias("class"))


@query("monthly", """
select period, case when residents_home + residents_abroad is null then 'CURRENT_MISSING'
 when residents_home + residents_abroad <= 0 then 'NOTHING_TO_SHARE' else 'AVAILABLE' end as state,
 cast(floor(residents_home * 100e0 / (residents_home + residents_abroad) + 0.5e0) as bigint) as home,
 cast(floor(residents_abroad * 100e0 / (residents_home + residents_abroad) + 0.5e0) as bigint) as abroad from monthly""")
def residence_composition(view):
    """Shares of travellers from here and from abroad, of the two added together."""
    state, home, abroad = aggregates.composition("residents_home", "residents_abroad")
    return view("monthly").select("period", state.alias("state"), home.alias("home"), abroad.alias("abroad"))


@query("editions", """
, w as (select n_nationkey as code from nation), c as (select * from editions where edition = 'current')
select w.code, u.use, case when c.code is null then 'NOT_PUBLISHED_IN_EDITION'
 when u.use = 'other' and w.code % 4 = 0 then 'NOT_PUBLISHED' else 'PUBLISHED' end as availability,
 case when c.code is not null and not (u.use = 'other' and w.code % 4 = 0) then case u.use
 when 'housing' then c.quantity * 10 else c.quantity % 3 end end as square_m, c.phase
from w cross join (values ('housing'), ('other')) u(use) left join c on c.code = w.code""")
def buildability_rows(view):
    """What an edition publishes for each exact code and use; a blank is not zero, and rows are never added up."""
    codes = view("nation").select(F.col("n_nationkey").alias("code"))
    c = view("editions").where("edition = 'current'").select("code", "phase", (F.col("quantity") * 10).alias("housing"), F.when(F.col("code") % 4 != 0, F.col("quantity") % 3).alias("other"))
    return linkage.published_uses(codes, c, ("housing", "other"), "code", "phase")


# ---- comparison

_PAIRS = """
with s as (select c_custkey as id, case when c_custkey % 5 = 0 then null else c_acctbal end as a_mean, c_custkey % 4 as a_n, c_acctbal * 2 as b_mean, 3 as b_n,
 case c_custkey % 7 when 0 then 'live' when 1 then 'snapshot' when 2 then 'odd' else 'published' end as source, c_custkey % 6 <> 0 as enabled, case
 when c_custkey % 11 = 0 then null else '1996' end as period,
 case when c_custkey % 3 = 0 then '12:00' else '15:00' end as a_step, '15:00' as b_step from customer)"""


def _two_sides(view):
    c, balance = F.col("c_custkey"), F.col("c_acctbal").cast("double")
    return view("customer").select(
        c.alias("id"), F.when(c % 5 != 0, balance).alias("a_mean"), (c % 4).alias("a_n"), (balance * 2).alias("b_mean"), F.lit(3).alias("b_n"),
        F.when(c % 7 == 0, "live").when(c % 7 == 1, "snapshot").when(c % 7 == 2, "odd").otherwise("published").alias("source"),
        (c % 6 != 0).alias("enabled"), F.when(c % 11 != 0, "1996").alias("period"), F.when(c % 3 == 0, "12:00").otherwise("15:00").alias("a_step"), F.lit("15:00").alias("b_step"),
    )


@query("", _PAIRS + """
, t as (select *, case when source = 'odd' then 'UNAVAILABLE' when not enabled then 'OFF' when not coalesce(a_mean >= 0 and a_n > 0,
 false) or not (b_mean >= 0 and b_n > 0) then 'NO_EVIDENCE' when period is null then 'INCOMPATIBLE' when source = 'snapshot' then 'VALID_PARTIAL'
 when source = 'published' then 'VALID_DEPLOYMENT' else 'VALID' end as state from s)
select state, count(*) as n, round(sum(case when starts_with(state, 'VALID') then b_mean - a_mean end), 2) as delta from t group by state""")
def activities_compared(view):
    """States of observed activity in two circles; a difference only where both are evidence."""
    state = compare.activity_state(F.col("enabled"), F.col("source"), F.col("period"), "a", "b")
    out = _two_sides(view).withColumn("state", state)
    return out.groupBy("state").agg(F.count("*").alias("n"), F.round(F.sum(F.when(F.col("state").startswith("VALID"), F.col("b_mean") - F.col("a_mean"))), 2).alias("delta"))


@query("", _PAIRS + """
, t as (select *, case when not enabled then 'OFF' when not (a_mean is not null and a_n > 0) then 'NO_EVIDENCE'
 when a_step <> b_step then 'INCOMPATIBLE' else 'VALID' end as state from s)
select state, count(*) as n, round(sum(case when state = 'VALID' then b_mean - a_mean end), 2) as delta from t group by state""")
def temperatures_compared(view):
    """States of modelled temperature in two circles; hours that differ are not compared."""
    out = _two_sides(view).withColumn("state", compare.temperature_state(F.col("enabled"), "a", "b"))
    return out.groupBy("state").agg(F.count("*").alias("n"), F.round(F.sum(F.when(F.col("state") == "VALID", F.col("b_mean") - F.col("a_mean"))), 2).alias("delta"))


@query("poi", _ONE + """
select metric, case when state = 'WITHHELD_EXTRACTION' then state when a is null then 'N_A' when a = 0 then 'ZERO' else 'VALID' end as a_evidence,
 case when state = 'WITHHELD_EXTRACTION' then state when b is null then 'N_A' when b = 0 then 'ZERO' else 'VALID' end as b_evidence,
 case when state = 'DENSITY' then 'density' when state = 'RAW' then 'count' end as delta_kind, case when state = 'DENSITY' then 'density'
 when state = 'RAW' then 'raw-counts' end as basis, delta,
 case when state = 'WITHHELD_EXTRACTION' then 'extraction-bounds' when state = 'UNAVAILABLE' then 'source-incompatible' end as withheld_reason from t1""")
def comparison_bridge(view):
    """What may be said across two circles, metric by metric, or why not."""
    return compare.bridge(compare.compare_counts(_sides(view, 4000.0)))


@query("", """
with a as (select o_orderstatus as side, o_orderpriority as metric, count(*) as value from orders where o_orderpriority <> '5-LOW' group by 1, 2),
b as (select o_orderstatus as side, o_orderpriority as metric, count(*) + case when o_orderpriority = '2-HIGH' then 1 else 0 end as value from orders
 where o_orderpriority <> '1-URGENT' group by 1, 2)
select coalesce(a.side, b.side) as side, coalesce(a.metric, b.metric) as metric, a.value as was, b.value as "is", case
 when a.side is null then 'ONLY_SECOND' when b.side is null then 'ONLY_FIRST' when a.value = b.value then 'SAME' else 'CHANGED' end as state
from a full outer join b on a.side = b.side and a.metric = b.metric""")
def session_readings(view):
    """Readings of two sessions, side by side."""
    n = view("orders").groupBy(F.col("o_orderstatus").alias("side"), F.col("o_orderpriority").alias("metric")).agg(F.count("*").alias("value"))
    later = n.withColumn("value", F.col("value") + F.when(F.col("metric") == "2-HIGH", 1).otherwise(0))
    return compare.readings_compared(n.where("metric <> '5-LOW'"), later.where("metric <> '1-URGENT'"))


@query("area_edges", """
, a as (select area_id, abs(sum(radians(x1 - x0) * (2 + sin(radians(y0)) + sin(radians(y1))))) * (6371000e0 * 6371000e0 / 2) / 1e6 as km2
 from area_edges group by area_id)
select 'POLYGON' as kind, area_id, round(km2, 6) as km2 from a union all select 'CIRCLE', cast(r_regionkey as int),
 round(pi() * power(500e0 * (r_regionkey + 1), 2) / 1e6, 6) from region""")
def shape_areas(view):
    """Areas of circles and polygons by one rule for each kind."""
    rings = areas(view).select("area_id", geo.polygon_shape(F.col("edges")).alias("shape"))
    circles = view("region").select(F.col("r_regionkey").cast("int").alias("area_id"), geo.circle_shape(F.lit(LAT), F.lit(LON), 500.0 * (F.col("r_regionkey") + 1)).alias("shape"))
    return rings.union(circles).select("shape.kind", "area_id", F.round(geo.shape_area_km2(F.col("shape")), 6).alias("km2"))


#: Four phases and five quantities of a planning area.
NINE = ("phase_plan", "phase_project", "phase_works", "phase_transfer", "surface", "housing", "offices", "industry", "other")


@query("", f"""
with m as (select unnest({list(NINE)}) as metric, unnest(range(9)) as m),
s as (
 select n_nationkey as area, m.metric, m.m,
  case when (n_nationkey + m) % 7 = 0 then 'NOT_PUBLISHED' when m >= 5 and n_nationkey % 6 = 5 then 'MULTIPLE_ROWS_NOT_COMBINED'
 when n_nationkey % 11 = 10 then 'NOT_PUBLISHED_IN_EDITION' else 'PUBLISHED' end as state,
  case (n_nationkey * m) % 3 when 0 then 'aprobado' when 1 then 'aprobado' else 'en curso' end as text, n_nationkey * 100 + m as value, case
 when n_nationkey % 5 = 4 then 'B' else 'A' end as edition
 from nation cross join m)
select a.area as pair, a.metric, case when a.m < 4 then 'CATEGORY' else 'QUANTITY' end as kind,
 case when a.m >= 4 then null when a.edition <> b.edition or a.state <> 'PUBLISHED' or b.state <> 'PUBLISHED' then 'INDETERMINATE'
 when a.text = b.text then 'SAME' else 'DIFFERENT' end as relation,
 case when a.m >= 4 and a.edition = b.edition and a.state = 'PUBLISHED' and b.state = 'PUBLISHED' then b.value - a.value end as delta,
 case when a.edition <> b.edition then 'CROSS_EDITION' when a.m < 4 then null
 when a.state = 'MULTIPLE_ROWS_NOT_COMBINED' or b.state = 'MULTIPLE_ROWS_NOT_COMBINED' then 'MULTIPLE_ROWS_NOT_COMBINED'
 when a.state <> 'PUBLISHED' or b.state <> 'PUBLISHED' then 'VALUE_NOT_PUBLISHED' end as withheld
from s a join s b on b.area = a.area + 1 and b.metric = a.metric""")
def planning_areas_compared(view):
    """Neighbouring planning areas by nine metrics: four phases that are equal or not, five quantities with a difference."""
    area = F.col("n_nationkey")
    metrics = F.explode(F.array(*(F.struct(F.lit(name).alias("metric"), F.lit(i).alias("m")) for i, name in enumerate(NINE))))
    s = view("nation").select(area.alias("area"), metrics.alias("x")).select("area", "x.metric", "x.m")
    a, m = F.col("area"), F.col("m")
    state = F.when((a + m) % 7 == 0, "NOT_PUBLISHED").when((m >= 5) & (a % 6 == 5), "MULTIPLE_ROWS_NOT_COMBINED").when(a % 11 == 10, "NOT_PUBLISHED_IN_EDITION").otherwise("PUBLISHED")
    words = F.when((a * m) % 3 == 0, "Aprobado").when((a * m) % 3 == 1, " aprobado ").otherwise("En curso")
    s = s.select("area", "metric", F.when(m < 4, "CATEGORY").otherwise("QUANTITY").alias("kind"), state.alias("state"), words.alias("text"), (a * 100 + m).alias("value"), F.when(a % 5 == 4, "B").otherwise("A").alias("edition"))
    side = lambda p: [F.col(c).alias(f"{p}_{c}") for c in ("state", "text", "value", "edition")]
    left = s.select(F.col("area").alias("pair"), "metric", "kind", *side("a"))
    right = s.select((F.col("area") - 1).alias("pair"), "metric", *side("b"))
    return compare.published_metrics(left.join(right, ["pair", "metric"]))


# ---- gates: (source, check, ok, bad)


def _sql_gate(source: str, check: str, bad: str) -> str:
    return f"select '{source}' as source, '{check}' as check, bad = 0 as ok, bad from ({bad}) g"


def _gates_sql(views: str, *parts: tuple[str, str, str]) -> str:
    body = " union all ".join(_sql_gate(*p) for p in parts)
    return f"{views} {body}"


def _all(*parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("population", _gates_sql(
    ", d as (select district_id, cast(sum(residents) as bigint) + case when district_id = 3 then 1 else 0 end as residents from population group by district_id)",
    ("population", "not_negative", "select count(case when not (residents >= 0) then 1 end) as bad from population"),
    ("population", "unique_key", "select count(*) as bad from (select area_id from population group by 1 having count(*) > 1) t"),
    ("population", "district_id_sums", "select count(*) as bad from d join (select district_id, sum(residents) as parts from population group by 1) p on p.district_id = d.district_id where parts <> d.residents"),
    ("population", "every_area_id", "select count(*) as bad from nation where n_nationkey not in (select area_id from population)"),
    ("population", "areas", "select abs(count(*) - 25) as bad from population"),
))
def population_gates(view):
    """Residents: whole numbers, one row an area, every area, and districts that are the sum of theirs."""
    p = view("population")
    wholes = p.groupBy("district_id").agg(F.sum("residents").alias("residents")).withColumn("residents", F.col("residents") + F.when(F.col("district_id") == 3, 1).otherwise(0))
    return _all(
        quality.gates(p, "population", {"not_negative": F.col("residents") >= 0}),
        quality.unique(p, "population", "area_id"),
        quality.sums_match(p, wholes, "population", "district_id", "residents"),
        quality.complete(p, view("nation").select(F.col("n_nationkey").alias("area_id")), "population", "area_id"),
        quality.expected_count(p, "population", "areas", 25),
    )


@query("population", _gates_sql(
    ", u as (select area_id, case when area_id = 4 then null when area_id = 6 then 120e0 else area_id * 0.5e0 end as rate, case when area_id = 4 then 'withheld' when area_id = 8 then 'odd' else 'published' end as state from population)",
    ("unemployment", "rate_in_range", "select count(case when not coalesce(state <> 'published' or rate between 0 and 100, false) then 1 end) as bad from u"),
    ("unemployment", "known_state", "select count(case when state not in ('published', 'withheld') then 1 end) as bad from u"),
    ("unemployment", "withheld_has_no_rate", "select count(case when state = 'withheld' and rate is not null then 1 end) as bad from u"),
    ("unemployment", "unique_key", "select count(*) as bad from (select area_id from u group by 1 having count(*) > 1) t"),
))
def unemployment_gates(view):
    """Rates in range, states of a closed set, and no figure where it is withheld."""
    a = F.col("area_id")
    rate = F.when(a == 4, None).when(a == 6, 120.0).otherwise(a * 0.5)
    u = view("population").select("area_id", rate.alias("rate"), F.when(a == 4, "withheld").when(a == 8, "odd").otherwise("published").alias("state"))
    rules = {
        "rate_in_range": (F.col("state") != "published") | F.col("rate").between(0, 100),
        "known_state": F.col("state").isin("published", "withheld"),
        "withheld_has_no_rate": (F.col("state") != "withheld") | F.col("rate").isNull(),
    }
    return quality.gates(u, "unemployment", rules).union(quality.unique(u, "unemployment", "area_id"))


@query("licences", _gates_sql(
    ", v as (select cast(ndp % 25 as int) as area_id, count(*) as licences, count(*) + cast(sum(id % 3) as bigint) - case when ndp % 25 = 7 then 1000000 else 0 end as units from licences group by 1, ndp % 25), w as (select area_id % 5 as district_id, cast(sum(licences) as bigint) as licences from v group by 1)",
    ("licence_counts", "units_not_below_licences", "select count(case when units < licences then 1 end) as bad from v"),
    ("licence_counts", "not_negative", "select count(case when licences < 0 then 1 end) as bad from v"),
    ("licence_counts", "district_id_sums", "select count(*) as bad from w join (select area_id % 5 as district_id, sum(licences) as n from v group by 1) p on p.district_id = w.district_id where p.n <> w.licences"),
))
def licence_count_gates(view):
    """Counts by area: never more licences than units, and districts add up."""
    area = (F.col("ndp") % 25).cast("int")
    v = view("licences").groupBy(area.alias("area_id")).agg(F.count("*").alias("licences"), F.sum(F.col("id") % 3).alias("extra"))
    v = v.select("area_id", (F.col("area_id") % 5).alias("district_id"), "licences", (F.col("licences") + F.col("extra") - F.when(F.col("area_id") == 7, 1_000_000).otherwise(0)).alias("units"))
    wholes = v.groupBy("district_id").agg(F.sum("licences").alias("licences"))
    rules = {"units_not_below_licences": F.col("units") >= F.col("licences"), "not_negative": F.col("licences") >= 0}
    return quality.gates(v, "licence_counts", rules).union(quality.sums_match(v, wholes, "licence_counts", "district_id", "licences"))


@query("area_edges editions", _gates_sql(
    ", n as (select area_id, count(*) as vertices from area_edges group by 1), c as (select * from editions where edition = 'current')",
    ("planning", "vertices", "select count(case when vertices <> 4 then 1 end) as bad from n"),
    ("planning", "known_code", "select count(*) as bad from (select distinct code from c where code not in (select area_id from n)) t"),
    ("planning", "every_code", "select count(*) as bad from n where area_id not in (select code from c)"),
    ("planning", "known_phase", "select count(case when phase not in ('F', 'O') then 1 end) as bad from c"),
    ("planning", "unique_key", "select count(*) as bad from (select code from c group by 1 having count(*) > 1) t"),
))
def planning_gates(view):
    """Planning areas: vertex counts, one state a code, known phases, and codes of both sides."""
    n = view("area_edges").groupBy("area_id").agg(F.count("*").alias("vertices"))
    c = view("editions").where("edition = 'current'")
    codes = n.select(F.col("area_id").alias("code"))
    return _all(
        quality.gates(n, "planning", {"vertices": F.col("vertices") == 4}),
        quality.references(c, codes, "planning", "code"),
        quality.complete(c, codes, "planning", "code"),
        quality.gates(c, "planning", {"known_phase": F.col("phase").isin("F", "O")}),
        quality.unique(c, "planning", "code"),
    )


@query("", _gates_sql(
    "with o as (select l_returnflag as mode, l_suppkey as origin_code, count(*) as tourists from lineitem group by 1, 2), p as (select s_suppkey as origin_code, s_nationkey as place from supplier where s_suppkey % 6 <> 0)",
    ("origins", "above_threshold", "select count(case when tourists <= 30 then 1 end) as bad from o"),
    ("origins", "known_origin_code", "select count(*) as bad from (select distinct origin_code from o where origin_code not in (select origin_code from p)) t"),
    ("origins", "unique_key", "select count(*) as bad from (select mode, origin_code from o group by 1, 2 having count(*) > 1) t"),
    ("places", "has_place", "select count(case when place is null then 1 end) as bad from p"),
))
def origin_gates(view):
    """Origins: only counts above the publication threshold, and a reference point for each."""
    o = view("lineitem").groupBy(F.col("l_returnflag").alias("mode"), F.col("l_suppkey").alias("origin_code")).agg(F.count("*").alias("tourists"))
    p = view("supplier").where("s_suppkey % 6 <> 0").select(F.col("s_suppkey").alias("origin_code"), F.col("s_nationkey").alias("place"))
    return _all(
        quality.gates(o, "origins", {"above_threshold": F.col("tourists") > 30}),
        quality.references(o, p, "origins", "origin_code"),
        quality.unique(o, "origins", "mode", "origin_code"),
        quality.gates(p, "places", {"has_place": F.col("place").isNotNull()}),
    )


@query("licences address_versions", _gates_sql(
    "",
    ("crosswalk", "ends_after_start", "select count(case when valid_from is not null and valid_to is not null and valid_from > valid_to then 1 end) as bad from address_versions"),
    ("crosswalk", "unique_key", "select count(*) as bad from (select ndp, version from address_versions group by 1, 2 having count(*) > 1) t"),
    ("crosswalk", "known_ndp", "select count(*) as bad from (select distinct ndp from address_versions where ndp not in (select ndp from licences)) t"),
))
def crosswalk_gates(view):
    """Address versions: intervals in order, one row a version, and addresses that licences use."""
    v = view("address_versions")
    ordered = F.col("valid_from").isNull() | F.col("valid_to").isNull() | (F.col("valid_from") <= F.col("valid_to"))
    return _all(quality.gates(v, "crosswalk", {"ends_after_start": ordered}), quality.unique(v, "crosswalk", "ndp", "version"), quality.references(v, view("licences"), "crosswalk", "ndp"))


@query("", _gates_sql(
    "with h as (select p_brand as class, p_size as area_id, count(*) as premises, count(distinct p_type) as kinds from part group by 1, 2)",
    ("hospitality", "known_class", "select count(case when not starts_with(class, 'Brand#') then 1 end) as bad from h"),
    ("hospitality", "kinds_not_above_premises", "select count(case when kinds > premises then 1 end) as bad from h"),
    ("hospitality", "known_area_id", "select count(*) as bad from (select distinct area_id from h where area_id not in (select n_nationkey from nation)) t"),
    ("hospitality", "unique_key", "select count(*) as bad from (select class, area_id from h group by 1, 2 having count(*) > 1) t"),
))
def hospitality_gates(view):
    """An aggregate of premises: a closed set of classes, counts in order, and known areas."""
    h = view("part").groupBy(F.col("p_brand").alias("class"), F.col("p_size").alias("area_id")).agg(F.count("*").alias("premises"), F.count_distinct("p_type").alias("kinds"))
    rules = {"known_class": F.col("class").startswith("Brand#"), "kinds_not_above_premises": F.col("kinds") <= F.col("premises")}
    return _all(quality.gates(h, "hospitality", rules), quality.references(h, view("nation").select(F.col("n_nationkey").alias("area_id")), "hospitality", "area_id"), quality.unique(h, "hospitality", "class", "area_id"))


@query("stations", _gates_sql(
    "",
    ("stations", "inside_scope", "select count(case when not (lon between -3.889e0 and -3.518e0 and lat between 40.312e0 and 40.564e0) then 1 end) as bad from stations"),
    ("stations", "mean_not_negative", "select count(case when not (mean_observed >= 0) then 1 end) as bad from stations"),
    ("stations", "has_observations", "select count(case when not (observation_count > 0) then 1 end) as bad from stations"),
    ("stations", "dates_in_order", "select count(case when date_min > date_max then 1 end) as bad from stations"),
    ("stations", "unique_key", "select count(*) as bad from (select station_id from stations group by 1 having count(*) > 1) t"),
))
def station_gates(view):
    """Counters of walkers: places, means, observations and dates."""
    s = view("stations")
    rules = {
        "inside_scope": filters.in_box(F.col("lat"), F.col("lon"), 40.312, 40.564, -3.889, -3.518),
        "mean_not_negative": F.col("mean_observed") >= 0,
        "has_observations": F.col("observation_count") > 0,
        "dates_in_order": F.col("date_min") <= F.col("date_max"),
    }
    return quality.gates(s, "stations", rules).union(quality.unique(s, "stations", "station_id"))


_FRESH = """(values ('licences', 'published', '2001-08-01', 'day', 'city'), ('areas', 'published', null, null, 'city'),
 ('monthly', 'snapshot', '2001-08', 'month', 'office'),
 ('hotels', 'old', '2001', 'year', 'office'), ('heat', 'unavailable', '2023-08-21', 'day', 'lab'), ('rail', 'live', '2024-13', 'month', ' '))"""


_FORM = {"day": "^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "month": "^[0-9]{4}-(0[1-9]|1[0-2])$", "year": "^[0-9]{4}$"}
_FITS = " or ".join(f"(precision = '{k}' and regexp_matches(reference_date, '{v}'))" for k, v in _FORM.items())


@query("sources", f"""
, r as (
 select state in ('live', 'published', 'snapshot', 'unavailable') as known_state, precision is null or precision in ('day', 'month', 'year') as known_precision,
  case when reference_date is null then precision is null else {_FITS} end as date_fits_precision,
  state <> 'unavailable' or reference_date is null as unavailable_has_no_date, trim(publisher) <> '' as has_publisher from sources),
t as (unpivot (select {", ".join(f"cast(coalesce({c}, false) as integer) as {c}" for c in ("known_state", "known_precision", "date_fits_precision", "unavailable_has_no_date", "has_publisher"))} from r)
 on known_state, known_precision, date_fits_precision, unavailable_has_no_date, has_publisher into name "check" value good)
select 'freshness' as source, "check", count(*) filter (good = 0) = 0 as ok, count(*) filter (good = 0) as bad from t group by "check\"""")
def freshness_gates(view):
    """The five freshness fields of each source: closed vocabularies, and a missing date that says so."""
    return quality.gates(view("sources"), "freshness", quality.freshness_rules())


@query("licences monthly", """
, g as (select 'licences' as source, count(case when family not in ('ACTIVITY', 'BUILDING') then 1 end) = 0 as ok from licences
 union all select 'licences', true union all select 'monthly', count(case when not coalesce(overnight_stays > 0, false) then 1 end) = 0 from monthly),
f as (select 'licences' as source, count(*) as rows, min(grant_date) as first, max(grant_date) as last from licences
 union all select 'monthly', count(*), min(period), max(period) from monthly union all select 'none', 0, null, null)
select f.source, f.rows, f.first, f.last, c.checks, c.failed, case when f.rows = 0 then 'UNAVAILABLE' when c.failed > 0 then 'FAIL' else 'PASS' end as verdict
from f left join (select source, count(*) as checks, count(case when not ok then 1 end) as failed from g group by 1) c on c.source = f.source""")
def deployment_manifest(view):
    """One row for each source: rows, period, checks and verdict."""
    licences, monthly = view("licences"), view("monthly")
    gated = _all(
        quality.gates(licences, "licences", {"known_family": F.col("family").isin("ACTIVITY", "BUILDING")}),
        quality.unique(licences, "licences", "id"),
        quality.gates(monthly, "monthly", {"has_nights": F.col("overnight_stays") > 0}),
    )
    fact = lambda df, name, date: df.agg(F.lit(name).alias("source"), F.count("*").alias("rows"), F.min(date).alias("first"), F.max(date).alias("last"))
    facts = _all(fact(licences, "licences", "grant_date"), fact(monthly, "monthly", "period"), fact(licences.where("false"), "none", "grant_date"))
    return quality.manifest(gated, facts)


@query("poi", """
select 'rows' as guard, cast(count(*) as double) as value, 50e0 as least, cast(null as double) as most, case when count(*) >= 50 then 'PASS' else 'FAIL' end as state from poi
union all select 'type=bike', count(*) filter (type = 'bike'), 5e0, null, case when count(*) filter (type = 'bike') >= 5 then 'PASS' else 'FAIL' end from poi
union all select 'type=rail', count(*) filter (type = 'rail'), 100000000e0, null, 'FAIL' from poi
union all select 'unclassified', round(count(*) filter (type = 'info') / count(*), 9), null, 0.1e0, case when count(*) filter (type = 'info') / count(*) <= 0.1 then 'PASS' else 'WARN' end from poi
union all select 'museum_to_stay', round(count(*) filter (type = 'museum') / count(*) filter (type = 'stay'), 9), 0.2e0, null,
 case when count(*) filter (type = 'museum') / count(*) filter (type = 'stay') >= 0.2 then 'PASS' else 'FAIL' end from poi
union all select 'outside', count(*) filter (not lon between -3.889e0 and -3.518e0), null, 0e0,
 case when count(*) filter (not lon between -3.889e0 and -3.518e0) = 0 then 'PASS' else 'FAIL' end from poi""")
def layer_guardrails(view):
    """Floors of a layer and of its kinds, shares and ratios; a kind that is missing fails although the layer looks healthy."""
    kind = F.col("type")
    guards = [
        guardrails.least_rows(50), *guardrails.least_of_each("type", {"bike": 5, "rail": 100_000_000}), guardrails.most_share("unclassified", kind == "info", 0.1, blocks=False),
        guardrails.least_ratio("museum_to_stay", kind == "museum", kind == "stay", 0.2), guardrails.none_where("outside", ~F.col("lon").between(-3.889, -3.518)),
    ]
    return guardrails.report(view("poi"), guards).withColumn("value", F.round("value", 9))


@query("licences", "select id, row_number() over (order by grant_date desc, family, id) - 1 as position from licences")
def licence_positions(view):
    """The place of each licence in an artifact's order: newest first, then by family and number."""
    keyed = view("licences").select("id", "family", (-F.unix_date("grant_date")).alias("age"))
    return numbered(keyed, ["age", "family", "id"]).select("id", "position")


@query("editions edition_manifest", """
, m as (select edition, max(snapshot) filter (family = 'state') as s, max(snapshot) filter (family = 'quantity') as q from edition_manifest group by edition),
c as (
 select c_custkey as id, c_custkey % 31 as code, c_custkey % 6 as k, (select s from m where edition = 'current') as cs, (select q from m where edition = 'current') as cq,
  (select s from m where edition = 'previous') as ps, (select q from m where edition = 'previous') as pq from customer),
r as (
 select id, code, case k when 0 then 'current' when 1 then 'current' when 2 then 'previous' end as edition from c),
f as (select r.*, e.phase, e.quantity, exists (select 1 from editions x where x.code = r.code) as known from r left join editions e on e.edition = r.edition and e.code = r.code),
z as (select *, case when not known then 'UNKNOWN_CODE' when edition is null then 'NO_SUCH_EDITION' when phase is null then 'ABSENT_FROM_EDITION' else 'RESOLVED' end as state from f)
select id, code, edition, state, case when state = 'RESOLVED' then phase end as phase, case when state = 'RESOLVED' then cast(quantity as string) end as quantity from z""")
def inputs_by_edition(view):
    """Requests that name the snapshots of both families: the edition that has exactly those, or nothing."""
    e, k = view("editions"), F.col("c_custkey")
    of = {(r.family, r.edition): F.lit(r.snapshot) for r in view("edition_manifest").collect()}  # two families, two editions
    pair = lambda s, q: F.create_map(F.lit("state"), s, F.lit("quantity"), q)
    s = lambda x: of["state", x]
    q = lambda x: of["quantity", x]
    wanted = F.when(k % 6 == 1, pair(s("current"), q("current"))).when(k % 6 == 2, pair(s("previous"), q("previous"))).when(k % 6 == 3, pair(s("current"), q("previous"))).when(k % 6 == 4, F.create_map(F.lit("state"), s("current"))).when(k % 6 == 5, pair(F.lit("x"), F.lit("y")))
    requests = view("customer").select(k.alias("id"), (k % 31).alias("code"), wanted.alias("wanted"))
    records = e.select(F.lit("state").alias("family"), "edition", "code", F.col("phase").alias("value")).union(e.select(F.lit("quantity"), "edition", "code", F.col("quantity").cast("string")))
    out = linkage.resolved_inputs(requests, view("edition_manifest"), records, ("state", "quantity"))
    return out.select("id", "code", "edition", "state", F.col("inputs")["state"].alias("phase"), F.col("inputs")["quantity"].alias("quantity"))
