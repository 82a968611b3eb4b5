"""Queries that audit editions, projections, coverage and gates, and scalar rules over given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.functions import geo, text
from terrafold.operators import audits, compare, filters, linkage, quality
from terrafold.plans.published_queries import _all, _gates_sql
from terrafold.plans.registry import query
from terrafold.plans.spatial_queries import _FROM_CENTRE, LAT, LON

# ---- editions

_ROWS = """
with o as (
 select o_orderkey as k, o_custkey as code, o_orderpriority as situation, cast(floor(o_totalprice) as bigint) as q,
  case when o_orderkey % 5 = 0 then 'Área ' else 'AREA ' end as name from orders),
a as (select code, situation, k as row, name || code as name, q as quantity from o where k % 17 <> 0),
b as (select code, situation, k as row, case when k % 7 = 0 then 'area ' || code when k % 19 = 0 then 'Sector' else name || code end as name,
 q + case when k % 11 = 0 then 1 else 0 end as quantity from o where k % 13 <> 0),
ga as (select code, situation, count(*) as n, max(quantity) as q, max(name) as name from a group by 1, 2),
gb as (select code, situation, count(*) as n, max(quantity) as q, max(name) as name from b group by 1, 2),
g as (
 select coalesce(ga.code, gb.code) as code, ga.n as an, gb.n as bn, coalesce(ga.n = 1 and gb.n = 1, false) as m, ga.q as aq, gb.q as bq, ga.name as x, gb.name as y
 from ga full join gb on ga.code = gb.code and ga.situation = gb.situation),
p as (
 select code, sum(an) as a, sum(bn) as b, count(*) filter (not m) as unmatched, count(*) filter (m and aq <> bq) as changed, count(*) filter (m and x <> y) as renamed,
  count(*) filter (m and x <> y and upper(replace(replace(x, 'Á', 'A'), 'á', 'a')) = upper(replace(replace(y, 'Á', 'A'), 'á', 'a'))) as cosmetic from g group by code),
production as (
 select code, a, b, case when a is null then 'NEW' when b is null then 'ABSENT' when unmatched > 0 then 'CAUSE_UNRESOLVED' when changed > 0 then 'QUANTITY_CHANGE' else 'NO_CHANGE' end as outcome,
  a is not null and b is not null and unmatched = 0 and changed = 0 and renamed > 0 and renamed = cosmetic as cosmetic_only from p),
fa as (select code, arg_min(quantity, row) as q, arg_min(name, row) as name from a group by code),
fb as (select code, arg_min(quantity, row) as q, arg_min(name, row) as name from b group by code),
legacy as (
 select coalesce(fa.code, fb.code) as code, case when fa.code is null then 'NEW' when fb.code is null then 'ABSENT' when fa.q <> fb.q then 'QUANTITY_CHANGE' else 'NO_CHANGE' end as outcome,
  coalesce(fa.q = fb.q and fa.name <> fb.name and upper(replace(replace(fa.name, 'Á', 'A'), 'á', 'a')) = upper(replace(replace(fb.name, 'Á', 'A'), 'á', 'a')), false) as cosmetic_only
 from fa full join fb on fa.code = fb.code),
r as (
 select l.code, l.outcome as legacy, l.cosmetic_only as lc, p.outcome as production, p.cosmetic_only as pc, l.outcome <> p.outcome or l.cosmetic_only <> p.cosmetic_only or p.outcome = 'CAUSE_UNRESOLVED' as diverges
 from legacy l join production p on p.code = l.code)"""


def _rows(view):
    k, code = F.col("o_orderkey"), F.col("o_custkey")
    name = F.when(k % 5 == 0, "Área ").otherwise("AREA ")
    quantity = F.floor("o_totalprice").cast("long")
    base = view("orders").select(code.alias("code"), F.col("o_orderpriority").alias("situation"), k.alias("row"), F.concat(name, code.cast("string")).alias("name"), quantity.alias("quantity"))
    row = F.col("row")
    renamed = F.when(row % 7 == 0, F.concat(F.lit("area "), F.col("code").cast("string"))).when(row % 19 == 0, "Sector").otherwise(F.col("name"))
    now = base.where("row % 13 <> 0").withColumns({"name": renamed, "quantity": F.col("quantity") + F.when(row % 11 == 0, 1).otherwise(0)})
    return base.where("row % 17 <> 0"), now


@query("", _ROWS + " select code, legacy, production, lc as legacy_cosmetic, pc as production_cosmetic, diverges from r")
def edition_audits(view):
    """Two audits of one pair of editions, by the first row of a code and by all its rows, and where they diverge."""
    return audits.reconciled(*_rows(view))


@query("", _ROWS + """,
t as (select 'legacy' as audit, legacy as outcome, lc as c, diverges from r union all select 'production', production, pc, diverges from r),
e(audit, outcome) as (select a, o from (values ('legacy'), ('production')) x(a) cross join (values ('NEW'), ('ABSENT'), ('CAUSE_UNRESOLVED'), ('QUANTITY_CHANGE'), ('NO_CHANGE')) y(o))
select e.audit, e.outcome, count(t.audit) as codes, count(*) filter (c) as cosmetic, count(*) filter (diverges) as diverging
from e left join t on t.audit = e.audit and t.outcome = e.outcome group by 1, 2""")
def edition_audit_counts(view):
    """Codes of each outcome in either audit, cosmetic changes and divergences apart."""
    return audits.audit_counts(audits.reconciled(*_rows(view)))


# ---- projections

_KRUGER = """
k as (select 1e0 / (2*298.257222101e0 - 1) as n),
c as (
 select n, 6378137e0 / (1 + n) * (1 + n*n/4 + n*n*n*n/64) as a, 2*sqrt(n)/(1 + n) as e,
  n/2 - 2*n*n/3 + 5*n*n*n/16 as a1, 13*n*n/48 - 3*n*n*n/5 as a2, 61*n*n*n/240 as a3 from k),
v as (select area_id, seq, radians(y0) as p, radians(x0 + 3e0) as dl, sin(radians(y0)) as s, c.* from area_edges, c),
s1 as (select *, 0.5e0*ln((1 + s)/(1 - s)) - e*0.5e0*ln((1 + e*s)/(1 - e*s)) as psi from v),
s2 as (select *, (exp(psi) - exp(-psi))/2 as t from s1),
s3 as (select *, atan2(t, cos(dl)) as xi, 0.5e0*ln((1 + sin(dl)/sqrt(1 + t*t))/(1 - sin(dl)/sqrt(1 + t*t))) as eta from s2),
u as (
 select area_id, seq, 500000e0 + 0.9996e0*a*(eta + a1*cos(2*xi)*(exp(2*eta)-exp(-2*eta))/2 + a2*cos(4*xi)*(exp(4*eta)-exp(-4*eta))/2 + a3*cos(6*xi)*(exp(6*eta)-exp(-6*eta))/2) as east,
  0.9996e0*a*(xi + a1*sin(2*xi)*(exp(2*eta)+exp(-2*eta))/2 + a2*sin(4*xi)*(exp(4*eta)+exp(-4*eta))/2 + a3*sin(6*xi)*(exp(6*eta)+exp(-6*eta))/2) as north from s3)"""


@query("area_edges", f", {_KRUGER} select area_id, seq, round(east, 3) as east, round(north, 3) as north from u")
def projected_vertices(view):
    """Vertices in metres of zone 30 north."""
    east, north = geo.utm30n(F.col("y0"), F.col("x0"))
    return view("area_edges").select("area_id", "seq", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


@query("area_edges", f"""
, {_KRUGER},
o as (select area_id as code, x0 as x, y0 as y from area_edges),
t as (select area_id as code, x0 + case when area_id = 7 then 0.002e0 else 0e0 end as x, y0 as y from area_edges where area_id <> 9 and not (area_id = 11 and seq = 2)),
n as (select o.code, count(*) as vertices from o group by 1), m as (select code, count(*) as authority from t group by 1)
select cast(n.code as int) as code, vertices, case when m.authority = vertices then case when n.code = 7 then 0.002e0 else 0e0 end end as deviation,
 case when coalesce(m.authority, 0) <> vertices then 'NOT_COMPARED' when n.code = 7 then 'BEYOND' else 'WITHIN' end as state from n left join m on m.code = n.code""")
def reprojected_areas(view):
    """Vertices that went to metres and back against an authority's: one area shifted there, one missing, one with a vertex less."""
    e = view("area_edges")
    east, north = geo.utm30n(F.col("y0"), F.col("x0"))
    lat, lon = geo.from_utm30n(F.col("east"), F.col("north"))
    ours = e.withColumns({"east": east, "north": north}).select(F.col("area_id").alias("code"), F.round(lon, 9).alias("x"), F.round(lat, 9).alias("y"))
    shifted = F.col("x0") + F.when(F.col("area_id") == 7, 0.002).otherwise(0.0)
    theirs = e.where("area_id <> 9 and not (area_id = 11 and seq = 2)").select(F.col("area_id").alias("code"), F.round(shifted, 9).alias("x"), F.round("y0", 9).alias("y"))
    return audits.reprojection_check(ours, theirs, 1e-6).select("code", "vertices", F.round("deviation", 7).alias("deviation"), "state")


# ---- coverage, sets and compositions


@query("licences poi", """
select l.family, cast(year(grant_date) as int) as year, count(*) as total, count(p.id) as resolved, count(*) - count(p.id) as unresolved, round(count(p.id) / count(*), 9) as share
from licences l left join poi p on p.id = l.ndp and p.type <> 'rail' group by 1, 2""")
def coverage_by_family_and_year(view):
    """Licences whose address is known, by family and year."""
    known = view("poi").where("type <> 'rail'").select(F.col("id").alias("ndp"), F.lit(True).alias("known"))
    both = view("licences").join(known, "ndp", "left").withColumn("year", F.year("grant_date"))
    return audits.coverage(both, F.coalesce("known", F.lit(False)), "family", "year").withColumn("share", F.round("share", 9))


@query("", """
with w as (select p_partkey as id from part), i as (select p_partkey as id from part where p_partkey % 10 <> 1 union all select p_partkey from part where p_partkey % 50 = 3),
f as (select p_partkey as id from part where p_partkey % 10 <> 0)
select (select count(*) from w) as count, (select count(distinct id) from i) as ids, (select count(*) from f) as features,
 (select count(*) from (select distinct id from i where id not in (select id from f)) t) as without_feature, (select count(*) from f where id not in (select id from i)) as without_id,
 (select count(*) from (select id from i group by id having count(*) > 1) t) as repeated, false as consistent""")
def service_sets(view):
    """A service's count, ids and features: what each lacks, and what stands twice."""
    p = view("part").select(F.col("p_partkey").alias("id"))
    return audits.set_agreement(p, p.where("id % 10 <> 1").union(p.where("id % 50 = 3")), p.where("id % 10 <> 0"))


@query("monthly", """
, m as (select * from monthly where travellers is not null and period = (select max(period) from monthly where travellers is not null))
select period, c.component, case c.component when 'home' then residents_home when 'abroad' then residents_abroad end as value,
 case when c.component <> 'unknown' and residents_home + residents_abroad = travellers and travellers > 0
  then round(case c.component when 'home' then residents_home else residents_abroad end / travellers, 9) end as share,
 case when c.component = 'unknown' then 'NOT_PUBLISHED' when residents_home + residents_abroad <> travellers then 'INCOHERENT' when travellers = 0 then 'ZERO_TOTAL' else 'PUBLISHED' end as state
from m cross join (values ('home'), ('abroad'), ('unknown')) c(component)""")
def latest_destination(view):
    """Where the travellers of the latest published month live."""
    m = view("monthly").withColumn("residents_unknown", F.lit(None).cast("long"))
    parts = {"home": "residents_home", "abroad": "residents_abroad", "unknown": "residents_unknown"}
    return audits.destination(m, "period", "travellers", parts).withColumn("share", F.round("share", 9))


# ---- gates


@query("area_edges population", _gates_sql(
    ", a as (select distinct area_id, district_id from area_edges), g as (select area_id, district_id + case when area_id = 12 then 1 else 0 end as district_id from a)",
    ("geography", "areas", "select abs(count(*) - 25) as bad from a"),
    ("geography", "districts", "select abs(count(distinct district_id) - 5) as bad from a"),
    ("geography", "known_district_id", "select count(*) as bad from (select distinct district_id from g where district_id not in (select distinct district_id from population)) t"),
    ("geography", "parent_of_register", "select count(case when g.district_id <> p.district_id then 1 end) as bad from g join population p on p.area_id = g.area_id"),
    ("geography", "one_parent", "select count(*) as bad from (select area_id from a group by 1 having count(*) > 1) t"),
    ("geography", "plausible_extent", "select count(case when e - w > 1 or n - s > 1 then 1 end) as bad from (select area_id, max(x0) as e, min(x0) as w, max(y0) as n, min(y0) as s from area_edges group by 1) t"),
))
def geography_gates(view):
    """Administrative areas: how many of each level, one parent each, the register's parent, and plausible extents."""
    e = view("area_edges")
    a = e.select("area_id", "district_id").distinct()
    g = a.withColumn("district_id", F.col("district_id") + F.when(F.col("area_id") == 12, 1).otherwise(0))
    p = view("population").select("area_id", F.col("district_id").alias("registered"))
    box = e.groupBy("area_id").agg((F.max("x0") - F.min("x0")).alias("w"), (F.max("y0") - F.min("y0")).alias("h"))
    return _all(
        quality.expected_count(a, "geography", "areas", 25), quality.expected_count(a.select("district_id").distinct(), "geography", "districts", 5),
        quality.references(g, p.select(F.col("registered").alias("district_id")).distinct(), "geography", "district_id"),
        quality.gates(g.join(p, "area_id"), "geography", {"parent_of_register": F.col("district_id") == F.col("registered")}),
        quality.unique(a, "geography", "area_id").withColumn("check", F.lit("one_parent")),
        quality.gates(box, "geography", {"plausible_extent": (F.col("w") <= 1) & (F.col("h") <= 1)}),
    )


_DAILY = """, s as (
 select family, cast(date_trunc('month', grant_date) as date) as period, count(*) as total, count(*) filter (id % 2 = 0) as even, count(*) filter (id % 2 <> 0) - case when month(min(grant_date)) = 3 and family = 'BUILDING' then 1 else 0 end as odd,
  case when year(min(grant_date)) = 1995 then 'estimated' else 'definitive' end as status from licences group by 1, 2)"""


@query("licences", _gates_sql(
    _DAILY,
    ("series", "chronological", "select count(case when b is not null and (year(period) - year(b)) * 12 + month(period) - month(b) <> 1 then 1 end) as bad from (select period, lag(period) over (partition by family order by period) as b from s) t"),
    ("series", "known_status", "select count(case when status not in ('definitive', 'provisional') then 1 end) as bad from s"),
    ("series", "components_add_up", "select count(case when even + odd <> total then 1 end) as bad from s"),
    ("series", "unique_key", "select count(*) as bad from (select family, period from s group by 1, 2 having count(*) > 1) t"),
))
def series_gates(view):
    """Monthly series: months that follow each other, known states, and components that add up to the total."""
    d = F.col("grant_date")
    s = view("licences").groupBy("family", F.trunc(d, "month").alias("period")).agg(F.count("*").alias("total"), F.count_if(F.col("id") % 2 == 0).alias("even"), F.count_if(F.col("id") % 2 != 0).alias("odd"), F.min(d).alias("first"))
    s = s.withColumns({"odd": F.col("odd") - F.when((F.month("first") == 3) & (F.col("family") == "BUILDING"), 1).otherwise(0), "status": F.when(F.year("first") == 1995, "estimated").otherwise("definitive")})
    rules = {"known_status": F.col("status").isin("definitive", "provisional"), "components_add_up": F.col("even") + F.col("odd") == F.col("total")}
    return _all(quality.chronological(s, "series", "period", "family"), quality.gates(s, "series", rules), quality.unique(s, "series", "family", "period"))


@query("editions stations poi", _gates_sql(
    """, p as (select * from editions where edition = 'previous'), c as (select * from editions where edition = 'current'),
 x as (select coalesce(p.code, c.code) as code, case when p.code is null then 'NEW' when c.code is null then 'ABSENT' when p.phase <> c.phase then 'STATE_TRANSITION' when p.quantity <> c.quantity then 'QUANTITY_CHANGE' else 'NO_CHANGE' end as outcome
  from p full join c on c.code = p.code),
 r as (select id, type, lon, lat from poi)""",
    ("change", "one_outcome", "select count(*) as bad from (select code from (select distinct code from editions) e left join x using (code) group by code having count(outcome) <> 1) t"),
    ("change", "fingerprint", "select 1 as bad"),
    ("samples", "enough_observations", "select count(case when observation_count < 3 then 1 end) as bad from stations"),
    ("samples", "dates_in_order", "select count(case when date_min > date_max then 1 end) as bad from stations"),
    ("fallback", "known_layer", "select count(case when type not in ('museum', 'info', 'stay', 'bike') then 1 end) as bad from r"),
    ("rail", "inside_contract", "select count(case when type = 'rail' and not (lon between -3.85e0 and -3.55e0 and lat between 40.33e0 and 40.55e0) then 1 end) as bad from r"),
))
def change_and_sample_gates(view):
    """Changes have one outcome for each code and a pinned fingerprint; research samples, the fallback's layers and the rail contract's box."""
    e = view("editions")
    found = linkage.classify_editions(e.where("edition = 'previous'"), e.where("edition = 'current'"), "code", "phase", "quantity")
    s, p = view("stations"), view("poi")
    box = filters.in_box(F.col("lat"), F.col("lon"), 40.33, 40.55, -3.85, -3.55)
    return _all(
        quality.outcomes_total(found, "change", e, "code", "outcome", linkage.EDITION_OUTCOMES), quality.pinned_rows(found, "change", "0" * 64),
        quality.gates(s, "samples", {"enough_observations": F.col("observation_count") >= 3, "dates_in_order": F.col("date_min") <= F.col("date_max")}),
        quality.gates(p, "fallback", {"known_layer": F.col("type").isin("museum", "info", "stay", "bike")}), quality.gates(p, "rail", {"inside_contract": (F.col("type") != "rail") | box}),
    )


# ---- scalar rules over whole tables


@query("", """
with o as (select o_orderkey as id, cast(o_orderdate as date) as d, o_custkey as c, o_orderkey % 4 as k from orders),
m(i, name) as (values (1,'enero'),(2,'febrero'),(3,'marzo'),(4,'abril'),(5,'mayo'),(6,'junio'),(7,'julio'),(8,'agosto'),(9,'septiembre'),(10,'octubre'),(11,'noviembre'),(12,'diciembre'))
select id, lpad(cast(c as varchar), 8, '0') as code, case when k = 3 then null else d end as long_date, case when k = 2 then null else d end as short_date,
 k <> 1 as month_ok, case when c % 7 - 3 > 0 then '+' else '' end || (c % 7 - 3) as delta, 'A & B <' || c || '>' as plain from o join m on m.i = month(d)""")
def published_scalars(view):
    """Padded codes, dates in words and in short forms, months, differences and entities, as publishers write them."""
    d, k, c = F.to_date("o_orderdate"), F.col("o_orderkey") % 4, F.col("o_custkey")
    month = F.element_at(F.array(*map(F.lit, text.MONTHS)), F.month(d))
    words = F.when(k == 3, "sin fecha").otherwise(F.concat(F.day(d).cast("string"), F.lit(" de "), month, F.lit(" de "), F.year(d).cast("string")))
    short = F.when(k == 2, "31.02.2020x").when(k == 1, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    stamp = F.when(k == 1, F.concat(F.date_format(d, "yyyy"), F.lit("-13"))).otherwise(F.date_format(d, "yyyy-MM"))
    entity = F.concat(F.lit("A &amp; B&nbsp;&lt;"), c.cast("string"), F.lit("&gt;"))
    return view("orders").select(
        F.col("o_orderkey").alias("id"), text.padded_code(c, 8).alias("code"), text.spanish_date(words).alias("long_date"), text.any_date(short, "yyyy-MM-dd", "dd/MM/yyyy").alias("short_date"),
        text.is_month(stamp).alias("month_ok"), text.delta_text(c % 7 - 3).alias("delta"), text.unescape(entity).alias("plain"),
    )


@query("poi", """
, p as (select *, case when id % 3 = 0 then lon else lat end as u, case when id % 3 = 0 then lat else lon end as v, case when id % 11 = 0 then null else (id * 37 % 7000) * 1e0 end as r from poi)
select id, case when id % 7 = 0 then null else lat end as lat, case when id % 7 = 0 then null else lon end as lon,
 case when r is null then 900e0 else least(5000e0, greatest(100e0, floor(r / 50e0 + 0.5e0) * 50)) end as radius,
 type <> 'stay' or id % 5 = 0 as kept, r is not null and r >= 0 as usable from p""")
def place_scalars(view):
    """Coordinates in either order put right, radii clamped to steps, one type's kind filtered, and numbers that can be used."""
    i = F.col("id")
    swapped = lambda a, b: F.when(i % 7 == 0, 500.0).when(i % 3 == 0, F.col(a)).otherwise(F.col(b))
    r = F.when(i % 11 != 0, (i * 37 % 7000).cast("double"))
    df = view("poi").withColumns({"u": swapped("lon", "lat"), "v": swapped("lat", "lon"), "r": r, "kind": F.when(i % 5 == 0, "hotel").otherwise("hostel")})
    at = geo.repaired_order(F.col("u"), F.col("v"), (40.0, 41.0), (-4.0, -3.0))
    return df.select("id", at["lat"].alias("lat"), at["lon"].alias("lon"), geo.clamped_radius(F.col("r")).alias("radius"), filters.only_kind("type", "kind", "stay", "hotel").alias("kept"), (filters.finite(F.col("r")) & (F.col("r") >= 0)).alias("usable"))


@query("poi", f"""
, h as (select type, count(*) filter (id % 2 = 0) as a, count(*) filter (id % 2 <> 0) as b from poi where {_FROM_CENTRE} <= 8000 group by type),
t(type) as (values ('museum'), ('info'), ('stay'), ('bike'), ('none'))
select t.type as metric, case when h.type is null then 'WITHHELD' else 'MEASURED' end as state, b - a as delta,
 case when h.type is null then 'NO_EVIDENCE' when b > a then 'BREAK' else 'CONTINUOUS' end as outcome from t left join h on h.type = t.type""")
def four_metrics(view):
    """Four layers counted on two sides and compared, each on its own; a layer that is not there is withheld."""
    held = view("poi").where(geo.in_circle(F.col("lat"), F.col("lon"), LAT, LON, 8000.0))
    counted = held.groupBy("type").agg(F.count_if(F.col("id") % 2 == 0).alias("a"), F.count_if(F.col("id") % 2 != 0).alias("b"))
    layers = view("poi").sparkSession.createDataFrame([(x,) for x in ("museum", "info", "stay", "bike", "none")], "type string")
    both = layers.join(counted, "type", "left").withColumn("state", F.when(F.col("a").isNull(), "WITHHELD").otherwise("MEASURED"))
    shown = compare.withheld_unless(both.withColumn("delta", F.col("b") - F.col("a")), "state", ["MEASURED"], ["delta"])
    sign = F.when(F.col("a").isNull(), "NONE").when(F.col("b") > F.col("a"), "BREAK").otherwise("CONTINUOUS")
    return shown.select(F.col("type").alias("metric"), "state", "delta", compare.governing_outcome(sign, F.lit("NONE")).alias("outcome"))


@query("licences", "select family, count(*) as n, min(grant_date) as first, max(grant_date) as last from licences group by family")
def granted_by_family(view):
    """Licences by family, of a table that must hold granted ones only."""
    held = filters.granted_universe(view("licences").withColumn("status", F.lit("GRANTED")), "status", "grant_date")
    return held.groupBy("family").agg(F.count("*").alias("n"), F.min("grant_date").alias("first"), F.max("grant_date").alias("last"))


@query("", r"""
with c as (
 select c_custkey as id, case when c_custkey % 9 = 0 then null else '  ' || case when c_custkey % 2 = 0 then 'Árbol' else 'ÑANDÚ' end || '   ' || c_mktsegment || ' ' end as name from customer)
select id, upper(trim(regexp_replace(coalesce(name, ''), '\s+', ' ', 'g'))) as canonical,
 trim(translate(lower(coalesce(name, '')), 'áñú', 'anu')) as ascii from c""")
def name_keys(view):
    """The two keys that names are compared by: with marks in upper case, and without them in lower case."""
    c = F.col("c_custkey")
    name = F.when(c % 9 != 0, F.concat(F.lit("  "), F.when(c % 2 == 0, "Árbol").otherwise("ÑANDÚ"), F.lit("   "), "c_mktsegment", F.lit(" ")))
    return view("customer").select(c.alias("id"), text.canonical_key(name).alias("canonical"), text.ascii_key(name).alias("ascii"))
