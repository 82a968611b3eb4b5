"""Queries on series, groups, editions, linkage, comparison and text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrafold.functions import geo, text
from terrafold.operators import aggregates, compare, linkage, series, spatial
from terrafold.plans.registry import query
from terrafold.plans.spatial_queries import _FROM_CENTRE, LAT, LON, areas

# ---- series


@query("monthly", """
select a.period, a.travellers, b.travellers as prior, case when a.travellers is null then 'CURRENT_MISSING'
 when b.period is null then 'NO_PRIOR_MONTH' when b.travellers is null then 'PRIOR_MISSING'
 when b.travellers = 0 then 'PRIOR_ZERO' else 'AVAILABLE' end as state,
 case when b.travellers <> 0 then round((a.travellers-b.travellers)*100e0/b.travellers, 6) end as pct from monthly a left
 join monthly b on b.period = cast(a.period - interval '1' year as date)""")
def year_over_year(view):
    """Change of each month against the same month a year before, with a state where there is none."""
    return series.year_over_year(view("monthly"), "period", "travellers").withColumn("pct", F.round("pct", 6))


@query("origins", """
, m as (select distinct month from origins), p as (select m.month from m join m b on b.month = cast(m.month - interval '1' month as date)),
k as (select p.month, o.origin_code from p join origins o on o.month = p.month union select p.month, o.origin_code from p
 join origins o on o.month = cast(p.month - interval '1' month as date))
select k.month, k.origin_code, a.tourists as now, b.tourists as before, case when b.tourists is null then 'NEWLY_PRESENT'
 when a.tourists is null then 'NO_LONGER_PRESENT' else 'SHARED' end as state, a.tourists - b.tourists as change
from k left join origins a on a.month = k.month and a.origin_code = k.origin_code left
 join origins b on b.month = cast(k.month - interval '1' month as date) and b.origin_code = k.origin_code""")
def origins_against_previous_month(view):
    """Origins of each month and the one before, neither side filled in."""
    return series.against_previous_month(view("origins"), "month", "origin_code", "tourists")


@query("monthly", """
, r as (select *, row_number() over (order by period desc) as back from monthly), l as (select * from r where back <= 24)
select period, travellers, (select min(travellers) from l) as least, (select max(travellers) from l) as most, (select count(travellers) < count(*)
 from l) as has_gaps from l""")
def trend_of_two_years(view):
    """The last 24 months with their least and most."""
    return series.trend(view("monthly"), "period", "travellers", 24)


@query("origins", """
, s as (select origin_code, min(month) as a, max(month) as b from origins group by origin_code),
 g as (select s.origin_code, cast(unnest(generate_series(s.a, s.b, interval '1' month)) as date) as month from s)
select g.origin_code, g.month, 'MISSING' as problem from g left join origins o on o.origin_code = g.origin_code and o.month = g.month where o.month is null""")
def missing_months(view):
    """Months that an origin skips between its first and its last."""
    return aggregates.missing_months(view("origins"), "month", "origin_code")


@query("origins", """
, t as (select origin_code, cast(sum(tourists) as bigint) as tourists from origins group by origin_code),
 p(code, lon, lat) as (select area_id, avg(x0), avg(y0) from area_edges where area_id % 4 <> 1 group by area_id)
, r as (select *, row_number() over (order by tourists desc, origin_code) as rank, max(tourists) over () as most from t)
select origin_code, tourists, rank, round(tourists*100e0/most, 6) as share_of_most, round(sqrt(tourists*1e0/most), 6) as radius, p.code is not null as placed from r left join p on p.code = r.origin_code where rank <= 10""".replace(", t as", ", area_edges as (select n_nationkey as area_id, 1e0 as x0, 1e0 as y0 from nation), t as", 1))
def top_origins(view):
    """The ten largest origins, their share of the largest, and whether a place for them is known."""
    totals = view("origins").groupBy("origin_code").agg(F.sum("tourists").alias("tourists"))
    top = totals.orderBy(F.desc("tourists"), "origin_code").limit(10)
    w = Window.orderBy(F.desc("tourists"), "origin_code")  # ten rows
    ranked = top.withColumns({"rank": F.row_number().over(w).cast("long"), "most": F.max("tourists").over(Window.partitionBy())})
    places = areas(view).where("area_id % 4 <> 1").select(F.col("area_id").alias("origin_code"), F.lit(True).alias("known"))
    return ranked.join(places, "origin_code", "left").select("origin_code", "tourists", "rank", F.round(F.col("tourists") * 100 / F.col("most"), 6).alias("share_of_most"), F.round(F.sqrt(F.col("tourists") / F.col("most")), 6).alias("radius"), F.coalesce("known", F.lit(False)).alias("placed"))


@query("licences", """
, m as (select ndp, id, grant_date, max(grant_date) over (partition by ndp
 order by id rows between unbounded preceding and 1 preceding) as latest_before from licences) select ndp, count(*) as inversions from m
 where grant_date < latest_before group by ndp""")
def order_inversions(view):
    """Licences of an address that bear an earlier date than one of a smaller number."""
    return series.inverted(view("licences"), "id", "grant_date", "ndp").groupBy("ndp").agg(F.count("*").alias("inversions"))


@query("licences", """
, d as (select distinct ndp, grant_date from licences), g as (select ndp, datediff('day', lag(grant_date) over (partition by ndp
 order by grant_date), grant_date) as days from d) select ndp, cast(max(days) as bigint) as longest_gap, count(days) as gaps from g group by ndp""")
def gaps_between_dates(view):
    """The longest gap in days between neighbouring dates of an address."""
    d = view("licences").select("ndp", "grant_date").distinct()
    g = d.withColumn("days", F.datediff("grant_date", F.lag("grant_date").over(Window.partitionBy("ndp").orderBy("grant_date"))))
    return g.groupBy("ndp").agg(F.max("days").cast("long").alias("longest_gap"), F.count("days").alias("gaps"))


@query("licences", "select ndp, min(id) as id, count(*) as records from licences group by ndp having count(*) > 1")
def first_of_duplicates(view):
    """The first licence of each address that has several."""
    n = F.count("*").over(Window.partitionBy("ndp"))
    return series.first_of_duplicates(view("licences").withColumn("records", n).where("records > 1"), "ndp", "id").select("ndp", "id", "records")


@query("monthly", """
select min(case when status = 'provisional' then period end) as first_of_new, max(case when status = 'definitive' then period end) as last_of_old
 from monthly""")
def era_breakpoints(view):
    """The last month of one era and the first of the next."""
    return view("monthly").agg(F.min(F.when(F.col("status") == "provisional", F.col("period"))).alias("first_of_new"), F.max(F.when(F.col("status") == "definitive", F.col("period"))).alias("last_of_old"))


# ---- groups


@query("licences area_edges population", """
, c as (select l.id, p.area_id, p.district_id from licences l join population p on p.area_id = l.ndp % 25)
select area_id, district_id, count(*) as licences, case when grouping(area_id) = 0 then 'area_id'
 when grouping(district_id) = 0 then 'district_id' else 'ALL' end as level from c group by rollup (district_id, area_id)""")
def licences_rolled_up(view):
    """Licences of areas, districts and the whole."""
    placed = view("licences").withColumn("area_id", (F.col("ndp") % 25).cast("int")).join(view("population"), "area_id").withColumn("licences", F.lit(1))
    return aggregates.rollup_levels(placed, "licences", ["area_id", "district_id"]).select("area_id", "district_id", "licences", "level")


@query("licences population", """
, c as (select ndp % 25 as area_id, count(*) as n from licences where ndp % 25 <> 7 group by 1),
 b as (select p.area_id, c.n, case when p.area_id = 9 then null when p.area_id = 11 then 0 else p.residents end as residents from population p left
 join c on c.area_id = p.area_id)
select area_id, case when n is null then 'NUMERATOR_MISSING' when residents is null then 'DENOMINATOR_MISSING'
 when residents <= 0 then 'DENOMINATOR_EMPTY' else 'AVAILABLE' end as state, case when n is not null and residents > 0 then round(n*1000e0/residents,
 6) end as per_thousand from b""")
def licences_per_thousand(view):
    """Licences per thousand residents, or why not."""
    counts = view("licences").where("ndp % 25 <> 7").groupBy((F.col("ndp") % 25).cast("int").alias("area_id")).agg(F.count("*").alias("n"))
    residents = F.when(F.col("area_id") == 9, None).when(F.col("area_id") == 11, 0).otherwise(F.col("residents"))
    ratio, state = aggregates.ratio_state(F.col("n"), F.col("residents"))
    return view("population").withColumn("residents", residents).join(counts, "area_id", "left").select("area_id", state.alias("state"), F.round(ratio, 6).alias("per_thousand"))


@query("", """
with v as (select o_orderpriority as g, o_totalprice as v, row_number() over (partition by o_orderpriority
 order by o_totalprice) as rn, count(*) over (partition by o_orderpriority) as n from orders)
select g, max(case when rn = cast(floor(0.3e0*(n-1)+0.5e0) as bigint)+1 then v end) as nearest_rank, round(quantile_cont(v, 0.3), 6) as interpolated,
 max(case when rn = least(cast(ceil(n*0.2e0) as bigint)+1, n) then v end) as break1, max(case when rn = least(cast(ceil(n*0.8e0) as bigint)+1,
 n) then v end) as break4 from v group by g""")
def three_quantile_rules(view):
    """Nearest rank, interpolation and class breaks are three rules."""
    orders = view("orders").withColumnRenamed("o_orderpriority", "g")
    places = {"nearest_rank": aggregates.nearest_rank(0.3), "break1": aggregates.class_break(1), "break4": aggregates.class_break(4)}
    between = orders.groupBy("g").agg(F.round(F.percentile("o_totalprice", 0.3), 6).alias("interpolated"))
    return aggregates.values_at(orders, "o_totalprice", places, "g").join(between, "g")


@query("", """
select o_orderstatus as g, count(o_totalprice) as n, min(o_totalprice) as least, round(quantile_cont(o_totalprice, 0.1),
 6) as p10, round(median(o_totalprice), 6) as median, round(quantile_cont(o_totalprice, 0.9),
 6) as p90, max(o_totalprice) as most, round(avg(o_totalprice), 6) as mean, round(stddev_pop(o_totalprice)/avg(o_totalprice), 6) as cv from orders
 group by o_orderstatus""")
def distribution_summary(view):
    """Count, extremes, quantiles, mean and coefficient of variation."""
    d = view("orders").groupBy(F.col("o_orderstatus").alias("g")).agg(*aggregates.distribution("o_totalprice"))
    return d.withColumns({c: F.round(c, 6) for c in ("p10", "median", "p90", "mean", "cv")})


@query("", """
with b as (select p_brand as g, p_size as x, floor(p_retailprice/100) as y from part), r as (select g, rank() over (partition by g
 order by x) + (count(*) over (partition by g, x) - 1)/2e0 as rx, rank() over (partition by g
 order by y) + (count(*) over (partition by g, y) - 1)/2e0 as ry from b)
select g, case when stddev_pop(rx)*stddev_pop(ry) <> 0 then round((avg(rx*ry)-avg(rx)*avg(ry))/(stddev_pop(rx)*stddev_pop(ry)),
 6) end as rho, round(avg(abs(rx-ry)), 6) as mean_shift, max(abs(rx-ry)) as max_shift from r group by g""")
def rank_correlation(view):
    """Spearman's rho with average ranks."""
    base = view("part").select(F.col("p_brand").alias("g"), F.col("p_size").alias("x"), F.floor(F.col("p_retailprice") / 100).alias("y"))
    return aggregates.spearman(base, "x", "y", "g").withColumns({c: F.round(c, 6) for c in ("rho", "mean_shift")})


@query("", """
with w as (select c_nationkey as g, c_custkey as id, c_acctbal as v, min(c_acctbal) over (partition by c_nationkey) as lo,
 max(c_acctbal) over (partition by c_nationkey) as hi from customer) select id, case when hi = lo then 0.5e0 else round(greatest(0e0, least(1e0,
 (v-lo)/(hi-lo))), 6) end as scaled from w""")
def min_max_scaled(view):
    """Balances scaled within their group; one half where all are equal."""
    return view("customer").select(F.col("c_custkey").alias("id"), F.round(aggregates.min_max("c_acctbal", "c_nationkey"), 6).alias("scaled"))


@query("poi", """
, c as (select type, count(*) as n from poi where type <> 'rail' group by type), t as (select *, sum(n) over () as total
 from c) select type, n, cast(floor(n*100e0/total + 0.5e0) as bigint) as pct from t union all select 'rail', count(*), null from poi
 where type = 'rail'""")
def category_mix(view):
    """Shares of the known kinds; a withheld kind has none and does not count."""
    c = view("poi").groupBy("type").agg(F.count("*").alias("n"))
    known = F.when(F.col("type") != "rail", F.col("n"))
    return c.select("type", "n", geo.js_round(known * 100.0 / F.sum(known).over(Window.partitionBy())).alias("pct"))


@query("", """
with s as (
 select c_nationkey as g,
  case when c_nationkey % 5 = 3 and o_orderkey % 97 = 0 then null else cast(o_orderdate as date) end as maybe,
  case o_orderstatus when 'F' then 1 when 'O' then 2 else 4 end as sev
 from orders join customer on o_custkey = c_custkey where not (c_nationkey % 2 = 0 and o_orderstatus = 'P'))
select g, case when count(*) > count(maybe) then null else min(maybe) end as oldest,
 case max(sev) when 1 then 'live' when 2 then 'published' when 3 then 'snapshot' else 'unavailable' end as status
from s group by g""")
def oldest_date_and_worst_status(view):
    """The oldest reference date, which one missing date makes missing, and the worst status; every fifth nation misses dates."""
    s = view("orders").join(view("customer"), F.col("o_custkey") == F.col("c_custkey")).where("not (c_nationkey % 2 = 0 and o_orderstatus = 'P')")
    known = ~((F.col("c_nationkey") % 5 == 3) & (F.col("o_orderkey") % 97 == 0))
    status = F.when(F.col("o_orderstatus") == "F", "live").when(F.col("o_orderstatus") == "O", "published").otherwise("unavailable")
    s = s.select(F.col("c_nationkey").alias("g"), F.when(known, F.col("o_orderdate").cast("date")).alias("maybe"), F.lit("day").alias("precision"), status.alias("status"))
    return s.groupBy("g").agg(aggregates.oldest_date("maybe", "precision").alias("oldest"), aggregates.worst_status("status").alias("status"))


@query("", """
with d as (select o_custkey, o_orderpriority, min(o_orderkey) as first from orders group by 1, 2) select o_custkey, string_agg(o_orderpriority, '|'
 order by first) as priorities from d group by o_custkey""")
def ordered_distinct(view):
    """Distinct values in the order in which they were first seen."""
    first = view("orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("first"))
    listed = F.array_sort(F.collect_list(F.struct("first", "o_orderpriority")))
    return first.groupBy("o_custkey").agg(F.array_join(F.transform(listed, lambda x: x["o_orderpriority"]), "|").alias("priorities"))


@query("", """
with g as (select o_custkey, o_orderpriority, count(*) n, count(distinct o_orderstatus) d from orders
 group by 1, 2) select case when n = 1 then 'SINGLE' when d = n then 'DISTINCT' else 'UNRESOLVED' end as verdict, count(*) as keys from g group by 1""")
def row_multiplicity(view):
    """Whether the rows of a key are one, tell each other apart, or neither."""
    per = view("orders").groupBy("o_custkey", "o_orderpriority").agg(aggregates.multiplicity("o_orderstatus").alias("verdict"))
    return per.groupBy("verdict").agg(F.count("*").alias("keys"))


@query("", """
with f as (select o_custkey, max(case when o_orderstatus='F' then 1 else 0 end) + 2*max(case when o_orderstatus='O' then 1 else 0 end) + 4*max(case
 when o_orderstatus='P' then 1 else 0 end) as state from orders group by 1) select cast(state as bigint) as state, count(*) as n from f group by 1""")
def flag_states(view):
    """Eight states of three flags."""
    bit = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(4)
    return view("orders").groupBy("o_custkey").agg(F.bit_or(bit).cast("long").alias("state")).groupBy("state").agg(F.count("*").alias("n"))


@query("licences", """
select cast(year(grant_date) as bigint) as year, family, count(*) as n, min(grant_date) as first, max(grant_date) as last from licences group by 1, 2""")
def extents_by_year(view):
    """Counts and extents of each family and year."""
    return view("licences").groupBy(F.year("grant_date").cast("long").alias("year"), "family").agg(F.count("*").alias("n"), F.min("grant_date").alias("first"), F.max("grant_date").alias("last"))


@query("", """
select o_orderstatus as status, count(case when o_orderpriority='1-URGENT' then 1 end) as urgent, count(case
 when o_orderpriority='2-HIGH' then 1 end) as high, count(case when o_orderpriority='5-LOW' then 1 end) as low from orders group by 1""")
def status_by_priority(view):
    """A cross-table."""
    p = view("orders").groupBy(F.col("o_orderstatus").alias("status")).pivot("o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"]).agg(F.count(F.lit(1)))
    return p.select("status", *(F.coalesce(c, F.lit(0).cast("long")).alias(n) for c, n in (("1-URGENT", "urgent"), ("2-HIGH", "high"), ("5-LOW", "low"))))


@query("", """
with d(code) as (values ('1-URGENT'),('2-HIGH'),('3-MEDIUM'),('9-NEVER')),
 o as (select o_orderpriority as code, count(*) as n, count(distinct o_custkey) as ids, min(cast(o_orderdate as date)) as first_seen,
 max(cast(o_orderdate as date)) as last_seen from orders group by 1)
select coalesce(o.code, d.code) as code, o.n, o.ids, o.first_seen, o.last_seen, case when d.code is null then 'UNDOCUMENTED'
 when o.code is null then 'NOT_OBSERVED' else 'OBSERVED' end as state from o full outer join d on d.code = o.code""")
def value_census(view):
    """Observed values against the documented ones."""
    o = view("orders").groupBy(F.col("o_orderpriority").alias("code")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("ids"), F.min(F.col("o_orderdate").cast("date")).alias("first_seen"), F.max(F.col("o_orderdate").cast("date")).alias("last_seen"))
    d = o.sparkSession.createDataFrame([(c, True) for c in ("1-URGENT", "2-HIGH", "3-MEDIUM", "9-NEVER")], "code string, documented boolean")
    return o.join(d, "code", "full_outer").select("code", "n", "ids", "first_seen", "last_seen", F.when(F.col("documented").isNull(), "UNDOCUMENTED").when(F.col("n").isNull(), "NOT_OBSERVED").otherwise("OBSERVED").alias("state"))


@query("", """
select 'c_name' as column, count(case when trim(c_name) <> '' then 1 end) as filled from customer
 union all select 'c_mktsegment', count(case when trim(c_mktsegment) <> '' then 1 end) from customer""")
def filled_census(view):
    """Filled cells by column."""
    c = view("customer").agg(*(F.count_if(F.trim(x) != "").alias(x) for x in ("c_name", "c_mktsegment")))
    return c.select(F.explode(F.array(*(F.struct(F.lit(x).alias("column"), F.col(x).alias("filled")) for x in ("c_name", "c_mktsegment")))).alias("r")).select("r.*")


@query("", """
with k as (select l_partkey % 500 as k, count(*) n, count(distinct l_returnflag) s from lineitem
 group by 1) select count(*) as keys, count(case when n > 1 then 1 end) as reused, count(case when s > 1 then 1 end) as with_other_attributes from k""")
def identity_profile(view):
    """Keys, those in use more than once, and those that mean different things."""
    k = view("lineitem").groupBy(F.col("l_partkey") % 500).agg(F.count("*").alias("n"), F.count_distinct("l_returnflag").alias("s"))
    return k.agg(F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("reused"), F.count_if(F.col("s") > 1).alias("with_other_attributes"))


@query("", """
select count(*) as n, count(case when abs(o_totalprice - 30e0*o_custkey) < 5000 then 1 end) as fits, round(count(case
 when abs(o_totalprice - 30e0*o_custkey) < 5000 then 1 end)*1e0/count(*), 6) as share from orders""")
def linear_relation(view):
    """How often one column is a multiple of another, to a tolerance."""
    fits = F.count_if(F.abs(F.col("o_totalprice") - 30.0 * F.col("o_custkey")) < 5000)
    return view("orders").agg(F.count("*").alias("n"), fits.alias("fits"), F.round(fits / F.count("*"), 6).alias("share"))


# ---- editions and linkage


@query("editions", """
, o(outcome) as (values ('NEW'),('ABSENT'),('STATE_TRANSITION'),('QUANTITY_CHANGE'),('NO_CHANGE'),('NON_COMPARABLE')),
d as (select case when a.code is null then 'NEW' when b.code is null then 'ABSENT' when a.phase is null or b.phase is null then 'NON_COMPARABLE'
 when a.phase <> b.phase then 'STATE_TRANSITION' when a.quantity is distinct from b.quantity then 'QUANTITY_CHANGE' else 'NO_CHANGE' end as outcome
 from (select * from editions where edition='previous') a full outer join (select * from editions where edition='current') b on a.code = b.code)
select o.outcome, count(d.outcome) as n from o left join d on d.outcome = o.outcome group by o.outcome""")
def edition_outcomes(view):
    """Every code of two editions has one outcome; outcomes without codes are listed too."""
    e = view("editions")
    found = linkage.classify_editions(e.where("edition = 'previous'"), e.where("edition = 'current'"), "code", "phase", "quantity")
    return aggregates.zero_filled(found.groupBy("outcome").agg(F.count("*").alias("n")), list(linkage.EDITION_OUTCOMES), "outcome")


@query("editions", "select a.phase as was, b.phase as \"is\", case when a.code is null then 'APPEARED' when b.code is null then 'DISAPPEARED' when a.phase = b.phase then 'SAME' else 'CHANGED' end as outcome, count(*) as n from (select * from editions where edition='previous') a full outer join (select * from editions where edition='current') b on a.code = b.code group by 1, 2, 3")
def phase_transitions(view):
    """From which phase to which, between two editions."""
    e = view("editions")
    return linkage.persistence(e.where("edition = 'previous'"), e.where("edition = 'current'"), "code", "phase").groupBy("was", "is", "outcome").agg(F.count("*").alias("n"))


@query("", """
with a as (select o_custkey as g, o_orderpriority as k, o_orderkey as row_id from orders where o_orderstatus = 'F'),
 b as (select o_custkey as g, o_orderpriority as k, o_orderkey as row_id from orders where o_orderstatus = 'O'),
x as (select *, count(*) over (partition by g, k) same, count(*) over (partition by g) total from a),
 y as (select *, count(*) over (partition by g, k) same, count(*) over (partition by g) total from b)
select x.g, x.row_id as a_row, y.row_id as b_row, case when x.total = 1 and y.total = 1 then 'ONLY_ROWS' else 'UNIQUE_KEY' end as rule from x
 join y on x.g = y.g where (x.total = 1 and y.total = 1) or (x.k = y.k and x.same = 1 and y.same = 1)""")
def row_correspondence(view):
    """Rows of two editions that are surely the same."""
    side = lambda s: view("orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("g"), F.col("o_orderpriority").alias("k"), F.col("o_orderkey").alias("row_id"))
    return linkage.unique_pairs(side("F"), side("O"), "g", "k")


@query("editions", """
, e as (select edition, code from editions union all select 'draft', n_nationkey from nation where n_nationkey <> 3), c as (select distinct code
 from editions where edition = 'previous')
select max(edition) as edition from (select e.edition from e left join c on c.code = e.code group by e.edition having count(*) = (select count(*)
 from c) and count(distinct e.code) = (select count(*) from c) and count(c.code) = (select count(*) from c)) t""")
def complete_edition(view):
    """The newest edition with exactly the canonical codes."""
    e = view("editions")
    draft = view("nation").where("n_nationkey <> 3").select(F.lit("draft").alias("edition"), F.col("n_nationkey").alias("code"))
    return linkage.complete_edition(e.select("edition", "code").union(draft), "edition", "code", e.where("edition = 'previous'"))


@query("licences address_versions", """
, m as (select l.id, count(v.version) as known, count(distinct case
 when (v.valid_from is null or v.valid_from <= l.grant_date) and (v.valid_to is null or l.grant_date <= v.valid_to) then v.version end) as versions,
 min(case when (v.valid_from is null or v.valid_from <= l.grant_date) and (v.valid_to is null or l.grant_date <= v.valid_to) then v.version end) as one
 from licences l left join address_versions v on l.ndp = v.ndp group by l.id)
select id, versions, case when known = 0 then 'UNKNOWN_KEY' when versions = 0 then 'NOT_ACTIVE'
 when versions = 1 then 'RESOLVED' else 'AMBIGUOUS' end as state, case when versions = 1 then one end as version from m""")
def address_as_of(view):
    """The version of an address at a licence's date; two versions are ambiguous."""
    return linkage.as_of(view("licences"), view("address_versions"), "id", "ndp", "grant_date")


@query("licences address_versions", """
, m as (select l.id, l.family, cast(year(l.grant_date) as bigint) as year, count(v.version) as versions from licences l left
 join address_versions v on l.ndp = v.ndp and (v.valid_from is null or v.valid_from <= l.grant_date) and (v.valid_to is null or l.grant_date <= v.valid_to)
 group by 1, 2, 3)
select family, year, count(case when versions = 1 then 1 end) as resolved, count(case when versions <> 1 then 1 end) as unresolved from m group by 1, 2""")
def linkage_coverage(view):
    """Resolved and other licences by family and year."""
    at = linkage.as_of(view("licences"), view("address_versions"), "id", "ndp", "grant_date").select("id", "state")
    return view("licences").join(at, "id").groupBy("family", F.year("grant_date").cast("long").alias("year")).agg(F.count_if(F.col("state") == "RESOLVED").alias("resolved"), F.count_if(F.col("state") != "RESOLVED").alias("unresolved"))


@query("", """
with l as (select case when c_custkey % 50 = 0 then c_custkey - 1 else c_custkey end as k, c_nationkey as v from customer),
r as (select case when s_suppkey % 10 = 0 then -s_suppkey else s_suppkey end as k, s_nationkey as v from supplier),
a as (select k, count(*) n, min(v) v from l group by 1), b as (select k, count(*) n, min(v) v from r group by 1)
select coalesce(a.k, b.k) as k, case when a.n > 1 or b.n > 1 then 'DUPLICATE' when b.n is null then 'LEFT_ONLY' when a.n is null then 'RIGHT_ONLY'
 when a.v is not distinct from b.v then 'MATCHED' else 'DIFFERS' end as state
from a full outer join b on a.k = b.k""")
def reconciled_keys(view):
    """Keys of two whole tables, each with one verdict; every fiftieth customer repeats a key."""
    k = F.col("c_custkey")
    left = view("customer").select(F.when(k % 50 == 0, k - 1).otherwise(k).alias("k"), F.col("c_nationkey").alias("v"))
    s = F.col("s_suppkey")
    right = view("supplier").select(F.when(s % 10 == 0, -s).otherwise(s).alias("k"), F.col("s_nationkey").alias("v"))
    return linkage.reconcile(left, right, "k", ["v"])


@query("", """
with f as (select c_custkey as id, c_acctbal > 0 as rich, c_mktsegment = 'BUILDING' as builder, c_custkey in (select o_custkey from orders) as buyer
 from customer where c_acctbal > 0 or c_mktsegment = 'BUILDING' or c_custkey in (select o_custkey
 from orders)) select rich, builder, buyer, count(*) as n from f group by 1, 2, 3""")
def id_universes(view):
    """Set algebra over ids as flags on one row for each."""
    c = view("customer")
    u = linkage.universes(rich=c.where("c_acctbal > 0").select(F.col("c_custkey").alias("id")), builder=c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id")), buyer=view("orders").select(F.col("o_custkey").alias("id")))
    return u.groupBy("rich", "builder", "buyer").agg(F.count("*").alias("n"))


@query("editions", """
, a as (select code from editions where edition='previous'), b as (select code from editions where edition='current')
select 'both' as side, code from (select code from a intersect select code from b) union all select 'previous', code from (select code
 from a except select code from b) union all select 'current', code from (select code from b except select code from a)""")
def code_set_algebra(view):
    """Codes of both editions and of either alone."""
    a, b = (view("editions").where(F.col("edition") == e).select("code") for e in ("previous", "current"))
    named = lambda s, df: df.select(F.lit(s).alias("side"), "code")
    return named("both", a.intersect(b)).union(named("previous", a.subtract(b))).union(named("current", b.subtract(a)))


@query("", """
with u as (select c_custkey as id, case when c_nationkey in (8, 9) then true else false end as a, c_mktsegment = 'BUILDING' as b
 from customer) select count(case when a then 1 end) as by_status, count(case when b then 1 end) as by_access, count(case
 when a and b then 1 end) as by_both, count(case when a or b then 1 end) as excluded, count(case when not (a or b) then 1 end) as kept from u""")
def official_exclusions(view):
    """Rows that one rule or another excludes, each counted once."""
    a, b = F.col("c_nationkey").isin(8, 9), F.col("c_mktsegment") == "BUILDING"
    return view("customer").agg(F.count_if(a).alias("by_status"), F.count_if(b).alias("by_access"), F.count_if(a & b).alias("by_both"), F.count_if(a | b).alias("excluded"), F.count_if(~(a | b)).alias("kept"))


@query("", """
with p as (select o_custkey, max(case when o_orderpriority='1-URGENT' then 1 else 0 end) p1, max(case
 when o_orderpriority='2-HIGH' then 1 else 0 end) p2, max(case when o_orderpriority='3-MEDIUM' then 1 else 0 end) p3 from orders group by 1)
select o_custkey, 1 as earlier, 2 as later from p where p2 = 1 and p1 = 0 union all select o_custkey, 1, 3 from p where p3 = 1 and p1 = 0
 union all select o_custkey, 2, 3 from p where p3 = 1 and p2 = 0""")
def implication_violations(view):
    """A later phase is reached and an earlier one is not."""
    has = lambda v: F.max(F.col("o_orderpriority") == v)
    p = view("orders").groupBy("o_custkey").agg(F.array(has("1-URGENT"), has("2-HIGH"), has("3-MEDIUM")).alias("p"))
    early = p.select("o_custkey", "p", F.posexplode("p").alias("i", "first")).where("not first")
    both = early.select("o_custkey", "i", F.posexplode("p").alias("j", "second")).where("i < j and second")
    return both.select("o_custkey", (F.col("i") + 1).alias("earlier"), (F.col("j") + 1).alias("later"))


# ---- comparison

_SIDES = f"""
, c as (select type, count(case when {_FROM_CENTRE} <= 4000 then 1 end) as a, count(case when {_FROM_CENTRE.replace('40.4168e0', '40.45e0')} <= {{r}} then 1 end) as b from poi group by type)
, s as (select type as metric, a, case when type = 'rail' then null else b end as b, type <> 'bike' as ok, pi()*16 as aa, pi()*{{r}}e0*{{r}}e0/1e6 as ba from c)
, t{{n}} as (select metric, a, b, case when not ok then 'WITHHELD_EXTRACTION' when a is null or b is null then 'UNAVAILABLE'
 when abs(aa-ba) > 1e-6 then 'DENSITY' else 'RAW' end as state, case when ok and a is not null and b is not null then case
 when abs(aa-ba) > 1e-6 then b/ba - a/aa else b*1e0 - a end end as delta from s)"""
_ONE = _SIDES.format(r=4000, n=1)
_TWO = _SIDES.format(r=3000, n=2).replace(", c as", ", c2 as").replace("from c)", "from c2)").replace(", s as", ", s2 as").replace("from s)", "from s2)")
_DIRECTION = "case when {d} > 0 then 'HIGHER' when {d} < 0 then 'LOWER' when {d} = 0 then 'EQUAL' else 'NONE' end"


def _sides(view, radius_m: float):
    here = lambda lat, r: F.count_if(geo.in_circle(F.col("lat"), F.col("lon"), lat, LON, r))
    c = view("poi").groupBy(F.col("type").alias("metric")).agg(here(LAT, 4000.0).alias("a"), here(40.45, radius_m).alias("b"))
    b = F.when(F.col("metric") != "rail", F.col("b"))
    return c.select("metric", "a", b.alias("b"), (F.col("metric") != "bike").alias("a_ok"), F.lit(True).alias("b_ok"), (F.pi() * 16).alias("a_area"), (F.pi() * radius_m * radius_m / 1e6).alias("b_area"))


@query("poi", f"{_ONE} select metric, a, b, state, delta, {_DIRECTION.format(d='delta')} as direction from t1")
def lenses_compared(view):
    """Two circles, kind by kind: a state first, a difference only where it may stand."""
    return compare.compare_counts(_sides(view, 4000.0))


@query("poi", f"""{_ONE}{_TWO}, x as (select *, {_DIRECTION.format(d='delta')} as dir from t1), y as (select *, {_DIRECTION.format(d='delta')} as dir from t2),
 o as (select x.metric, x.state in ('RAW','DENSITY') as ao, y.state in ('RAW','DENSITY') as bo, x.state as s1, y.state as s2, x.dir as d1,
 y.dir as d2, x.delta as e1, y.delta as e2 from x join y on x.metric = y.metric)
, z as (select *, case when not ao and not bo then 'STILL_WITHHELD' when not ao then 'BECAME_AVAILABLE' when not bo then 'BECAME_WITHHELD'
 when s1 <> s2 then 'BASIS_CHANGED' when d1 <> d2 then 'DIRECTION_CHANGED' else 'STABLE' end as transition from o)
select metric, transition, case when transition in ('STABLE','DIRECTION_CHANGED') then e2 - e1 end as delta_of_delta from z""")
def lens_sensitivity(view):
    """How the comparison moves when one circle shrinks."""
    return compare.sensitivity(compare.compare_counts(_sides(view, 4000.0)), compare.compare_counts(_sides(view, 3000.0)))


@query("population editions", """
, a as (select p.area_id, p.district_id, e.phase, p.residents, e.quantity from population p left join (select * from editions
 where edition='current') e on e.code = p.area_id), pr as (select x.area_id as pair, x.district_id xd, y.district_id yd, x.phase xp, y.phase yp,
 x.residents xr, y.residents yr, x.quantity xq, y.quantity yq from a x join a y on y.area_id = x.area_id + 1)
select pair, 'district_id' as metric, case when xd = yd then 'EQUAL' else 'DIFFERENT' end as state, cast(null as double) as delta from pr
 union all select pair, 'phase', case when xp is null or yp is null then 'WITHHELD' when xp = yp then 'EQUAL' else 'DIFFERENT' end, null from pr
union all select pair, 'residents', 'MEASURED', cast(yr-xr as double) from pr
 union all select pair, 'quantity', case when xq is null or yq is null then 'WITHHELD' else 'MEASURED' end, cast(yq-xq as double) from pr""")
def neighbouring_areas_compared(view):
    """Areas of neighbouring numbers, metric by metric."""
    now = view("editions").where("edition = 'current'").select(F.col("code").alias("area_id"), "phase", "quantity")
    a = view("population").join(now, "area_id", "left")
    paired = a.withColumn("pair", F.col("area_id")).join(a.select((F.col("area_id") - 1).alias("pair")), "pair", "left_semi")
    other = a.withColumn("pair", F.col("area_id") - 1).join(a.select(F.col("area_id").alias("pair")), "pair", "left_semi")
    return compare.compare_areas(paired, other, ["district_id", "phase"], ["residents", "quantity"])


@query("population", """
select x.area_id as a, y.area_id as b, case when y.area_id is null then 'PARTIAL' when x.area_id = y.area_id then 'SAME_AREA'
 when x.district_id = y.district_id then 'SAME_DISTRICT' else 'DIFFERENT' end as relation from population x left
 join population y on y.area_id = x.area_id * 6 % 30""")
def area_relations(view):
    """How two places relate by area and district."""
    p = view("population")
    a = p.select(F.col("area_id").alias("a"), F.col("district_id").alias("a_district"), (F.col("area_id") * 6 % 30).alias("b_id"))
    b = p.select(F.col("area_id").alias("b"), F.col("district_id").alias("b_district"))
    return a.join(b, F.col("b_id") == F.col("b"), "left").select("a", "b", compare.area_relation("a", "b", "a_district", "b_district").alias("relation"))


@query("stations population area_edges editions", """
, par as (select p.station_id as id, e.area_id, sum(case
 when ((e.y0>p.lat)<>(e.y1>p.lat)) and p.lon < (e.x1-e.x0)*(p.lat-e.y0)/(e.y1-e.y0)+e.x0 then 1 else 0 end) as crossings from stations p cross
 join area_edges e where e.area_id <> 12 group by p.station_id, e.area_id)
, h as (select id, area_id from par where crossings % 2 = 1)
select s.station_id, case when h.area_id is null then 'OUTSIDE' else 'RESOLVED' end as state, h.area_id, p.residents, e.phase, case
 when h.area_id is null then 'UNAVAILABLE' when e.phase is null then 'NOT_PUBLISHED' else 'PUBLISHED' end as phase_state from stations s left
 join h on h.id = s.station_id left join population p on p.area_id = h.area_id left join (select * from editions
 where edition = 'current') e on e.code = h.area_id""")
def area_profiles(view):
    """What is known of the area around each station, each figure with its state."""
    at = spatial.locate(view("stations").select(F.col("station_id").alias("id"), "lat", "lon"), areas(view).where("area_id <> 12"))
    now = view("editions").where("edition = 'current'").select(F.col("code").alias("area_id"), "phase")
    out = at.join(view("population").select("area_id", "residents"), "area_id", "left").join(now, "area_id", "left")
    state = F.when(F.col("area_id").isNull(), "UNAVAILABLE").when(F.col("phase").isNull(), "NOT_PUBLISHED").otherwise("PUBLISHED")
    return out.select(F.col("id").alias("station_id"), F.when(F.col("area_id").isNull(), "OUTSIDE").otherwise("RESOLVED").alias("state"), "area_id", "residents", "phase", state.alias("phase_state"))


# ---- text and cells


@query("", """
with r as (select p_partkey as id, p_name, case when lower(p_name) = 'large bolt' then 0 when lower(p_name) like 'large%' then 1
 when lower(p_name) like '%bolt%' then 2 end as kind from part),
 k as (select *, count(*) over () as total, row_number() over (order by kind, id) as rank from r
 where kind is not null) select id, p_name, cast(kind as integer) as kind, total from k where rank <= 8""")
def ranked_search(view):
    """The eight best matches of a text, with how many there are."""
    name = text.fold(F.col("p_name"))
    kind = F.when(name == "large bolt", 0).when(name.startswith("large"), 1).when(name.contains("bolt"), 2)
    found = view("part").select(F.col("p_partkey").alias("id"), "p_name", kind.alias("kind")).where("kind is not null")
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy("kind", "id").limit(8).join(F.broadcast(total))


@query("", "select page_id, strlen(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) as n_bytes, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) as digest from pages")
def stripped_pages(view):
    """Pages without tags, blanks squeezed."""
    plain = text.strip_tags(F.col("html"))
    return view("pages").select("page_id", F.octet_length(plain).cast("long").alias("n_bytes"), F.sha2(plain, 256).alias("digest"))


@query("", """
with c as (select p_partkey as id, case when p_partkey % 5 = 0 then ' ' when p_partkey % 7 = 0 then 'n.d.' when p_partkey % 11 = 0 then '0' else replace(cast(p_size as varchar) || '.5', '.', ',') end as s from part)
select id, case when trim(s) = '' then 'NOT_PUBLISHED' when try_cast(replace(trim(s), ',', '.') as double) is null then 'NOT_PUBLISHED_NON_NUMERIC' else 'PUBLISHED' end as state, try_cast(replace(trim(s), ',', '.') as double) as value from c""")
def published_cells(view):
    """Blank, text, zero and numbers are told apart."""
    s = F.when(F.col("p_partkey") % 5 == 0, " ").when(F.col("p_partkey") % 7 == 0, "n.d.").when(F.col("p_partkey") % 11 == 0, "0").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(",5")))
    return view("part").select(F.col("p_partkey").alias("id"), text.cell_state(s).alias("c")).select("id", "c.state", "c.value")


@query("", """
select o_orderkey as id, upper(o_orderstatus || ' ' || o_orderpriority) as key, lpad(cast(o_custkey as varchar),
 6, '0') as code, case when o_orderkey % 3 = 0 then 'GRANTED' else 'OTHER' end as class,
 cast(date_trunc('month', o_orderdate) as date) as month, strftime(o_orderdate, '%Y-%m') as label from orders""")
def normal_forms(view):
    """Keys, padded codes, classes and months."""
    key = text.cosmetic_key(F.concat_ws(" ", "o_orderstatus", "o_orderpriority"))
    return view("orders").select(F.col("o_orderkey").alias("id"), key.alias("key"), text.padded_code(F.col("o_custkey"), 6).alias("code"), F.when(F.col("o_orderkey") % 3 == 0, "GRANTED").otherwise("OTHER").alias("class"), F.trunc("o_orderdate", "month").alias("month"), F.date_format("o_orderdate", "yyyy-MM").alias("label"))


@query("", """
with m as (select user_id, event_type, avg(value) as v from events where event_type <> 'purchase' group by 1, 2),
 w as (select user_id, max(case when event_type = 'click' then v end) as c, max(case when event_type = 'view' then v end) as d from m group by 1)
select user_id, round(c, 6) as at_click, case when c is null then 'MISSING' when c < 32 then 'MODERATE' when c < 38 then 'STRONG'
 when c < 46 then 'VERY_STRONG' else 'EXTREME' end as class from w""")
def measurements_by_key(view):
    """Measurements gathered into a map, read at one key and classed."""
    m = view("events").where("event_type <> 'purchase'").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    gathered = m.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("readings"))
    at = F.try_element_at("readings", F.lit("click"))
    band = F.when(at.isNull(), "MISSING").when(at < 32, "MODERATE").when(at < 38, "STRONG").when(at < 46, "VERY_STRONG").otherwise("EXTREME")
    return gathered.select("user_id", F.round(at, 6).alias("at_click"), band.alias("class"))
