"""The registry's questions over a table of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.operators.answers import Answers
from terrafold.operators.evidence import SOURCES
from terrafold.plans.registry import query

_REGISTER = ", ".join("(" + ", ".join("cast(null as varchar)" if v is None else f"'{v}'" for v in s) + ")" for s in SOURCES)
_DISTANCE = "2*6371000e0*asin(sqrt(power(sin(radians(l.lat-w.lat)/2),2)+cos(radians(w.lat))*cos(radians(l.lat))*power(sin(radians(l.lon-w.lon)/2),2)))"
_ANGLE = "acos(greatest(-1e0, least(1e0, sin(radians(lat))*sin(radians({y}))+cos(radians(lat))*cos(radians({y}))*cos(radians({x}-lon)))))"
_EAST = "c{i}/sin(c{i})*6371008.8e0*cos(radians({y}))*sin(radians({x}-lon))"
_NORTH = "c{i}/sin(c{i})*6371008.8e0*(cos(radians(lat))*sin(radians({y}))-sin(radians(lat))*cos(radians({y}))*cos(radians({x}-lon)))"


@query("poi licences area_edges editions population monthly questions", f"""
, register(source_id, scope, unit, reference_date, source_state, ceiling) as (values {_REGISTER}),
q as (select *, shape <> 'RANK_AREAS' and coalesce(flag in ('predictive', 'ranking'), false) as barred from questions),
h as (select * from q where not barred and shape <> 'RANK_AREAS'),
e as (select min(grant_date) as low, max(grant_date) as high from licences),
w0 as (
 select h.*, low, high, coalesce(first, case when first is null or last is null then
   cast(make_date(year(high)-1, month(high), least(day(high), 28)) + to_days(cast(1 + day(high) - least(day(high), 28) as int)) as date) end) as f,
  coalesce(last, high) as t from h, e where shape = 'LICENCES_IN_LENS'),
w as (select * replace (least(f, t) as f, greatest(f, t) as t) from w0),
n as (
 select w.id, count(*) filter (l.family = 'ACTIVITY') as na, count(*) filter (l.family = 'BUILDING') as nb, count(*) filter (l.family = 'TEMPORARY') as nt
 from w left join licences l on l.grant_date between greatest(f, low) and least(t, high) and {_DISTANCE} <= w.radius_m group by w.id),
lens as (
 select w.id, case when t < low or f > high then null when family is null then '{{{{"ACTIVITY":' || na || ',"BUILDING":' || nb || ',"TEMPORARY":' || nt || '}}}}'
   else '{{{{"BUILDING":' || nb || '}}}}' end as value,
  '{{{{"first":"' || greatest(f, low) || '","last":"' || least(t, high) || '","clamped":' || (f < low or t > high) || '}}}}' as applied,
  case when t < low or f > high then 'OUTSIDE_COVERAGE' end as reason from w join n on n.id = w.id),
par as (
 select h.id, x.area_id, any_value(x.district_id) as district_id, sum(case when ((y0>lat)<>(y1>lat)) and lon < (x1-x0)*(lat-y0)/(y1-y0)+x0 then 1 else 0 end) % 2 as inside
 from h cross join area_edges x where shape in ('AREA_AT_POINT', 'AREA_PROFILE', 'AREAS_IN_LENS') group by 1, 2),
held as (select id, min(area_id) as area_id from par where inside = 1 group by id),
c as (
 select h.id, area_id, lat, lon, radius_m, x0, y0, x1, y1, {_ANGLE.format(x="x0", y="y0")} as c0, {_ANGLE.format(x="x1", y="y1")} as c1
 from h cross join area_edges where shape = 'AREAS_IN_LENS'),
m as (
 select id, area_id, radius_m, {_EAST.format(i=0, x="x0", y="y0")} as ax, {_NORTH.format(i=0, x="x0", y="y0")} as ay,
  {_EAST.format(i=1, x="x1", y="y1")} as bx, {_NORTH.format(i=1, x="x1", y="y1")} as b_y from c),
d as (select *, greatest(0e0, least(1e0, -(ax*(bx-ax)+ay*(b_y-ay))/((bx-ax)*(bx-ax)+(b_y-ay)*(b_y-ay)))) as t from m),
near as (
 select d.id, d.area_id from d group by d.id, d.area_id, radius_m having min(sqrt(power(ax+t*(bx-ax),2)+power(ay+t*(b_y-ay),2))) <= radius_m
 union select id, area_id from par where inside = 1),
met as (select id, '[' || string_agg(area_id, ',' order by area_id) || ']' as value from near group by id),
p as (select * from editions where edition = 'previous'), r as (select * from editions where edition = 'current'),
diff as (
 select '{{{{"NEW":' || count(*) filter (p.code is null) || ',"ABSENT":' || count(*) filter (r.code is null)
  || ',"STATE_TRANSITION":' || count(*) filter (p.phase <> r.phase) || ',"QUANTITY_CHANGE":' || count(*) filter (p.phase = r.phase and p.quantity <> r.quantity)
  || ',"NO_CHANGE":' || count(*) filter (p.phase = r.phase and p.quantity = r.quantity) || ',"NON_COMPARABLE":0}}}}' as value
 from p full join r on r.code = p.code),
late as (select * from monthly where period = (select max(period) from monthly)),
demand as (
 select '{{{{"period":"' || a.period || '"' || coalesce(',"travellers":' || a.travellers, '') || ',"change_state":"' || case when a.travellers is null then 'CURRENT_MISSING'
  when b.period is null then 'NO_PRIOR_MONTH' when b.travellers is null then 'PRIOR_MISSING' when b.travellers = 0 then 'PRIOR_ZERO' else 'AVAILABLE' end || '"}}}}' as value
 from late a left join monthly b on b.period = cast(a.period - interval '1' year as date)),
v as (
 select id, 'LICENCES_IN_LENS' as shape, 'licences' as source_id, 'COUNT' as derivation, value, applied, reason from lens
 union all select h.id, h.shape, 'areas', 'MEMBERSHIP', cast(held.area_id as varchar), null, null from h left join held on held.id = h.id where shape = 'AREA_AT_POINT'
 union all select h.id, h.shape, 'areas', 'MEMBERSHIP', met.value, null, null from h left join met on met.id = h.id where shape = 'AREAS_IN_LENS'
 union all select h.id, h.shape, 'editions', 'LOOKUP', case when shape = 'AREA_PHASE' then x.phase else cast(x.quantity as varchar) end, null, null
  from h left join editions x on x.edition = coalesce(h.edition, 'current') and x.code = h.code where shape in ('AREA_PHASE', 'AREA_QUANTITY')
 union all select h.id, h.shape, 'editions', 'EDITION_COMPARISON', diff.value, null, null from h, diff where shape = 'EDITION_DIFF'
 union all select h.id, h.shape, 'population', 'DIFFERENCE', cast(y.residents - x.residents as varchar), null, null
  from h left join population x on x.area_id = h.a left join population y on y.area_id = h.b where shape = 'AREA_COMPARE'
 union all select h.id, h.shape, h.source, 'LOOKUP', nullif(h.source, 'rumour'), null, case when h.source = 'rumour' then 'UNKNOWN_SOURCE' end from h where shape = 'SOURCE_PROVENANCE'
 union all select h.id, h.shape, 'population', 'LOOKUP', '{{{{"area_id":' || x.area_id || ',"district_id":' || x.district_id || ',"residents":' || x.residents || '}}}}', null, null
  from h left join held on held.id = h.id left join population x on x.area_id = held.area_id where shape = 'AREA_PROFILE'
 union all select h.id, h.shape, 'monthly', 'LATEST_PERIOD', demand.value, null, null from h, demand where shape = 'CITY_DEMAND'),
z as (
 select id, shape, source_id, derivation, value, coalesce(applied, '{{{{}}}}') as applied, case when value is null then coalesce(reason, 'NO_RECORD') end as reason, cast(null as varchar) as message from v
 union all select id, shape, null, null, null, null, case when barred then 'PROHIBITED' else 'UNKNOWN_SHAPE' end,
  case when barred then case flag when 'predictive' then 'nothing is forecast' else 'places are not ranked' end end from q where barred or shape = 'RANK_AREAS')
select z.id, case when value is null then 'ABSTENTION' else 'EVIDENCE' end as kind, shape, value, scope, unit, case when value is not null then z.source_id end as source_id,
 reference_date, source_state, ceiling, case when value is not null then derivation end as derivation, case when value is not null then applied end as applied, reason,
 coalesce(message, case reason when 'NO_RECORD' then 'the source has no such record' when 'OUTSIDE_COVERAGE' then 'the register does not cover the window'
  when 'UNKNOWN_SOURCE' then 'no such source is registered' when 'UNKNOWN_SHAPE' then 'the question is not one of the registry''s' end) as message
from z left join register g on g.source_id = z.source_id and value is not null""".replace("{{", "{").replace("}}", "}"))
def answered_questions(view):
    """One evidence row or abstention for each of many questions, of all ten shapes and of one that is not asked."""
    none = F.array().cast("array<string>")
    q = view("questions").withColumn("flags", F.when(F.col("flag").isNull(), none).otherwise(F.array("flag"))).withColumn("families", F.when(F.col("family").isNull(), none).otherwise(F.array("family")))
    return Answers(view, SOURCES).answer(q)
