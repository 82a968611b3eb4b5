"""States of readers as links, and what links hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.functions import links
from terrafold.plans.registry import query
from terrafold.runtime import shuffle_partitions

_CIRCLE = "printf('%.5f%%2C%.5f%%2C%d', lat, lon, cast(radius_m as int)"


@query("poi questions", f"""
, q as (
 select *, id%20 in (1, 2) as refused, id%13 = 0 as away, id%15 = 0 as crowded, id%6 = 0 as ringed, id%2 = 0 as area, first > last as turned,
  id%3 = 0 as measured, id%5 <> 0 as second, id%9 = 0 as off from questions),
t as (
 select q.*, case id%20 when 1 then 'v=2&' when 2 then '' else 'v=1&' end || coalesce('s=' || edition || '&', '')
  || 'm=' || case id%4 when 0 then 'PLACE' when 1 then 'COMPARE' when 2 then 'CITY' else 'ATLAS' end || '&a=' || {_CIRCLE})
  || case when second then '&b=' || {_CIRCLE} + case when off then 25 else 0 end) else '' end
  || case when crowded then '&gx=' || case when ringed then 'AB' else 'B' end
      when ringed then '&ga=' || printf('%.6f%%2C%.6f%%3B%.6f%%2C%.6f%%3B%.6f%%2C%.6f', lat, lon, lat + 0.01e0, lon, lat, lon + 0.01e0) else '' end
  || '&be=' || case when second then '1' else '0' end || '&al=' || case when area then 'B' else 'A' end || '&ly=museum.rail' || case when id%8 = 0 then '.tram' else '' end
  || coalesce('&lw=' || cast(first as varchar) || '%2C' || cast(last as varchar), '')
  || case when area then '&sc=AMBITO&aa=' || code else '&sc=LENS' end
  || case when measured then '&fm=stays&fl=' || case when area then '0' else '1' end else '' end || '&rd=citizen&lg=en' as link,
  concat_ws(',', case when id%4 = 3 then 'mode:INVALID_MODE' end, case when away then 'lensA:INVALID_COORDINATES' end,
   case when second and away then 'lensB:INVALID_COORDINATES' when second and off then 'lensB:RADIUS_NOT_ON_STEP' end,
   case when ringed and away and not crowded then 'geometryA:INVALID_GEOMETRY' end, case when crowded then 'geometry:GEOMETRY_NOT_IN_LINK' end,
   case when id%8 = 0 then 'layers:UNKNOWN_LAYER' end, case when turned then 'licenceWindow:INVALID_LICENCE_WINDOW' end,
   case when area and code > 24 then 'ambitoA:UNKNOWN_AMBITO' end, case when area and measured then 'metric:UNKNOWN_METRIC' end) as faults
 from q)
select id, link, case when refused then 'REFUSED' when faults <> '' then 'PARTIAL' else 'EXACT' end as outcome,
 case when refused or edition is null then 'UNKNOWN' when edition = 'current' then 'MATCH' else 'MISMATCH' end as snapshot_status,
 case id%20 when 1 then 'version:VERSION_UNSUPPORTED' when 2 then 'version:VERSION_MISSING'
  else concat_ws(',', nullif(faults, ''), case when edition <> 'current' then 'snapshot:SNAPSHOT_MISMATCH' end) end as issues,
 case when not refused and second and not away and not off then cast(radius_m as double) end as radius_b,
 case when not refused and ringed and not crowded and not away then 3 end as vertices_a,
 case when not refused and not turned then cast(first as varchar) end as first_day
from t""")
def shared_states(view):
    """Links made of many states and read again: what each holds, and what of it cannot be used and why."""
    i = F.col("id")
    place = lambda dy, dx: F.struct((F.col("lat") + dy).alias("lat"), (F.col("lon") + dx).alias("lon"))
    second = i % 5 != 0
    link = links.link(
        snapshot=F.col("edition"), mode=F.element_at(F.array(*map(F.lit, ("PLACE", "COMPARE", "CITY", "ATLAS"))), (i % 4 + 1).cast("int")),
        lens_a=links.lens(F.col("lat"), F.col("lon"), F.col("radius_m")), lens_b=F.when(second, links.lens(F.col("lat"), F.col("lon"), F.col("radius_m") + F.when(i % 9 == 0, 25).otherwise(0))),
        ring_a=F.when(i % 6 == 0, F.array(place(0.0, 0.0), place(0.01, 0.0), place(0.0, 0.01))), ring_b=F.when(i % 15 == 0, F.transform(F.sequence(F.lit(0), F.lit(29)), lambda k: place(k / 1000, 0.0))),
        b_enabled=second, active=F.when(i % 2 == 0, "B").otherwise("A"), layers=F.concat(F.array(F.lit("rail"), F.lit("museum")), F.when(i % 8 == 0, F.array(F.lit("tram"))).otherwise(F.array().cast("array<string>"))),
        window=F.struct("first", "last"), scope=F.when(i % 2 == 0, "AMBITO").otherwise("LENS"), code_a=F.col("code"),
        metric=F.when(i % 3 == 0, F.struct(F.lit("stays").alias("id"), (i % 2 == 1).alias("locked"))),
    )
    told = F.when(i % 20 == 1, F.regexp_replace(link, "^v=1", "v=2")).when(i % 20 == 2, F.regexp_replace(link, "^v=1&", "")).otherwise(link)
    q = view("questions")
    q = q.repartition(shuffle_partitions(q.sparkSession), "id")  # a state takes long and few bytes, so a split of a file holds far too many
    read = links.read_links(q.select("id", told.alias("link")), "link", snapshot="current", known={"code": [str(c) for c in range(25)]})
    issues = F.array_join(F.transform("issues", lambda x: F.concat(x["dimension"], F.lit(":"), x["code"])), ",")
    held = F.col("state.ring_a")
    return read.select("id", "link", "outcome", "snapshot_status", issues.alias("issues"), F.col("state.lens_b.radius_m").alias("radius_b"), F.when(held.isNotNull(), F.size(held)).alias("vertices_a"), F.col("state.window.first").alias("first_day"))
