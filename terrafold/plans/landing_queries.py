"""Given tables written in the forms in which place-based data is published, and read again by the readers of those forms."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.operators import spatial
from terrafold.plans.registry import query
from terrafold.runtime import shared_dir
from terrafold.sources import readers, sinks

#: Ids in each landed document.
PER_DOCUMENT = 5000


def _place(df: DataFrame, name: str) -> str:
    """A new folder that all executors share; it goes when the application ends."""
    path = f"{shared_dir(df.sparkSession)}/terrafold/landed-{name}-{uuid.uuid4().hex}"
    where, files = sinks._hadoop(df.sparkSession, path)
    files.deleteOnExit(where)
    return path


def _landed(df: DataFrame, name: str, record: Column, head: str, tail: str, between: str = ",") -> str:
    """Documents of PER_DOCUMENT records each, a file to a document."""
    parts = df.select(F.floor(F.col("id") / PER_DOCUMENT).alias("document"), record.alias("record"))
    whole = parts.groupBy("document").agg(F.concat(F.lit(head), F.concat_ws(between, F.collect_list("record")), F.lit(tail)).alias("value"))
    path = _place(df, name)
    whole.write.partitionBy("document").text(path)
    return f"{path}/*/*"


def _json(column: Column) -> Column:
    return F.to_json(column)


def _rounded(df: DataFrame, *rest: str) -> DataFrame:
    return df.select(*rest, F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query("poi", "select id, type as kind, round(lat, 9) as lat, round(lon, 9) as lon from poi")
def landed_table(view):
    """A delimited table whose headers are known by several published names."""
    poi = view("poi").select(F.col("id").alias("Número"), F.concat(F.lit(" "), "type").alias("Tipo de CAPA"), F.col("lat").alias("LATITUD"), F.col("lon").alias("Longitud (º)"), F.lit(" ").alias("Longitud"))
    path = _place(poi, "table")
    poi.write.csv(path, sep=";", header=True, encoding="UTF-8")
    header = readers.sniff_files(poi.sparkSession, path).where("header <> ''").agg(F.max("delimiter").alias("delimiter"), F.max("encoding").alias("encoding")).first()
    landed = poi.sparkSession.read.csv(path, sep=header.delimiter, encoding=header.encoding, header=True, schema=", ".join(f"`{c}` string" for c in poi.columns), enforceSchema=False)
    named = readers.with_aliases(landed, {"id": ["numero"], "kind": ["tipo_de_capa", "capa"], "lat": ["latitude", "latitud"], "lon": ["longitud", "longitud o"]})
    return _rounded(named.select(F.col("id").cast("int").alias("id"), "kind", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")), "id", "kind")


@query("poi", "select cast(id as varchar) as id, type as name, round(lat, 9) as lat, round(lon, 9) as lon from poi where id % 50 <> 0")
def landed_features(view):
    """Points of feature collections; features without a place go."""
    poi = view("poi")
    place = F.when(F.col("id") % 50 == 0, F.array().cast("array<double>")).otherwise(F.array("lon", "lat"))
    names = F.struct(F.col("id").cast("string").alias("id"), F.col("type").alias("name"))
    feature = _json(F.struct(F.lit("Feature").alias("type"), names.alias("properties"), F.struct(F.lit("Point").alias("type"), place.alias("coordinates")).alias("geometry")))
    return _rounded(readers.read_geojson_points(poi.sparkSession, _landed(poi, "features", feature, '{"type":"FeatureCollection","features":[', "]}")), "id", "name")


@query("poi", "select 'urn:' || id as id, type || ' ' || id as name, round(lat, 9) as lat, round(lon, 9) as lon from poi where id % 40 <> 0")
def landed_graph(view):
    """Points of linked data; places stand in a location or beside the title, and titles have tags."""
    poi = view("poi")
    lat = F.when(F.col("id") % 40 == 0, "no").otherwise(F.col("lat").cast("string"))
    pair = F.struct(lat.alias("latitude"), F.col("lon").cast("string").alias("longitude"))
    beside = F.col("id") % 3 == 0
    title = F.concat(F.lit("<b>"), "type", F.lit("</b> "), F.col("id").cast("string"))
    place = [F.when(beside, pair["latitude"]).alias("latitude"), F.when(beside, pair["longitude"]).alias("longitude"), F.when(~beside, pair).alias("location")]
    record = F.struct(F.concat(F.lit("urn:"), F.col("id").cast("string")).alias("@id"), title.alias("title"), *place)
    return _rounded(readers.read_json_graph(poi.sparkSession, _landed(poi, "graph", _json(record), '{"@graph":[', "]}")), "id", "name")


@query("poi", "select cast(id as varchar) as id, type as name, id % 4 = 0 as way, round(lat, 9) as lat, round(lon, 9) as lon from poi where id % 60 <> 0")
def landed_elements(view):
    """Elements with tags, ways at their centres; those without a place go."""
    poi = view("poi")
    way, none = F.col("id") % 4 == 0, F.col("id") % 60 == 0
    own = lambda c: F.when(~way & ~none, F.col(c)).alias(c)
    centre = F.when(way & ~none, F.struct("lat", "lon"))
    tags = F.struct(F.col("type").alias("name"), F.when(way, "way").alias("kind"))
    record = F.struct("id", F.when(way, "way").otherwise("node").alias("type"), own("lat"), own("lon"), centre.alias("center"), tags.alias("tags"))
    out = readers.read_osm(poi.sparkSession, _landed(poi, "elements", _json(record), '{"elements":[', "]}"))
    return _rounded(out.withColumn("way", F.try_element_at("tags", F.lit("kind")).eqNullSafe("way")), "id", "name", "way")


@query("poi", "select type || ' & ' || id as name, round(lat, 9) as lat, round(lon, 9) as lon from poi")
def landed_markup(view):
    """Points of markup, each of which stands there twice."""
    poi = view("poi")
    element = lambda tag, c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))
    one = F.concat(F.lit("<p>"), element("name", F.concat("type", F.lit(" &amp; "), F.col("id").cast("string"))), element("latitude", F.col("lat").cast("string")), element("longitude", F.col("lon").cast("string")), F.lit("</p>"))
    return _rounded(readers.read_xml_points(poi.sparkSession, _landed(poi, "markup", F.concat(one, one), "<s>", "</s>", ""), "p"), "name")


@query("shape_edges", """
select cast(area_id as varchar) as area_id, case when ring = 2 then 1 else 0 end as part, case when ring = 1 then 1 else 0 end as ring_no, count(*) as vertices,
 round(abs(sum(x0*y1 - x1*y0)) / 2, 6) as area from shape_edges where kind in (0, 5) group by area_id, ring""")
def landed_shapes(view):
    """Polygons, and multipolygons with holes, as rings again."""
    e = view("shape_edges").where("kind in (0, 5)")
    ordered = F.array_sort(F.collect_list(F.struct("seq", F.array("x0", "y0").alias("v"))))
    points = F.transform(ordered, lambda s: s["v"])
    closed = F.concat(points, F.slice(points, 1, 1))
    ringed = e.groupBy("area_id", "kind", "ring").agg(closed.alias("ring_points"))
    whole = ringed.groupBy("area_id", "kind").agg(F.array_sort(F.collect_list(F.struct("ring", "ring_points"))).alias("r"))
    of = lambda *rings: F.filter("r", lambda x: x["ring"].isin(*rings))
    part = lambda *rings: F.transform(of(*rings), lambda x: x["ring_points"])
    polygon, multi = F.col("kind") == 0, F.array(part(0, 1), part(2))
    geometry = F.when(polygon, F.concat(F.lit('{"type":"Polygon","coordinates":'), _json(part(0)), F.lit("}"))).otherwise(F.concat(F.lit('{"type":"MultiPolygon","coordinates":'), _json(multi), F.lit("}")))
    feature = F.concat(F.lit('{"type":"Feature","properties":{"id":"'), F.col("area_id").cast("string"), F.lit('"},"geometry":'), geometry, F.lit("}"))
    path = _landed(whole.withColumn("id", F.col("area_id")), "shapes", feature, '{"features":[', "]}")
    read = readers.read_geojson_rings(e.sparkSession, path).withColumn("key", F.struct("area_id", "part", "ring_no"))
    edges = spatial.edges_of_rings(read, key="key")
    turn = F.abs(F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0"))) / 2
    return edges.groupBy("key").agg(F.count("*").alias("vertices"), F.round(turn, 6).alias("area")).select("key.*", "vertices", "area")


@query("origins", "select 'N' || origin_code as code, 'nation ' || origin_code as name, cast(month as varchar) as period, cast(tourists as double) as value from origins")
def published_series(view):
    """Statistics series that are picked by their codes."""
    o = view("origins")
    observations = o.select(F.concat(F.lit("N"), F.col("origin_code").cast("string")).alias("code"), F.lit("TRIPS").alias("operation"), F.col("month").cast("string").alias("period"), F.col("tourists").cast("double").alias("value"))
    codes = {f"N{r.origin_code}": f"nation {r.origin_code}" for r in o.select("origin_code").distinct().collect()}  # one for each nation
    if not codes:
        return observations.select("code", F.lit("").alias("name"), "period", "value")
    return readers.series_by_code(observations, codes, "TRIPS")


@query("population", "select area_id, district_id, residents from population")
def committed_population(view):
    """A committed artifact, read only if it has the rows and the fingerprint that were declared."""
    p = view("population")
    path = sinks.write_versioned(p, _place(p, "artifact"))
    declared = sinks.fingerprint(p).first()
    return readers.read_committed(p.sparkSession, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in p.schema), rows=declared["n"], fingerprint=declared["fingerprint"])
