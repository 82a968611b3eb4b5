"""Readers of the forms in which place-based data is published. Schemas are given, never guessed; a wrong header fails."""

from __future__ import annotations

import io
import re
import struct
import unicodedata
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.functions.text import strip_tags
from terrafold.runtime import ship
from terrafold.sources.sinks import fingerprint as content_fingerprint

POINT = "id string, name string, lat double, lon double"


def expect_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Fails unless the header is exactly this, in order."""
    if df.columns != names:
        raise ValueError(f"columns {df.columns} are not {names}")
    return df


def read_table(spark: SparkSession, path: str, schema: str, delimiter: str = ";", encoding: str = "UTF-8") -> DataFrame:
    """A delimited table with a fixed header; a malformed row fails the read."""
    df = spark.read.csv(path, sep=delimiter, encoding=encoding, header=True, schema=schema, enforceSchema=False, mode="FAILFAST")
    return expect_columns(df, [f.name for f in T._parse_datatype_string(schema).fields])


def sniff(content: bytes) -> dict[str, str]:
    """Encoding and delimiter from the first 64 KiB: UTF-8 where it decodes, else Windows-1252; the commonest candidate of the first line."""
    head = content[: 1 << 16]
    encoding = "UTF-8"
    try:
        text = head.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        whole = e.start >= len(head) - 3  # a character cut at the end
        encoding, text = ("UTF-8", head[: e.start].decode("utf-8-sig")) if whole else ("windows-1252", head.decode("cp1252", "replace"))
    line = text.splitlines()[0] if text else ""
    return {"encoding": encoding, "delimiter": max(";,\t|", key=line.count), "header": line}


def sniff_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, encoding, delimiter, header) of each file, read on the executors."""
    ship(spark)
    heads = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, 1 << 16).alias("head"))

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            found = [sniff(bytes(h)) for h in pdf["head"]]
            yield pdf[["path"]].assign(**{k: [f[k] for f in found] for k in ("encoding", "delimiter", "header")})

    return heads.mapInPandas(run, "path string, encoding string, delimiter string, header string")


def read_geojson_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of a feature collection; features without finite coordinates go."""
    schema = "features array<struct<id: string, geometry: struct<type: string, coordinates: array<double>>, properties: map<string, string>>>"
    each = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    place = F.col("f.geometry.coordinates")
    out = each.select(F.coalesce("f.id", F.try_element_at("f.properties", F.lit("id"))).alias("id"), F.try_element_at("f.properties", F.lit("name")).alias("name"), F.try_element_at(place, F.lit(2)).alias("lat"), F.try_element_at(place, F.lit(1)).alias("lon"))
    return out.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")


def read_geojson_rings(spark: SparkSession, path: str) -> DataFrame:
    """(area_id, part, ring_no, ring) of polygons and multipolygons."""
    schema = "features array<struct<id: string, geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>"
    each = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    multi = "array<array<array<array<double>>>>"
    text = F.when(F.col("f.geometry.type") == "Polygon", F.concat(F.lit("["), F.col("f.geometry.coordinates"), F.lit("]"))).otherwise(F.col("f.geometry.coordinates"))
    parts = each.select(F.coalesce("f.id", F.try_element_at("f.properties", F.lit("id"))).alias("area_id"), F.posexplode(F.from_json(text, multi)).alias("part", "rings"))
    rings = parts.select("area_id", "part", F.posexplode("rings").alias("ring_no", "r"))
    return rings.select("area_id", "part", "ring_no", F.transform("r", lambda v: F.struct(v[0].alias("lon"), v[1].alias("lat"))).alias("ring"))


def read_json_graph(spark: SparkSession, path: str) -> DataFrame:
    """Points of a JSON-LD graph; coordinates stand in a location or beside the name."""
    schema = "`@graph` array<struct<`@id`: string, title: string, latitude: string, longitude: string, location: struct<latitude: string, longitude: string>>>"
    each = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("@graph").alias("g"))
    number = lambda c: F.coalesce(F.col(f"g.location.{c}"), F.col(f"g.{c}")).try_cast("double")
    return each.select(F.col("g.`@id`").alias("id"), strip_tags(F.col("g.title")).alias("name"), number("latitude").alias("lat"), number("longitude").alias("lon")).where("lat is not null and lon is not null")


def read_osm(spark: SparkSession, path: str) -> DataFrame:
    """Elements with tags; ways stand at their centre."""
    schema = "elements array<struct<id: long, type: string, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string, string>>>"
    each = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("elements").alias("e"))
    return each.select(F.col("e.id").cast("string").alias("id"), F.try_element_at("e.tags", F.lit("name")).alias("name"), F.coalesce("e.lat", "e.center.lat").alias("lat"), F.coalesce("e.lon", "e.center.lon").alias("lon"), "e.tags").where("lat is not null and lon is not null")


def read_xml_points(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """One point for each row element; repeats of a name at a place once."""
    rows = spark.read.format("xml").option("rowTag", row_tag).schema("name string, latitude double, longitude double").load(path)
    return rows.select("name", F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).where("lat is not null and lon is not null").withColumns({"lat6": F.round("lat", 6), "lon6": F.round("lon", 6)}).dropDuplicates(["name", "lat6", "lon6"]).drop("lat6", "lon6")


def _sheets(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        for sheet in sorted(n for n in names if n.startswith("xl/worksheets/sheet")):
            for i, row in enumerate(ElementTree.fromstring(z.read(sheet)).iterfind(".//m:row", ns)):
                values = []
                for c in row.iterfind("m:c", ns):
                    v = c.findtext("m:v", namespaces=ns)
                    at = _column(c.get("r"), len(values))
                    values += [""] * (at - len(values))  # blank cells are left out of the file
                    values.append(shared[int(v)] if c.get("t") == "s" and v is not None else v or "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")))
                yield sheet.rpartition("/")[2], i, values


def _column(reference: str | None, following: int) -> int:
    """The place of a cell in its row: C5 is 2; a cell without a reference follows the last."""
    place = 0
    for letter in (reference or "").rstrip("0123456789"):
        place = 26 * place + ord(letter) - ord("A") + 1
    return place - 1 if place else following


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, cells) of every sheet, a workbook to a row of the scan."""
    ship(spark)
    schema = "path string, sheet string, row int, cells array<string>"

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame([(p, *r) for r in _sheets(bytes(content))], columns=["path", "sheet", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def _records(dbf: bytes, shp: bytes) -> Iterator[tuple[float | None, float | None, dict[str, str]]]:
    n, head, width = struct.unpack("<IHH", dbf[4:12])
    fields, at = [], 32
    while dbf[at] != 0x0D:
        fields.append((dbf[at : at + 11].split(b"\0")[0].decode("latin-1"), dbf[at + 16]))
        at += 32
    points, at = [], 100
    while at < len(shp):
        size = struct.unpack(">i", shp[at + 4 : at + 8])[0] * 2
        kind = struct.unpack("<i", shp[at + 8 : at + 12])[0]
        points.append(struct.unpack("<dd", shp[at + 12 : at + 28]) if kind else (None, None))  # 0 is a record without a shape
        at += 8 + size
    if len(points) != n:
        raise ValueError(f"{n} records but {len(points)} points")
    for i, (x, y) in enumerate(points):
        row, start = {}, head + i * width + 1
        if dbf[start - 1 : start] == b"*":  # deleted
            continue
        for name, size in fields:
            row[name] = dbf[start : start + size].decode("latin-1").strip()
            start += size
        yield x, y, row


def read_shapefile_points(spark: SparkSession, folder: str) -> DataFrame:
    """(x, y, attributes) of point shapefiles: each .dbf with its .shp, whose counts must agree. Deleted records go; one without a shape has no place."""
    ship(spark)
    files = spark.read.format("binaryFile").load(folder).where(F.lower("path").rlike(r"\.(dbf|shp)$"))
    pairs = files.groupBy(F.regexp_replace("path", r"\.[A-Za-z]+$", "").alias("name")).agg(F.max(F.when(F.lower("path").endswith(".dbf"), F.col("content"))).alias("dbf"), F.max(F.when(F.lower("path").endswith(".shp"), F.col("content"))).alias("shp"))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for dbf, shp in zip(pdf["dbf"], pdf["shp"], strict=True):
                yield pd.DataFrame(list(_records(bytes(dbf), bytes(shp))), columns=["x", "y", "attributes"])

    return pairs.mapInPandas(run, "x double, y double, attributes map<string, string>")


def tiered(layers: list[str], tiers: list[tuple[str, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(points of the best tier that has any, layer status): tiers from best to worst; a layer without points is unavailable. Tiers have a column layer."""
    spark = tiers[0][1].sparkSession
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumns({"tier": F.lit(name), "priority": F.lit(i)}) for i, (name, df) in enumerate(tiers)])
    best = every.groupBy("layer").agg(F.min("priority").alias("priority"), F.min_by("tier", "priority").alias("status"))
    points = every.join(best.select("layer", "priority"), ["layer", "priority"], "left_semi").drop("priority")
    status = spark.createDataFrame([(x,) for x in layers], "layer string").join(best.select("layer", "status"), "layer", "left").select("layer", F.coalesce("status", F.lit("unavailable")).alias("status"))
    return points, status


def series_by_code(observations: DataFrame, codes: dict[str, str], operation: str) -> DataFrame:
    """(code, name, period, value) of the statistics series with the given codes; series are never picked by name.

    observations: code, operation, period, value. The job fails on a code of another
    operation, on a code that is not there and on a period that stands twice.
    """
    spark = observations.sparkSession
    wanted = spark.createDataFrame(sorted(codes.items()), "code string, name string")
    found = wanted.join(observations, "code", "left")
    twice = F.count("*").over(Window.partitionBy("code", "period")) > 1
    wrong = F.when(F.col("period").isNull(), "no observations").when(F.col("operation") != operation, "another operation").when(twice, "a period twice")
    # a filter holds for the row, whichever of its columns are read later
    failed = F.raise_error(F.concat("code", F.lit(": "), "wrong")).cast("boolean")
    checked = found.withColumn("wrong", wrong).where(F.when(F.col("wrong").isNull(), True).otherwise(failed))
    return checked.select("code", "name", "period", "value")


def header_key(name: str | None) -> str:
    """A column's name without accents, case and marks: words joined by one underscore."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", name or "") if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+", "_", plain.casefold()).strip("_")


def with_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """One column for each name: the first of its published names, in the order given, that holds more than blanks; null where none does.

    Published names meet by ``header_key``, so accents, case and marks of an edition do not
    matter. A file that has none of a column's names fails before a row is read.
    """
    there: dict[str, list[str]] = {}
    for c in df.columns:
        there.setdefault(header_key(c), []).append(c)
    out = []
    for name, published in aliases.items():
        own = [c for a in published for c in there.get(header_key(a), ())]
        if not own:
            raise ValueError(f"no column is called {' or '.join(published)}; there are {', '.join(df.columns)}")
        out.append(F.coalesce(*(F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in dict.fromkeys(own))).alias(name))
    return df.select(*out)


def read_committed(spark: SparkSession, path: str, schema: str, form: str = "parquet", rows: int | None = None, fingerprint: str | None = None, **options: str) -> DataFrame:
    """A committed artifact (parquet, json, csv) of a fixed schema, checked against the number of rows and the fingerprint that its manifest declares.

    A column that is not there, a malformed line, another count or another fingerprint fails
    before anything is read from it; both checks are one pass over the table.
    """
    fields = T._parse_datatype_string(schema)
    if form == "parquet":
        found = spark.read.parquet(path)
        lost = [f.name for f in fields if f.name not in found.columns or found.schema[f.name].dataType != f.dataType]
        if lost:
            raise ValueError(f"{path} has no {', '.join(lost)} of the declared type")
        df = found.select(*fields.fieldNames())
    else:
        df = spark.read.format(form).schema(schema).options(mode="FAILFAST", **options).load(path)
    if rows is not None or fingerprint is not None:
        own = content_fingerprint(df).first()
        if (rows is not None and own["n"] != rows) or (fingerprint is not None and own["fingerprint"] != fingerprint):
            raise ValueError(f"{path} has {own['n']} rows of fingerprint {own['fingerprint']}, declared are {rows} of {fingerprint}")
    return df


def pinned_edition(df: DataFrame, columns: list[str]) -> DataFrame:
    """The landed sheet of an edition, if its header is exactly the pinned one, in order; else an error before any row is read."""
    if df.columns != columns:
        raise ValueError(f"the edition has columns {df.columns}, not {columns}")
    return df
