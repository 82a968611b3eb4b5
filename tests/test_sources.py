"""Readers, sinks, the registry and the stream."""

from __future__ import annotations

import datetime as dt
import json
import struct
import zipfile

import pytest

from terrafold.operators.evidence import Registry, clamp_window, intent
from terrafold.plans.fixtures import table
from terrafold.sources import readers, sinks
from terrafold.streaming.counters import hourly_counts

SF = "/root/testdata/sf0.001"


def test_delimited_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code;n\n01;5\n02;\n")
    df = readers.read_table(spark, f"{tmp_path}/a.csv", "code string, n int")
    assert [tuple(r) for r in df.collect()] == [("01", 5), ("02", None)]
    with pytest.raises(ValueError):
        readers.expect_columns(df, ["n", "code"])
    assert readers.sniff("año,b\n".encode("cp1252")) == {"encoding": "windows-1252", "delimiter": ",", "header": "año,b"}
    (tmp_path / "b.csv").write_bytes("x\ty\n".encode())
    assert {r.delimiter for r in readers.sniff_files(spark, str(tmp_path)).collect()} == {";", "\t"}


def test_geojson_and_graph(spark, tmp_path):
    point = {"type": "Feature", "properties": {"id": "p1", "name": "one"}, "geometry": {"type": "Point", "coordinates": [-3.5, 40.5]}}
    (tmp_path / "p.json").write_text(json.dumps({"features": [point, {"properties": {"id": "p2"}, "geometry": {"type": "Point", "coordinates": []}}]}))
    assert [tuple(r) for r in readers.read_geojson_points(spark, f"{tmp_path}/p.json").collect()] == [("p1", "one", 40.5, -3.5)]
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    shapes = [{"properties": {"id": "a"}, "geometry": {"type": "Polygon", "coordinates": [ring, ring]}}, {"properties": {"id": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}]
    (tmp_path / "r.json").write_text(json.dumps({"features": shapes}))
    rows = readers.read_geojson_rings(spark, f"{tmp_path}/r.json").collect()
    assert sorted((r.area_id, r.part, r.ring_no, len(r.ring)) for r in rows) == [("a", 0, 0, 4), ("a", 0, 1, 4), ("b", 0, 0, 4), ("b", 1, 0, 4)]
    graph = {"@graph": [{"@id": "g", "title": "<b>x</b>", "location": {"latitude": "40.1", "longitude": "-3"}}, {"@id": "h", "title": "y", "latitude": "no"}]}
    (tmp_path / "g.json").write_text(json.dumps(graph))
    assert [tuple(r) for r in readers.read_json_graph(spark, f"{tmp_path}/g.json").collect()] == [("g", "x", 40.1, -3.0)]
    osm = {"elements": [{"id": 1, "type": "way", "center": {"lat": 1.0, "lon": 2.0}, "tags": {"name": "w"}}, {"id": 2, "type": "node"}]}
    (tmp_path / "o.json").write_text(json.dumps(osm))
    assert [(r.id, r.name, r.lat) for r in readers.read_osm(spark, f"{tmp_path}/o.json").collect()] == [("1", "w", 1.0)]
    (tmp_path / "x.xml").write_text("<s><p><name>a</name><latitude>1.0</latitude><longitude>2.0</longitude></p><p><name>a</name><latitude>1.0</latitude><longitude>2.0</longitude></p></s>")
    assert readers.read_xml_points(spark, f"{tmp_path}/x.xml", "p").count() == 1


def test_workbooks_and_shapefiles(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>code</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c><v>7</v></c></row></sheetData></worksheet>')
    assert [(r.sheet, r.row, r.cells) for r in readers.read_workbooks(spark, f"{tmp_path}/a.xlsx").collect()] == [("sheet1.xml", 0, ["code", "7"])]
    folder = tmp_path / "shp"
    folder.mkdir()
    field = b"NAME\0\0\0\0\0\0\0C" + bytes(4) + bytes([3]) + bytes(15)
    (folder / "p.dbf").write_bytes(struct.pack("<4BIHH20x", 3, 24, 1, 1, 1, 65, 4) + field + b"\r abc")
    (folder / "p.shp").write_bytes(bytes(100) + struct.pack(">ii", 1, 10) + struct.pack("<idd", 1, 1.5, 2.5))
    assert [tuple(r) for r in readers.read_shapefile_points(spark, str(folder)).collect()] == [(1.5, 2.5, {"NAME": "abc"})]


def test_fingerprint_ignores_order(spark):
    a = spark.range(1000).selectExpr("id", "id % 7 as b")
    assert sinks.fingerprint(a).first() == sinks.fingerprint(a.repartition(5)).first() != sinks.fingerprint(a.where("id <> 3")).first()
    assert sinks.canonical_json({"b": 1.0, "a": [2.5, None]}) == '{"a":[2.5,null],"b":1}'


def test_versions_and_bundle(spark, tmp_path):
    one, two = (sinks.write_versioned(spark.range(n), str(tmp_path)) for n in (3, 4))
    assert one != two and spark.read.parquet(two).count() == 4
    r = Registry(spark, lambda name: table(spark, SF, name))
    row = r.query("AREA_AT_POINT", lat=40.4168, lon=-3.7038).first().asDict()
    files = sinks.reading_bundle(row, [{"id": "areas"}], 40.4168, -3.7038, 900)
    assert set(files) == {"reading.json", "sources.json", "geometry.geojson", "state.url", "README.txt"} and json.loads(files["sources.json"]) == [{"id": "areas"}]
    assert sinks.verify(row, r.query("AREA_AT_POINT", lat=40.4168, lon=-3.7038).first().asDict()) == "VERIFIED"
    assert sinks.verify(row, row | {"value": "x"}) == "MISMATCH" and sinks.verify(row, None) == "UNVERIFIABLE"


def test_registry_refuses_before_it_reads(spark):
    r = Registry(spark, lambda name: table(spark, "/nowhere", name))
    assert r.query("CITY_DEMAND", flags=("causal",)).first()["reason"] == "PROHIBITED"
    assert r.query("NO_SUCH").first()["reason"] == "UNKNOWN_SHAPE"
    assert intent("How many licences within the circle?") == "LICENCES_IN_LENS" and intent("tell me a joke") is None


def test_windows():
    day = dt.date
    low, high = day(2000, 1, 1), day(2024, 2, 29)
    assert clamp_window(day(2001, 1, 1), day(1999, 1, 1), low, high).first == low
    assert clamp_window(day(1990, 1, 1), day(1991, 1, 1), low, high) is None
    assert clamp_window(None, None, low, high).first == day(2023, 3, 2)
    assert not clamp_window(None, None, low, high).clamped


def test_stream(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").select("ts", "event_type", "value").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{tmp_path}/in")
    q = hourly_counts(stream).writeStream.outputMode("complete").format("memory").queryName("hours").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from hours").first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()


def test_paged_source(spark, tmp_path):
    from terrafold.runtime import ship
    from terrafold.sources.paged import PagedSource

    ship(spark)
    for i in range(5):
        (tmp_path / f"{i}.json").write_text(json.dumps({"records": [{"id": 2 * i}, {"id": 2 * i + 1, "name": "x"}]}))
    spark.dataSource.register(PagedSource)
    df = spark.read.format("paged").options(url=f"file://{tmp_path}/{{page}}.json", pages=5, columns="id,name", pagesPerPartition=2).load()
    assert sorted((r.id, r.name) for r in df.collect()) == sorted((str(i), "x" if i % 2 else None) for i in range(10)) and df.rdd.getNumPartitions() == 3


def test_shared_state_and_session():
    url = sinks.state_url(40.5, -3.5, 900, "AREA_AT_POINT")
    assert sinks.parse_state(url) == ("EXACT", {"lat": 40.5, "lon": -3.5, "r": 900.0, "shape": "AREA_AT_POINT"}, [])
    assert sinks.parse_state("?lat=40&lon=-3&r=9000&x=1")[0] == "PARTIAL" and sinks.parse_state("?lat=99&lon=0&r=900")[0] == "REFUSED" and sinks.parse_state("?r=900")[0] == "REFUSED"
    text = sinks.session_file([{"n": 1.0}], {"type": "Point"})
    assert sinks.open_session(text)["readings"] == [{"n": 1}]
    with pytest.raises(ValueError):
        sinks.open_session(text.replace('"n":1', '"n":2'))
