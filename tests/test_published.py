"""Sources, exports, linkage, shapes and graphs on small cases made for them."""

from __future__ import annotations

import io
import json
import struct
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from terrafold.functions import geo, text
from terrafold.operators import aggregates, filters, graph, linkage, quality, spatial
from terrafold.sources import readers, sinks


def test_blank_cells_of_a_workbook_keep_their_place(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rows = '<row r="1"><c r="A1"><v>1</v></c><c r="C1"><v>3</v></c><c r="AB1"><v>28</v></c></row><row r="2"><c><v>4</v></c><c><v>5</v></c></row>'
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
    (tmp_path / "a.xlsx").write_bytes(held.getvalue())
    got = [r.cells for r in readers.read_workbooks(spark, str(tmp_path)).orderBy("row").collect()]
    assert got[0][:4] == ["1", "", "3", ""] and len(got[0]) == 28 and got[0][27] == "28" and got[1] == ["4", "5"]


def test_deleted_records_go_and_null_shapes_have_no_place(spark, tmp_path):
    names = [b" one  ", b"*two  ", b" three"]
    head = 32 + 32 + 1
    field = b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([5]) + bytes(15)
    dbf = bytes(4) + struct.pack("<IHH", 3, head, 6) + bytes(20) + field + b"\x0d" + b"".join(names)
    shapes = [struct.pack("<idd", 1, 1.5, 2.5), struct.pack("<idd", 1, 9.0, 9.0), struct.pack("<i", 0)]
    shp = bytes(100) + b"".join(struct.pack(">ii", i + 1, len(s) // 2) + s for i, s in enumerate(shapes))
    (tmp_path / "p.dbf").write_bytes(dbf)
    (tmp_path / "p.shp").write_bytes(shp)
    got = {r.attributes["NAME"]: (r.x, r.y) for r in readers.read_shapefile_points(spark, str(tmp_path)).collect()}
    assert got == {"one": (1.5, 2.5), "three": (None, None)}


def test_fingerprint_tells_missing_from_text(spark):
    schema = "a string, b string"
    prints = [sinks.fingerprint(spark.createDataFrame([row], schema)).first().fingerprint for row in ((None, "x"), ("null", "x"), ('1","b":"2', None), ("1", "2"))]
    assert len(set(prints)) == 4
    twice = spark.createDataFrame([("1", "2"), ("1", "2")], schema)
    assert sinks.fingerprint(twice).first().n == 2 and sinks.fingerprint(twice).first().fingerprint != prints[3]
    assert sinks.fingerprint(twice.limit(0)).first().n == 0


@pytest.mark.parametrize(("code", "kind"), [("UZPp.02.03-RP", "PLANNING_AREA"), ("UZP.3.01", "PLANNING_AREA"), ("AOD.1.1", "PLANNING_AREA"), ("US.4", "PLANNING_AREA"), ("3.1.b", "ZONAL_NORM"), ("4", "ZONAL_NORM"), ("NUP.6", "NON_DEVELOPABLE"), ("APEX", "OTHER")])
def test_record_classes(spark, code, kind):
    assert spark.range(1).select(filters.record_class(F.lit(code)).alias("v")).first().v == kind


def test_ways_of_every_class(spark):
    tags = [{"highway": w} for w in ("primary_link", "secondary_link", "tertiary_link", "road", "raceway", "elevator", "odd")] + [{"highway": "path", "access": "private", "foot": "permissive"}, {"highway": "path", "access": "no"}]
    ways = spark.createDataFrame([(t,) for t in tags], "tags map<string, string>")
    got = [r.v for r in ways.select(filters.way_retention("tags")[1].alias("v")).collect()]
    assert got == ["KEPT"] * 4 + ["BARRED"] * 2 + ["UNKNOWN_CLASS", "KEPT", "PRIVATE"]


#: A concave ring with a hole, and a second part: all edges of one area.
SHAPE = [[(0, 0), (4, 0), (4, 4), (2, 2), (0, 4)], [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)], [(10, 10), (11, 10), (11, 11)]]


def edges_of(rings):
    out = []
    for ring in rings:
        out += [(float(a[0]), float(a[1]), float(b[0]), float(b[1])) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    return [(7, i, *e) for i, e in enumerate(out)]


def ray(x, y, edges):
    return sum(1 for _, _, x0, y0, x1, y1 in edges if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0) % 2 == 1


def test_holes_concave_rings_and_parts(spark):
    edges = edges_of(SHAPE)
    areas = spatial.polygons(spark.createDataFrame(edges, "area_id int, seq int, x0 double, y0 double, x1 double, y1 double"))
    points = [(i, x / 4 + 0.1, y / 4 + 0.05) for i, (x, y) in enumerate((x, y) for x in range(-2, 48) for y in range(-2, 48))]
    df = spark.createDataFrame(points, "id int, lon double, lat double")
    got = {r.id for r in spatial.in_areas(df, areas, size=0.7).collect()}
    assert got == {i for i, x, y in points if ray(x, y, edges)} and 100 < len(got) < 400
    met = spatial.circles_meet_areas(df.where("id % 7 = 0"), areas, 60_000.0, size=0.9)
    inside = {i for i in got if i % 7 == 0}
    assert inside <= {r.id for r in met.collect()}


def test_nearest_without_a_radius(spark):
    left = spark.createDataFrame([(1, 40.0, -3.0), (2, -60.0, 100.0), (3, 40.0005, -3.0)], "key int, lat double, lon double")
    places = [(i, 40.0 + i * i / 300, -3.0 + i / 50) for i in range(30)]
    right = spark.createDataFrame(places, "id int, r_lat double, r_lon double")
    got = {}
    for r in spatial.nearest_anywhere(left, right, 4, 500.0, "key", "id").collect():
        got.setdefault(r.key, []).append((r["rank"], r.id))
    from math import asin, cos, radians, sin, sqrt

    def metres(a, b, c, d):
        a, b, c, d = map(radians, (a, b, c, d))
        return 2 * 6371000 * asin(min(1, sqrt(sin((c - a) / 2) ** 2 + cos(a) * cos(c) * sin((d - b) / 2) ** 2)))

    for key, lat, lon in ((1, 40.0, -3.0), (2, -60.0, 100.0), (3, 40.0005, -3.0)):
        want = sorted((metres(lat, lon, a, b), i) for i, a, b in places)[:4]
        assert sorted(got[key]) == [(n + 1, i) for n, (_, i) in enumerate(want)]
    assert spatial.nearest_anywhere(left, right.limit(2), 4, 500.0, "key", "id").count() == 6


def test_projection_there_and_back(spark):
    df = spark.range(50).selectExpr("40.0 + id / 100 as lat", "-6.0 + id / 10 as lon")
    x, y = geo.utm30n(F.col("lat"), F.col("lon"))
    lat, lon = geo.from_utm30n(F.col("x"), F.col("y"))
    back = df.withColumns({"x": x, "y": y}).select((F.abs(lat - F.col("lat")) + F.abs(lon - F.col("lon"))).alias("off"))
    assert back.agg(F.max("off").alias("m")).first().m < 1e-8


def test_shapes_know_their_area_and_members(spark):
    ring = F.expr("array(named_struct('x0', 0D, 'y0', 0D, 'x1', 1D, 'y1', 0D), named_struct('x0', 1D, 'y0', 0D, 'x1', 1D, 'y1', 1D), named_struct('x0', 1D, 'y0', 1D, 'x1', 0D, 'y1', 0D))")
    circle, polygon = geo.circle_shape(F.lit(0.0), F.lit(0.0), F.lit(1000)), geo.polygon_shape(ring)
    r = spark.range(1).select(geo.shape_area_km2(circle).alias("c"), geo.shape_area_km2(polygon).alias("p"), geo.shape_holds(circle, F.lit(0.0), F.lit(0.008)).alias("near"), geo.shape_holds(polygon, F.lit(0.2), F.lit(0.5)).alias("inside"), geo.shape_holds(polygon, F.lit(0.8), F.lit(0.5)).alias("outside")).first()
    assert abs(r.c - 3.14159265) < 1e-6 and abs(r.p - 6182) < 5 and r.near and r.inside and not r.outside


def test_distances_over_cycles(spark):
    import heapq
    import random

    draw = random.Random(4)
    edges = [(draw.randrange(60), draw.randrange(60), float(draw.randint(1, 9))) for _ in range(120)] + [(i, i + 1, 5.0) for i in range(60, 80)]
    near, seeds = {}, [(0, 0.0, "a"), (7, 1.0, "b")]
    for a, b, m in edges:
        near.setdefault(a, []).append((b, m))
        near.setdefault(b, []).append((a, m))
    best, heap = {}, [(c, label, n) for n, c, label in seeds]
    heapq.heapify(heap)
    while heap:
        d, label, n = heapq.heappop(heap)
        if n not in best:
            best[n] = (d, label)
            for to, m in near.get(n, ()):
                heapq.heappush(heap, (d + m, label, to))
    got = graph.distances(spark.createDataFrame(edges, "a long, b long, length_m double"), spark.createDataFrame(seeds, "node long, cost_m double, label string"))
    assert {r.node: (r.distance_m, r.label) for r in got.collect()} == best


def test_lengths_and_detours(spark):
    edges = spark.createDataFrame([(1, 2, 3.0), (2, 3, 3.0), (8, 9, 2.0)], "a long, b long, length_m double")
    r = graph.lengths(edges).first()
    assert (r.total_m, r.largest_m, r.parts, r.share) == (8.0, 6.0, 2, 0.75)
    d = spark.createDataFrame([(6.0, 4.0), (6.0, 0.5)], "net double, straight double").select(graph.detour_ratio("net", "straight", 1.0).alias("v")).collect()
    assert [x.v for x in d] == [1.5, None]


def test_rows_join_by_position_only_under_their_fingerprint(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "row_index long, k string")
    b = spark.createDataFrame([(1, "y", 5), (0, "x", 4)], "row_index long, k string, v int")
    assert {(r.row_index, r.v, r.state) for r in linkage.by_position(a, b, ["k"]).collect()} == {(0, 4, "JOINED"), (1, 5, "JOINED")}
    other = b.withColumn("k", F.lit("x"))
    assert {(r.v, r.state) for r in linkage.by_position(a, other, ["k"]).collect()} == {(None, "FINGERPRINT_DIFFERS")}


def test_series_are_picked_by_code(spark):
    rows = [("A1", "ETOT", "2024-01", 5.0), ("A1", "ETOT", "2024-02", 6.0), ("B2", "ETOT", "2024-01", 7.0), ("C3", "OTHER", "2024-01", 7.0), ("D4", "ETOT", "2024-01", 1.0), ("D4", "ETOT", "2024-01", 2.0)]
    df = spark.createDataFrame(rows, "code string, operation string, period string, value double")
    assert readers.series_by_code(df, {"A1": "nights", "B2": "guests"}, "ETOT").count() == 3
    for code in ("C3", "D4", "E5"):
        with pytest.raises(PySparkException):
            readers.series_by_code(df, {code: "x"}, "ETOT").collect()


def test_pinned_headers_and_counts(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    assert readers.pinned_edition(df, ["k", "v"]).count() == 3
    with pytest.raises(ValueError):
        readers.pinned_edition(df, ["v", "k"])
    with pytest.raises(ValueError):
        sinks.write_pinned(df, str(tmp_path / "audit"), {"a": 2, "b": 2}, "k")
    assert not (tmp_path / "audit").exists()
    assert spark.read.parquet(sinks.write_pinned(df, str(tmp_path / "audit"), {"a": 2, "b": 1}, "k")).count() == 3
    assert sinks.same_rows(df.orderBy("v"), df) and not sinks.same_rows(df.union(df.limit(1)), df)
    assert sinks.schema_fingerprint(df) != sinks.schema_fingerprint(df.select("v", "k"))


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, 40.0, -3.0), (2, None, None)], "id int, lat double, lon double")
    table, shapes = sinks.export_points(df, str(tmp_path))
    assert spark.read.option("header", True).csv(table).count() == 2
    features = {f["properties"]["id"]: f["geometry"] for f in (json.loads(r.value) for r in spark.read.text(shapes).collect())}
    assert features[1] == {"type": "Point", "coordinates": [-3.0, 40.0]} and features[2] is None


def test_text_keys(spark):
    assert text.header_name("﻿  Código Distrito (nº)") == "codigo_distrito_n"
    a = text.address_signature(F.lit("Calle"), F.lit("de la Luna"), F.lit("12"), F.lit("b"))
    b = text.address_signature(F.lit("CALLE"), F.lit("Luna"), F.lit("12B"), F.lit(None).cast("string"))
    assert spark.range(1).select((a == b).alias("v")).first().v


def test_gates_by_hand(spark):
    parts = spark.createDataFrame([("d1", 3), ("d1", 4), ("d2", 5)], "d string, v int")
    wholes = spark.createDataFrame([("d1", 7), ("d2", 6), ("d3", 0)], "d string, v int")
    assert quality.sums_match(parts, wholes, "s", "d", "v").first().bad == 1
    assert quality.complete(parts, wholes, "s", "d").first().bad == 1
    assert quality.expected_count(parts, "s", "c", 5).first().bad == 2


def test_values_at_places(spark):
    df = spark.createDataFrame([("g", v) for v in (5.0, 1.0, 1.0, 9.0, 3.0)] + [("h", 2.0), ("h", None)], "g string, v double")
    got = {r.g: (r.p30, r.b4) for r in aggregates.values_at(df, "v", {"p30": aggregates.nearest_rank(0.3), "b4": aggregates.class_break(4)}, "g").collect()}
    assert got == {"g": (1.0, 9.0), "h": (2.0, 2.0)}


def test_eras_and_names(spark):
    target = spark.createDataFrame([("NOW", "192", "19", "Valdebernardo"), ("OLD", "192", "19", "Ambroz"), ("NOW", "101", "10", "A"), ("NOW", "102", "10", "a")], "era string, code string, district string, name string")
    source = spark.createDataFrame([(1, "NOW", "192", "19", "VALDEBERNARDO"), (2, "OLD", "192", "19", "Ambroz"), (3, "NOW", "192", "18", "x"), (4, "NOW", None, "19", "Valdebernardo "), (5, "NOW", None, None, None), (6, "NOW", "999", "10", "A")], "id int, era string, code string, district string, name string")
    got = {r.id: (r.method, r.entity) for r in linkage.code_then_name(source, target).collect()}
    assert got == {1: ("CODE", "NOW:192"), 2: ("CODE", "OLD:192"), 3: ("CODE_DISTRICT_MISMATCH", None), 4: ("DISTRICT_PLUS_NAME", "NOW:192"), 5: ("SOURCE_NULL", None), 6: ("UNMATCHED", None)}


def test_tables_are_published_together(spark, tmp_path):
    a = spark.range(3)
    sinks.publish({"one": a, "two": a.where("id = 1")}, str(tmp_path))
    sinks.publish({"one": a.where("id > 0"), "two": a}, str(tmp_path))
    assert sinks.published(spark, str(tmp_path), "one").count() == 2 and sinks.published(spark, str(tmp_path), "two").count() == 3


def test_dossiers_escape_what_they_show():
    page = sinks.dossier_html({"shape": "A<B", "value": "x & y", "source_id": "s"}, [{"id": "s", "name": "<script>"}, {"id": "t", "name": "other"}])
    assert "A&lt;B" in page and "x &amp; y" in page and "&lt;script&gt;" in page and "other" not in page and "<script>" not in page


def test_pages_by_total_with_filters_and_fewer_columns(spark, tmp_path):
    from terrafold.runtime import ship
    from terrafold.sources.paged import FilteringReader, PagedSource
    from pyspark.sql.datasource import EqualTo, GreaterThan

    ship(spark)
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps({"total": 5, "records": [{"id": 2 * i + k, "name": "x"} for k in range(2 if i < 2 else 1)]}))
    spark.dataSource.register(PagedSource)
    options = {"url": f"file://{tmp_path}/{{page}}.json", "total": "total", "columns": "id,name"}
    assert spark.read.format("paged").options(**options).load().count() == 5
    assert spark.read.format("paged").schema("id string").options(**options).load().columns == ["id"]
    reader = FilteringReader({"url": "u?{where}", "pages": 1}, ["id"])
    rest = [GreaterThan(("id",), 3)]
    assert list(reader.pushFilters([EqualTo(("name",), "a b"), *rest])) == rest and reader.equal == {"name": "a b"}
