"""Services that filter, versions that guardrails refuse, total orders, aliases: what lands and what is published."""

from __future__ import annotations

import functools
import glob
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from terrafold.operators import guardrails
from terrafold.runtime import ship
from terrafold.sources import readers, sinks
from terrafold.sources.paged import PagedSource, within_bounds

RECORDS = [{"id": i, "kind": "abc"[i % 3], "lat": 40 + i / 100, "lon": -4 + i / 50, "note": "x" * 50} for i in range(95)]


@pytest.fixture
def service():
    """Ten records a page, filtered by envelope, kind and least id, with only the columns asked for; ``asked`` lists the queries."""
    asked, faults = [], {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            asked.append(q)
            west, south, east, north = map(float, q["box"].split(","))
            kinds = q["kind__in"].split(",") if "kind__in" in q else [q["kind"]] if "kind" in q else list("abc")
            found = [r for r in RECORDS if west <= r["lon"] <= east and south <= r["lat"] <= north and r["kind"] in kinds and r["id"] >= int(q.get("id__gte", 0))]
            page = int(q["page"])
            sent = [{c: r[c] for c in q["cols"].split(",")} for r in found[10 * page : 10 * page + 10]]
            body = json.dumps({"total": len(found), "records": sent[: faults.get(page)]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/?page={{page}}&box={{envelope}}&cols={{columns}}&{{where}}", asked, faults
    server.shutdown()


@pytest.fixture
def paged(spark, service):
    ship(spark)
    spark.dataSource.register(PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield lambda columns: spark.read.format("paged").options(url=service[0], total="total", columns=columns, pagesPerPartition=2).load()
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_only_the_asked_pages_and_columns_travel(paged, service):
    df = paged("id int,kind,lat double,lon double")
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["int", "string", "double", "double"]
    service[1].clear()
    got = df.where("lat >= 40.2 and lat < 40.5 and lon <= -3.1 and kind in ('a', 'b')").collect()
    want = [r for r in RECORDS if 40.2 <= r["lat"] < 40.5 and r["lon"] <= -3.1 and r["kind"] in "ab"]
    assert sorted(r.id for r in got) == [r["id"] for r in want] and len(want) > 10
    assert {q["box"] for q in service[1]} == {"-180,40.2,-3.1,40.5"} and {q["kind__in"] for q in service[1]} == {"a,b"}
    assert {q["cols"] for q in service[1]} == {"id,kind,lat,lon"}
    assert {int(q["page"]) for q in service[1]} == set(range(-(-len(want) // 10)))
    service[1].clear()
    assert df.where("kind = 'c' and id >= 60").count() == sum(r["kind"] == "c" and r["id"] >= 60 for r in RECORDS)
    assert {q["kind"] for q in service[1]} == {"c"} and {q["id__gte"] for q in service[1]} == {"60"}


def test_bounds_from_a_join_key(spark, paged, service):
    keys = spark.createDataFrame([(40.31, -3.4), (40.35, -3.3), (None, None)], "y double, x double")
    df = paged("id int,lat double,lon double")
    service[1].clear()
    got = within_bounds(df, keys, {"lat": "y", "lon": "x"}, margin=0.005).collect()
    assert sorted(r.id for r in got) == [r["id"] for r in RECORDS if 40.305 <= r["lat"] <= 40.355 and -3.405 <= r["lon"] <= -3.295]
    assert {q["box"] for q in service[1]} == {"-3.405,40.305,-3.295,40.355"}
    assert within_bounds(df, keys.where("y is null"), {"lat": "y"}).isEmpty()


def test_a_short_page_fails(paged, service):
    service[2][3] = 4
    with pytest.raises(PySparkException, match="page 3 has 4 of 10"):
        paged("id int,lat double,lon double").collect()


def guards():
    return {"poi": [guardrails.least_rows(5), *guardrails.least_of_each("mode", {"metro": 2, "bus": 2}), guardrails.most_share("unclassified", F.col("kind").isNull(), 0.25), guardrails.none_where("unnamed", F.col("name").isNull(), blocks=False)]}


def layer(spark, rows):
    return spark.createDataFrame(rows, "mode string, kind string, name string")


def test_a_broken_ratio_leaves_the_old_version(spark, tmp_path):
    good = [("metro", "a", "n")] * 4 + [("bus", "b", None)] * 3 + [("bus", None, "n")]
    version, report = sinks.publish_guarded({"poi": layer(spark, good).repartition(3)}, str(tmp_path), guards())
    assert {r["guard"]: (r["value"], r["state"]) for r in report} == {"rows": (8.0, "PASS"), "mode=bus": (4.0, "PASS"), "mode=metro": (4.0, "PASS"), "unclassified": (0.125, "PASS"), "unnamed": (3.0, "WARN")}
    broken = [[("metro", None, "n")] * 4 + good, [("bus", "b", "n")] * 50, good[:4], []]
    for rows, guard in zip(broken, ["unclassified", "mode=metro", "rows", "rows"], strict=True):
        with pytest.raises(sinks.Refused, match=guard) as e:
            sinks.publish_guarded({"poi": layer(spark, rows)}, str(tmp_path), guards())
        assert any(r["state"] == "FAIL" and r["guard"] == guard for r in e.value.report)
        assert sinks.published(spark, str(tmp_path), "poi").count() == 8
        assert [p.name for p in tmp_path.glob("version=*")] == [f"version={version}"]
    rows = {r.guard: (r.value, r.state) for r in guardrails.report(layer(spark, good), guards()["poi"]).collect()}
    assert rows == {r["guard"]: (r["value"], r["state"]) for r in report}
    assert guardrails.report(layer(spark, []), [guardrails.declared_rows(0)]).first().state == "PASS"


def test_files_in_total_order_are_the_same_bytes(spark, tmp_path):
    names = ["zeta", "Zeta", "Ávila", "avila", "Avila", "ñu", "nu", "oz", "", None, "éa", "eb"]
    df = spark.range(3000).select((F.col("id") % 700).alias("k"), F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 12 + 1).cast("int")).alias("name"))
    texts = set()
    for parts in (1, 7, 64):
        path = sinks.write_ordered(df.repartition(parts), str(tmp_path / "o"), [sinks.in_collation("name"), F.col("k")], parts)
        files = sorted(glob.glob(f"{path}/part-*"))
        assert len(files) >= min(parts, 6)
        texts.add("".join(open(f, encoding="utf-8").read() for f in files))
    assert len(texts) == 1
    order = list(dict.fromkeys(json.loads(x)["name"] for x in texts.pop().splitlines()))
    # as people sort: accents and case come after the letters
    assert order == [None, "", "avila", "Avila", "Ávila", "éa", "eb", "nu", "ñu", "oz", "zeta", "Zeta"]


def test_rows_are_numbered_without_one_task(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), "id").repartition(9)
    got = {r.k: r.position for r in sinks.numbered(df, ["k"]).collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))}
    assert sinks.numbered(df.where("id < 0"), ["k"]).columns == ["k", "id", "position"]


def test_exports_come_in_one_rename(spark, tmp_path):
    df = spark.createDataFrame([(1, 40.0, -3.0)], "id int, lat double, lon double")
    with pytest.raises(PySparkException):
        sinks.export_points(df.withColumn("bad", F.raise_error(F.lit("stop")).cast("string")), str(tmp_path))
    assert not list(tmp_path.glob("version=*"))
    table, shapes = sinks.export_points(df, str(tmp_path))
    assert table.rpartition("/")[0] == shapes.rpartition("/")[0] and not list(tmp_path.glob("_writing-*/table/part*"))[1:]


def test_a_series_guard_stands_on_every_column(spark):
    rows = [("D4", "ETOT", "2024-01", 1.0), ("D4", "ETOT", "2024-01", 2.0)]
    df = spark.createDataFrame(rows, "code string, operation string, period string, value double")
    for read in (lambda d: d.select("code", "period").collect(), lambda d: d.count(), lambda d: d.collect()):
        with pytest.raises(PySparkException, match="a period twice"):
            read(readers.series_by_code(df, {"D4": "nights"}, "ETOT"))


def test_columns_by_their_published_names(spark):
    assert [readers.header_key(x) for x in ["  Código Distrito (nº) ", "BICICLETAS/PEATONES", None, "__a--b", "Straße"]] == ["codigo_distrito_no", "bicicletas_peatones", "", "a_b", "strasse"]
    df = spark.createDataFrame([("1", " ", "9"), (" 2 ", "8", None), (None, "", "7")], ["Número", "Peatones", "Bicicletas/Peatones"])
    aliases = {"n": ["numero"], "walkers": ["PEATONES", "bicicletas peatones"]}
    assert [tuple(r) for r in readers.with_aliases(df, aliases).collect()] == [("1", "9"), ("2", "8"), (None, "7")]
    with pytest.raises(ValueError, match="latitud"):
        readers.with_aliases(df, {"lat": ["latitude", "latitud"]})
