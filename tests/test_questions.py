"""The catalogue, dossiers, committed artifacts, editions on disk and questions by the table."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from terrafold.operators import linkage, questions
from terrafold.operators.answers import QUESTIONS, Answers
from terrafold.operators.evidence import SOURCES, Registry
from terrafold.plans.fixtures import table
from terrafold.sources import readers, sinks
from terrafold.sources.editions import Editions

SF = "/root/testdata/sf0.001"
HERE = {"lens": {"which": "A", "lat": 40.4168, "lon": -3.7038, "radius_m": 3000.0}, "selection": {"type": "area", "code": 5}, "window": {"first": dt.date(1990, 1, 1), "last": dt.date(1996, 1, 1)}}


@pytest.fixture(scope="module")
def registry(spark):
    return Registry(spark, lambda name: table(spark, SF, name))


def plain(context):
    return json.loads(json.dumps(context, default=str))


def test_every_question_is_asked(registry):
    for q in questions.CATALOGUE:
        out = questions.ask(registry, q, HERE | {"window": {}})
        assert out["status"] == "answered" and out["result"]["shape"] == questions.CATALOGUE[q].shape and out["context_key"] == sinks.context_key(HERE | {"window": {}})
    out = questions.ask(registry, "phase_of_area", HERE | {"selection": None})
    assert out["status"] == "abstained" and out["result"]["reason"] == "MISSING_PARAMETER"
    assert questions.ask(registry, "what_changed", HERE | {"window": {}, "ready": {"editions": "loading"}})["waiting_for"] == "editions"
    assert questions.refuse(registry, "area_here", "causal")["result"]["reason"] == "PROHIBITED"
    with pytest.raises(ValueError):
        questions.refuse(registry, "area_here", "plain")


def test_dossiers_refuse_a_stale_context(registry):
    context = plain(HERE | {"window": {}})
    out = questions.ask(registry, "area_here", context)
    sources = [{"id": s[0], "scope": s[1]} for s in SOURCES]
    made = sinks.dossier(out, sources, context, "2024-05-03T10:00:00Z")
    assert made["schema_version"] == 1 and made["evidence"]["value"] == "12" and made["sources"] == [{"id": "areas", "scope": "administrative areas"}]
    assert sinks.open_dossier(sinks.canonical_json(made)) == json.loads(sinks.canonical_json(made))
    proven = sinks.dossier(out, sources, context, "x", verification={"verdict": "VERIFIED"})
    assert proven["schema_version"] == 2 and sinks.open_dossier(json.dumps(proven))["verification"]
    moved = context | {"lens": context["lens"] | {"radius_m": 900.0}}
    with pytest.raises(sinks.StaleContext):
        sinks.dossier(out, sources, moved, "x")
    assert sinks.context_key(context | {"language": "es"}) == sinks.context_key(context)
    with pytest.raises(ValueError, match="not registered"):
        sinks.dossier(out, sources[:1], context, "x")
    for bad in ({"schema_version": 3}, {"schema_version": 2}, {}):
        with pytest.raises(ValueError):
            sinks.open_dossier(json.dumps(bad))
    nowhere = context | {"lens": context["lens"] | {"lat": 0.0}}
    none = questions.ask(registry, "area_here", nowhere)
    assert sinks.dossier(none, sources, nowhere, "x")["abstention"]["reason"] == "NO_RECORD"
    with pytest.raises(ValueError, match="only an answer"):
        sinks.dossier(none, sources, nowhere, "x", verification={})


def test_the_table_of_questions_agrees_with_the_registry(spark, registry):
    day = dt.date
    rows = [
        (1, "LICENCES_IN_LENS", None, None, 40.4168, -3.7038, 3000.0, day(1990, 1, 1), day(1996, 1, 1), None, None, None, None, None),
        (2, "LICENCES_IN_LENS", [], ["BUILDING"], 40.4168, -3.7038, 3000.0, None, None, None, None, None, None, None),
        (3, "LICENCES_IN_LENS", [], [], 40.4168, -3.7038, 3000.0, day(1980, 1, 1), day(1981, 1, 1), None, None, None, None, None),
        (4, "AREA_AT_POINT", ["noted"], None, 40.4168, -3.7038, None, None, None, None, None, None, None, None),
        (5, "AREAS_IN_LENS", None, None, 40.4168, -3.7038, 4000.0, None, None, None, None, None, None, None),
        (6, "AREA_COMPARE", None, None, None, None, None, None, None, None, None, 1, 2, None),
        (7, "CITY_DEMAND", ["noted", "predictive"], None, None, None, None, None, None, None, None, None, None, None),
        (8, "ELSE", ["causal"], None, None, None, None, None, None, None, None, None, None, None),
        (9, "SOURCE_PROVENANCE", None, None, None, None, None, None, None, None, None, None, None, "rumour"),
    ]
    got = {r.id: r.asDict() for r in Answers(registry.view, SOURCES).answer(spark.createDataFrame(rows, QUESTIONS)).collect()}
    lens = {"lat": 40.4168, "lon": -3.7038}
    want = {
        1: registry.query("LICENCES_IN_LENS", **lens, radius_m=3000.0, first=day(1990, 1, 1), last=day(1996, 1, 1)), 2: registry.query("LICENCES_IN_LENS", **lens, radius_m=3000.0, families=("BUILDING",)),
        3: registry.query("LICENCES_IN_LENS", **lens, radius_m=3000.0, first=day(1980, 1, 1), last=day(1981, 1, 1)), 4: registry.query("AREA_AT_POINT", **lens), 5: registry.query("AREAS_IN_LENS", **lens, radius_m=4000.0),
        6: registry.query("AREA_COMPARE", a=1, b=2), 7: registry.query("CITY_DEMAND", flags=("predictive",)), 8: registry.query("ELSE"), 9: registry.query("SOURCE_PROVENANCE", source="rumour"),
    }
    assert got == {i: {"id": i} | df.first().asDict() for i, df in want.items()}


def test_editions_open_only_their_own_files(spark, tmp_path):
    store = Editions(spark, str(tmp_path))
    for edition in ("previous", "current"):
        for family in ("state", "quantity"):
            store.add(spark.createDataFrame([(c, f"{family} {edition} {c}") for c in "abc"], "code string, value string"), family, edition, f"{family}-{edition}-sha")
    wanted = {"state": "state-previous-sha", "quantity": "quantity-previous-sha"}
    df = store.inputs(wanted, ["a", "b"])
    assert sorted(r.value for r in df.collect()) == ["quantity previous a", "quantity previous b", "state previous a", "state previous b"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(edition" in plan and "previous" in plan
    opened = {r.f for r in df.select(F.input_file_name().alias("f")).distinct().collect()}
    assert opened and all("edition=previous" in f for f in opened)
    mixed = {"state": "state-current-sha", "quantity": "quantity-previous-sha"}
    assert store.inputs(mixed) is None and store.inputs({"state": "state-current-sha"}) is None and store.edition_of(wanted) == "previous"
    with pytest.raises(Exception, match="exist"):
        store.add(df.select("code", "value"), "state", "current", "other")


def test_inputs_are_exact_or_nothing(spark):
    manifest = spark.createDataFrame([("s", "1", "s1"), ("q", "1", "q1"), ("s", "2", "s2"), ("q", "2", "q2"), ("s", "3", "s3")], "family string, edition string, snapshot string")
    records = spark.createDataFrame([("s", "1", 5, "x"), ("q", "1", 5, "7"), ("s", "2", 5, "y"), ("s", "2", 6, "z")], "family string, edition string, code int, value string")
    asks = [(1, 5, {"s": "s1", "q": "q1"}), (2, 5, {"q": "q2", "s": "s2"}), (3, 5, {"s": "s1", "q": "q2"}), (4, 6, {"s": "s1", "q": "q1"}), (5, 9, {"s": "s1", "q": "q1"}), (6, 5, None), (7, 5, {"s": "s3"}), (8, 5, {"s": "s1", "q": "q1", "z": "z1"})]
    got = {r.id: (r.edition, r.state, r.inputs) for r in linkage.resolved_inputs(spark.createDataFrame(asks, "id int, code int, wanted map<string, string>"), manifest, records, ("s", "q"), newest="2").collect()}
    assert got == {
        1: ("1", "RESOLVED", {"s": "x", "q": "7"}), 2: ("2", "RESOLVED", {"s": "y"}), 3: (None, "NO_SUCH_EDITION", None), 4: ("1", "ABSENT_FROM_EDITION", None),
        5: ("1", "UNKNOWN_CODE", None), 6: ("2", "RESOLVED", {"s": "y"}), 7: (None, "NO_SUCH_EDITION", None), 8: (None, "NO_SUCH_EDITION", None),
    }


def test_committed_artifacts_are_what_their_manifest_says(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    df.write.parquet(f"{tmp_path}/p")
    df.write.json(f"{tmp_path}/j")
    own = sinks.fingerprint(df).first()
    for form in ("parquet", "json"):
        read = readers.read_committed(spark, f"{tmp_path}/{form[0]}", "id int, name string", form, rows=2, fingerprint=own.fingerprint)
        assert sorted(map(tuple, read.collect())) == [(1, "a"), (2, None)]
        with pytest.raises(ValueError, match="declared are 3"):
            readers.read_committed(spark, f"{tmp_path}/{form[0]}", "id int, name string", form, rows=3)
    with pytest.raises(ValueError, match="no id, other"):
        readers.read_committed(spark, f"{tmp_path}/p", "id string, other int")


def test_a_universe_of_granted_records_only(spark):
    from pyspark.errors import PySparkException

    from terrafold.operators import filters

    good = spark.createDataFrame([(1, "GRANTED", "2020-01-01")], "id int, status string, day string")
    assert filters.granted_universe(good, "status", "day").count() == 1
    for row, why in (((2, "REFUSED", "2020-01-01"), "status REFUSED"), ((3, None, "2020-01-01"), "status null"), ((4, "GRANTED", None), "no date")):
        bad = good.union(spark.createDataFrame([row], good.schema))
        with pytest.raises(PySparkException, match=why):
            filters.granted_universe(bad, "status", "day").select("id").collect()
