"""Canonical text, fingerprints and bundles of computed rows."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from html import escape

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from terrafold.functions.text import canonical
from terrafold.operators.guardrails import Guard
from terrafold.runtime import materialise


def fingerprint(df: DataFrame) -> DataFrame:
    """One SHA-256 for a multiset of rows, whatever their order and partitions, with their number.

    Each row's SHA-256 is read as eight 32-bit words; the words are added up place by
    place, which every task does for its own rows, and the sums are hashed.
    """
    rows = df.select(F.sha2(canonical(*df.columns), 256).alias("h"))
    words = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"w{i}") for i in range(8)]
    sums = rows.agg(F.count("*").alias("n"), *words)
    joined = F.concat_ws(",", "n", *(F.coalesce(F.col(f"w{i}"), F.lit(0)).cast("string") for i in range(8)))
    return sums.select(F.sha2(joined, 256).alias("fingerprint"), "n")


def schema_fingerprint(df: DataFrame) -> str:
    """SHA-256 of the column names in order."""
    return hashlib.sha256("\t".join(df.columns).encode()).hexdigest()


def same_rows(rebuilt: DataFrame, committed: DataFrame) -> bool:
    """Whether a derived table, built again, equals the committed one as a multiset of rows."""
    columns = committed.columns
    return sorted(columns) == sorted(rebuilt.columns) and rebuilt.select(*columns).exceptAll(committed).isEmpty() and committed.exceptAll(rebuilt.select(*columns)).isEmpty()


def write_pinned(df: DataFrame, folder: str, pinned: dict[str, int], by: str) -> str:
    """Writes an audit table if its counts by a column are the pinned ones; else an error and nothing is written."""
    found = {r[by]: r["count"] for r in df.groupBy(by).count().collect()}
    if found != pinned:
        raise ValueError(f"counts by {by}: {found}, not {pinned}")
    return write_versioned(df, folder)


def export_points(df: DataFrame, folder: str, lat: str = "lat", lon: str = "lon") -> tuple[str, str]:
    """(CSV, line-by-line GeoJSON features) of a table with a place for each row; one rename brings both into place, or neither is there."""
    rest = [c for c in df.columns if c not in (lat, lon)]
    geometry = F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull(), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))
    features = df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*rest).alias("properties"), geometry.alias("geometry")), {"ignoreNullFields": "false"}).alias("value"))
    root, version = folder.rstrip("/"), uuid.uuid4().hex
    fresh, place = f"{root}/_writing-{version}", f"{root}/version={version}"
    df.write.option("header", True).csv(f"{fresh}/table")
    features.write.text(f"{fresh}/features")
    where, files = _hadoop(df.sparkSession, fresh)
    files.rename(where, _hadoop(df.sparkSession, place)[0])
    return f"{place}/table", f"{place}/features"


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def write_ordered(df: DataFrame, folder: str, keys: list[Column], parts: int | None = None) -> str:
    """Writes rows as lines of canonical JSON in a total order: the files one behind another are the same bytes, whatever the number of parts.

    Rows are dealt by ranges of the keys and sorted within; rows with equal keys stand in the
    order of their text. A key can carry a collation, as ``in_collation`` gives it.
    """
    order = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    lines = df.select(canonical(*df.columns).alias("value"), *order)
    names = [*(f"k{i}" for i in range(len(keys))), "value"]
    path = f"{folder.rstrip('/')}/version={uuid.uuid4().hex}"
    dealt = lines.repartitionByRange(parts, *names) if parts else lines.repartitionByRange(*names)
    dealt.sortWithinPartitions(*names).select("value").write.text(path)
    return path


def in_collation(column: Column | str, collation: str = "UNICODE") -> Column:
    """A text key in the order that people of any language expect, accents and case last."""
    return F.collate(column, collation)


def numbered(df: DataFrame, keys: list[str], name: str = "position") -> DataFrame:
    """Rows with their place from 0 on in the total order of the keys, without a window over all rows.

    Rows are dealt by ranges, sorted and written; a place is the row's own in its part and the
    number of rows in the parts before, which are as few numbers as there are parts.
    """
    sorted_rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = materialise(sorted_rows.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "numbered")
    counts = sorted((r["_part"], r["n"]) for r in at.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before, total = {}, 0
    for part, n in counts:
        before[part], total = total, total + n
    if not before:
        return at.select(*df.columns, F.lit(0).cast("long").alias(name))
    starts = df.sparkSession.createDataFrame(sorted(before.items()), "_part int, _start long")
    return at.join(F.broadcast(starts), "_part").select(*df.columns, (F.col("_start") + F.col("_row")).alias(name))


def canonical_json(value) -> str:
    """Sorted keys, no blanks, whole floats as integers."""
    plain = lambda v: {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else [plain(x) for x in v] if isinstance(v, list) else int(v) if isinstance(v, float) and v.is_integer() else v
    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def write_versioned(df: DataFrame, folder: str, fmt: str = "parquet", *partition_by: str) -> str:
    """Writes a new version beside the others; Spark's commit makes it whole or absent. Gives its path."""
    path = f"{folder.rstrip('/')}/version={uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).format(fmt).save(path)
    return path


def publish(tables: dict[str, DataFrame], folder: str) -> str:
    """Writes several tables as one version: all of them, then a pointer that is renamed into place. Readers see the old set or the new one."""
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{folder.rstrip('/')}/version={version}/{name}")
    _point(next(iter(tables.values())).sparkSession, folder.rstrip("/"), version)
    return version


def _point(spark: SparkSession, root: str, version: str) -> None:
    fresh, files = _hadoop(spark, f"{root}/_pointer-{version}")
    out = files.create(fresh, True)
    out.write(version.encode())
    out.close()
    files.mkdirs(_hadoop(spark, f"{root}/pointers")[0])
    files.rename(fresh, _hadoop(spark, f"{root}/pointers/{time.time_ns():020d}-{version}")[0])


class Refused(ValueError):
    """A version that guardrails kept from being published, with what they measured."""

    def __init__(self, report: list[dict]) -> None:
        super().__init__("; ".join(f"{r['table']} {r['guard']}: {r['value']} is not between {r['least']} and {r['most']}" for r in report if r["state"] == "FAIL"))
        self.report = report


def publish_guarded(tables: dict[str, DataFrame], folder: str, guards: dict[str, list[Guard]]) -> tuple[str, list[dict]]:
    """Publishes as ``publish`` does if every guardrail of every table holds; (version, report).

    What a guardrail measures is observed while its table is written, so no table is read
    twice. Where one that blocks does not hold, ``Refused`` is raised, the version that was
    written is deleted and readers keep the one before. Others only warn.
    """
    spark, root, version = next(iter(tables.values())).sparkSession, folder.rstrip("/"), uuid.uuid4().hex
    report = []
    for name, df in tables.items():
        own = guards.get(name, [])
        seen = Observation(f"{name}-{version}")
        watched = df.observe(seen, *(g.measure.alias(f"g{i}") for i, g in enumerate(own))) if own else df
        watched.write.parquet(f"{root}/version={version}/{name}")
        report += [{"table": name, **g.judged(seen.get[f"g{i}"])} for i, g in enumerate(own)]
    if any(r["state"] == "FAIL" for r in report):
        where, files = _hadoop(spark, f"{root}/version={version}")
        files.delete(where, True)
        raise Refused(report)
    _point(spark, root, version)
    return version, report


def published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the version that was published last."""
    root = folder.rstrip("/")
    path, files = _hadoop(spark, f"{root}/pointers")
    found = files.listStatus(path)
    last = max(f.getPath().getName() for f in found)
    return spark.read.parquet(f"{root}/version={last.rpartition('-')[2]}/{name}")


#: Versions of a dossier's layout: with a verification record it is the second.
DOSSIER_VERSIONS = (1, 2)


class StaleContext(ValueError):
    """An answer that was given for another context than the one in force."""


def context_key(context: dict) -> str:
    """What an answer depends on, as one text: the circle, the selection, the window and which tables were ready. Wording and language are no part of it."""
    plain = lambda v: v if v is None or isinstance(v, (int, float, str)) else str(v)
    of = lambda name, *keys: [plain(context[name].get(k)) for k in keys] if context.get(name) else None
    return canonical_json([of("lens", "which", "lat", "lon", "radius_m"), of("selection", "type", "code"), of("window", "first", "last"), of("ready", "planning", "licences", "editions")])


def dossier(outcome: dict, sources: list[dict], context: dict, generated_at: str, verification: dict | None = None) -> dict:
    """The record of one question: what was asked, in which context, the row that answered it or why none did, and the sources used.

    outcome: as ``questions.ask`` gives it. A context that has changed since is refused, as are
    an answer whose source is not registered, an unfinished outcome, and a verification of no answer.
    """
    if context_key(context) != outcome["context_key"]:
        raise StaleContext(f"the answer is for {outcome['context_key']}, in force is {context_key(context)}")
    if outcome["status"] not in ("answered", "abstained"):
        raise ValueError(f"the outcome is {outcome['status']}")
    answered = outcome["status"] == "answered"
    if verification is not None and not answered:
        raise ValueError("only an answer is verified")
    row = outcome["result"]
    used = [s for s in sources if s["id"] == row.get("source_id")]
    if answered and not used:
        raise ValueError(f"source {row.get('source_id')} is not registered")
    out = {
        "schema_version": DOSSIER_VERSIONS[verification is not None], "generated_at": generated_at,
        "question": {"id": outcome["question"], "shape": outcome["shape"], "params": outcome["params"], "context_key": outcome["context_key"]},
        "context": context, "evidence": row if answered else None, "abstention": None if answered else row, "sources": used,
        "method": {"derivation": row["derivation"], "performed_at_export": False} if answered else None, "limits": [row["ceiling"]] if answered else [],
    }
    return out | ({"verification": verification} if verification is not None else {})


def open_dossier(text: str) -> dict:
    """A dossier from its text; another layout, or a second version without its verification, is refused."""
    out = json.loads(text)
    if out.get("schema_version") not in DOSSIER_VERSIONS or (out["schema_version"] == 2) != ("verification" in out):
        raise ValueError(f"a dossier of version {out.get('schema_version')} cannot be read")
    return out


def dossier_html(evidence: dict, sources: list[dict]) -> str:
    """The evidence and its sources as one page of tables; every text is escaped, nothing is computed again."""
    row = lambda k, v: f"<tr><th>{escape(str(k))}</th><td>{escape('' if v is None else str(v))}</td></tr>"
    table = lambda d: "<table>" + "".join(row(k, v) for k, v in sorted(d.items())) + "</table>"
    used = [s for s in sources if s.get("id") == evidence.get("source_id")]
    body = "<h1>Evidence</h1>" + table(evidence) + "<h2>Sources</h2>" + "".join(map(table, used))
    return f"<!doctype html><html><head><meta charset=\"utf-8\"><title>{escape(str(evidence.get('shape', '')))}</title></head><body>{body}</body></html>"


def reading_bundle(evidence: dict, sources: list[dict], lat: float, lon: float, radius_m: float) -> dict[str, str]:
    """The files of one answered question: a transcript of computed rows, nothing is computed again."""
    reading = canonical_json(evidence)
    geometry = {"type": "Feature", "properties": {"radius_m": radius_m}, "geometry": {"type": "Point", "coordinates": [lon, lat]}}
    used = [s for s in sources if s.get("id") == evidence.get("source_id")]
    files = {"reading.json": reading, "sources.json": canonical_json(used), "geometry.geojson": canonical_json(geometry)}
    state = f"?lat={lat:.6f}&lon={lon:.6f}&r={radius_m:g}&shape={evidence.get('shape')}"
    text = "\n".join(f"{k}: {v}" for k, v in sorted(evidence.items()) if v is not None)
    checks = "\n".join(f"{name} {hashlib.sha256(body.encode()).hexdigest()}" for name, body in sorted(files.items()))
    return files | {"state.url": state, "README.txt": f"{text}\n\n{checks}\n"}


def verify(evidence_then: dict, evidence_now: dict | None) -> str:
    """VERIFIED where a question asked again gives the same answer."""
    if evidence_now is None:
        return "UNVERIFIABLE"
    return "VERIFIED" if canonical_json(evidence_then) == canonical_json(evidence_now) else "MISMATCH"


#: The keys of a shared state, in order, and their limits.
STATE_KEYS = (("lat", -90.0, 90.0), ("lon", -180.0, 180.0), ("r", 100.0, 5000.0))


def state_url(lat: float, lon: float, radius_m: float, shape: str | None = None) -> str:
    """The shared state, always in one order of keys."""
    return "?" + "&".join([f"lat={lat:.6f}", f"lon={lon:.6f}", f"r={radius_m:g}", *([f"shape={shape}"] if shape else [])])


def parse_state(url: str) -> tuple[str, dict, list[str]]:
    """(outcome, state, issues): EXACT, PARTIAL where a value had to be clamped or a key is unknown, REFUSED without a usable place."""
    from urllib.parse import parse_qsl

    given, issues, state = dict(parse_qsl(url.lstrip("?"))), [], {}
    for key, low, high in STATE_KEYS:
        try:
            value = float(given.pop(key))
        except (KeyError, ValueError):
            issues.append(f"{key}: missing")
            continue
        if value != value:
            issues.append(f"{key}: not a number")
            continue
        if not low <= value <= high:
            if key != "r":
                return "REFUSED", {}, [f"{key}: out of range"]
            issues.append(f"{key}: clamped")
        state[key] = min(high, max(low, value))
    if "shape" in given:
        state["shape"] = given.pop("shape")
    issues += [f"{k}: unknown" for k in given]
    if not {"lat", "lon"} <= set(state):
        return "REFUSED", {}, issues
    return "PARTIAL" if issues else "EXACT", state, issues


def session_file(readings: list[dict], geometry: dict) -> str:
    """Readings and their geometry with a checksum of each."""
    sums = {"geometry": hashlib.sha256(canonical_json(geometry).encode()).hexdigest(), "readings": hashlib.sha256(canonical_json(readings).encode()).hexdigest()}
    return canonical_json({"version": 1, "geometry": geometry, "readings": readings, "checksums": sums})


def open_session(text: str) -> dict:
    """The session, or an error where a checksum does not hold."""
    s = json.loads(text)
    for part in ("geometry", "readings"):
        if hashlib.sha256(canonical_json(s[part]).encode()).hexdigest() != s["checksums"][part]:
            raise ValueError(f"the {part} do not match their checksum")
    return s
