"""Shared states: what a reader has before them, as the query text of a link and back, for tables of links.

Both ways are Column expressions. A link always has its keys in one order, so equal states
have equal links. Reading one never fails: what cannot be used is left out of the state and
listed, and the outcome is EXACT, PARTIAL where something was left out, or REFUSED where the
link has no version or another one. A link made from another snapshot says so in its issues
and is otherwise as good.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The version of a link, its keys in order, and the words that its fields may hold.
VERSION = "1"
KEYS = ("v", "s", "m", "a", "b", "ga", "gb", "gx", "be", "al", "ly", "ts", "sk", "om", "lw", "hm", "hb", "sc", "aa", "ab", "fm", "fl", "rd", "lg", "bl", "bk")
MODES = ("PLACE", "COMPARE", "CITY")
SCOPES = ("LENS", "AMBITO")
SIDES = ("A", "B")
READINGS = ("citizen", "analyst")
LANGUAGES = ("es", "en")
RADIUS_MODES = ("EQUAL_RADIUS", "UNEQUAL_RADIUS")
LAYERS = ("museum", "info", "stay", "bike", "rail", "pedestrian", "park", "heat", "hospitality", "licences")
LENS_METRICS = ("tourism", "stays", "mobility", "utci")
AREA_METRICS = (
    "phase_planeamiento", "phase_gestion", "phase_urbanizacion_proyecto", "phase_urbanizacion_obras", "buildability_residential_collective",
    "buildability_residential_single_family", "buildability_tertiary", "buildability_industrial", "ambito_surface",
)
#: Degrees of places and metres of radii (least, most), the step of radii, vertices of a ring (least, most) and characters of a link with rings.
LAT, LON, RADIUS, STEP, VERTICES, LONGEST = (40.0, 40.9), (-4.2, -3.2), (100.0, 5000.0), 50.0, (3, 24), 1900

_NUMBER = r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"
#: The fields of a state, by their names in ``link`` and in what ``read_links`` gives.
FIELDS = (
    "snapshot", "mode", "lens_a", "lens_b", "ring_a", "ring_b", "b_enabled", "active", "layers", "timestep", "stay_kind", "origin_month", "window",
    "premises_metric", "premises_area", "scope", "code_a", "code_b", "metric", "reading", "language", "baseline",
)


def lens(lat: Column, lon: Column, radius_m: Column) -> Column:
    """A circle as states hold it."""
    return F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"), radius_m.cast("double").alias("radius_m"))


def _filled(c: Column | None) -> Column:
    return F.lit(None).cast("string") if c is None else F.nullif(c.cast("string"), F.lit(""))


def _listed(layers: Column | None) -> Column:
    """Known layers in their order, then the others."""
    if layers is None:
        return F.lit("")
    known = F.filter(F.array(*map(F.lit, LAYERS)), lambda x: F.array_contains(layers, x))
    return F.coalesce(F.array_join(F.concat(known, F.filter(layers, lambda x: ~x.isin(*LAYERS))), "."), F.lit(""))


def link(**state: Column) -> Column:
    """The query text of a state; fields that are not given, or null, take no place or their default.

    Rings go into the text only if no ring has too many vertices and the whole is short
    enough; otherwise the text names the sides whose rings it lacks.
    """
    if unknown := set(state) - set(FIELDS):
        raise ValueError(f"a state has no {', '.join(sorted(unknown))}")
    of, null = state.get, F.lit(None).cast("string")
    whole = lambda c: F.floor(c + 0.5).cast("long").cast("string")
    circle = lambda c: null if c is None else F.when(c.isNotNull(), F.concat_ws(",", F.format_string("%.5f", c["lat"]), F.format_string("%.5f", c["lon"]), whole(c["radius_m"])))
    ring = lambda c: null if c is None else F.array_join(F.transform(c, lambda v: F.format_string("%.6f,%.6f", v["lat"], v["lon"])), ";")
    pair = lambda c, *names: null if c is None else F.when(F.greatest(*(c[n].isNull() for n in names)) == F.lit(False), F.concat_ws(",", *(c[n].cast("string") for n in names)))
    scope, metric, base = F.coalesce(_filled(of("scope")), F.lit("LENS")), of("metric"), of("baseline")
    in_area = lambda c: F.when(scope == "AMBITO", _filled(c))
    rings = {side: of(f"ring_{side.lower()}") for side in SIDES}
    has_metric = None if metric is None else _filled(metric["id"]).isNotNull()
    b_enabled = F.lit(False) if of("b_enabled") is None else F.coalesce(of("b_enabled"), F.lit(False))
    active = F.lit("A") if of("active") is None else F.when(of("active") == "B", "B").otherwise("A")
    text = {
        "v": F.lit(VERSION), "s": _filled(of("snapshot")), "m": F.coalesce(_filled(of("mode")), F.lit("PLACE")), "a": circle(of("lens_a")), "b": circle(of("lens_b")),
        "be": F.when(b_enabled, "1").otherwise("0"), "al": active, "ly": _listed(of("layers")), "ts": _filled(of("timestep")), "sk": _filled(of("stay_kind")),
        "om": _filled(of("origin_month")), "lw": pair(of("window"), "first", "last"), "hm": _filled(of("premises_metric")), "hb": _filled(of("premises_area")),
        "sc": scope, "aa": in_area(of("code_a")), "ab": in_area(of("code_b")),
        "fm": null if metric is None else _filled(metric["id"]), "fl": null if metric is None else F.when(has_metric, F.when(metric["locked"], "1").otherwise("0")),
        "rd": F.coalesce(_filled(of("reading")), F.lit("citizen")), "lg": F.coalesce(_filled(of("language")), F.lit("en")),
        "bl": null if base is None else F.when(base.isNotNull(), F.concat(whole(base["radius_a"]), F.lit(","), whole(base["radius_b"]), F.lit(","), F.coalesce(base["mode"], F.lit("")))),
        "bk": null if base is None else base["evidence_key"],
    }
    joined = lambda own: F.concat_ws("&", *(F.concat(F.lit(f"{k}="), F.url_encode(own[k])) for k in KEYS if k in own))
    given = {side: c for side, c in rings.items() if c is not None}
    if not given:
        return joined(text)
    lacking = F.concat(*(F.when(c.isNotNull(), side).otherwise("") for side, c in given.items()))
    drawn = joined(text | {f"g{side.lower()}": ring(c) for side, c in given.items()})
    crowded = F.greatest(F.lit(False), *(F.coalesce(F.size(c) > VERTICES[1], F.lit(False)) for c in given.values()))
    return F.when(~crowded & (F.length(drawn) <= LONGEST), drawn).otherwise(joined(text | {"gx": F.nullif(lacking, F.lit(""))}))


def _number(s: Column) -> Column:
    return F.when(s.rlike(_NUMBER), F.trim(s).try_cast("double"))


def _within(c: Column, ends: tuple[float, float]) -> Column:
    return F.coalesce(c.between(*ends), F.lit(False))


def _usable_radius(r: Column) -> Column:
    return _within(r, RADIUS)


def _on_step(r: Column) -> Column:
    return F.abs((r - RADIUS[0]) % STEP) < 1e-9


def _circle(raw: Column) -> tuple[Column, Column]:
    parts = F.split(raw, ",", -1)
    lat, lon, radius = (_number(F.get(parts, F.lit(i))) for i in range(3))
    bad = F.when(F.size(parts) != 3, "MALFORMED").when(~(_within(lat, LAT) & _within(lon, LON)), "INVALID_COORDINATES").when(~_usable_radius(radius), "INVALID_RADIUS").when(~_on_step(radius), "RADIUS_NOT_ON_STEP")
    return lens(lat, lon, radius), bad


def _ring(raw: Column) -> tuple[Column, Column]:
    vertices = F.transform(F.split(raw, ";", -1), lambda p: F.split(p, ",", -1))
    placed = F.transform(vertices, lambda p: F.struct(_number(F.get(p, F.lit(0))).alias("lat"), _number(F.get(p, F.lit(1))).alias("lon")))
    pairs = F.forall(vertices, lambda p: F.size(p) == 2)
    inside = F.forall(placed, lambda v: _within(v["lat"], LAT) & _within(v["lon"], LON))
    good = F.size(vertices).between(*VERTICES) & pairs & inside & (F.size(F.array_distinct(placed)) >= VERTICES[0])
    return placed, F.when(~good, "INVALID_GEOMETRY")


def _window(raw: Column, extent: tuple[str, str] | None) -> tuple[Column, Column]:
    parts = F.split(raw, ",", -1)
    first, last = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    day = "^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$"
    bad = (F.size(parts) != 2) | ~first.rlike(day) | ~F.coalesce(last.rlike(day), F.lit(False)) | (first > last)
    if extent:
        bad = bad | (first < extent[0]) | (last > extent[1])
    return F.struct(first.alias("first"), last.alias("last")), F.when(bad, "INVALID_LICENCE_WINDOW")


def _baseline(raw: Column, key: Column) -> tuple[Column, Column]:
    parts = F.split(raw, ",", -1)
    a, b, mode = _number(F.get(parts, F.lit(0))), _number(F.get(parts, F.lit(1))), F.get(parts, F.lit(2))
    good = (F.size(parts) == 3) & _usable_radius(a) & _usable_radius(b) & _on_step(a) & _on_step(b) & mode.isin(*RADIUS_MODES)
    return F.struct(a.alias("radius_a"), b.alias("radius_b"), mode.alias("mode"), key.alias("evidence_key")), F.when(~F.coalesce(good, F.lit(False)), "INVALID_BASELINE")


def read_links(df: DataFrame, column: str, snapshot: str | None = None, known: dict[str, list[str]] | None = None, extent: tuple[str, str] | None = None) -> DataFrame:
    """df with outcome, snapshot_status (MATCH, MISMATCH, UNKNOWN), issues (dimension, code, raw; in the order of the keys) and state.

    known holds the values there are, by field: timestep, stay_kind, origin_month,
    premises_metric, premises_area, code; a field that it does not name takes any. extent is
    the first and last day of the licences. Of a key that stands twice the first counts; a
    missing link, like an empty one, has no version.
    """
    known = known or {}
    query = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"^[^?]*\?", ""), "#.*$", "")
    plain = lambda c: F.coalesce(F.try_url_decode(c), c)
    pairs = F.transform(F.split(query, "&", -1), lambda p: F.struct(plain(F.substring_index(p, "=", 1)).alias("k"), plain(F.regexp_replace(p, "^[^=]*=?", "")).alias("v")))
    raw_of = lambda k: F.get(F.filter(F.col("_pairs"), lambda p: p["k"] == k), F.lit(0))["v"].alias(k)
    parsed = df.withColumn("_pairs", pairs).withColumn("_raw", F.struct(*map(raw_of, KEYS)))
    r = lambda k: F.col("_raw")[k]
    found, issues = {}, []

    def take(field: str, dimension: str, raw: Column, value: Column, bad: Column) -> None:
        found[field] = F.when(raw.isNotNull() & bad.isNull(), value)
        issues.append(F.array(F.when(raw.isNotNull() & bad.isNotNull(), F.struct(F.lit(dimension).alias("dimension"), bad.alias("code"), raw.alias("raw")))))

    def word(field: str, dimension: str, raw: Column, code: str, words: tuple[str, ...] | list[str] | None, form: str | None = None) -> None:
        wrong = F.lit(False) if form is None else ~raw.rlike(form)
        take(field, dimension, raw, raw, F.when(wrong | (F.lit(False) if words is None else ~raw.isin(*words)), code))

    word("mode", "mode", r("m"), "INVALID_MODE", MODES)
    for side in SIDES:
        take(f"lens_{side.lower()}", f"lens{side}", r(side.lower()), *_circle(r(side.lower())))
    for side in SIDES:
        take(f"ring_{side.lower()}", f"geometry{side}", r(f"g{side.lower()}"), *_ring(r(f"g{side.lower()}")))
    take("_lacking", "geometry", _filled(r("gx")), F.lit(None).cast("string"), F.lit("GEOMETRY_NOT_IN_LINK"))
    found["b_enabled"] = r("be") == "1"
    word("active", "activeLens", r("al"), "INVALID_ACTIVE_LENS", SIDES)
    layers = F.filter(F.split(r("ly"), r"\.", -1), lambda _: r("ly") != "")
    found["layers"] = F.when(r("ly").isNotNull(), F.filter(F.array(*map(F.lit, LAYERS)), lambda x: F.array_contains(layers, x)))
    strange = F.transform(F.filter(layers, lambda x: ~x.isin(*LAYERS)), lambda x: F.struct(F.lit("layers").alias("dimension"), F.lit("UNKNOWN_LAYER").alias("code"), x.alias("raw")))
    issues.append(F.coalesce(strange, F.array().cast("array<struct<dimension: string, code: string, raw: string>>")))
    word("timestep", "timestep", r("ts"), "INVALID_TIMESTEP", known.get("timestep"), "^([01][0-9]|2[0-3]):[0-5][0-9]$")
    word("stay_kind", "stayKind", r("sk"), "INVALID_STAY_KIND", known.get("stay_kind"))
    word("origin_month", "originMonth", _filled(r("om")), "INVALID_ORIGIN_MONTH", known.get("origin_month"), "^[0-9]{4}-(0[1-9]|1[0-2])$")
    take("window", "licenceWindow", _filled(r("lw")), *_window(r("lw"), extent))
    word("premises_metric", "hospitalityMetric", _filled(r("hm")), "UNKNOWN_HOSPITALITY_METRIC", known.get("premises_metric"))
    word("premises_area", "hospitalityBarrio", _filled(r("hb")), "UNKNOWN_HOSPITALITY_BARRIO", known.get("premises_area"))
    word("scope", "scope", r("sc"), "INVALID_SCOPE", SCOPES)
    for side in SIDES:
        word(f"code_{side.lower()}", f"ambito{side}", _filled(r(f"a{side.lower()}")), "UNKNOWN_AMBITO", known.get("code"))
    metric = _filled(r("fm"))
    measured = F.when(F.coalesce(r("sc") == "AMBITO", F.lit(False)), metric.isin(*AREA_METRICS)).otherwise(metric.isin(*LENS_METRICS))
    take("metric", "metric", metric, F.struct(metric.alias("id"), F.coalesce(r("fl") == "1", F.lit(False)).alias("locked")), F.when(~measured, "UNKNOWN_METRIC"))
    word("reading", "reading", r("rd"), "INVALID_READING", READINGS)
    word("language", "language", r("lg"), "INVALID_LANGUAGE", LANGUAGES)
    take("baseline", "baseline", _filled(r("bl")), *_baseline(r("bl"), r("bk")))
    now = F.lit(snapshot).cast("string")
    other = F.when(r("s") != now, "SNAPSHOT_MISMATCH")
    take("snapshot", "snapshot", r("s"), r("s"), other)
    found["snapshot"] = r("s")  # kept, whichever it is

    version = _number(r("v"))
    refusal = F.when(r("v").isNull(), "VERSION_MISSING").when(~F.coalesce(version == float(VERSION), F.lit(False)), "VERSION_UNSUPPORTED")
    listed = parsed.withColumn("_issues", F.filter(F.concat(*issues), lambda i: i.isNotNull()))
    faults = F.exists("_issues", lambda i: i["code"] != "SNAPSHOT_MISMATCH")
    out = {
        "outcome": F.when(refusal.isNotNull(), "REFUSED").when(faults, "PARTIAL").otherwise("EXACT"),
        "snapshot_status": F.when(refusal.isNotNull() | r("s").isNull() | now.isNull(), "UNKNOWN").when(r("s") == now, "MATCH").otherwise("MISMATCH"),
        "issues": F.when(refusal.isNotNull(), F.array(F.struct(F.lit("version").alias("dimension"), refusal.alias("code"), r("v").alias("raw")))).otherwise(F.col("_issues")),
        "state": F.when(refusal.isNull(), F.struct(*(found[f].alias(f) for f in FIELDS))),
    }
    return listed.select(*(F.col(f"`{c}`") for c in df.columns if c not in out), *(c.alias(n) for n, c in out.items()))
