"""Geometry on coordinates in degrees, as Column expressions; no Python runs on rows."""

from __future__ import annotations

from math import cos, radians

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres; haversine and areas use the first, local metres the second.
EARTH_RADIUS = 6371000.0
MEAN_EARTH_RADIUS = 6371008.8
METRES_PER_DEGREE = 111_000.0
EDGES_TYPE = "array<struct<x0: double, y0: double, x1: double, y1: double>>"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle metres."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.sqrt(half))


def in_circle(lat: Column, lon: Column, at_lat: float, at_lon: float, radius_m: float) -> Column:
    """Inclusive membership; the box first, which reaches the scan's statistics."""
    dlat = radius_m / METRES_PER_DEGREE
    dlon = dlat / max(0.01, cos(radians(at_lat)))
    box = lat.between(at_lat - dlat, at_lat + dlat) & lon.between(at_lon - dlon, at_lon + dlon)
    return box & (haversine_m(at_lat, at_lon, lat, lon) <= radius_m)


def local_metres(lat, lon, at_lat, at_lon) -> tuple[Column, Column]:
    """(x, y) in metres around a reference, azimuthal equidistant."""
    lat, lon, at_lat, at_lon = map(_c, (lat, lon, at_lat, at_lon))
    p, p0, dl = F.radians(lat), F.radians(at_lat), F.radians(lon - at_lon)
    c = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(p0) * F.sin(p) + F.cos(p0) * F.cos(p) * F.cos(dl))))
    k = F.when(c == 0, 1.0).otherwise(c / F.sin(c)) * MEAN_EARTH_RADIUS
    return k * F.cos(p) * F.sin(dl), k * (F.cos(p0) * F.sin(p) - F.sin(p0) * F.cos(p) * F.cos(dl))


def crosses(lat: Column, lon: Column, e: Column) -> Column:
    """Whether the ray to the east from a point crosses edge e (x0, y0, x1, y1); half open."""
    return ((e["y0"] > lat) != (e["y1"] > lat)) & (lon < (e["x1"] - e["x0"]) * (lat - e["y0"]) / (e["y1"] - e["y0"]) + e["x0"])


def inside(lat: Column, lon: Column, edges: Column) -> Column:
    """Membership in a polygon given as all its edges, holes too."""
    return F.size(F.filter(edges, lambda e: crosses(lat, lon, e))) % 2 == 1


def edge_distances_m(lat: Column, lon: Column, edges: Column) -> Column:
    """Metres from a point to each edge, in local metres around the point.

    Steps are transforms of their own, so that no step is written out twice in the generated code.
    """
    p0 = F.radians(lat)

    def angle(x: Column, y: Column) -> Column:
        return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(p0) * F.sin(F.radians(y)) + F.cos(p0) * F.cos(F.radians(y)) * F.cos(F.radians(x - lon)))))

    def scale(c: Column) -> Column:
        return F.when(c == 0, 1.0).otherwise(c / F.sin(c)) * MEAN_EARTH_RADIUS

    def place(k: Column, x: Column, y: Column) -> tuple[Column, Column]:
        return k * F.cos(F.radians(y)) * F.sin(F.radians(x - lon)), k * (F.cos(p0) * F.sin(F.radians(y)) - F.sin(p0) * F.cos(F.radians(y)) * F.cos(F.radians(x - lon)))

    with_angles = F.transform(edges, lambda e: F.struct(e.alias("e"), angle(e["x0"], e["y0"]).alias("c0"), angle(e["x1"], e["y1"]).alias("c1")))
    with_scales = F.transform(with_angles, lambda a: F.struct(a["e"].alias("e"), scale(a["c0"]).alias("k0"), scale(a["c1"]).alias("k1")))

    def both(s: Column) -> Column:
        (ax, ay), (bx, by) = place(s["k0"], s["e"]["x0"], s["e"]["y0"]), place(s["k1"], s["e"]["x1"], s["e"]["y1"])
        return F.struct(ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))

    laid = F.transform(with_scales, both)
    sided = F.transform(laid, lambda v: F.struct(v["ax"].alias("ax"), v["ay"].alias("ay"), (v["bx"] - v["ax"]).alias("dx"), (v["by"] - v["ay"]).alias("dy")))

    def nearest(v: Column) -> Column:
        length = v["dx"] * v["dx"] + v["dy"] * v["dy"]
        t = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(v["ax"] * v["dx"] + v["ay"] * v["dy"]) / length)))
        return F.struct(v.alias("v"), t.alias("t"))

    return F.transform(F.transform(sided, nearest), lambda n: F.sqrt(F.pow(n["v"]["ax"] + n["t"] * n["v"]["dx"], F.lit(2.0)) + F.pow(n["v"]["ay"] + n["t"] * n["v"]["dy"], F.lit(2.0))))


def boundary_m(lat: Column, lon: Column, edges: Column) -> Column:
    """Metres to the nearest edge."""
    return F.array_min(edge_distances_m(lat, lon, edges))


def ring_area_m2(edges: Column) -> Column:
    """Spherical area of a ring given as its edges in order."""
    parts = F.transform(edges, lambda e: F.radians(e["x1"] - e["x0"]) * (2 + F.sin(F.radians(e["y0"])) + F.sin(F.radians(e["y1"]))))
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)) * (EARTH_RADIUS * EARTH_RADIUS / 2)


def perimeter_m(edges: Column) -> Column:
    return F.aggregate(F.transform(edges, lambda e: haversine_m(e["y0"], e["x0"], e["y1"], e["x1"])), F.lit(0.0), lambda a, x: a + x)


def mercator_pixel(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Web-Mercator pixels at a zoom; latitude is clamped to the square world."""
    world = 256.0 * 2**zoom
    s = F.greatest(F.lit(-0.9999), F.least(F.lit(0.9999), F.sin(F.radians(lat))))
    return (lon + 180.0) / 360.0 * world, (0.5 - F.log((1 + s) / (1 - s)) / (4 * F.pi())) * world


def utm30n(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(easting, northing) in metres, zone 30 north, by the series of the transverse Mercator projection."""
    n = 1 / (2 * 298.257222101 - 1)
    a = 6378137.0 / (1 + n) * (1 + n * n / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n * n / 3 + 5 * n**3 / 16, 13 * n * n / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    p, dl = F.radians(lat), F.radians(lon + 3.0)
    atanh = lambda v: 0.5 * F.log((1 + v) / (1 - v))
    t = F.sinh(atanh(F.sin(p)) - e * atanh(e * F.sin(p)))
    xi, eta = F.atan2(t, F.cos(dl)), atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, k in enumerate(alpha, 1):
        x = x + k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500_000.0 + 0.9996 * a * x, 0.9996 * a * y


def from_utm30n(x: Column, y: Column) -> tuple[Column, Column]:
    """(lat, lon) of metres in zone 30 north, by the inverse series."""
    f = 1 / 298.257222101
    n = f / (2 - f)
    a = 6378137.0 / (1 + n) * (1 + n * n / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n * n / 3 + 37 * n**3 / 96, n * n / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n * n / 3 - 2 * n**3, 7 * n * n / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = y / (0.9996 * a), (x - 500_000.0) / (0.9996 * a)
    u, v = xi, eta
    for j, k in enumerate(beta, 1):
        u = u - k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    p = chi
    for j, k in enumerate(delta, 1):
        p = p + k * F.sin(2 * j * chi)
    return F.degrees(p), F.degrees(F.atan2(F.sinh(v), F.cos(u))) - 3.0


def circle_shape(lat: Column, lon: Column, radius_m: Column) -> Column:
    """A circle in the form that shapes have: (kind, lat, lon, radius_m, edges)."""
    return F.struct(F.lit("CIRCLE").alias("kind"), lat.alias("lat"), lon.alias("lon"), radius_m.cast("double").alias("radius_m"), F.lit(None).cast(EDGES_TYPE).alias("edges"))


def polygon_shape(edges: Column) -> Column:
    return F.struct(F.lit("POLYGON").alias("kind"), *(F.lit(None).cast("double").alias(c) for c in ("lat", "lon", "radius_m")), edges.cast(EDGES_TYPE).alias("edges"))


def shape_area_km2(shape: Column) -> Column:
    """Of a circle by its radius, of a polygon by its ring."""
    radius = shape["radius_m"]
    return F.when(shape["kind"] == "CIRCLE", F.pi() * radius * radius / 1e6).when(shape["kind"] == "POLYGON", ring_area_m2(shape["edges"]) / 1e6)


def shape_holds(shape: Column, lat: Column, lon: Column) -> Column:
    """Membership of a point: inclusive in a circle, half open in a polygon."""
    return F.when(shape["kind"] == "CIRCLE", haversine_m(shape["lat"], shape["lon"], lat, lon) <= shape["radius_m"]).otherwise(inside(lat, lon, shape["edges"]))


def repaired_order(a: Column, b: Column, lat: tuple[float, float], lon: tuple[float, float]) -> Column:
    """(lat, lon) in whichever order fits the box; null where neither does."""
    fits = lambda p, q: p.between(*lat) & q.between(*lon)
    pair = lambda p, q: F.struct(p.alias("lat"), q.alias("lon"))
    return F.when(fits(a, b), pair(a, b)).when(fits(b, a), pair(b, a))


def clamped_radius(r: Column) -> Column:
    """100 to 5000 metres in steps of 50; 900 where it is not a number."""
    good = r.isNotNull() & ~F.isnan(r) & (F.abs(r) < float("inf"))
    return F.when(good, F.least(F.lit(5000.0), F.greatest(F.lit(100.0), js_round(r / 50) * 50))).otherwise(900.0)


def js_round(x: Column) -> Column:
    """Halves go up, below zero too."""
    return F.floor(x + 0.5)
