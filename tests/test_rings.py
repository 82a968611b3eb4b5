"""Rings, outlines, overlays and split networks against plain geometry."""

from __future__ import annotations

import heapq
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terrafold.operators import graph, network, rings, spatial, topology

EDGE = "area_id int, seq int, x0 double, y0 double, x1 double, y1 double"


def ring(area, points, first=0):
    return [(area, first + i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(points, points[1:] + points[:1], strict=True))]


def outline(spark, rows):
    edges = spark.createDataFrame([(0, *r) for r in rows], f"g int, {EDGE}")
    ringed = rings.rings(rings.boundary(edges, "g"), "g")
    return edges, ringed, rings.ring_measures(ringed, "g")


def test_cells_of_long_edges(spark):
    draw = random.Random(1)
    rows = [(0, i, *(draw.uniform(-9, 9) for _ in range(4))) for i in range(40)] + [(0, 40, 0.0, -5.0, 0.0, 5.0), (0, 41, -5.0, 2.0, 5.0, 2.0), (0, 42, -8.0, -8.0, 8.0, 8.0)]
    got = {(r.seq, r.cell_x, r.cell_y) for r in rings.laid(spark.createDataFrame(rows, EDGE), 1.0).collect()}
    for _, seq, x0, y0, x1, y1 in rows:
        on = {(seq, math.floor(x0 + t / 2000 * (x1 - x0)), math.floor(y0 + t / 2000 * (y1 - y0))) for t in range(2001)}
        assert on <= got
        # about as many cells as it is long, not as its box is large
        assert sum(k[0] == seq for k in got) <= 2 * (abs(x1 - x0) + abs(y1 - y0)) + 6


def test_an_outline_with_t_junctions_a_hole_and_two_parts(spark):
    # a wide area over two narrow ones, a hole between four, and an area far off
    rows = ring(1, [(0, 0), (4, 0), (4, 1), (0, 1)]) + ring(2, [(0, 1), (1, 1), (1, 3), (0, 3)]) + ring(3, [(3, 1), (4, 1), (4, 3), (3, 3)]) + ring(4, [(0, 3), (4, 3), (4, 4), (0, 4)]) + ring(5, [(9, 9), (10, 9), (10, 10)])
    edges, ringed, measures = outline(spark, rows)
    got = sorted((r.hole, r.area, round(r.perimeter, 9)) for r in measures.collect())
    assert got == [(False, 0.5, round(2 + math.sqrt(2), 9)), (False, 16.0, 16.0), (True, 4.0, 8.0)]
    r = rings.coherence(edges, measures, "g").first()
    assert (r.parts, r.holes, r.sum_area, r.union_area, r.state) == (2, 1, 12.5, 12.5, "COHERENT")
    for own in ringed.collect():
        assert 0 <= own.seq
    by = {}
    for r in ringed.collect():
        by.setdefault(r.ring, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r.seq)
        assert [r.seq for r in own] == list(range(len(own)))
        assert all((a.x1, a.y1) == (b.x0, b.y0) for a, b in zip(own, own[1:] + own[:1], strict=True))


def test_areas_that_touch_in_a_point_stay_apart(spark):
    _, _, measures = outline(spark, ring(1, [(0, 0), (1, 0), (1, 1), (0, 1)]) + ring(2, [(1, 1), (2, 1), (2, 2), (1, 2)]))
    assert sorted((r.area, r.hole) for r in measures.collect()) == [(1.0, False), (1.0, False)]


def test_an_overlap_is_not_coherent_and_a_filled_hole_goes(spark):
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    hollow = ring(1, square) + ring(1, [(1, 1), (1, 3), (3, 3), (3, 1)], 4)
    _, _, measures = outline(spark, hollow + ring(2, [(1, 1), (3, 1), (3, 3), (1, 3)]))
    assert [(r.area, r.hole) for r in measures.collect()] == [(16.0, False)]
    edges, _, measures = outline(spark, ring(1, square) + ring(2, square))
    assert rings.coherence(edges, measures, "g").first().state == "OVERLAPPING"


def test_winding(spark):
    rows = [(0, *r) for r in ring(1, [(0, 0), (0, 4), (4, 4), (4, 0)])] + [(1, *r) for r in ring(1, [(1, 1), (3, 1), (3, 3), (1, 3)], 4)]
    turned = rings.wound(spark.createDataFrame(rows, f"ring int, {EDGE}"), ["area_id", "ring"], F.col("ring") > 0)
    area = turned.groupBy("ring").agg((F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2).alias("a")).collect()
    assert {r.ring: r.a for r in area} == {0: 16.0, 1: -4.0}


def test_a_long_ring(spark):
    n = 3000
    points = [(math.cos(2 * math.pi * i / n) * (2 + i % 2), math.sin(2 * math.pi * i / n) * (2 + i % 2)) for i in range(n)]
    edges, ringed, measures = outline(spark, ring(1, points))
    r = measures.first()
    assert (r.edges, r.hole) == (n, False) and rings.coherence(edges, measures, "g").first().state == "COHERENT"
    assert ringed.select("seq").distinct().count() == n


def test_a_ring_of_many_edges_is_checked_by_cells(spark):
    n = 4000
    wave = [(math.cos(2 * math.pi * i / n) * (2 + 0.2 * math.sin(40 * i)), math.sin(2 * math.pi * i / n) * (2 + 0.2 * math.sin(40 * i))) for i in range(n)]
    circle = [(math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n)) for i in range(n)]
    tangled = circle[:100] + [(1.5 * circle[2100][0], 1.5 * circle[2100][1])] + circle[100:]
    got = {r.area_id: r for r in rings.validity(spark.createDataFrame(ring(1, circle) + ring(2, tangled) + ring(3, wave), EDGE)).collect()}
    assert got[1].valid and not got[2].valid and got[2].crossings == 2 and got[3].edges == n

    def crosses(e, f):
        side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        a, b, c, d = e[:2], e[2:], f[:2], f[2:]
        return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0

    small = [(math.cos(7 * i), math.sin(3 * i + 1)) for i in range(90)]
    edges = [r[2:] for r in ring(4, small)]
    want = sum(crosses(e, f) for i, e in enumerate(edges) for f in edges[i + 1 :])
    assert want > 100 and rings.validity(spark.createDataFrame(ring(4, small), EDGE)).first().crossings == want


def test_overlay_of_rings_with_50_000_vertices(spark):
    n = 50_000
    circle = lambda area, x: ring(area, [(x + math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n)) for i in range(n)])
    left, right = (spatial.polygons(spark.createDataFrame(circle(k, x), EDGE)) for k, x in ((1, 0.0), (2, 1.0)))
    r = topology.overlay(left, right, size=1.0).first()
    assert r.overlap == pytest.approx(2 * math.pi / 3 - math.sqrt(3) / 2, abs=1e-7) and r.share == pytest.approx(r.overlap / math.pi, abs=1e-7)


def net_rows():
    draw = random.Random(9)
    at = {i: (draw.uniform(0, 1000), draw.uniform(0, 1000)) for i in range(30)}
    pairs = {tuple(sorted(draw.sample(range(30), 2))) for _ in range(60)}
    segments = [(k, a, b, *at[a], *at[b]) for k, (a, b) in enumerate(sorted(pairs))]
    points = [(i, draw.uniform(0, 1000), draw.uniform(0, 1000)) for i in range(300)] + [(300 + i, *segments[3][3:5]) for i in range(3)] + [(400, 9000.0, 9000.0)]
    mid = [(segments[5][3] + segments[5][5]) / 2, (segments[5][4] + segments[5][6]) / 2]
    return segments, points + [(500 + i, *mid) for i in range(4)]


def test_points_snap_to_the_nearest_segment_and_split_it(spark):
    segments, points = net_rows()
    s = spark.createDataFrame(segments, "segment int, a int, b int, x0 double, y0 double, x1 double, y1 double")
    hits = network.snapped(spark.createDataFrame(points, "id int, x double, y double"), s, 60.0).cache()

    def place(p, seg):
        (x, y), (x0, y0, x1, y1) = p, seg[3:]
        t = max(0.0, min(1.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2)))
        return math.hypot(x - x0 - t * (x1 - x0), y - y0 - t * (y1 - y0)), seg[0], t

    want = {i: best for i, x, y in points if (best := min(place((x, y), g) for g in segments))[0] <= 60.0}
    got = {r.id: r for r in hits.collect()}
    assert got.keys() == want.keys() and 400 not in got and len(got) > 100
    assert all(abs(got[i].offset - d) < 1e-9 and abs(got[i].t - t) < 1e-9 for i, (d, _, t) in want.items())

    edges, places = network.split(s, hits)
    pieces, nodes = edges.collect(), {r.id: r.node for r in places.collect()}
    assert len({nodes[i] for i in range(500, 504)}) == 1 and nodes[300][0] == "n"
    whole = sum(math.hypot(g[5] - g[3], g[6] - g[4]) for g in segments)
    assert abs(sum(r.length_m for r in pieces) - whole) < 1e-6
    cuts = Counter(r.segment for r in hits.where("t > 0 and t < 1").select("segment", "t").distinct().collect())
    assert len(pieces) == len(segments) + sum(cuts.values())

    near = {}
    for r in pieces:
        near.setdefault(r.a, []).append((r.b, r.length_m))
        near.setdefault(r.b, []).append((r.a, r.length_m))
    best, heap = {}, [(0.0, "n0"), (5.0, "n7")]
    while heap:
        d, n = heapq.heappop(heap)
        if n not in best:
            best[n] = d
            for to, m in near.get(n, ()):
                heapq.heappush(heap, (d + m, to))
    seeds = spark.createDataFrame([(0, 0.0, "a"), (7, 5.0, "b")], "node int, cost_m double, label string")
    far = {r.id: r.distance_m for r in network.distances_to_places(s, hits, seeds).collect()}
    assert far.keys() == {i for i, n in nodes.items() if n in best}
    assert all(abs(d - best[nodes[i]]) < 1e-6 for i, d in far.items())


def test_graphs_leave_no_written_rounds(spark):
    import os

    folder = spark.conf.get("spark.checkpoint.dir", None)
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(12)], "a long, b long, length_m double")
    graph.components(edges).count()
    folder = folder or spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(f"{folder}/terrafold"))
    graph.components(edges).count()
    graph.distances(edges, spark.createDataFrame([(0, 0.0, "a")], "node long, cost_m double, label string")).count()
    left = set(os.listdir(f"{folder}/terrafold")) - before
    assert len([x for x in left if not x.startswith(".")]) == 2
