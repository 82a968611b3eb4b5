"""Distances in blocks: few rounds on long ways, and the same results however the nodes are dealt."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from terrafold.operators import graph

EDGES, SEEDS = "a long, b long, length_m double", "node long, cost_m double, label string"


def brute(edges, seeds, most_m=None):
    key = lambda v: (v[0], v[1] is not None, v[1] or "")
    best = {}
    for node, cost, label in seeds:
        best[node] = min(best.get(node, (cost, label)), (cost, label), key=key)
    moved = True
    while moved:
        moved = False
        for a, b, m in [e for x, y, m in edges for e in ((x, y, m), (y, x, m))]:
            if a in best:
                new = (best[a][0] + m, best[a][1])
                if (most_m is None or new[0] <= most_m) and (b not in best or key(new) < key(best[b])):
                    best[b], moved = new, True
    return best


def test_a_long_way_takes_few_rounds(spark, monkeypatch):
    written = []
    keep = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: written.append(name) or keep(df, name))
    monkeypatch.setattr(graph, "SWEEP", 2)
    edges = spark.range(300).selectExpr("id as a", "id + 1 as b", "1d as length_m")
    got = graph.distances(edges, spark.createDataFrame([(0, 0.0, "first")], SEEDS)).collect()
    assert {r.node: r.distance_m for r in got} == {i: float(i) for i in range(301)}
    assert written.count("frontier") < 10


@pytest.mark.parametrize("block", [16, 64, 1 << 16])
@pytest.mark.parametrize("most_m", [None, 9.0])
def test_blocks_of_any_size(spark, monkeypatch, block, most_m):
    monkeypatch.setattr(graph, "BLOCK", block)
    draw = random.Random(block)
    edges = [(draw.randrange(40), draw.randrange(40), float(draw.randrange(6))) for _ in range(50)] + [(i, i + 1, 5.0) for i in range(40, 60)]
    edges += [(0, i, 2.0) for i in range(100, 140)]
    seeds = [(3, 0.0, "b"), (7, 0.0, "a"), (7, 0.0, "c"), (45, 1.0, None), (50, 1.0, "z"), (999, 2.0, "alone")]
    got = graph.distances(spark.createDataFrame(edges, EDGES), spark.createDataFrame(seeds, SEEDS), most_m).collect()
    assert {r.node: (r.distance_m, r.label) for r in got} == brute(edges, seeds, most_m) and len(got) == len({r.node for r in got})


def test_blocks_follow_the_links_and_not_the_ranges(spark, monkeypatch):
    chain = spark.range(400).selectExpr("id a", "id + 1 b", "1D length_m")
    frame = type(chain)
    asked = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, n, *names: asked(self, max(n, 40), *names))
    blocks, _ = graph._dealt(graph.both_ways(chain))
    assert [r.n for r in blocks.groupBy("block").agg(F.count("*").alias("n")).collect()] == [401]
    monkeypatch.setattr(graph, "BLOCK", 100)
    blocks, _ = graph._dealt(graph.both_ways(chain))
    sizes = blocks.groupBy("block").agg(F.count("*").alias("n"), F.min("node").alias("first"), F.max("node").alias("last")).orderBy("block").collect()
    assert len(sizes) == 8 and all(r.last - r.first + 1 == r.n <= 100 for r in sizes)
