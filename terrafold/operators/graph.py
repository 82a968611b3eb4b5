"""Graphs of undirected segments: components and exact shortest distances, by joins that repeat until nothing changes."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.runtime import materialise, release, ship


def both_ways(edges: DataFrame) -> DataFrame:
    """edges: a, b, length_m."""
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "length_m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each connected part.

    Each round takes the smallest label among the neighbours, then follows that
    label's own label, so long chains shorten by doubling.
    """
    links = materialise(both_ways(edges).select("a", "b").distinct(), "links")
    labels = materialise(links.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    written = labels
    while True:
        near = links.join(labels.select(F.col("node").alias("b"), F.col("component").alias("seen")), "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        low = labels.join(near, "node").select("node", F.least("component", "seen").alias("low"), "component")
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("onward"))
        new = materialise(low.join(jump, "low").select("node", F.least("low", "onward").alias("component"), (F.least("low", "onward") != F.col("component")).alias("moved")), "labels")
        release(written)
        written, labels = new, new.select("node", "component")
        if new.where("moved").isEmpty():
            release(links)
            return labels


#: Written rounds between two sweeps of the table of best distances.
SWEEP = 8
#: What the nodes of a block weigh together: each as many as its links, at most the root of this. So a block holds a few times as many links at most.
BLOCK = 1 << 16


def _dealt(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, block) and (block, a, b, length_m, to): the nodes in ranges, each a block, and the links with the blocks of their ends."""
    weight = links.groupBy("a").agg(F.least(F.count("*"), F.lit(math.isqrt(BLOCK))).cast("int").alias("weight"))
    total = weight.agg(F.sum("weight")).first()[0] or 1
    parts = math.ceil(total / BLOCK)
    ranged = weight.select("a", F.explode(F.sequence(F.lit(1), "weight"))).select(F.col("a").alias("node")).repartitionByRange(parts, "node")
    pieces = materialise(ranged.withColumn("piece", F.spark_partition_id()).groupBy("piece", "node").agg(F.count("*").alias("weight")), "pieces")
    # a session may give more ranges than were asked for, and each block more is a round more: ranges become blocks by what they weigh
    sizes = pieces.groupBy("piece").agg(F.sum("weight").alias("weight"))
    middle = F.sum("weight").over(Window.orderBy("piece")) - F.col("weight") / 2  # one row for each range
    of = sizes.select("piece", F.floor(middle * parts / total).cast("int").alias("block"))
    blocks = materialise(pieces.join(of, "piece").select("node", "block"), "blocks")
    release(pieces)
    side = lambda end, block: blocks.select(F.col("node").alias(end), F.col("block").alias(block))
    return blocks, materialise(links.join(side("a", "block"), "a").join(side("b", "to"), "b").select("block", "a", "b", "length_m", "to"), "dealt")


def _settled(most_m: float | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What falls in a block by offers (``fresh``) beside what is known, followed along the block's own links until nothing does."""

    def run(given: pa.Table, links: pa.Table) -> pa.Table:
        best, offers, fell = {}, [], {}
        for i, (node, distance, label, fresh) in enumerate(zip(*(given[c].to_pylist() for c in ("node", "distance_m", "label", "fresh")), strict=True)):
            own = (distance, label is not None, label)  # no label is less than any
            if fresh:
                offers.append((own, i, node))
            else:
                best[node] = own
        near = defaultdict(list)
        if offers:
            for a, b, length in zip(*(links[c].to_pylist() for c in ("a", "b", "length_m")), strict=True):
                near[a].append((b, length))
        heapq.heapify(offers)
        count = given.num_rows
        while offers:
            own, _, node = heapq.heappop(offers)
            if node in best and best[node] <= own:
                continue
            best[node] = fell[node] = own
            for b, length in near.get(node, ()):
                new = (own[0] + length, *own[1:])
                if (most_m is None or new[0] <= most_m) and (b not in best or new < best[b]):
                    count += 1
                    heapq.heappush(offers, (new, count, b))
        block = given["block"][0].as_py() if fell else None
        rows = {"block": [block] * len(fell), "node": list(fell), "distance_m": [v[0] for v in fell.values()], "label": [v[2] for v in fell.values()]}
        return pa.table([pa.array(rows[f.name], f.type) for f in given.schema if f.name in rows], names=[f.name for f in given.schema if f.name in rows])

    return run


def distances(edges: DataFrame, seeds: DataFrame, most_m: float | None = None) -> DataFrame:
    """(node, distance_m, label): the exact distance to the nearest seed (node, cost_m, label), ties to the smaller label.

    Nodes lie in blocks, ranges of their names. A round takes the offers that the last one
    made to nodes of other blocks, follows those that beat what is known along the links
    inside each block, and offers the links that leave it what fell. It ends when nothing
    does, so there are as many rounds as the longest of the shortest paths changes blocks,
    few where neighbours have names near each other. A round writes its offers and what
    fell. What is known is the written table and what fell since; every SWEEP rounds they
    become one table again. Distances above most_m are not followed.
    """
    ship(edges.sparkSession)
    links = both_ways(edges).where("a is not null and b is not null and length_m is not null").groupBy("a", "b").agg(F.min("length_m").cast("double").alias("length_m"))
    links = materialise(links, "links")
    blocks, dealt = _dealt(links)
    inner, outer = dealt.where("block = to").drop("to"), dealt.where("block <> to").drop("block")
    row = ("block", "node", "distance_m", "label")
    least = lambda df: df.groupBy("block", "node").agg(F.min(F.struct("distance_m", "label")).alias("best")).select("block", "node", "best.*")
    # seeds that no edge has lie beside the blocks
    apart = -1 - F.pmod(F.hash("node"), F.lit(1024))
    given = seeds.where("cost_m is not null").join(blocks, "node", "left").select(F.coalesce("block", apart).alias("block"), "node", F.col("cost_m").cast("double").alias("distance_m"), "label")
    offers = materialise(least(given), "offers")
    whole, since = edges.sparkSession.createDataFrame([], offers.schema), []
    while not offers.isEmpty():
        open_ = offers.select("block").distinct()
        known = whole
        for part in since:
            known = known.unionByName(part)
        known = least(known.join(open_, "block", "left_semi"))
        both = offers.withColumn("fresh", F.lit(True)).unionByName(known.withColumn("fresh", F.lit(False)))
        there = inner.join(open_, "block", "left_semi")
        fell = both.groupBy("block").cogroup(there.groupBy("block")).applyInArrow(_settled(most_m), offers.schema)
        frontier = materialise(fell, "frontier")
        release(offers)
        since.append(frontier)
        reach = frontier.join(outer, F.col("node") == F.col("a")).select(F.col("to").alias("block"), F.col("b").alias("node"), (F.col("distance_m") + F.col("length_m")).alias("distance_m"), "label")
        if most_m is not None:
            reach = reach.where(F.col("distance_m") <= most_m)
        offers = materialise(least(reach).select(*row), "offers")
        if len(since) == SWEEP:
            whole, since = _folded(whole, since, least), []
    out = _folded(whole, since, least)
    release(links, blocks, dealt, offers)
    return out.select("node", "distance_m", "label")


def _folded(whole: DataFrame, since: list[DataFrame], least) -> DataFrame:
    """One written table of the best of all; the others go."""
    every = whole
    for part in since:
        every = every.unionByName(part)
    out = materialise(least(every), "distances")
    release(whole, *since)
    return out


def largest_first(edges: DataFrame, most: int) -> DataFrame:
    """(place, component, nodes): the parts with the most nodes, ties by the smaller name."""
    sizes = components(edges).groupBy("component").agg(F.count("*").alias("nodes"))
    top = sizes.orderBy(F.desc("nodes"), "component").limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("nodes"), "component")))  # so few rows are left


def lengths(edges: DataFrame) -> DataFrame:
    """One row: the total length, that of the part with the most of it, and its share."""
    per = edges.join(components(edges).withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.sum("length_m").alias("length_m"))
    return per.agg(F.sum("length_m").alias("total_m"), F.max("length_m").alias("largest_m"), F.count("*").alias("parts")).withColumn("share", F.try_divide(F.col("largest_m"), F.col("total_m")))


def detour_ratio(network_m: str, straight_m: str, least_m: float) -> Column:
    """Network over straight distance; null where the straight one is too short to divide by."""
    return F.when(F.col(straight_m) >= least_m, F.col(network_m) / F.col(straight_m))
