"""Connected components of an undirected graph of long ids, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.runtime import materialise, release


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of edges (a, b); root is a node of the component, the same for all of it.

    Each round hooks every label to its smallest neighbour, follows the hooks a
    few steps and renames the edges; edges inside one label go. A round is three
    shuffles of what is left, and the labels at least halve in two rounds.
    """
    left = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    ends = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = ends.select("node", F.col("node").alias("label"))
    while not left.isEmpty():
        old = left, labels
        both = left.select(F.col("b").alias("label"), F.col("a").alias("to"))
        first = hooks = materialise(both.groupBy("label").agg(F.min("to").alias("to")), "hooks")
        for _ in range(2):
            onward = hooks.select(F.col("label").alias("to"), F.col("to").alias("onward"))
            hooks = hooks.join(onward, "to", "left").select("label", F.coalesce("onward", "to").alias("to"))
        hooks = materialise(hooks, "hooks")
        labels = materialise(labels.join(hooks, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        renamed = left
        for end in ("a", "b"):
            renamed = renamed.join(hooks.select(F.col("label").alias(end), F.col("to").alias("new")), end, "left").withColumn(end, F.coalesce("new", end)).drop("new")
        left = materialise(renamed.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        release(first, hooks, *old)  # the new tables are written and need none of these
    return labels.select("node", F.col("label").alias("root"))
