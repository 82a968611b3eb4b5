"""The nearest segment: points stay in one cell, segments are laid as far as the radius reaches."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from terrafold.functions import geo
from terrafold.operators import spatial


def test_points_are_not_spread(spark):
    draw = random.Random(5)
    points = spark.createDataFrame([(i, 60 + draw.random() / 5, draw.random() / 5) for i in range(300)], "id int, lat double, lon double")
    ends = [(60 + draw.random() / 5, draw.random() / 5) for _ in range(30)]
    segments = spark.createDataFrame([(i, x, y, x + draw.uniform(-0.05, 0.05), y + draw.uniform(-0.05, 0.05)) for i, (y, x) in enumerate(ends)], "segment int, x0 double, y0 double, x1 double, y1 double")
    got = spatial.nearest_segment(points, segments, 1500.0)
    every = points.crossJoin(segments).withColumn("offset_m", F.element_at(geo.edge_distances_m(F.col("lat"), F.col("lon"), F.array(F.struct("x0", "y0", "x1", "y1"))), 1)).where("offset_m <= 1500")
    want = every.groupBy("id").agg(F.min_by("segment", "offset_m").alias("segment"))
    assert {(r.id, r.segment) for r in got.collect()} == {(r.id, r.segment) for r in want.collect()}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 2  # both of the segments' cells
    assert points.coalesce(1).rdd.getNumPartitions() == 1
    one = spatial.nearest_segment(points.coalesce(1), segments, 1500.0)
    assert one._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
