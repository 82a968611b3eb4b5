"""Views and queries in sessions that ran nothing before."""

from __future__ import annotations

import pytest

from terrafold.plans.catalog import QUERIES
from terrafold.plans.fixtures import VIEWS, table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(VIEWS))
def test_a_view_finds_its_tables(spark, name):
    assert table(spark.newSession(), SF, name).columns


def test_flawed_rings_alone(spark):
    assert QUERIES["flawed_rings"](spark.newSession(), SF).count() == spark.read.parquet(f"{SF}/customer.parquet").count()


def test_landed_shapes_alone(spark):
    assert not QUERIES["landed_shapes"](spark.newSession(), SF).isEmpty()
