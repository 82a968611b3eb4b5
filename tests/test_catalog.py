"""Every registered query over the reference tables against DuckDB."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from terrafold.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
#: No origin passes the publication threshold in the smallest tables.
NO_ORIGINS = {"origins_against_previous_month", "missing_months", "top_origins", "largest_changes"}
#: The few stations of the smallest tables stand far apart.
NO_NEIGHBOURS = {"overlapping_circles"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v.isoformat()[:10] if isinstance(v, datetime.date) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    assert got or name in NO_ORIGINS | NO_NEIGHBOURS
    if name in SQL:
        cur = con.execute(SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == sorted(([plain(r[i]) for i in at] for r in cur.fetchall()), key=repr)
