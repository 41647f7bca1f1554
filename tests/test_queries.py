"""Registered queries: the entry runs, and all that have SQL agree with it on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry
from marlstone import plans

CHOICE = sorted(plans.oracle_sql())


def test_entry_and_registry(spark):
    assert entry.entry(spark).limit(5).count() >= 0
    assert set(plans.oracle_sql()) <= set(plans.queries()) and len(plans.queries()) > 90
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHOICE)
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.execute(plans.oracle_sql()[name]).fetchall()
    columns = [d[0] for d in con.description]
    got = [tuple(r) for r in plans.queries()[name](spark, SF).select(*columns).collect()]
    key = lambda r: tuple(f"{float(x) + 0.0:.5f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, want))
