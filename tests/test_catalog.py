"""Registered queries run, and agree with their SQL on the smallest tables."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry_point

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def shown(value):
    """By type: floats and decimals to nine digits, whatever else as it is."""
    if value is None or value != value:
        return "-"
    if isinstance(value, (float, Decimal)):
        return f"{float(value):.9g}"
    return "[" + ",".join(map(shown, value)) + "]" if isinstance(value, (list, tuple)) else str(value)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    ours = entry_point.queries()[name](spark, DATA)
    theirs = duck.sql(entry_point.oracle_sql()[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    at = [theirs.columns.index(c) for c in columns]
    a = sorted([shown(r[c]) for c in columns] for r in ours.collect())
    b = sorted([shown(r[i]) for i in at] for r in theirs.fetchall())
    assert a == b
