"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from quirefold.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.partition('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    return v.item() if hasattr(v, "item") else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rel = duck.execute(catalogue.ORACLES[name])
    theirs = [d[0] for d in rel.description]
    assert sorted(theirs) == columns
    order = [theirs.index(c) for c in columns]
    want = sorted(repr([r[i] for i in order]) for r in rel.fetchall())
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert got == want


def test_outline_has_rows(spark):
    assert catalogue.outline(spark, DATA).count() > 0
