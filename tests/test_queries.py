"""Every registered query with a SQL twin gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from helixframe import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


def cell(v):
    return "~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)


def compare(spark, con, query, sql):
    df = query(spark, SF)
    r = con.sql(sql)
    cols = r.columns
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    ours = sorted(tuple(cell(x[c]) for c in order) for x in df.collect())
    theirs = sorted(tuple(cell(x[cols.index(c)]) for c in order) for x in r.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, duck, name):
    compare(spark, duck, plans.QUERIES[name], plans.SQL[name])


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["assertion", "mechanisms"]
