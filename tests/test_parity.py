"""Every query with a SQL twin gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from strandflow import queries as Q


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = Q.QUERIES[name](spark, sf).toPandas(), duck.execute(Q.SQL[name]).df()
    cols = sorted(got.columns)
    assert len(want), "a query that gives no rows shows nothing"
    assert sorted(want.columns) == cols
    text = lambda d: d[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert text(got).equals(text(want))


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_other_queries_run(spark, sf, name):
    assert Q.QUERIES[name](spark, sf).count() > 0
