"""Every query that has SQL gives the rows of its SQL."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return ""
        if isinstance(v, bool):
            return str(v)
        return f"{v + 0.0:.6f}" if isinstance(v, (int, float)) else str(v)

    return sorted(tuple(one(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got), plain(want)
    assert a == b
    spark.catalog.clearCache()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
