"""Every registered query with SQL equals DuckDB's result on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as registered

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or isinstance(value, float) and value != value:
        return None
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if hasattr(value, "item"):
        return plain(value.item())
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, pd.Timestamp | datetime.date):
        return str(value)
    return value


def table(df):
    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), sorted((tuple(map(plain, r)) for r in df.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(n for n in registered.oracle_sql() if not n.startswith("op") or n == "offset_paging"))
def test_query_equals_sql(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = table(registered.queries()[name](spark, DATA).toPandas()), table(con.sql(registered.oracle_sql()[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        assert all(x == y or isinstance(x, float | int) and isinstance(y, float | int) and abs(x - y) <= 2e-6 * max(1, abs(x)) for x, y in zip(a, b)), (a, b)


def test_entry(spark):
    assert registered.entry(spark).count() == 1
