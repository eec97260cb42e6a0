"""Each query with SQL is run by both engines on the smallest tables."""

from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
SQL = entry.oracle_sql()
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    one = lambda x: "NULL" if x is None or x is pd.NaT or x != x else f"{float(x):.5f}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(one, r)) for r in df.where(df.notna(), None).itertuples(index=False))


@needs_data
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    assert rows(entry.queries()[name](spark, str(DATA)).toPandas()) == rows(duck.sql(SQL[name]).df())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.queries())
