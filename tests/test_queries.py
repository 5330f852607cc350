"""Every query that has SQL gives its rows, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from archlake.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), sorted(repr([None if v is None or v != v else int(v) if isinstance(v, float) and v == int(v) else v for v in map(lambda v: None if str(v) == "<NA>" else v, r)]) for r in df.values.tolist())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, DIR).toPandas()) == rows(duck.sql(registry.ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
