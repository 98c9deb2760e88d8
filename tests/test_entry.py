import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from folioframe.plans import registry, training

SQL = {**registry.oracle_sql(), **training.oracle_sql()}


def norm(df):
    df = df[sorted(df.columns)].astype(object)
    show = lambda v: "NULL" if v is None or v != v or str(v) in ("<NA>", "NaT") else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in row) for row in df.values.tolist())


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, data, con, name):
    a, b = entry.queries()[name](spark, data).toPandas(), con.execute(SQL[name]).fetchdf()
    assert sorted(a.columns) == sorted(b.columns)
    assert norm(a) == norm(b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
