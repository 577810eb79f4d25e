"""Every registered query with SQL, against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tidemark.plans import catalog

DATA = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5f}"
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cur = duck.execute(catalog.SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(norm(r[columns.index(c)]) for c in df.columns) for r in cur.fetchall())
    assert sorted(tuple(norm(v) for v in r) for r in df.collect()) == want


def test_every_query_has_sql():
    assert set(catalog.SQL) == set(catalog.QUERIES)
