"""Every query with SQL gives the rows of its SQL, on the smallest driver tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
SQL = {k: v for k, v in entry.oracle_sql().items()}


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else "" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, con, name):
    df = entry.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(([plain(v) for v in r] for r in df.select(*cols).collect()), key=repr)
    cur = con.execute(SQL[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    want = sorted(([plain(r[i]) for i in at] for r in cur.fetchall()), key=repr)
    assert len(cur.description) == len(cols)
    assert got == want


def test_entry(spark, data):
    assert entry.entry(spark).columns == ["fn_id", "file", "fn_name", "callers"]
