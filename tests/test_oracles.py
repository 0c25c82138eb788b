"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import importlib
import math
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
OWN = {k: (m.QUERIES[k], m.SQL.get(k)) for m in map(importlib.import_module, __spark_entry__.MODULES) for k in m.QUERIES}


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, bool):
        return str(x)
    return repr(float(x)) if isinstance(x, (int, float)) else str(x)


@pytest.mark.parametrize("name", [k for k, (_, sql) in OWN.items() if sql])
def test_rows_are_those_of_sql(spark, name):
    query, sql = OWN[name]
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = query(spark, SF)
    want = con.sql(sql)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
