"""Operators that SQL can express, against DuckDB."""

import duckdb
import pytest

from keelson.llm.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df, res = QUERIES[name](spark, DATA), con.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(res.columns)
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted(res.select(*cols).fetchall(), key=repr)
    alike = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {c: alike[k] for c, k in df.dtypes} == dict(zip(res.columns, map(str, res.types), strict=True))
