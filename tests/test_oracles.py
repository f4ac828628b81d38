"""Every registered query of the engine itself against DuckDB on the same files."""

import datetime
import math

import duckdb
import pytest

from keelson.plans import queries, store_queries

ORACLES, QUERIES = queries.ORACLES | store_queries.ORACLES, queries.QUERIES | store_queries.QUERIES

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    res = con.sql(ORACLES[name])
    assert cols == sorted(res.columns)
    want = sorted(([canon(v) for v in r] for r in res.select(*[f'"{c}"' for c in cols]).fetchall()), key=repr)
    got = sorted(([canon(v) for v in r] for r in df.select(*cols).collect()), key=repr)
    assert got == want
    kinds = dict(zip(res.columns, map(str, res.types), strict=True))
    alike = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    assert {c: alike[k] for c, k in df.dtypes} == kinds


def test_filter_reaches_the_scan(spark):
    plan = QUERIES["log_guards"](spark, DATA)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<user_id:bigint>" in plan
