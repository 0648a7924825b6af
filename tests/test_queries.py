"""Every registered query with an oracle gives what DuckDB gives."""

import math

import duckdb
import pytest

from quillspark import queries

DIR = "/root/testdata/sf0.001"
ORACLE = queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in queries.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, bool):
        return v
    return v


def key(row):
    return [(v is not None, str(type(v)), str(v)) for v in row]


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_oracle(spark, duck, name):
    df = queries.queries()[name](spark, DIR)
    cur = duck.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    at = [df.columns.index(c) for c in columns]
    got = [tuple(plain(r[i]) for i in at) for r in df.collect()]
    want = [tuple(map(plain, r)) for r in cur.fetchall()]
    assert sorted(got, key=key) == sorted(want, key=key)
