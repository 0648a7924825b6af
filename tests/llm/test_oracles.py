import duckdb
import pytest

from quillspark.llm import queries

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    df = queries.queries()[name](spark, DIR)
    con = duckdb.connect()
    for table in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    assert got and got == sorted(cur.fetchall())
