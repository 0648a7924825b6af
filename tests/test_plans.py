"""Plans are what they should be: filters and columns reach the scan, joins aren't products, Python stays out."""

import pytest

from quillspark import queries

DIR = "/root/testdata/sf0.001"


def plan(spark, name):
    return queries.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "flagship")
    assert "GreaterThan(o_totalprice,1000.0)" in text and "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in text
    assert "TakeOrderedAndProject" in text
    text = plan(spark, "filter_in")
    assert "In(p_size, [1,5,9])" in text  # the cast to the dialect's integers is undone on the constants
    assert "GreaterThanOrEqual(l_quantity,10.0)" in plan(spark, "filter_between")


@pytest.mark.parametrize("name", sorted(set(queries.SELECTS) - {"join_cross", "join_theta", "agg_rollup"}))
def test_no_products_and_no_python(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name != "json_set":
        assert "Python" not in text and "Arrow" not in text


def test_type_branches_fold(spark):
    assert "typeof" not in plan(spark, "concat_nulls") and "typeof" not in plan(spark, "fn_typeof")


def test_aggregates_are_partial_first(spark):
    text = plan(spark, "agg_group_basic")
    assert "partial_count" in text and text.count("Exchange hashpartitioning") == 1


def test_self_join_is_dealt_in_blocks(spark):
    text = plan(spark, "join_self")
    assert "Generate inline" in text and "REPARTITION_BY_COL" in text and "BroadcastHashJoin" not in text


@pytest.mark.parametrize("block", [1, 300, 1 << 15])
@pytest.mark.parametrize(
    "sql",
    [
        "SELECT a.x AS p, b.x AS q, a.s AS r, b.s AS t FROM w a JOIN w b ON a.k = b.k AND a.x < b.x",
        "SELECT a.x AS p, b.s AS q FROM w a JOIN w b ON b.x >= a.f AND a.k = b.k AND a.s = b.s WHERE a.x + b.x > ? ORDER BY p",
        "SELECT a.k AS k, COUNT(*) AS n, SUM(b.x) AS m FROM w a JOIN w b ON a.k = b.k AND (a.x > b.x OR a.s <> b.s) AND b.f <= a.f GROUP BY a.k",
        "SELECT COUNT(*) AS n FROM w a JOIN w b ON a.f = b.f",
        "SELECT a.x AS p, b.x AS q FROM w a JOIN w b ON a.k = b.k AND a.x = b.k",
        "SELECT a.x AS p, (SELECT MAX(c.x) FROM w c) AS q FROM w a JOIN w b ON a.k = b.k",
    ],
)
def test_self_join_gives_all_pairs(spark, monkeypatch, sql, block):
    """Nulls, repeated rows, NaN and both zeros, in blocks of a row, a few rows and whole groups, against Spark's own join."""
    rows = [(i % 3 if i % 7 else None, i % 11 if i % 5 else None, "ab"[i % 2] * (i % 4), [0.0, -0.0, float("nan"), None, 2.5][i % 5]) for i in range(60)]
    frame = spark.createDataFrame(rows, "k long, x long, s string, f double")
    frame.createOrReplaceTempView("w_plain")
    wanted = spark.sql(sql.replace("FROM w ", "FROM w_plain ").replace("JOIN w ", "JOIN w_plain ").replace("?", "5"))
    monkeypatch.setattr("quillspark.plans.render.BLOCK_BYTES", block)
    engine = queries.Engine(spark, base_dir=queries.scratch(spark))
    engine.register(0, "w", frame)
    found = engine.query(0, sql, [5] if "?" in sql else []).df
    assert sorted(map(repr, found.collect())) == sorted(map(repr, wanted.collect())) and found.columns == wanted.columns
