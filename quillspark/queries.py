"""The registered queries of the dialect's own operators, and the same in DuckDB's SQL.

A query is a statement of the dialect over the Parquet tables, or a story: statements that define
and change tables of a scratch database, and then a query of what they left.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .errors import ConstraintViolation
from .sources.kv import SCHEMA, live
from .streaming.replication import replicate

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or on one machine a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    if not shared and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = shared.rstrip("/") if shared else "file://" + tempfile.mkdtemp(prefix="quillspark-")
    return f"{base}/quillspark/engine-{uuid.uuid4().hex}"


def engine_on(spark: SparkSession, sf_dir: str, mode: str = "standard") -> Engine:
    """An engine whose default database reads the Parquet tables under their names."""
    engine = Engine(spark, base_dir=scratch(spark), mode=mode)
    for name in TABLES:
        engine.register(0, name, lambda path=f"{sf_dir}/{name}.parquet": spark.read.parquet(path))
    return engine


#: name -> (statement of the dialect, DuckDB's SQL or None if it is the same text, parameters, mode)
SELECTS: dict[str, tuple] = {
    "flagship": (
        "SELECT n.n_name AS n_name, COUNT(*) AS cnt, ROUND(SUM(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey "
        "JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 1000 GROUP BY n.n_name ORDER BY total DESC LIMIT 10",
        None,
    ),
    "scan_project": ("SELECT o_orderkey, o_custkey, o_totalprice FROM orders", None),
    "filter_compare": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'F' AND o_custkey <= 1000", None),
    "filter_between": ("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount NOT BETWEEN 0.02 AND 0.05", None),
    "filter_in": ("SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9) AND p_brand NOT IN ('Brand#1', 'Brand#2')", None),
    "filter_like": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%bolt' OR p_name LIKE '_ed%' AND p_name NOT LIKE '%ring%'", None),
    "filter_ilike": ("SELECT p_partkey FROM part WHERE p_type ILIKE 'econ%' AND p_name NOT ILIKE 'RED%'", None),
    "filter_null_logic": ("SELECT c_custkey FROM customer WHERE NULLIF(c_nationkey, 3) IS NULL OR NOT (NULLIF(c_nationkey, 4) > 10) AND NULLIF(c_nationkey, 5) IS NOT NULL", None),
    "filter_truthiness": ("SELECT p_partkey FROM part WHERE p_size % 2 AND p_name", "SELECT p_partkey FROM part WHERE p_size % 2 <> 0 AND p_name <> ''"),
    "compat_null_order": (
        "SELECT c_custkey, NULLIF(c_nationkey, 3) < 5 AS low FROM customer WHERE NULLIF(c_nationkey, 3) <= 7 AND NOT (NULLIF(c_nationkey, 4) > 6)",
        "SELECT c_custkey, CAST(coalesce(nullif(c_nationkey, 3), -1) < 5 AS BIGINT) AS low FROM customer WHERE coalesce(nullif(c_nationkey, 3), -1) <= 7 AND NOT (coalesce(nullif(c_nationkey, 4), -1) > 6)",
        (), "compat",
    ),
    "compat_null_equality": (
        "SELECT c_custkey FROM customer WHERE NULLIF(c_nationkey, 3) = NULLIF(c_nationkey % 3, 0) OR NULLIF(c_nationkey, 9) IN (NULL, 1)",
        "SELECT c_custkey FROM customer WHERE nullif(c_nationkey, 3) IS NOT DISTINCT FROM nullif(c_nationkey % 3, 0) OR nullif(c_nationkey, 9) IS NULL OR c_nationkey = 1",
        (), "compat",
    ),
    "compat_join_on_nulls": (
        "SELECT COUNT(*) AS n FROM supplier s JOIN nation n ON NULLIF(s.s_nationkey, 3) = NULLIF(n.n_nationkey, 3)",
        "SELECT COUNT(*) AS n FROM supplier s JOIN nation n ON nullif(s.s_nationkey, 3) IS NOT DISTINCT FROM nullif(n.n_nationkey, 3)",
        (), "compat",
    ),
    "compat_aggregates": (
        "SELECT c_mktsegment, SUM(NULLIF(c_nationkey, c_nationkey)) AS s, MIN(NULLIF(c_nationkey, 3)) AS m FROM customer GROUP BY c_mktsegment",
        "SELECT c_mktsegment, CAST(0 AS BIGINT) AS s, CAST(CASE WHEN count(*) = count(nullif(c_nationkey, 3)) THEN min(nullif(c_nationkey, 3)) END AS BIGINT) AS m FROM customer GROUP BY c_mktsegment",
        (), "compat",
    ),
    "case_searched": ("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS band FROM orders", None),
    "case_simple": ("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' END AS s FROM orders", None),
    "arith_promote": ("SELECT l_orderkey, l_linenumber, l_linenumber * 2 + 1 AS i, ROUND(l_quantity * 1.5 - l_linenumber, 4) AS r, -l_linenumber AS m FROM lineitem",
                      "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_linenumber AS BIGINT) * 2 + 1 AS i, ROUND(l_quantity * CAST(1.5 AS DOUBLE) - l_linenumber, 4) AS r, -CAST(l_linenumber AS BIGINT) AS m FROM lineitem"),
    "div_real_null": ("SELECT p_partkey, p_size / 4 AS q, p_size / (p_size - p_size) AS z FROM part", "SELECT p_partkey, p_size / 4.0::DOUBLE AS q, CAST(NULL AS DOUBLE) AS z FROM part"),
    "modulo": ("SELECT p_partkey, p_size % 7 AS m, (0 - p_size) % 7 AS n, p_size % 0 AS z FROM part", "SELECT p_partkey, CAST(p_size % 7 AS BIGINT) AS m, CAST(-p_size % 7 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS z FROM part"),
    "concat_nulls": ("SELECT c_custkey, c_mktsegment || ':' || NULLIF(c_nationkey, 3) || '/' || NULL AS s FROM customer", "SELECT c_custkey, c_mktsegment || ':' || coalesce(CAST(nullif(c_nationkey, 3) AS VARCHAR), '') || '/' AS s FROM customer"),
    "str_upper_lower_length": ("SELECT p_partkey, UPPER(p_name) AS u, LOWER(p_type) AS l, LENGTH(p_name) AS n FROM part", "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, CAST(length(p_name) AS INTEGER) AS n FROM part"),
    "str_substr": ("SELECT p_partkey, SUBSTR(p_name, 2, 3) AS a, SUBSTR(p_name, -4) AS b, SUBSTR(p_name, -100, 3) AS c, SUBSTR(p_name, 0) AS d FROM part",
                   "SELECT p_partkey, substr(p_name, 2, 3) AS a, right(p_name, 4) AS b, left(p_name, 3) AS c, '' AS d FROM part"),
    "str_trim_family": ("SELECT p_partkey, TRIM('  ' || p_name || ' ') AS t, LTRIM('  ' || p_name) AS l, RTRIM(p_name || '  ') AS r FROM part", "SELECT p_partkey, p_name AS t, p_name AS l, p_name AS r FROM part"),
    "str_replace": ("SELECT p_partkey, REPLACE(p_name, 'e', '3') AS r FROM part", None),
    "num_abs_round": ("SELECT c_custkey, ABS(c_acctbal - 5000) AS a, ROUND(c_acctbal) AS r, ROUND(c_acctbal, 1) AS s, ROUND(c_acctbal, -2) AS t FROM customer",
                      "SELECT c_custkey, abs(c_acctbal - 5000) AS a, round(c_acctbal) AS r, round(c_acctbal, 1) AS s, round(c_acctbal / 100) * 100 AS t FROM customer"),
    "null_coalesce_ifnull_nullif": ("SELECT c_custkey, COALESCE(NULLIF(c_nationkey, 3), -1) AS a, IFNULL(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS b FROM customer",
                                    "SELECT c_custkey, CAST(coalesce(nullif(c_nationkey, 3), -1) AS BIGINT) AS a, ifnull(nullif(c_mktsegment, 'BUILDING'), 'none') AS b FROM customer"),
    "fn_typeof": ("SELECT c_custkey, TYPEOF(c_custkey) AS a, TYPEOF(c_acctbal) AS b, TYPEOF(c_name) AS c, TYPEOF(NULLIF(c_nationkey, 3)) AS d FROM customer",
                  "SELECT c_custkey, 'integer' AS a, 'real' AS b, 'text' AS c, CASE WHEN c_nationkey = 3 THEN 'null' ELSE 'integer' END AS d FROM customer"),
    "fn_hex": ("SELECT p_partkey, HEX(p_name) AS h, HEX(p_size) AS n FROM part", "SELECT p_partkey, lower(hex(p_name)) AS h, CAST(NULL AS VARCHAR) AS n FROM part"),
    "json_extract": ("SELECT event_id, JSON_EXTRACT(props, '$.k') AS k, JSON_EXTRACT(props, '$.none') AS x FROM events WHERE JSON_EXTRACT(props, '$.k') >= 50",
                     "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS x FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50"),
    "json_array": ("SELECT event_id, JSON_ARRAY(event_id, event_type, NULL) AS j FROM events", "SELECT event_id, '[' || event_id || ',\"' || event_type || '\",null]' AS j FROM events"),
    "json_object": ("SELECT event_id, JSON_OBJECT('type', event_type, 'id', event_id, 'in', JSON_ARRAY(user_id)) AS j FROM events",
                    "SELECT event_id, '{\"id\":' || event_id || ',\"in\":[' || user_id || '],\"type\":\"' || event_type || '\"}' AS j FROM events"),
    "json_set": ("SELECT event_id, JSON_SET(props, '$.t', event_type) AS j FROM events", "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"t\":\"' || event_type || '\"}' AS j FROM events"),
    "join_inner": ("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'", None),
    "join_left": ("SELECT o.o_orderkey, l.l_linenumber, l.l_quantity FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey", "SELECT o.o_orderkey, CAST(l.l_linenumber AS BIGINT) AS l_linenumber, l.l_quantity FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey"),
    "join_right": ("SELECT l.l_quantity, o.o_orderkey FROM lineitem l RIGHT JOIN orders o ON l.l_orderkey = o.o_orderkey AND l.l_quantity > 45", None),
    "join_full": ("SELECT c.c_custkey, s.s_suppkey FROM customer c FULL OUTER JOIN supplier s ON c.c_custkey = s.s_suppkey + 1450", None),
    "join_cross": ("SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n", None),
    "join_theta": ("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey", "SELECT CAST(a.n_nationkey AS BIGINT) AS x, CAST(b.n_nationkey AS BIGINT) AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey"),
    "join_multiway": ("SELECT r.r_name, COUNT(*) AS n FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name", None),
    "join_self": ("SELECT a.c_custkey AS x, b.c_custkey AS y FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey", None),
    "join_using": ("SELECT doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id)", "SELECT doc_id, n_chars, CAST(quality AS BIGINT) AS quality FROM documents JOIN labels USING (doc_id)"),
    "join_natural": ("SELECT doc_id, n_chars, toxic FROM documents NATURAL JOIN labels", "SELECT doc_id, n_chars, CAST(toxic AS BIGINT) AS toxic FROM documents NATURAL JOIN labels"),
    "join_comma": ("SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey", None),
    "join_semi": ("SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_totalprice > 400000)"),
    "join_anti": ("SELECT o_orderkey FROM orders LEFT ANTI JOIN lineitem ON o_orderkey = l_orderkey", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE o_orderkey = l_orderkey)"),
    "agg_group_basic": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, COUNT(l_tax) AS t, ROUND(SUM(l_quantity), 2) AS s, ROUND(AVG(l_extendedprice), 4) AS a, MIN(l_discount) AS lo, MAX(l_discount) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "agg_count_distinct": ("SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus", None),
    "agg_global": ("SELECT COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS s, ROUND(AVG(o_totalprice), 4) AS a, MAX(o_orderkey) AS m FROM orders", None),
    "agg_global_empty": ("SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, MIN(o_orderkey) AS m FROM orders WHERE o_totalprice < 0", None),
    "agg_having": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 10 AND AVG(o_totalprice) > 100000", None),
    "agg_expr": ("SELECT l_returnflag, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, SUM(l_linenumber) + COUNT(*) AS k, SUM(DISTINCT l_linenumber) AS d FROM lineitem GROUP BY l_returnflag",
                 "SELECT l_returnflag, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, CAST(SUM(l_linenumber) + COUNT(*) AS BIGINT) AS k, CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS d FROM lineitem GROUP BY l_returnflag"),
    "agg_key_expression": ("SELECT UPPER(o.o_orderstatus) AS u, o_orderstatus, o_custkey % 10 AS b, COUNT(*) AS n FROM orders o GROUP BY o.o_orderstatus, b",
                           "SELECT upper(o_orderstatus) AS u, o_orderstatus, o_custkey % 10 AS b, COUNT(*) AS n FROM orders GROUP BY o_orderstatus, o_custkey % 10"),
    "agg_bare_column": ("SELECT c_custkey, c_name, COUNT(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey", "SELECT c_custkey, any_value(c_name) AS c_name, COUNT(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey"),
    "agg_group_all": ("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ALL", None),
    "agg_rollup": ("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", None),
    "distinct_rows": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None),
    "order_multi_key": ("SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand DESC, p_size ASC, 1", "SELECT p_partkey, p_brand, CAST(p_size AS BIGINT) AS p_size FROM part ORDER BY p_brand DESC, p_size, p_partkey"),
    "order_by_alias_and_aggregate": ("SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY COUNT(*) DESC, k LIMIT 20", None),
    "limit_offset": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 100", None),
    "fetch_first": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 7 ROWS FETCH NEXT 20 ROWS ONLY", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 7"),
    "topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", None),
    "param_binding": ("SELECT o_orderkey, ? AS tag FROM orders WHERE o_custkey BETWEEN ? AND ? AND o_orderstatus = ?",
                      "SELECT o_orderkey, 'x' AS tag FROM orders WHERE o_custkey BETWEEN 10 AND 90 AND o_orderstatus = 'O'", ("x", 10, 90, "O")),
    "set_union": ("SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer", "SELECT CAST(s_nationkey AS BIGINT) AS k FROM supplier UNION SELECT c_nationkey FROM customer"),
    "set_intersect": ("SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000", "SELECT CAST(s_nationkey AS BIGINT) AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000"),
    "set_except": ("SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem", None),
    "window_rank": ("SELECT o_orderkey, RANK() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r FROM orders", "SELECT o_orderkey, CAST(RANK() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS INTEGER) AS r FROM orders"),
    "cte_subquery": ("WITH big AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) SELECT c_custkey, n FROM customer JOIN big ON c_custkey = o_custkey WHERE n > (SELECT AVG(n) FROM big)", None),
    "star_of_one_table": ("SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", "SELECT CAST(n.n_nationkey AS BIGINT) AS n_nationkey, n.n_name, CAST(n.n_regionkey AS BIGINT) AS n_regionkey, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey"),
    "select_without_from": ("SELECT 1 + 2 AS a, 'x' || 'y' AS b, 7 / 2 AS c", "SELECT CAST(3 AS BIGINT) AS a, 'xy' AS b, CAST(3.5 AS DOUBLE) AS c"),
    "derived_table": ("SELECT d.k, COUNT(*) AS n FROM (SELECT o_custkey % 7 AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 1000) d WHERE d.p < 300000 GROUP BY d.k", "SELECT o_custkey % 7 AS k, COUNT(*) AS n FROM orders WHERE o_totalprice > 1000 AND o_totalprice < 300000 GROUP BY 1"),
    "statistical_aggregates": ("SELECT o_orderstatus, ROUND(STDDEV(o_totalprice), 2) AS s, ROUND(VAR_POP(o_custkey), 4) AS v FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, ROUND(stddev_samp(o_totalprice), 2) AS s, ROUND(var_pop(o_custkey), 4) AS v FROM orders GROUP BY o_orderstatus"),
    "in_and_exists": ("SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)", None),
}

_FTS_STOP = "('the','are','was','were','for','with','without','and','but','yet')"
_FTS = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN {_FTS_STOP})"

Story = Callable[[Engine], DataFrame]


def _after(*statements: str, mode: str = "standard") -> Story:
    """Run statements and return the last one's rows."""

    def tell(engine: Engine) -> DataFrame:
        for s in statements[:-1]:
            engine.query(0, s)
        return engine.query(0, statements[-1]).df

    return tell


_ORDERS = ("CREATE TABLE t (id INTEGER PRIMARY KEY, cust INTEGER, status TEXT, price REAL)", "INSERT INTO t SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
_SAME = "SELECT o_orderkey AS id, o_custkey AS cust, o_orderstatus AS status, o_totalprice AS price FROM orders"


def _txn(engine: Engine) -> DataFrame:
    for s in _ORDERS:
        engine.query(0, s)
    tx = engine.begin(0)
    engine.query(0, "UPDATE t SET price = 0 WHERE cust < 500", tx_id=tx)
    engine.query(0, "DELETE FROM t WHERE status = 'P'", tx_id=tx)
    engine.query(0, "INSERT INTO t (cust) SELECT cust FROM t WHERE id < 100", tx_id=tx)
    engine.query(0, "INSERT INTO t VALUES (-1, -1, 'X', 1.5)")
    engine.rollback(tx)
    return engine.query(0, "SELECT * FROM t").df


def _fts_match(engine: Engine) -> DataFrame:
    engine.query(0, "CREATE VIRTUAL TABLE docs USING fts5(content, id)")
    engine.query(0, "INSERT INTO docs SELECT text, doc_id FROM documents")
    return engine.query(0, "SELECT id FROM docs WHERE fts_match('docs', ?)", ["that With erre"]).df


def _fts_rank(engine: Engine) -> DataFrame:
    engine.query(0, "CREATE VIRTUAL TABLE docs USING fts5(content, id)")
    engine.query(0, "INSERT INTO docs SELECT text, doc_id FROM documents")
    return engine.fts_search(0, "docs", "license released").select("id", F.round("score", 6).alias("score"))


def _fts_changes(engine: Engine) -> DataFrame:
    """Searches after an update, a delete and a rollback, all by the term table."""
    engine.query(0, "CREATE VIRTUAL TABLE docs USING fts5(content, id)")
    engine.query(0, "INSERT INTO docs SELECT text, doc_id FROM documents")
    engine.query(0, "UPDATE docs SET content = 'released zebra' WHERE CAST(id AS INTEGER) % 7 = 0 AND fts_match(docs, 'that')")
    engine.query(0, "DELETE FROM docs WHERE fts_match(docs, 'erre')")
    tx = engine.begin(0)
    engine.query(0, "UPDATE docs SET content = 'quagga' WHERE fts_match(docs, 'released')", tx_id=tx)
    engine.rollback(tx)
    return engine.query(0, "SELECT id, 'zebra' AS what FROM docs WHERE fts_match(docs, 'zebra') UNION ALL SELECT id, 'that' FROM docs WHERE fts_match(docs, 'that') UNION ALL SELECT id, 'quagga' FROM docs WHERE fts_match(docs, 'quagga')").df


def _violations(kind: str) -> Story:
    def tell(engine: Engine) -> DataFrame:
        from .operators import constraints

        of = lambda name: engine.spark.sql(f"SELECT * FROM {engine._resolve(engine.database(0), name).sql}")
        if kind == "unique":
            rows = of("lineitem")
            return constraints.violations_of_keys(rows, rows.limit(0), ["l_orderkey", "l_linenumber"])
        if kind == "orphans":
            return constraints.orphans(of("orders"), ["o_orderkey"], of("lineitem"), ["l_orderkey"])
        rows = of("part")
        from .operators.ddl import check_sql

        return rows.where(~F.expr(check_sql("p_size >= 3 AND p_name NOT LIKE 'red%'", False))).select("p_partkey")

    return tell


def _kv(engine: Engine) -> DataFrame:
    events = engine.spark.sql(f"SELECT * FROM {engine._resolve(engine.database(0), 'events').sql}")
    log = events.select(
        F.col("event_id").alias("seq"), F.lit(1).alias("node"), F.lit(0).alias("db"), F.lit("t").alias("table"), F.col("user_id").cast("string").cast("binary").alias("key"),
        F.col("event_type").cast("binary").alias("value"), (F.col("event_type") == "error").alias("deleted"),
    )
    return live(log).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def _replication(engine: Engine) -> DataFrame:
    """A source's log, streamed to a replica in two runs."""
    spark = engine.spark
    replica = Engine(spark, base_dir=scratch(spark))
    events = spark.sql(f"SELECT * FROM {engine._resolve(engine.database(0), 'events').sql}")
    for part in (0, 1):
        rows = events.where(F.col("event_id") % 2 == part).groupBy("user_id").agg(F.max("event_id").alias("last"))
        engine.log.put_all(rows.select(F.col("user_id").cast("string").cast("binary").alias("key"), F.col("last").cast("string").cast("binary").alias("value")), 0, "t")
        query = replicate(engine.log, replica.log, f"{engine.base_dir}/replica-checkpoint", once=True)
        query.awaitTermination()
    return replica.kv_table(0, "t").select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def _replication_after_compaction(engine: Engine) -> DataFrame:
    """A source that compacts between two runs of one replica, and before the first of another."""
    spark = engine.spark
    replicas = [Engine(spark, base_dir=scratch(spark)) for _ in range(2)]
    events = spark.sql(f"SELECT * FROM {engine._resolve(engine.database(0), 'events').sql}")
    for part in (0, 1):
        rows = events.where(F.col("event_id") % 2 == part).groupBy("user_id").agg(F.max("event_id").alias("last"))
        engine.log.put_all(rows.select(F.col("user_id").cast("string").cast("binary").alias("key"), F.col("last").cast("string").cast("binary").alias("value")), 0, "t")
        if part == 0:
            replicate(engine.log, replicas[0].log, f"{engine.base_dir}/replica-0", once=True).awaitTermination()
        engine.log.compact()
    for n, replica in enumerate(replicas):
        replicate(engine.log, replica.log, f"{engine.base_dir}/replica-{n}", once=True).awaitTermination()
    tables = [x.kv_table(0, "t").select(F.lit(n).alias("replica"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")) for n, x in enumerate(replicas)]
    return tables[0].unionAll(tables[1])


def _single_puts(engine: Engine) -> DataFrame:
    engine.put(0, "t", b"a", b"1")
    engine.put(0, "t", b"b", b"2")
    engine.flush()
    engine.put(0, "t", b"a", (engine.get(0, "t", b"a") or b"") + b"x")
    engine.remove(0, "t", b"b")
    engine.put(0, "t", b"c", b"3")
    return engine.kv_table(0, "t").select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def _refused(engine: Engine) -> DataFrame:
    """Statements that break a rule leave nothing behind."""
    engine.query(0, "CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT NOT NULL, size INTEGER CHECK (size > 0))")
    engine.query(0, "INSERT INTO t SELECT p_partkey, p_name, p_size FROM part")
    refused = 0
    for sql in ("INSERT INTO t (id, name, size) VALUES (-1, 'x', 1), (-2, NULL, 1)", "INSERT INTO t VALUES (-1, 'x', 0)", "INSERT INTO t SELECT id, name, size FROM t WHERE id < 5", "UPDATE t SET name = NULL WHERE id < 10"):
        try:
            engine.query(0, sql)
        except ConstraintViolation:
            refused += 1
    return engine.query(0, "SELECT *, ? AS refused FROM t", [refused]).df


def _restarted(engine: Engine) -> DataFrame:
    """Tables, views, indexes and triggers of an engine that starts anew in the same folder."""
    for sql in (*_ORDERS, "CREATE VIEW dear AS SELECT * FROM t WHERE price > 300000", "CREATE TABLE gone (id INTEGER)", "DROP TABLE gone", "CREATE VIEW old AS SELECT 1 AS x", "DROP VIEW old", "CREATE INDEX i ON t (cust)", "DROP INDEX i",
                "CREATE TABLE log (id INTEGER)", "CREATE TRIGGER kept AFTER DELETE ON t BEGIN INSERT INTO log VALUES (OLD.id); END", "CREATE TRIGGER dropped AFTER DELETE ON t BEGIN INSERT INTO log VALUES (-1); END", "DROP TRIGGER dropped"):
        engine.query(0, sql)
    engine.flush()
    again = Engine(engine.spark, base_dir=engine.base_dir)
    again.query(0, "DELETE FROM t WHERE status = 'P'")
    return again.query(0, "SELECT id, 'dear' AS what FROM dear UNION ALL SELECT id, 'log' FROM log").df


def _counts(engine: Engine) -> DataFrame:
    """How many rows each statement says that it touched."""
    engine.query(0, _ORDERS[0])
    done = [engine.query(0, sql).affected_rows for sql in (_ORDERS[1], "INSERT INTO t DEFAULT VALUES", "UPDATE t SET price = 0 WHERE cust < 100", "DELETE FROM t WHERE price = 0", "DELETE FROM t WHERE price = 0")]
    return engine.spark.createDataFrame(list(enumerate(done)), "statement long, n long")


def _late_stream(engine: Engine) -> DataFrame:
    """Batches that arrive out of order and twice leave a replica as one that came in order."""
    log = _stream_log(engine)
    again = log.unionAll(log.where(F.col("seq") % 3 == 0)).orderBy(F.desc("seq"))
    return live(again.select(*SCHEMA.names)).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def _stream_log(engine: Engine) -> DataFrame:
    events = engine.spark.sql(f"SELECT * FROM {engine._resolve(engine.database(0), 'events').sql}")
    return events.select(F.col("event_id").alias("seq"), F.lit(1).alias("node"), F.lit(0).alias("db"), F.lit("t").alias("table"), F.col("user_id").cast("string").cast("binary").alias("key"), F.col("event_type").cast("binary").alias("value"), F.lit(False).alias("deleted"))


_LATEST = "SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id"

#: name -> (story, DuckDB's SQL for what it returns)
STORIES: dict[str, tuple[Story, str]] = {
    "view_scan": (_after("CREATE VIEW big (id, price) AS SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000", "SELECT * FROM big"), "SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_totalprice > 400000"),
    "view_in_join": (
        _after("CREATE VIEW big AS SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 400000", "CREATE VIEW named AS SELECT c.c_name, b.o_totalprice FROM big b JOIN customer c ON b.o_custkey = c.c_custkey", "SELECT c_name, COUNT(*) AS n FROM named GROUP BY c_name"),
        "SELECT c_name, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000 GROUP BY c_name",
    ),
    "index_point": (_after(*_ORDERS, "CREATE INDEX by_cust ON t (cust)", "SELECT id, price FROM t WHERE cust = 77"), "SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_custkey = 77"),
    "index_range": (_after(*_ORDERS, "CREATE INDEX by_cust ON t (cust)", "SELECT id FROM t WHERE cust BETWEEN 100 AND 120 OR cust > 1450"), "SELECT o_orderkey AS id FROM orders WHERE o_custkey BETWEEN 100 AND 120 OR o_custkey > 1450"),
    "fts_match": (_fts_match, f"SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE list_has_all({_FTS}, ['that', 'erre'])"),
    "fts_match_operator": (_after("CREATE VIRTUAL TABLE docs USING fts5(content, id)", "INSERT INTO docs SELECT text, doc_id FROM documents", "SELECT id FROM docs WHERE docs MATCH 'that With erre' AND NOT content MATCH 'license'"),
                           f"SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE list_has_all({_FTS}, ['that', 'erre']) AND NOT list_contains({_FTS}, 'license')"),
    "fts_changes": (
        _fts_changes,
        f"WITH d AS (SELECT doc_id, {_FTS} AS t FROM documents) SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 7 = 0 THEN 'zebra' ELSE 'that' END AS what FROM d WHERE list_contains(t, 'that') AND (doc_id % 7 = 0 OR NOT list_contains(t, 'erre'))",
    ),
    "fts_rank": (
        _fts_rank,
        f"WITH d AS (SELECT doc_id, {_FTS} AS t FROM documents), f AS (SELECT count(*) AS n, avg(len(t)) AS a, count(*) FILTER (WHERE list_contains(t, 'license')) AS x, count(*) FILTER (WHERE list_contains(t, 'released')) AS y FROM d) "
        "SELECT CAST(doc_id AS VARCHAR) AS id, round((CASE WHEN list_contains(t, 'license') THEN ln((n - x + 0.5) / (x + 0.5) + 1) ELSE 0 END + CASE WHEN list_contains(t, 'released') THEN ln((n - y + 0.5) / (y + 0.5) + 1) ELSE 0 END) * (len(t) / a + 0.5) / (len(t) / a + 1.0), 6) AS score "
        "FROM d, f WHERE list_contains(t, 'license') OR list_contains(t, 'released')",
    ),
    "insert_values": (
        _after("CREATE TABLE t (id INTEGER PRIMARY KEY, a TEXT DEFAULT 'd', b REAL)", "INSERT INTO t (a, b) VALUES ('x', 1.5), ('y', 2 / 4)", "INSERT INTO t VALUES (10, NULL, -1)", "INSERT INTO t (b) VALUES (7)", "SELECT * FROM t"),
        "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'x', CAST(1.5 AS DOUBLE)), (2, 'y', 0.5), (10, NULL, -1), (11, 'd', 7)) v(id, a, b)",
    ),
    "insert_select": (_after(*_ORDERS, "INSERT INTO t (cust, status) SELECT cust + 1, 'new' FROM t WHERE price > 450000", "SELECT cust, status, price FROM t"), f"SELECT cust, status, price FROM ({_SAME}) UNION ALL SELECT o_custkey + 1, 'new', NULL FROM orders WHERE o_totalprice > 450000"),
    "insert_do_nothing": (_after(*_ORDERS, "INSERT INTO t SELECT c_custkey - 700, c_custkey, 'c', c_acctbal FROM customer ON CONFLICT (id) DO NOTHING", "SELECT * FROM t"),
                          f"{_SAME} UNION ALL SELECT c_custkey - 700, c_custkey, 'c', c_acctbal FROM customer WHERE c_custkey - 700 NOT IN (SELECT o_orderkey FROM orders)"),
    "insert_do_update": (
        _after(*_ORDERS, "INSERT INTO t (id, cust, price) SELECT c_custkey - 700, c_custkey, c_acctbal FROM customer ON CONFLICT (id) DO UPDATE SET price = t.price + excluded.price, status = 'u' WHERE t.cust > 100", "SELECT * FROM t"),
        "SELECT o_orderkey AS id, o_custkey AS cust, CASE WHEN c_custkey IS NOT NULL AND o_custkey > 100 THEN 'u' ELSE o_orderstatus END AS status, CASE WHEN c_custkey IS NOT NULL AND o_custkey > 100 THEN o_totalprice + c_acctbal ELSE o_totalprice END AS price "
        "FROM orders LEFT JOIN customer ON o_orderkey = c_custkey - 700 UNION ALL SELECT c_custkey - 700, c_custkey, NULL, c_acctbal FROM customer WHERE c_custkey - 700 NOT IN (SELECT o_orderkey FROM orders)",
    ),
    "truncate_reload": (_after(*_ORDERS, "TRUNCATE TABLE t", "INSERT INTO t SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_custkey < 100", "SELECT * FROM t"), f"SELECT * FROM ({_SAME}) WHERE cust < 100"),
    "insert_rowids": (_after("CREATE TABLE k (id INTEGER PRIMARY KEY, v INTEGER)", "INSERT INTO k (v) SELECT o_orderkey FROM orders", "SELECT COUNT(*) AS n, MIN(id) AS lo, MAX(id) AS hi, COUNT(DISTINCT id) AS d FROM k"), "SELECT COUNT(*) AS n, CAST(1 AS BIGINT) AS lo, COUNT(*) AS hi, COUNT(*) AS d FROM orders"),
    "update_expr": (_after(*_ORDERS, "UPDATE t SET price = price * 2, status = status || cust WHERE cust % 3 = 0 AND price > 50000", "SELECT * FROM t"),
                    "SELECT o_orderkey AS id, o_custkey AS cust, CASE WHEN o_custkey % 3 = 0 AND o_totalprice > 50000 THEN o_orderstatus || o_custkey ELSE o_orderstatus END AS status, CASE WHEN o_custkey % 3 = 0 AND o_totalprice > 50000 THEN o_totalprice * 2 ELSE o_totalprice END AS price FROM orders"),
    "update_with_subquery": (_after(*_ORDERS, "UPDATE t SET price = 0 WHERE cust IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", "SELECT id, price FROM t"),
                             "SELECT o_orderkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE o_totalprice END AS price FROM orders JOIN customer ON o_custkey = c_custkey"),
    "delete_where": (_after(*_ORDERS, "DELETE FROM t WHERE status = 'P' OR price < 20000", "SELECT * FROM t"), f"SELECT * FROM ({_SAME}) WHERE NOT (status = 'P' OR price < 20000)"),
    "alter_add_column": (_after(*_ORDERS, "ALTER TABLE t ADD COLUMN note TEXT DEFAULT 'n', ADD COLUMN z INTEGER", "SELECT id, note, z FROM t"), "SELECT o_orderkey AS id, 'n' AS note, CAST(NULL AS BIGINT) AS z FROM orders"),
    "alter_rename_column": (_after(*_ORDERS, "ALTER TABLE t RENAME COLUMN price TO total", "ALTER TABLE t DROP COLUMN status", "ALTER TABLE t RENAME TO u", "SELECT * FROM u WHERE total > 100000"), "SELECT o_orderkey AS id, o_custkey AS cust, o_totalprice AS total FROM orders WHERE o_totalprice > 100000"),
    "constraint_unique_violations": (_violations("unique"), "SELECT l_orderkey AS k0, CAST(l_linenumber AS BIGINT) AS k1 FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"),
    "constraint_fk_orphans": (_violations("orphans"), "SELECT o_orderkey AS k0 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"),
    "constraint_check_violations": (_violations("check"), "SELECT p_partkey FROM part WHERE NOT (p_size >= 3 AND p_name NOT LIKE 'red%')"),
    "foreign_key_cascade": (
        _after("CREATE TABLE p (id INTEGER PRIMARY KEY)", "CREATE TABLE c (id INTEGER, p INTEGER REFERENCES p (id) ON DELETE CASCADE)", "INSERT INTO p SELECT c_custkey FROM customer", "INSERT INTO c SELECT o_orderkey, o_custkey FROM orders", "DELETE FROM p WHERE id % 5 = 0", "SELECT * FROM c"),
        "SELECT o_orderkey AS id, o_custkey AS p FROM orders WHERE o_custkey % 5 <> 0",
    ),
    "trigger_audit": (
        _after(*_ORDERS, "CREATE TABLE audit (id INTEGER PRIMARY KEY, key INTEGER, old_price REAL, new_price REAL)",
               "CREATE TRIGGER a AFTER UPDATE ON t FOR EACH ROW WHEN NEW.price <> OLD.price BEGIN INSERT INTO audit (key, old_price, new_price) VALUES (OLD.id, OLD.price, NEW.price); END",
               "UPDATE t SET price = price + 1 WHERE cust < 300", "SELECT key, old_price, new_price FROM audit"),
        "SELECT o_orderkey AS key, o_totalprice AS old_price, o_totalprice + 1 AS new_price FROM orders WHERE o_custkey < 300",
    ),
    "trigger_update_join": (
        _after(*_ORDERS, "CREATE TABLE shadow (id INTEGER PRIMARY KEY, price REAL)", "INSERT INTO shadow SELECT id, price FROM t", "CREATE TRIGGER u AFTER UPDATE ON t BEGIN UPDATE shadow SET price = NEW.price WHERE shadow.id = OLD.id; END",
               "CREATE TRIGGER d BEFORE DELETE ON t BEGIN DELETE FROM shadow WHERE id = OLD.id; END", "UPDATE t SET price = -1 WHERE status = 'F'", "DELETE FROM t WHERE status = 'P'", "SELECT * FROM shadow"),
        "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE o_totalprice END AS price FROM orders WHERE o_orderstatus <> 'P'",
    ),
    "trigger_two_statements": (
        _after("CREATE TABLE t (id INTEGER PRIMARY KEY, prev INTEGER)", "CREATE TABLE log (id INTEGER)", "CREATE TRIGGER a AFTER INSERT ON t BEGIN INSERT INTO log VALUES (NEW.id); DELETE FROM log WHERE id = NEW.prev; END",
               "INSERT INTO t SELECT n_nationkey + 1, (n_nationkey + 1) % 3 * 5 FROM nation WHERE n_nationkey < 6 ORDER BY n_nationkey", "SELECT id FROM log"),
        # Row by row: 1 (deletes 5), 2 (10), 3 (0), 4 (5), 5 (10), 6 (0).
        "SELECT * FROM (VALUES (CAST(1 AS BIGINT)), (2), (3), (4), (5), (6)) v(id)",
    ),
    "trigger_row_order": (
        _after("CREATE TABLE t (id INTEGER PRIMARY KEY, prev INTEGER)", "CREATE TABLE log (id INTEGER)", "CREATE TRIGGER a AFTER INSERT ON t BEGIN INSERT INTO log VALUES (NEW.id); DELETE FROM log WHERE id = NEW.prev; END", "INSERT INTO t VALUES (1, 2), (2, 1)", "SELECT id FROM log"),
        "SELECT CAST(2 AS BIGINT) AS id",
    ),
    "trigger_cascade": (
        _after(*_ORDERS, "CREATE TABLE a (id INTEGER)", "CREATE TABLE b (id INTEGER)", "CREATE TRIGGER one AFTER DELETE ON t BEGIN INSERT INTO a VALUES (OLD.id); END", "CREATE TRIGGER two AFTER INSERT ON a BEGIN INSERT INTO b VALUES (NEW.id * 2); END", "DELETE FROM t WHERE status = 'P'", "SELECT id FROM b"),
        "SELECT o_orderkey * 2 AS id FROM orders WHERE o_orderstatus = 'P'",
    ),
    "refused_statements": (_refused, "SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS name, CAST(p_size AS BIGINT) AS size, CAST(4 AS BIGINT) AS refused FROM part"),
    "restart": (_restarted, "SELECT o_orderkey AS id, 'dear' AS what FROM orders WHERE o_totalprice > 300000 AND o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, 'log' FROM orders WHERE o_orderstatus = 'P'"),
    "affected_rows": (_counts, "WITH n AS (SELECT count(*) FILTER (WHERE o_custkey < 100) AS few, count(*) AS all_ FROM orders) SELECT * FROM (SELECT CAST(0 AS BIGINT) AS statement, all_ AS n FROM n UNION ALL SELECT 1, 1 UNION ALL SELECT 2, few FROM n UNION ALL SELECT 3, few FROM n UNION ALL SELECT 4, 0)"),
    "kv_single_puts": (_single_puts, "SELECT * FROM (VALUES ('a', '1x'), ('c', '3')) v(key, value)"),
    "replication_after_compaction": (_replication_after_compaction, "SELECT replica, CAST(user_id AS VARCHAR) AS key, CAST(coalesce(max(event_id) FILTER (WHERE event_id % 2 = 1), max(event_id)) AS VARCHAR) AS value FROM events, (VALUES (0), (1)) r(replica) GROUP BY replica, user_id"),
    "txn_rollback": (_txn, f"{_SAME} UNION ALL SELECT -1, -1, 'X', 1.5"),
    "kv_latest": (_kv, "SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'"),
    "replication_apply": (_replication, "SELECT CAST(user_id AS VARCHAR) AS key, CAST(coalesce(max(event_id) FILTER (WHERE event_id % 2 = 1), max(event_id)) AS VARCHAR) AS value FROM events GROUP BY user_id"),
    "replication_late_duplicates": (_late_stream, _LATEST),
}


def _select(name: str) -> Callable[[SparkSession, str], DataFrame]:
    sql, _, *rest = SELECTS[name]
    params, mode = (*rest, (), "standard")[:2] if len(rest) == 2 else (rest[0] if rest else (), "standard")
    return lambda spark, sf_dir: engine_on(spark, sf_dir, mode).query(0, sql, params).df


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _select(name) for name in SELECTS}
    for name, (story, _) in STORIES.items():
        out[name] = lambda spark, sf_dir, tell=story: tell(engine_on(spark, sf_dir))
    return out


def oracle_sql() -> dict[str, str]:
    return {n: x[1] or x[0] for n, x in SELECTS.items()} | {n: x[1] for n, x in STORIES.items()}
