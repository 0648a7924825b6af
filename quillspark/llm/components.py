"""Connected components by alternating large and small stars, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: longs a, b. Returns (id, component): the smallest id reachable from each id.

    Null ends and loops are ignored, repeated edges count once; no edges give no rows. Each round
    joins edges with one minimum per node, so a hub with a third of all edges is only a skewed
    join side that adaptive execution splits; no node's neighbours are gathered. Every round is
    written to the shared folder, and the previous one is deleted.
    """
    spark = edges.sparkSession
    start = (
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    now, path = store.materialize(start, "edges")
    seen = _digest(now)
    while seen[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(store.joinable(least, 2 * seen[0]), "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        floor = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(store.joinable(floor, seen[0]), "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after, to = store.materialize(moved.unionAll(floor.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        store.drop(spark, path)
        path, now = to, after
        digest = _digest(now)
        if digest == seen:
            break
        seen = digest
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionAll(now.select("lo", "lo").distinct())


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())
