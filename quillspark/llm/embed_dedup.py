"""Embedding near-duplicates by collision counting over one-dimensional projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .components import connected_components
from .workers import map_arrow

LEAST = 0.93
#: Projections counted, half width of a query's window in each, and the share of pairs at the least
#: similarity that the counted threshold must let through.
PROJECTIONS, HALF_WIDTH, RECALL = 16, 0.75, 0.998
#: Classes that a cell aims at and a block holds, cell width, and the share of pairs that some table must bring together.
CELL, BLOCK, CELL_WIDTH, TABLE_RECALL = 4096, 2048, 2.0, 0.99
_SEED = 20240229


def _normal_within(x: float, sigma: float) -> float:
    return math.erf(x / sigma / math.sqrt(2))


def least_count(least: float, projections: int = PROJECTIONS, half_width: float = HALF_WIDTH, recall: float = RECALL) -> int:
    """The largest count that a pair of unit vectors at similarity ``least`` reaches with probability ``recall``.

    Their difference projects to a normal variable with the pair's distance as deviation, so window
    collisions are binomial; nearer pairs collide more often.
    """
    p = _normal_within(half_width, math.sqrt(2 - 2 * least))
    tail = 0.0
    for k in range(projections, -1, -1):
        tail += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if tail >= recall:
            return k
    return 0


def layout(largest: int, least: float) -> tuple[int, int]:
    """(cell coordinates K, tables T) for the largest label's number of classes.

    A table cuts space into cells by K projections on shifted grids. Far pairs share a coordinate
    with probability about 1/2, so K grows with the logarithm of the size and a cell stays near
    CELL; T tables bring a pair at the least similarity together with probability TABLE_RECALL.
    """
    k = max(0, math.ceil(math.log2(largest / CELL))) if largest > CELL else 0
    near = 1 - math.sqrt(2 - 2 * least) * math.sqrt(2 / math.pi) / CELL_WIDTH
    return k, 1 if k == 0 else math.ceil(math.log(1 - TABLE_RECALL) / math.log(1 - near**k))


def _directions(dim: int, n: int, salt: int) -> np.ndarray:
    """``n`` Gaussian directions, the same for the same arguments."""
    return np.random.default_rng([_SEED, salt, dim]).standard_normal((dim, n))


def _valid(c: Column) -> Column:
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(c.isNotNull() & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column whose rows are of one length as a matrix of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def collisions(queries: np.ndarray, candidates: np.ndarray, half_width: float = HALF_WIDTH) -> np.ndarray:
    """Number of projections in which each candidate falls into each query's window (queries x candidates).

    Each projection is sorted; a query's window is a stretch of the sorted order, found by binary search.
    """
    count = np.zeros((len(queries), len(candidates)), np.uint8)
    rank = np.empty(len(candidates), np.int32)
    for j in range(candidates.shape[1]):
        order = np.argsort(candidates[:, j])
        rank[order] = np.arange(len(candidates))
        line = candidates[order, j]
        low = np.searchsorted(line, queries[:, j] - half_width, "left").astype(np.int32)
        high = np.searchsorted(line, queries[:, j] + half_width, "right").astype(np.int32)
        # low <= rank < high, by one unsigned comparison
        count += (rank[None, :] - low[:, None]).view(np.uint32) < (high - low).view(np.uint32)[:, None]
    return count


def _bipartite_forest(linked: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Entries of ``linked`` (rows x columns; ``same``: both sides are the same vectors) that connect what all of them connect."""
    n, m = linked.shape
    if same:
        a, b, rest = [], [], np.ones(n, bool)
        for start in np.flatnonzero(linked.sum(1) > 0):
            if not rest[start]:
                continue
            rest[start] = False
            stack = [int(start)]
            while stack:
                u = stack.pop()
                new = np.flatnonzero(linked[u] & rest)
                rest[new] = False
                a.append(np.full(len(new), u))
                b.append(new)
                stack += new.tolist()
        return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))
    a, b, rows, columns = [], [], np.ones(n, bool), np.ones(m, bool)
    for start in np.flatnonzero(linked.any(1)):
        if not rows[start]:
            continue
        rows[start] = False
        stack = [int(start)]
        while stack:
            u = stack.pop()
            if u >= 0:
                new = np.flatnonzero(linked[u] & columns)
                columns[new] = False
                a.append(np.full(len(new), u))
                b.append(new)
                stack += (-1 - new).tolist()
            else:
                new = np.flatnonzero(linked[:, -1 - u] & rows)
                rows[new] = False
                a.append(new)
                b.append(np.full(len(new), -1 - u))
                stack += new.tolist()
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def near_duplicates(vectors: DataFrame, least: float = LEAST, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Link vectors of equal labels whose cosine is at least ``least``.

    Returns vec_id, n_links (other vectors linked directly), component_id (smallest vec_id
    reachable) and kept (vec_id = component_id). Vectors that are null, empty, zero or hold null or
    non-finite components, and rows without label, link with nothing and are components of their
    own; so are vectors of another length. Links are exact: each was verified in double precision.
    Those missed are pairs near ``least``: see ``least_count`` and ``layout``. Repeated ids stay
    rows of their own (their links count all rows); null ids come back with null components unless
    linked to others; other columns are left out; an empty table gives no rows.

    Equal vectors become one weighted class by a partial aggregation. A class goes to one cell of
    each table, cells are cut into blocks, and a task compares two blocks: it counts collisions,
    verifies by a product, and emits a count for each class and a spanning forest, never pairs: a
    group of near copies would otherwise give all of its pairs, so vectors go to the tasks, in the
    precision that they came in, and not to pairs. A pair that meets in several tables counts in the
    first of them.
    """
    with store.keeping_only(vectors.sparkSession) as kept:
        stored = "array<float>" if vectors.select(vector_col).dtypes[0][1] == "array<float>" else "array<double>"  # single precision is enough where it is what was given
        slim = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast(stored).alias("v"), F.col(label_col).cast("string").alias("label"))
        rows, rows_at = store.materialize(slim.withColumn("valid", F.col("label").isNotNull() & _valid(F.col("v"))), "vectors")
        classes, _ = store.materialize(rows.where("valid").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("w")).withColumn("class", F.monotonically_increasing_id()), "classes")
        largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
        k, tables = layout(largest, least)
        needed, half_width = least_count(least), HALF_WIDTH

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """For each table, the hash of the cell."""
            for batch in batches:
                size = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
                for dim in np.unique(size):
                    at = pa.array(np.flatnonzero(size == dim))
                    own = [c.take(at) for c in batch.columns]
                    u = _unit(_matrix(own[1]))
                    rng = np.random.default_rng([_SEED, 2, int(dim)])
                    keys = np.full((len(u), tables), int(dim), np.uint64)
                    for t in range(tables):
                        grid = np.floor((u @ rng.standard_normal((int(dim), k))) / CELL_WIDTH + rng.random(k)).astype(np.int64).astype(np.uint64)
                        for j in range(k):
                            keys[:, t] = (keys[:, t] ^ grid[:, j]) * np.uint64(0x9E3779B97F4A7C15)
                            keys[:, t] ^= keys[:, t] >> np.uint64(29)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))
                    yield pa.RecordBatch.from_arrays([own[0], own[2], own[3], own[1], lists], ["label", "w", "class", "v", "keys"])

        placed, _ = store.materialize(
            map_arrow(classes.select("label", "v", "w", "class"), cells, f"label string, w long, class long, v {stored}, keys array<long>"), "cells")
        dealt = placed.select("*", F.posexplode("keys").alias("t", "key"))
        sizes = dealt.groupBy("label", "t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / (BLOCK * 0.8)))
        # Each block meets itself and every other block of its cell: a class is copied once for each.
        own = F.pmod(F.xxhash64("class", "t"), F.col("blocks"))
        met = dealt.join(sizes, ["label", "t", "key"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        met = met.select("label", "t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "w", "class", "v", F.slice("keys", 1, F.col("t")).alias("keys"))

        def compare(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            t = table.column("t")[0].as_py()
            second = table.column("second").to_numpy()
            u, w, name = _unit(_matrix(table.column("v").combine_chunks())), table.column("w").to_numpy(), table.column("class").to_numpy()
            keys = np.array(table.column("keys").combine_chunks().flatten()).reshape(len(u), t)
            p = u @ _directions(u.shape[1], PROJECTIONS, 1)
            same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
            one, two = (np.arange(len(u)),) * 2 if same else (np.flatnonzero(~second), np.flatnonzero(second))
            linked = np.zeros((len(one), len(two)), bool)
            for at in range(0, len(one), 256) if len(two) else ():
                q = one[at : at + 256]
                passed = collisions(p[q], p[two], half_width) >= needed
                for earlier in range(t):
                    passed &= keys[q, earlier][:, None] != keys[two, earlier][None, :]
                if passed.any():
                    linked[at : at + 256] = passed & (u[q] @ u[two].T >= least)
            if same:
                np.fill_diagonal(linked, False)
                linked |= linked.T  # a product may round differently from its mirror image
            n = np.zeros(len(u), np.int64)
            n[one] += linked @ w[two]
            if not same:
                n[two] += w[one] @ linked
            a, b = _bipartite_forest(linked, same)
            has = np.flatnonzero(n)
            none = np.full(len(has), None)
            return pa.table({
                "a": pa.array(np.concatenate([name[one][a], name[has]]), pa.int64()),
                "b": pa.array([*name[two][b].tolist(), *none], pa.int64()),
                "n": pa.array(np.concatenate([np.zeros(len(a), np.int64), n[has]]), pa.int64()),
            })

        found, _ = store.materialize(met.groupBy("label", "t", "key", "i", "j").applyInArrow(compare, "a long, b long, n long"), "links")
        counts = found.where("b IS NULL").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
        joined = connected_components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("id", "class")
        rooted = classes.select("class", "rep", "w", "label", "v").join(joined, "class", "left").join(counts, "class", "left").withColumn("root", F.coalesce("component", "class"))
        smallest = rooted.groupBy("root").agg(F.min("rep").alias("smallest"))
        member, member_at = store.materialize(rooted.join(smallest, "root").select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "smallest"), "members")
        kept |= {rows_at, member_at}
    linked = rows.where("valid").join(member, ["label", "v"]).select("vec_id", "n_links", F.col("smallest").alias("component_id"))
    alone = rows.where("NOT valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
