"""Exact top-k inner products by dual-tree search over cover trees."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .workers import map_arrow

#: Rows of a candidate block and queries of a query block; query blocks that meet a candidate block in one task.
BLOCK, QUERIES, BUNDLE = 8192, 4096, 8
#: Most children of a node of the tree's two upper levels, and the rows that a node's are picked from.
CENTRES, SAMPLE = 128, 4096
LEAF, FANOUT = 512, 32
_NONE = np.iinfo(np.int64).min


@dataclass
class Node:
    """A cover tree's node: every row of it lies within ``radius`` of ``centre``."""

    centre: np.ndarray
    radius: float
    norm: float
    rows: np.ndarray
    children: list[Node] = field(default_factory=list)


def cover_tree(x: np.ndarray, rows: np.ndarray | None = None, leaf: int = LEAF) -> Node | None:
    """A cover tree over the rows of ``x``.

    A node holds a centre and all its rows lie within its radius, which is measured. Its children's
    centres are rows more than half the radius apart, the first being its own centre (nesting,
    separation), and each row belongs to the nearest child. Children are added until every row is
    within half the radius, but no more than FANOUT: where rows lie so far apart that these don't
    do, a child's radius may be more than half its parent's, and its own children separate the
    rest. Nodes with few rows, or whose rows are all equal, are leaves.
    """
    rows = np.arange(len(x)) if rows is None else rows
    if not len(rows):
        return None
    start = int(rows[0])
    root = _node(x, start, rows)
    stack = [(root, start)]
    while stack:
        node, centre = stack.pop()
        if len(node.rows) <= leaf or node.radius == 0:
            continue
        half = node.radius / 2
        own = x[node.rows]
        best = np.full(len(own), np.inf)
        who = np.zeros(len(own), np.int64)
        centres: list[int] = []
        pick = int(np.flatnonzero(node.rows == centre)[0])
        while True:
            d = np.sqrt(((own - own[pick]) ** 2).sum(1))
            nearer = d < best
            who[nearer], best[nearer] = len(centres), d[nearer]
            centres.append(int(node.rows[pick]))
            pick = int(best.argmax())
            if best[pick] <= half:
                break
            if len(centres) >= FANOUT:
                break
        if len(centres) == 1:
            node.radius = float(best.max())
            if node.radius > 0:
                stack.append((node, centre))
            continue
        for k, c in enumerate(centres):
            mine = node.rows[who == k]
            if len(mine):
                child = _node(x, c, mine)
                node.children.append(child)
                if len(mine) < len(node.rows):
                    stack.append((child, c))
    return root


def _node(x: np.ndarray, centre: int, rows: np.ndarray) -> Node:
    radius = float(np.sqrt(((x[rows] - x[centre]) ** 2).sum(1).max()))
    return Node(x[centre], radius, float(np.sqrt((x[centre] ** 2).sum())), rows)


def bound(a: Node, b: Node) -> float:
    """No inner product between rows of two nodes exceeds this (the slack covers rounding)."""
    top = float(a.centre @ b.centre) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
    return top + 1e-9 * abs(top) + 1e-6


class Best:
    """The k best (score, smallest id) of each query so far, and a floor from elsewhere below which nothing counts."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.score = np.full((queries, k), _NONE, np.int64)
        self.id = np.full((queries, k), np.iinfo(np.int64).max, np.int64)

    def kth(self, rows: np.ndarray) -> int:
        """The worst kth score of a group of queries."""
        return int(np.maximum(self.score[rows, -1], self.floor[rows]).min())

    def offer(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """``score``: rows x candidates; _NONE where a candidate is not for a query."""
        level = np.maximum(self.score[rows, -1], self.floor[rows])
        for i in np.flatnonzero((score >= level[:, None]).any(1)):
            q = rows[i]
            take = np.flatnonzero((score[i] >= level[i]) & (score[i] != _NONE))
            s, d = np.concatenate([self.score[q], score[i, take]]), np.concatenate([self.id[q], ids[take]])
            order = np.lexsort((d, ~s))[: self.k]  # ~ turns the order round without overflow
            self.score[q], self.id[q] = s[order], d[order]


def _reach(a: np.ndarray, b: np.ndarray) -> float:
    """No partial sum of inner products of rows is larger."""
    return float(np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1]))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of whole-number doubles, clipped to longs."""
    if _reach(a, b) < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])(a) @ np.vectorize(int, otypes=[object])(b).T
    return np.vectorize(lambda v: min(max(v, -(2**63) + 1), 2**63 - 1), otypes=[np.int64])(exact)


def dual_search(queries: np.ndarray, query_rows: np.ndarray, floor: np.ndarray, candidates: np.ndarray, ids: np.ndarray, rows_of: np.ndarray, k: int, tree: Node | None = None) -> Best:
    """Descend both trees together, best bounds first; drop a pair of nodes whose bound is below the query node's worst kth score.

    A candidate whose number in ``rows_of`` is the query's in ``query_rows`` is the query itself.
    """
    best = Best(len(queries), k, floor)
    exact = _reach(queries, candidates) < 2**53  # doubles hold every product
    a, b = cover_tree(queries, leaf=LEAF // 2), tree or cover_tree(candidates)
    stack = [(bound(a, b), a, b)] if a and b else []
    while stack:
        top, q, c = stack.pop()
        if top < best.kth(q.rows):  # a tie may still win by its id
            continue
        if not q.children and not c.children:
            for at in range(0, len(q.rows), 512):
                rows = q.rows[at : at + 512]
                for to in range(0, len(c.rows), 4096):
                    own = c.rows[to : to + 4096]
                    score = (queries[rows] @ candidates[own].T).astype(np.int64) if exact else products(queries[rows], candidates[own])
                    score[query_rows[rows][:, None] == rows_of[own][None, :]] = _NONE
                    best.offer(rows, score, ids[own])
            continue
        wide = c.children and (not q.children or c.radius >= q.radius)
        pairs = [(q, x) for x in c.children] if wide else [(x, c) for x in q.children]
        stack += sorted(((bound(x, y), x, y) for x, y in pairs), key=lambda p: p[0])
    return best


def _floats(column) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _valid(c: Column) -> Column:
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _centres(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first centres: the top of a cover tree over the sample."""
    out, far = [sample[0]], np.full(len(sample), np.inf)
    while len(out) < n:
        far = np.minimum(far, ((sample - out[-1]) ** 2).sum(1))
        pick = int(far.argmax())
        if far[pick] == 0:
            break
        out.append(sample[pick])
    return np.array(out)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre, the first of equals, and the distance."""
    best, who = np.full(len(x), np.inf), np.zeros(len(x), np.int32)
    for j in range(len(centres)):
        d = ((x - centres[j]) ** 2).sum(1)
        nearer = d < best
        who[nearer], best[nearer] = j, d[nearer]
    return who, np.sqrt(best)


_PLACED = "row long, id long, v array<double>, dim int, c int, far double"


def _place(rows: DataFrame, centres: dict[tuple[int, int | None], np.ndarray], level: int) -> DataFrame:
    """Give every row its nearest centre of the first level, or of its node's on the second; nodes without centres stay."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)  # CENTRES a node at most, so CENTRES squared for a vector length

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            node = batch.column("c").to_numpy() if level else np.zeros(len(size), np.int32)
            for dim, c in {*zip(size.tolist(), node.tolist())}:
                at = pa.array(np.flatnonzero((size == dim) & (node == c)))
                row, ids, v = (batch.column(k).take(at) for k in ("row", "id", "v"))
                own = sent.value.get((dim, c if level else None))
                if own is None and level:
                    who, far = np.full(len(at), c * CENTRES, np.int32), batch.column("far").take(at).to_numpy()
                else:
                    who, far = _nearest(_floats(v), np.zeros((1, dim)) if own is None else own)
                    who = who + np.int32(c * CENTRES) if level else who
                yield pa.RecordBatch.from_arrays([row, ids, v, pa.array(np.full(len(at), dim, np.int32)), pa.array(who.astype(np.int32)), pa.array(far)], ["row", "id", "v", "dim", "c", "far"])

    return map_arrow(rows, assign, _PLACED)


def top_k(vectors: DataFrame, k: int = 20, *, scale: float = 64.0, query_every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` highest integer inner products of every query with all other rows.

    Components become floor(scale * x). Queries are rows whose id is divisible by ``query_every``;
    candidates, all rows but the query's own. Returns query_id, rank (from 1), vec_id and score,
    ties to the smaller vec_id; all candidates if fewer than ``k``. Rows with a null id, and vectors
    that are null, empty or hold null or non-finite components, take no part; vectors of different
    lengths have no product and don't meet; rows that share an id all ask, each with an answer of
    its own, and are candidates of their own, for each other too. Scores beyond a long are clipped.
    Other columns are left out; an empty table gives no rows.

    The two upper levels of the tree have bounded sets of centres, picked from samples of SAMPLE
    rows or so a node; every row joins its nearest centre, and the leaves' covering radii come from
    all rows. A leaf that is still large is cut into blocks by a hash. First each query block
    searches one block of its leaf, which gives every query a floor; then leaves whose bound lies
    below a query block's worst floor are dropped, by numbers alone. Only then do vectors move: a
    task searches a block of candidates for BUNDLE neighbouring query blocks, and sends on at most
    ``k`` rows a query, of those that reach its floor.
    """
    spark = vectors.sparkSession
    slim = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & _valid(F.col("v")))

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            lists = pa.ListArray.from_arrays(_offsets(v), pa.array(np.floor(scale * v.flatten().to_numpy(zero_copy_only=False))))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "v"])

    rows, _ = store.materialize(map_arrow(slim, integers, "id long, v array<double>"), "vectors")
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # of written files; written itself with the first placing
    total = rows.count()
    per_dim: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id", "v")).limit(SAMPLE).collect():
        per_dim.setdefault(len(r["v"]), []).append(r["v"])
    wanted = min(CENTRES, max(1, math.ceil(total / BLOCK)))
    first = {(d, None): _centres(np.array(x), wanted) for d, x in per_dim.items()}
    placed, placed_at = store.materialize(_place(rows, first, 0), "placed")
    # Nodes that hold more than a block: at most CENTRES for each vector length.
    large = placed.groupBy("dim", "c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)

    def pick(table: pa.Table) -> pa.Table:
        dim, c, n = (table.column(x)[0].as_py() for x in ("dim", "c", "n"))
        found = _centres(_floats(table.column("v").combine_chunks()), min(CENTRES, math.ceil(n / BLOCK) + 1))
        return pa.table({"dim": pa.array([dim] * len(found), pa.int32()), "c": pa.array([c] * len(found), pa.int32()), "v": pa.array(found.tolist(), pa.list_(pa.float64()))})

    sample = placed.join(F.broadcast(large), ["dim", "c"]).where(F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / SAMPLE)) == 0)
    second: dict[tuple[int, int], list] = {}
    for r in sample.select("dim", "c", "n", "v").groupBy("dim", "c").applyInArrow(pick, "dim int, c int, v array<double>").collect():
        second.setdefault((r["dim"], r["c"]), []).append(r["v"])
    second = {node: np.array(x) for node, x in second.items()}
    placed, _ = store.materialize(_place(placed, second, 1), "placed")
    store.drop(spark, placed_at)
    is_query = F.pmod("id", F.lit(query_every)) == 0
    # At most CENTRES squared rows for each vector length.
    leaves = placed.groupBy("dim", "c").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"), F.max(F.when(is_query, F.col("far"))).alias("query_radius"), F.count_if(is_query).alias("queries")).orderBy("dim", "c").collect()
    if not any(g["queries"] for g in leaves):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def centre(dim: int, c: int) -> np.ndarray:
        if (own := second.get((dim, c // CENTRES))) is not None:
            return own[c % CENTRES]
        return first[dim, None][c // CENTRES] if (dim, None) in first else np.zeros(dim)

    tops: dict[int, tuple] = {}  # by vector length: leaves, centres, radii, radii of queries, blocks
    for dim in {g["dim"] for g in leaves}:
        own = [g for g in leaves if g["dim"] == dim]
        tops[dim] = (np.array([g["c"] for g in own]), np.array([centre(dim, g["c"]) for g in own]), np.array([g["radius"] for g in own]), np.array([g["query_radius"] or 0.0 for g in own]), [math.ceil(g["n"] / BLOCK) for g in own])
    sent = spark.sparkContext.broadcast(tops)
    dealt, at = [], 0
    for g in leaves:
        parts = math.ceil(g["queries"] / QUERIES)
        dealt.append((g["dim"], g["c"], math.ceil(g["n"] / BLOCK), parts, at))
        at += parts
    dealt = F.broadcast(spark.createDataFrame(dealt, "dim int, c int, blocks int, parts int, first long"))  # a row for each leaf
    candidates = placed.join(dealt, ["dim", "c"]).select("dim", "c", F.pmod(F.xxhash64("row", F.lit(1)), F.col("blocks")).cast("int").alias("s"), "row", "id", "v")
    queries = placed.where(is_query).join(dealt, ["dim", "c"]).select("dim", (F.col("first") + F.pmod(F.xxhash64("row", F.lit(2)), F.col("parts"))).alias("b"), F.col("c").alias("own"), "row", "id", "v")
    queries, _ = store.materialize(queries, "queries")

    def search(qt: pa.Table, ct: pa.Table) -> pa.Table:
        out = []
        if qt.num_rows and ct.num_rows:
            candidates, ids, rows_of = _floats(ct.column("v").combine_chunks()), ct.column("id").to_numpy(), ct.column("row").to_numpy()
            tree, blocks = cover_tree(candidates), qt.column("b").to_numpy()
            for b in np.unique(blocks):
                own = qt.take(pa.array(np.flatnonzero(blocks == b)))
                numbers, names = own.column("row").to_numpy(), own.column("id").to_numpy()
                best = dual_search(_floats(own.column("v").combine_chunks()), numbers, own.column("floor").to_numpy(), candidates, ids, rows_of, k, tree)
                q, j = np.nonzero(best.score != _NONE)
                out.append((numbers[q], names[q], best.id[q, j], best.score[q, j]))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(x, pa.int64()) for x in columns], ["row", "query_id", "vec_id", "score"])

    answers = "row long, query_id long, vec_id long, score long"
    # Round 1: every query block against block 0 of its own leaf.
    bundle = (F.col("b") / BUNDLE).cast("long").alias("bundle")
    keys = ["dim", "c", "s", "bundle"]
    seeds = candidates.where("s = 0").join(dealt.where("parts > 0"), ["dim", "c"]).withColumn("bundle", F.explode(F.sequence((F.col("first") / BUNDLE).cast("long"), ((F.col("first") + F.col("parts") - 1) / BUNDLE).cast("long"))))
    asked = queries.select("dim", F.col("own").alias("c"), F.lit(0).alias("s"), bundle, "b", "row", "id", "v", F.lit(_NONE).alias("floor"))
    nearby = asked.groupBy(*keys).cogroup(seeds.select(*keys, "row", "id", "v").groupBy(*keys)).applyInArrow(search, answers)
    floors = nearby.groupBy("row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    floored, floored_at = store.materialize(queries.join(floors, "row", "left").select("dim", "b", "own", "row", "id", "v", F.coalesce("floor", F.lit(_NONE)).alias("floor")), "floors")

    # Round 2: the leaves that may still hold a better or equal score, for each query block.
    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                cs, x, radius, query_radius, blocks = sent.value[r["dim"]]
                me = int(np.searchsorted(cs, r["own"]))
                norms = np.sqrt((x**2).sum(1))
                top = x @ x[me] + norms[me] * radius + norms * query_radius[me] + query_radius[me] * radius
                floor = float(r["floor"])
                hit = np.flatnonzero(top + 1e-9 * np.abs(top) + 1e-6 >= floor - abs(floor) * 1e-9)
                pairs = [(int(cs[i]), p) for i in hit for p in range(blocks[i])]
                yield pa.RecordBatch.from_arrays([pa.array([r["dim"]] * len(pairs), pa.int32()), pa.array([r["b"]] * len(pairs), pa.int64()), pa.array([c for c, _ in pairs], pa.int32()), pa.array([p for _, p in pairs], pa.int32())], ["dim", "b", "c", "s"])

    worst = floored.groupBy("dim", "own", "b").agg(F.min("floor").alias("floor"))
    pairs, pairs_at = store.materialize(map_arrow(worst, reached, "dim int, b long, c int, s int"), "pairs")
    asked = spark.read.parquet(floored_at).join(pairs, ["dim", "b"]).select("dim", "c", "s", bundle, "b", "row", "id", "v", "floor")
    needed = spark.read.parquet(pairs_at).select("dim", "c", "s", bundle).distinct()
    offered = candidates.join(needed, ["dim", "c", "s"]).select(*keys, "row", "id", "v")
    found = asked.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInArrow(search, answers)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _offsets(v: pa.ListArray) -> pa.Array:
    lengths = v.value_lengths().to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
