import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from quillspark.llm import embed_dedup, topk

SCHEMA = "vec_id long, embedding array<float>, label int, v int, n int"


def make(rng, n, dim=16, labels=3):
    centres = rng.standard_normal((labels * 4, dim))
    rows = []
    for i in range(n):
        c = int(rng.integers(0, len(centres)))
        x = centres[c] + rng.standard_normal(dim) * rng.choice([0.02, 0.15, 0.25, 1.0])
        rows.append([i, [float(v) for v in x.astype(np.float32)], c % labels])
    for i in range(n // 10):  # exact copies
        rows.append([n + i, rows[i % 7][1], rows[i % 7][2]])
    bad = [None, [], [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] * dim, [None] + [1.0] * (dim - 1), [1.0, 2.0], [1.0, 2.0]]
    rows += [[2 * n + i, b, 0] for i, b in enumerate(bad)] + [[3 * n, rows[0][1], None], [3 * n + 1, rows[0][1], None]]
    return [(*r, 0, 1) for r in rows]


def brute_links(rows, least):
    good = {i: (np.array(v, float), lab) for i, v, lab, *_ in rows if v and lab is not None and None not in v and all(map(math.isfinite, v)) and any(v)}
    out = defaultdict(set)
    ids = list(good)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            (a, p), (b, q) = good[i], good[j]
            if p == q and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= least:
                out[i].add(j)
                out[j].add(i)
    return out


@pytest.mark.parametrize(("cell", "block"), [(4096, 2048), (24, 8)])
def test_embedding_duplicates(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embed_dedup, "CELL", cell)
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rows = make(np.random.default_rng(5), 260)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(df).collect()}
    want = brute_links(rows, 0.93)
    assert set(got) == {r[0] for r in rows}
    total = sum(len(v) for v in want.values())
    found = sum(r["n_links"] for r in got.values())
    assert all(got[i]["n_links"] <= len(want.get(i, ())) for i in got), "a link below the least cosine"
    assert found >= 0.97 * total
    reach = {}
    for i in sorted(got):
        if i not in reach:
            stack = [i]
            while stack:
                u = stack.pop()
                if u not in reach:
                    reach[u] = i
                    stack += want.get(u, ())
    assert sum(got[i]["component_id"] == reach[i] for i in got) >= 0.97 * len(got)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert all(got[r[0]]["n_links"] == 0 and got[r[0]]["kept"] for r in rows if r[2] is None)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embedding_duplicates_with_null_and_repeated_ids(spark, kind):
    one, near, far = [1.0, 0.0, 0.0], [1.0, 0.125, 0.0], [0.0, 0.0, 1.0]
    rows = [(None, one, 1, "x"), (5, one, 1, "x"), (5, near, 1, None), (None, far, 1, "x"), (7, far, 2, "x"), (8, [1e300 if kind == "double" else 1e30, 0.0, 0.0], 1, "x")]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, class string")
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in embed_dedup.near_duplicates(df).collect())
    assert got == [("5", 3, "5", True), ("5", 3, "5", True), ("7", 0, "7", True), ("8", 3, "5", False), ("None", 0, "None", False), ("None", 3, "5", False)]


def test_calibration():
    rng = np.random.default_rng(0)
    needed = embed_dedup.least_count(0.93)
    a = embed_dedup._unit(rng.standard_normal((4000, 64)))
    other = rng.standard_normal((4000, 64))
    other = embed_dedup._unit(other - (other * a).sum(1, keepdims=True) * a)
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * other
    p = embed_dedup._directions(64, embed_dedup.PROJECTIONS, 1)
    hits = (np.abs((a - b) @ p) <= embed_dedup.HALF_WIDTH).sum(1)
    assert (hits >= needed).mean() > 0.97
    assert (embed_dedup.collisions(a[:50] @ p, b[:80] @ p) == (np.abs((a[:50] @ p)[:, None] - (b[:80] @ p)[None]) <= embed_dedup.HALF_WIDTH).sum(2)).all()
    k, tables = embed_dedup.layout(10**7, 0.93)
    assert k > 5 and tables < 60


def brute_top(rows, k, every):
    good = [(i, [math.floor(64 * float(x)) for x in v]) for i, v, *_ in rows if i is not None and v and None not in v and all(map(math.isfinite, v))]
    out = {}
    for i, v in good:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i and len(w) == len(v))
            out[i] = [(j, -s) for s, j in scores[:k]]
    return out


@pytest.mark.parametrize(("block", "queries", "centres", "sample"), [(8192, 4096, 128, 4096), (40, 4, 128, 4096), (20, 2, 3, 60)])
def test_top_k(spark, monkeypatch, block, queries, centres, sample):
    for name, value in (("BLOCK", block), ("QUERIES", queries), ("CENTRES", centres), ("SAMPLE", sample)):
        monkeypatch.setattr(topk, name, value)
    rows = [*make(np.random.default_rng(9), 300), (None, [1.0] * 16, 1, 0, 1), (-40, [0.5] * 16, 1, 0, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = defaultdict(list)
    for r in topk.top_k(df, 20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    want = brute_top(rows, 20, 20)
    assert set(got) == {q for q, v in want.items() if v}
    for q, best in got.items():
        assert best == want[q], q
    assert topk.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [8192, 10])
def test_rows_that_share_an_id_all_ask(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(8)
    rows = [(i % 30, [float(x) for x in rng.integers(-3, 3, 4)]) for i in range(90)] + [(0, [1.0, 0.0, 0.0, 0.0])] * 3
    got = defaultdict(list)
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5).collect():
        got[r["query_id"], r["rank"]].append((r["score"], r["vec_id"]))
    want = defaultdict(list)
    for n, (i, v) in enumerate(rows):
        if i % 20 == 0:
            others = sorted((-int(sum(64 * 64 * a * b for a, b in zip(v, w))), j) for m, (j, w) in enumerate(rows) if m != n)
            for rank, (s, j) in enumerate(others[:5], 1):
                want[i, rank].append((-s, j))
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}


def test_cover_tree_invariants():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-20, 20, (400, 5)), np.repeat(rng.integers(-20, 20, (1, 5)), 300, 0)]).astype(float)
    stack, leaves = [topk.cover_tree(x, leaf=8)], []
    while stack:
        node = stack.pop()
        assert (np.sqrt(((x[node.rows] - node.centre) ** 2).sum(1)) <= node.radius + 1e-9).all()
        if node.children:
            assert sorted(r for c in node.children for r in c.rows) == sorted(node.rows)
            assert (node.children[0].centre == node.centre).all()
            apart = [np.sqrt(((a.centre - b.centre) ** 2).sum()) for i, a in enumerate(node.children) for b in node.children[:i]]
            assert min(apart) > node.radius / 2 - 1e-9 and len(node.children) <= topk.FANOUT
            assert len(node.children) == topk.FANOUT or all(c.radius <= node.radius / 2 + 1e-9 for c in node.children)
            stack += node.children
        else:
            leaves.append(node)
            assert len(node.rows) <= 8 or node.radius == 0
    assert sum(len(n.rows) for n in leaves) == len(x)


def test_dual_search_prunes_and_is_exact():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((10, 8)) * 60
    x = np.floor(centres[rng.integers(0, 10, 2000)] + rng.standard_normal((2000, 8)))
    ids = rng.permutation(2000)
    q = x[:50]
    best = topk.dual_search(q, np.arange(50), np.full(50, topk._NONE), x, ids, np.arange(2000), 5)
    for i in range(50):
        s = sorted((-int(v), int(d)) for v, d in zip(x @ q[i], ids) if d != ids[i])[:5]
        assert [(-int(a), int(b)) for a, b in zip(best.score[i], best.id[i])] == s


def test_huge_products_are_exact():
    a = np.array([[2.0**40, 3.0], [1.0, -(2.0**52)]])
    assert topk.products(a, a).tolist() == [[min(2**80 + 9, 2**63 - 1), 2**40 - 3 * 2**52], [2**40 - 3 * 2**52, 2**63 - 1]]


def test_schema_of_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert isinstance(topk.top_k(empty).schema["rank"].dataType, T.IntegerType)
