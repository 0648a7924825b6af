import random
import re

import numpy as np
import xxhash

from quillspark.llm import simhash, store
from quillspark.llm.components import connected_components


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    own = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not own:
        return 0
    shingles = [" ".join(own[i : i + 4]) for i in range(max(1, len(own) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """id -> smallest id reachable, by comparing all pairs."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_masks_cover_every_pair():
    rng = random.Random(0)
    masks = simhash.covering_masks(list(range(64)))
    assert len(masks) == 31 and all(28 <= m.bit_count() <= 36 for m in masks)
    for bits in (list(range(64)), list(range(3, 40)), [5, 9, 11]):
        masks = simhash.covering_masks(bits)
        for _ in range(3000):
            diff = sum(1 << b for b in rng.sample(bits, min(len(bits), rng.randint(0, 4))))
            assert any(not m & diff for m in masks)


def test_documents(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    texts = [None, "", " \t", "One", "one", "ONE two", "a\x1cb c\x85d é\xa0f", "x " * 3000]
    for _ in range(60):
        own = rng.choices(vocabulary, k=rng.randint(5, 400))
        texts.append(" ".join(own))
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(own)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append("\n".join(copy))
    docs = spark.createDataFrame([(i * 7 % 1009, t, 0, 1) for i, t in enumerate(texts)], "doc_id long, text string, fp int, component int")
    prints = {i * 7 % 1009: brute_print(t) for i, t in enumerate(texts)}
    want = brute_components(prints)
    for cap in (4096, 2):
        monkeypatch.setattr(simhash, "CAP", cap)
        rows = simhash.near_duplicates(docs).collect()
        assert len(rows) == len(texts)
        assert {r["doc_id"]: int(r["fingerprint"], 16) for r in rows} == prints
        assert {r["doc_id"]: r["component_id"] for r in rows} == want
        assert all(len(r["fingerprint"]) == 16 for r in rows)
    kept = {r["doc_id"] for r in simhash.deduplicated(docs).collect()}
    assert kept == set(want.values())
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "zz"), (5, "a b c"), (5, "a b c"), (3, "a b c"), (5, "q w e r t")], "doc_id long, text string")
    rows = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert rows == sorted([(None, 3), (None, None), (5, 3), (5, 3), (3, 3), (5, 5)], key=str)


def test_chains_and_dense_balls(spark, monkeypatch):
    rng = np.random.default_rng(1)
    center = int(rng.integers(0, 2**63))
    ball = {center ^ int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))) for _ in range(400)}
    chain = [int(rng.integers(0, 2**63))]
    for _ in range(50):
        chain.append(chain[-1] ^ int(sum(1 << int(b) for b in rng.choice(64, 4, replace=False))))
    alone = [int(x) for x in rng.integers(0, 2**63, 200)]
    values = sorted({*ball, *chain, *alone})
    prints = dict(enumerate(values))
    want = brute_components(prints)
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    for cap in (4096, 20):
        monkeypatch.setattr(simhash, "CAP", cap)
        found = {r["id"] & (2**64 - 1): r["component"] & (2**64 - 1) for r in connected_components(simhash.links(df)).collect()}
        groups, wanted = {}, {}
        for i, v in prints.items():
            groups.setdefault(found.get(v, v), set()).add(i)
            wanted.setdefault(want[i], set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5200)] + [(None, 1), (7, 7)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plans_of(monkeypatch, act):
    """What ``act`` returns, and the plans of the tables that it wrote."""
    plans, write = [], store.materialize

    def noted(df, name):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return write(df, name)

    monkeypatch.setattr(store, "materialize", noted)
    return act(), plans


def chains(spark):
    """Texts of few words and copies of them, whose fingerprints link some."""
    rng = random.Random(5)
    base = [[rng.choice("abcdefgh") * 3 for _ in range(120)] for _ in range(8)]
    texts = [" ".join(w[:k] + ["x"] + w[k + 1 :]) for w in base for k in range(110, 116)]
    return spark.createDataFrame([(i, texts[i % len(texts)]) for i in range(2 * len(texts))], "doc_id long, text string")


def test_tables_beyond_the_bound_are_not_broadcast(spark, monkeypatch):
    docs = chains(spark)
    small = sorted(map(tuple, simhash.near_duplicates(docs).collect()))
    assert len({c for *_, c in small}) < len({f for _, f, _ in small})
    monkeypatch.setattr(store, "BROADCAST_ROWS", 0, raising=False)
    large, plans = plans_of(monkeypatch, lambda: simhash.near_duplicates(docs))
    plans.append(large._jdf.queryExecution().sparkPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 4
    assert not any("Broadcast" in p for p in plans)
    assert sorted(map(tuple, large.collect())) == small


def test_buckets_are_not_broadcast(spark, monkeypatch):
    prints, _ = store.materialize(simhash.fingerprints(chains(spark)).select("fp").distinct(), "prints")
    _, plans = plans_of(monkeypatch, lambda: simhash.links(prints))
    assert "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]


def test_dropped_ids_beyond_the_bound_are_not_broadcast(spark, monkeypatch):
    docs = chains(spark)
    small = sorted(map(tuple, simhash.deduplicated(docs).collect()))
    monkeypatch.setattr(store, "BROADCAST_ROWS", 0, raising=False)
    large = simhash.deduplicated(docs)
    assert "Broadcast" not in large._jdf.queryExecution().sparkPlan().toString()
    assert sorted(map(tuple, large.collect())) == small
