import math
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import sharding


def docs_of(spark, n):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("é"), F.col("id")).alias("text"), F.lit(1).alias("rank"), F.lit(2).alias("shard"))


def test_contract(spark):
    extra = spark.sql("SELECT * FROM VALUES (null, null, 1, 2), (7L, '', 1, 2), (7L, '', 1, 2), (8L, 'x', 1, 2) AS t(doc_id, text, rank, shard)")
    rows = sharding.shard(docs_of(spark, 5000).unionByName(extra)).collect()
    assert len(rows) == 5004
    slots = defaultdict(list)
    for r in rows:
        text = {None: ""}.get(r["doc_id"])
        if text is None and r["size"] > 4:
            text = f"é{r['doc_id']}"
            assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode())
        assert 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16) and r["law"] == "key"
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(slots) == 16
    assert {r["size"] for r in rows if r["doc_id"] is None} == {1}
    shares = Counter(r["shard"] for r in rows)
    assert max(shares.values()) < 1.3 * 5000 / 16 and min(shares.values()) > 0.7 * 5000 / 16
    assert 0.6 * 5000 / 17 < sum(r["grown_shard"] == 16 for r in rows) < 1.4 * 5000 / 17
    assert len({r["shard"] for r in rows if r["doc_id"] == 7}) == 1
    assert sharding.shard(docs_of(spark, 0)).count() == 0


def plain(key, shards, weights=None, racks=2, slots=2):
    """The shard of a long key by loops over the tree."""
    w = list(weights or [1.0] * shards)
    w += [1.0] * (-len(w) % (racks * slots))

    def draw(level, node, weight):
        h = xxhash.xxh64_intdigest(struct.pack("<q", level), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<q", node), h)
        h = xxhash.xxh64_intdigest(struct.pack("<q", key), h)
        return -math.log(((h >> 11) + 0.5) / 2.0**53) / weight if weight > 0 else math.inf

    def subtree(level, node):
        """(draw, shards taken, slots) of each child, as far above the least as it draws."""
        n, span = {1: (racks, slots), 2: (slots, 1)}[level]
        children = [node * n + j for j in range(n)]
        own = [draw(level + 1, c, sum(w[c * span : (c + 1) * span])) for c in children]
        return [(d - min(own), c, span) for d, c in zip(own, children)]

    def best(level, node, at, span):
        """The least draw among taken shards below a node, and its shard."""
        if node * span >= shards:
            return math.inf, None
        if level == 3:
            return at, node
        if (node + 1) * span <= shards:  # taken whole: its draw is the least below it
            return at, best(level + 1, *min((d, c, s) for d, c, s in subtree(level, node))[1:2], at, span // {1: racks, 2: slots}[level])[1]
        return min(best(level + 1, c, at + d, s) for d, c, s in subtree(level, node))

    size = racks * slots
    regions = [best(1, r, draw(1, r, sum(w[r * size : (r + 1) * size])), size) for r in range(len(w) // size)]
    return min(regions)[1]


def flat(key, shards):
    """Rendezvous hashing over all shards."""
    return min(range(shards), key=lambda s: xxhash.xxh64_intdigest(struct.pack("<q", key), xxhash.xxh64_intdigest(struct.pack("<q", s), 42)))


@pytest.mark.parametrize(("shards", "weights", "racks", "slots"), [(1, None, 2, 2), (16, None, 2, 2), (7, None, 2, 2), (13, None, 3, 2), (9, [1.0, 2, 0, 4, 1, 0.5, 3, 1, 1], 2, 3)])
def test_against_loops(spark, shards, weights, racks, slots):
    rows = sharding.descend(spark.range(600), "id", shards, weights, racks=racks, slots=slots, grown="grown").collect()
    for r in rows:
        assert r["shard"] == plain(r["id"], shards, weights, racks, slots)
        assert r["grown"] == plain(r["id"], shards + 1, weights and [*weights, 1.0], racks, slots)
    if shards == 16:
        assert sum(r["shard"] != flat(r["id"], 16) for r in rows) > 400


def test_cost_follows_the_levels(spark, monkeypatch):
    """A key's draws are those of regions, racks and slots, the latter two for the last region's and the chosen one's."""
    drawn, draw = [], sharding._draw
    monkeypatch.setattr(sharding, "_draw", lambda *a: drawn.append(a[0]) or draw(*a))
    sharding.descend(spark.range(5), "id", 1024, racks=16, slots=16, grown="grown")
    assert Counter(drawn) == {"region": 5, "rack": 32, "shard": 32}


def test_growth_moves_rows_into_the_new_shard_alone(spark):
    keys = spark.range(3000)
    for n in range(1, 19):
        keys = sharding.descend(keys, "id", n, out=f"s{n}", grown=f"g{n}")
    rows = keys.collect()
    for r in rows:
        assert all(r[f"s{n + 1}"] in (r[f"s{n}"], n) and r[f"s{n + 1}"] == r[f"g{n}"] for n in range(1, 18))
    for n in (4, 7, 16, 18):
        shares = Counter(r[f"s{n}"] for r in rows)
        assert len(shares) == n and all(abs(c - 3000 / n) < 5 * math.sqrt(3000 / n) for c in shares.values())


def test_weights(spark):
    before, after = [1.0, 2.0, 0.0, 1.0, 4.0, 1.0, 1.0, 2.0], [1.0, 2.0, 0.0, 3.0, 4.0, 1.0, 1.0, 2.0]
    rows = sharding.descend(sharding.descend(spark.range(20000), "id", 8, before, out="a"), "id", 8, after, out="b").collect()
    n = Counter(r["a"] for r in rows)
    assert n[2] == 0 and all(abs(n[s] / 20000 - w / 12) < 0.02 for s, w in enumerate(before))
    # The changed shard is in rack 1 (2, 3) of region 0 (0 to 3): all else keeps its rows, but for those that enter.
    assert all(r["b"] == r["a"] or r["b"] < 4 for r in rows) and any(r["b"] != r["a"] for r in rows)
    assert all(r["b"] == 3 for r in rows if r["a"] < 4 and r["b"] != r["a"])
    with pytest.raises(ValueError):
        sharding.weights_of(2, [0.0, 0.0])
