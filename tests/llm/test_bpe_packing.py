import hashlib
import json
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillspark.llm import packing, word_bpe

FILE = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "Hello, world! it's 2024's we'll I'D", "a\x1cb c\x85d e　f", "<|endoftext|> x<|startoftext|>y <|endoftext", "ΑΣ ΣΑΣ İstanbul ẞ ǅ",
    "étude ́x ﬁ 한국어 각 日本語 😀😀 ‍", "\x00\x01\x1f", "x" * 5000, "ab12 " * 3000, "it''s '''s 'S 'LL", "a b c​d﻿e", "Ⅷ ² ½ ٣",
]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_encoding_is_the_librarys(spark):
    rng = random.Random(5)
    alphabet = "aábcdeftsrn'12 .,<|>\t\nΣßİ́한\x1c\x85"
    texts = TEXTS + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(400)]
    library = Tokenizer.from_file(FILE)
    got = {r["doc_id"]: r for r in word_bpe.encode_decode(frame(spark, texts)).collect()}
    for k, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[k]["ids"] == ids, repr(text)
        assert got[k]["decoded"] == decoded and got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_clashing_columns_repeats_and_empty_tables(spark):
    docs = spark.sql("SELECT * FROM VALUES (1L, 'a b', 'x', 0), (1L, 'a b', 'x', 0), (null, null, null, null) AS t(doc_id, text, id, n_tokens)")
    rows = sorted(((r["doc_id"], r["n_tokens"]) for r in word_bpe.encode_decode(docs).collect()), key=str)
    assert rows == [(1, 2), (1, 2), (None, 0)]
    assert word_bpe.encode_decode(docs.limit(0)).count() == 0


def test_special_tokens_of_any_shape(tmp_path):
    spec = json.load(open(FILE, encoding="utf-8"))
    renamed = ["[stop]", "{go}"]
    for token, name in zip(spec["added_tokens"], renamed):
        token["content"] = name
    file = tmp_path / "other.json"
    file.write_text(json.dumps(spec), encoding="utf-8")
    bpe, library = word_bpe.WordBPE(str(file)), Tokenizer.from_file(str(file))
    assert word_bpe.WordBPE(FILE).hint == "<"
    for text in ("a [stop] b{go}c", "[stop]", "go stop", "x{go}"):
        assert bpe.encode(text) == library.encode(text, add_special_tokens=False).ids, text


def test_merge_order_against_rescanning():
    bpe = word_bpe.WordBPE(FILE)
    rng = random.Random(1)
    for _ in range(300):
        ids = [bpe.inner[ord(c)] for c in rng.choices("antheirsou", k=rng.randrange(1, 30))]
        want = list(ids)
        while pairs := [(bpe.merges[p][0], i) for i, p in enumerate(zip(want, want[1:])) if p in bpe.merges]:
            i = min(pairs)[1]
            want[i : i + 2] = [bpe.merges[want[i], want[i + 1]][1]]
        assert bpe.merge(list(ids)) == want


def test_small_cache_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(word_bpe, "CACHE_WORDS", 3)
    cache = word_bpe.Cache(lambda c: c.lower().split("-"), lambda w: f"<{w}>", "".join)
    words = ["a", "bb", "B-a", "dddd", "eeeee", "a-A", "bb"] * 4 + ["z" * 100]
    assert [cache[w] for w in words] == ["".join(f"<{x}>" for x in w.lower().split("-")) for w in words] and len(cache) <= 4 and len(cache.old) <= 4


def place(counts, capacity):
    slots = defaultdict(list)
    for length, rank, bins, per, first, offset in packing.plan(counts, capacity):
        for step in range(bins * per):
            slots[first + step // per].append((offset + step % per * length, length, rank + step))
    return slots


@pytest.mark.parametrize("seed", range(25))
def test_plan_is_gapless_and_tight(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 50, 400])
    counts = {rng.randint(1, capacity): rng.randint(1, 60) for _ in range(rng.randint(1, 30))}
    slots = place(counts, capacity)
    seen = defaultdict(list)
    for rows in slots.values():
        at = 0
        for offset, length, rank in sorted(rows):
            assert offset == at
            at += length
            seen[length].append(rank)
        assert at <= capacity
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in counts.items()}
    rooms = []  # best-fit decreasing, piece by piece
    for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= length]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= length
        else:
            rooms.append(capacity - length)
    assert len(slots) == len(rooms) and sorted(slots) == list(range(len(rooms)))


def test_plan_stays_small():
    rng = random.Random(3)
    counts = {n: rng.randint(1, 10**9) for n in range(1, 4097)}
    assert len(packing.plan(counts)) < 40_000


def test_packed_documents(spark):
    texts = [*TEXTS, *["the same text"] * 50, "word " * 9000]
    docs = frame(spark, texts).selectExpr("*", "1 AS length", "2 AS rank", "3 AS l")
    rows = packing.pack(docs).collect()
    library = Tokenizer.from_file(FILE)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for k, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted(by_doc[k], key=lambda r: r["piece"])
        assert [i for r in own for i in r["ids"]] == ids
        assert [r["start"] for r in own] == list(range(0, len(ids), 4096)) and [r["piece"] for r in own] == list(range(len(own)))
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) for r in own)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    slim = packing.pack(docs, keep_ids=False)
    assert "ids" not in slim.columns and slim.count() == len(rows)
    assert packing.pack(docs.limit(0)).count() == 0


def test_ids_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, "some words " * (i % 7 * 300)) for i in range(60)], "doc_id long, text string").repartition(5)
    out = packing.pack(docs)
    lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: next(i for i, c in enumerate(line) if c.isalpha())
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and "ids#" in line)
    above, indent = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if any(map(str.isalpha, line)) and depth(line) < indent:
            above.append(line)
            indent = depth(line)
    assert any("Join" in line for line in above) and not any("Exchange" in line or " Sort" in line for line in above), lines
    assert "Bucketed: true" in lines[at]
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows if r["piece"] == 0) == list(range(60))
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0) and len(r["ids"]) == r["length"]
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096
