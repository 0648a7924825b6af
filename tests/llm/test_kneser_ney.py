import math
import pathlib
import pickle
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import kneser_ney as kn


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]  # None: the end


class Brute:
    """The model from dictionaries, in the textbook's terms."""

    def __init__(self, texts, order):
        self.order = order
        grams = Counter()
        for t in texts:
            own = [0] * (order - 1) + tokens(t)
            grams.update(tuple(own[i : i + order]) for i in range(len(own) - order + 1))
        self.seen = Counter()
        for g, n in grams.items():
            self.seen[g[-1]] += n
        self.counts = {order: grams}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.N, self.V = sum(self.seen.values()), len(self.seen)
        self.contexts, self.d = {}, {}
        for k, c in self.counts.items():
            self.contexts[k] = defaultdict(list)
            for g, n in c.items():
                self.contexts[k][g[:-1]].append(n)
            n1, n2, n3, n4 = (sum(v == i for v in c.values()) for i in (1, 2, 3, 4))
            if n1 and n2:
                y = n1 / (n1 + 2 * n2)
                d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
                self.d[k] = [0, *[min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]]
            else:
                self.d[k] = [0, 0.5, 0.5, 0.5]

    def p(self, gram):
        k = len(gram)
        lower = self.p(gram[1:]) if k > 1 else 1 / (self.V + 1)
        own = self.contexts[k].get(gram[:-1])
        if not own:
            return lower
        d = self.d[k]
        c = self.counts[k][gram]
        return max(c - d[min(c, 3)], 0) / sum(own) + sum(d[min(n, 3)] for n in own) / sum(own) * lower

    def score(self, text):
        own = [0] * (self.order - 1) + tokens(text)
        return sum(math.log10(self.p(tuple(own[i : i + self.order]))) for i in range(len(own) - self.order + 1))

    def base(self, text):
        return sum(math.log10((self.seen[t] + 1) / (self.N + self.V + 1)) for t in tokens(text))


def make(n=300):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdeé", k=3)) for _ in range(80)]
    weights = [1 / (i + 1) for i in range(80)]
    return [None, "", " ", "A a\x1ca a\xa0b", *[" ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 40))).capitalize() for _ in range(n)]]


@pytest.mark.parametrize(("order", "shard"), [(1, 10**6), (2, 100), (3, 300)])
def test_against_dictionaries(spark, monkeypatch, order, shard):
    monkeypatch.setattr(kn, "SHARD_NGRAMS", shard)
    texts = make()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, n string, shard int").repartition(5)
    learned = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 != 2]
    brute = Brute([texts[i] for i in learned], order)
    rows = kn.score_documents(docs, order).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        own = tokens(text)
        assert r["held_out"] == (r["doc_id"] not in learned) and r["train_tokens"] == brute.N
        assert (r["n_tokens"], r["n_known"]) == (len(own), sum(brute.seen[t] > 0 for t in own))
        assert math.isclose(r["base_score"], brute.base(text), rel_tol=1e-9)
        assert math.isclose(r["score"], brute.score(text), rel_tol=1e-9)
        assert math.isclose(r["perplexity"], 10 ** (-r["score"] / len(own)), rel_tol=1e-9)
    for context in list(brute.contexts[order])[:20]:
        assert math.isclose(sum(brute.p((*context, w)) for w in [*brute.seen, "unseen"]), 1, rel_tol=1e-9)


def test_flushing_often_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(make(2500))), "doc_id long, text string").coalesce(1)
    want = {r["doc_id"]: r["score"] for r in kn.score_documents(docs).collect()}
    monkeypatch.setattr(kn, "TOKENS_AT_ONCE", 500)
    monkeypatch.setattr(kn, "_SCORE_TOKENS", 10)
    got = {r["doc_id"]: r["score"] for r in kn.score_documents(docs).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in got)


def test_empty_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert kn.score_documents(spark.createDataFrame([], schema)).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = kn.score_documents(spark.createDataFrame([(only, "a b"), (None, "c")], schema)).collect()
    assert {(r["doc_id"], r["held_out"], r["train_tokens"], r["n_known"], r["score"]) for r in rows} == {(only, True, 0, 0, 0.0), (None, False, 0, 0, 0.0)}


def test_windows_stay_in_their_text():
    grams, sizes = kn.windows(["a b", None, "c"], 3)
    assert sizes.tolist() == [3, 1, 2] and grams.shape == (6, 3)
    assert (grams[[0, 3, 4], :2] == kn.BEGIN).all() and (grams[[2, 3, 5], 2] == kn.END).all()
    assert grams[5, 0] == kn.BEGIN and len(np.unique(kn.keys_of(grams))) == 6


def test_the_query_scores_by_two_words_before(spark, monkeypatch):
    assert kn.ORDER == 3
    monkeypatch.setattr(kn, "SHARD_NGRAMS", 300)
    texts = make()
    brute = Brute([t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2], 3)
    rows = kn.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts) and all(math.isclose(r["score"], brute.score(texts[r["doc_id"]]), rel_tol=1e-9) for r in rows)


def test_order_four_in_passes(spark, monkeypatch):
    monkeypatch.setattr(kn, "SHARD_NGRAMS", 200)
    texts = make(100)
    brute = Brute([t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2], 4)
    for passes in (1, 3):
        monkeypatch.setattr(kn, "PASSES", passes)
        rows = kn.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4).collect()
        assert all(math.isclose(r["score"], brute.score(texts[r["doc_id"]]), rel_tol=1e-9) for r in rows)


@pytest.mark.parametrize(("n", "shards"), [(0, 4), (1, 1), (1000, 1), (100_000, 8)])
def test_files_keep_every_bit(tmp_path, n, shards):
    rng = np.random.default_rng(n)
    shard = shards - 1
    bits = int(math.log2(shards))
    keys = np.unique(rng.integers(0, 1 << 63, n, np.uint64) << np.uint64(1) >> np.uint64(bits) | np.uint64(shard << (64 - bits) if bits else 0))
    values = [rng.zipf(1.3, (len(keys), w)).clip(0, 10**12) for w in (1, 4)]
    kn._save(f"{tmp_path}/0/file", bits, [(keys, v) for v in values])
    tables = kn.mapped(f"{tmp_path}/0/file", bits)
    assert len(tables) == 2
    for table, v in zip(tables, values):
        hit, place = table.places(keys)
        assert hit.all() and (place == np.arange(len(keys))).all()
        assert not table.places(keys ^ np.uint64(1))[0][~np.isin(keys ^ np.uint64(1), keys)].any()
        assert (table.values(place, v.shape[1]) == v).all()


@pytest.mark.parametrize("order", [2, 3, 4, 5])
def test_hot_words_and_ranges_of_shards(spark, monkeypatch, order):
    monkeypatch.setattr(kn, "SHARD_NGRAMS", 20)
    monkeypatch.setattr(kn, "HOT", 40)
    monkeypatch.setattr(kn, "FAN", 16)
    monkeypatch.setattr(kn, "PASSES", 2)
    texts = make(120)
    brute = Brute([t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2], order)
    assert sum(n >= 40 for n in brute.seen.values()) > 10
    rows = kn.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), order).collect()
    assert len(rows) == len(texts) and all(math.isclose(r["score"], brute.score(texts[r["doc_id"]]), rel_tol=1e-9) for r in rows)


def test_four_thousand_shards_with_few_descriptors(spark, monkeypatch, tmp_path):
    """Reads a model of 4,096 shards in a process that may hold 256 descriptors."""
    texts = make(150)
    size = sum(len((t or "").encode()) + 6 for t in texts)
    monkeypatch.setattr(kn, "SHARD_NGRAMS", size / 6 / 4096)
    model = kn.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert model.shards == 4096
    brute = Brute(texts, 3)
    (tmp_path / "in").write_bytes(pickle.dumps((model, texts)))
    code = (
        "import pickle, resource, sys, numpy as np; resource.setrlimit(resource.RLIMIT_NOFILE, (256, 256))\n"
        "from quillspark.llm import kneser_ney as kn\n"
        "model, texts = pickle.load(open(sys.argv[1], 'rb')); reader = kn.Reader(model)\n"
        "grams, sizes = kn.windows(texts, 3); logs = reader.scores(grams)[0]; assert len(reader.open) <= kn.MAPS\n"
        "print(*np.add.reduceat(logs, np.cumsum(sizes) - sizes).tolist())"
    )
    root = str(pathlib.Path(kn.__file__).parents[2])
    out = subprocess.run([sys.executable, "-c", code, str(tmp_path / "in")], capture_output=True, text=True, cwd=root, timeout=300)
    assert out.returncode == 0, out.stderr
    assert all(math.isclose(float(x), brute.score(t), rel_tol=1e-9) for x, t in zip(out.stdout.split(), texts, strict=True))


def test_repeated_rows_and_a_clashing_column(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (3, "c", "y")], "doc_id long, text string, kind string")
    rows = kn.score_documents(docs, 2).collect()
    assert len(rows) == 3 and len({(r["doc_id"], r["score"]) for r in rows}) == 2


def test_words_are_hashed_alike_in_blocks_of_any_size(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choices("aBé 😀\t\n\x0b\x1c\xa0z", k=rng.randint(0, 60))) for _ in range(300)] + ["x" * 5000 + " y", " ", ""]
    raw = "\n".join(texts).encode()
    want, at = kn.word_hashes(raw)
    own = [w for t in texts for w in tokens(t)[:-1]]
    assert len(own) == len(want) and len(set(own)) == len(set(want.tolist())) == len(set(zip(own, want.tolist())))
    assert all(raw[a:].lower().startswith(w.lower().encode()) for a, w in zip(at.tolist(), own))
    for block in (7, 64, 1000):
        monkeypatch.setattr(kn, "_BLOCK", block)
        got, places = kn.word_hashes(raw)
        assert (got == want).all() and (places == at).all()


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5])
def test_a_pass_picks_its_shards_before_it_gathers(order):
    texts = [" ".join(random.Random(i).choices(["a", "b", "hot", "warm", *map(str, range(40))], k=i)) for i in (0, 1, 7, 300)] + [None, "hot hot hot hot hot hot"]
    hot = np.sort(np.concatenate([[kn.BEGIN], kn.word_hashes(b"hot warm")[0]]))
    layout = kn.Layout(order, 8, hot)
    h, ends, sizes = kn.line_up(texts, order)
    whole, tokens_of = kn.windows(texts, order)
    shard = layout.shard(layout.keys(kn._GRAM, order, whole)[0])
    assert sizes.tolist() == tokens_of.tolist() and len(set(shard.tolist())) > 4
    for first, end in ((0, 2), (2, 5), (5, 8)):
        assert (kn._grams(h, layout.within(h, ends, first, end), order) == whole[(shard >= first) & (shard < end)]).all()


def test_white_space_adds_nothing_to_a_hash():
    words = [b"Ab", b"c" * 5000, "é".encode()]
    spaced = b" \t" * 3000 + b"\n".join(w + b" \x0b" * 2500 for w in words)
    found, starts = kn.word_hashes(spaced)
    assert found.tolist() == [kn.word_hashes(w)[0][0] for w in words] and spaced[starts[0] : starts[0] + 2] == b"Ab"


def test_texts_come_as_arrow_arrays_too():
    texts = ["A b", None, "", "x" * 70_000 + " y", "é\x00 z"] * 3
    for kind in (pa.string(), pa.large_string()):
        for a, n in ((0, 15), (3, 9), (2, 0)):
            got, want = kn.line_up(pa.array(texts, kind).slice(a, n), 3), kn.line_up(texts[a : a + n], 3)
            assert all((x == y).all() for x, y in zip(got, want))


def test_look_ups_go_through_short_runs(tmp_path):
    rng = np.random.default_rng(1)
    for taken, n in ((6, 300_000), (20, 60_000)):  # too few bits are left for short runs at 20
        keys = np.unique(rng.integers(0, 1 << 63, n, np.uint64) >> np.uint64(taken - 1))
        kn._save(f"{tmp_path}/{taken}/file", taken, [(keys, np.arange(len(keys))[:, None])])
        (table,) = kn.mapped(f"{tmp_path}/{taken}/file", taken)
        assert len(keys) >> table.bits < kn.RUN or table.bits == 31 - taken
        hit, place = table.places(np.concatenate([keys[::-1], keys[keys + np.uint64(1) != np.roll(keys, -1)] + np.uint64(1)]))
        assert hit[: len(keys)].all() and not hit[len(keys) :].any() and (place == np.arange(len(keys))[::-1]).all()
        assert (table.values(place, 1)[:, 0] == place).all()


def test_keys_alike_in_their_top_bits_are_sorted_in_full():
    rng = np.random.default_rng(2)
    for keys in (rng.integers(0, 1 << 63, 5000, np.uint64), np.append(rng.integers(0, 9, 5000).astype(np.uint64), np.uint64(1 << 63)), np.zeros(3, np.uint64), np.zeros(0, np.uint64)):
        order, got = kn._in_order(keys)
        assert (got == np.sort(keys)).all() and (keys[order] == got).all()
        names, at = kn._distinct(keys)
        assert (names == np.unique(keys)).all() and (names[at] == keys).all()
