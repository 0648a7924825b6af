"""Secret scans: fixed patterns, and Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workers import map_arrow

# Fixed values of the base scan.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "markov")

#: Shortest run that the models look at by default: at this length chance rarely misleads.
LEAST = 20
#: Where a run is cut, and its parts with the cuts before them.
CUT_PART = re.compile(r"[/_=-]*[^/_=-]+[/_=-]*\Z|[/_=-]*[^/_=-]+")
_ALPHABET = string.ascii_letters + string.digits + "+/_=-"
_INDEX = np.full(128, 0, np.int64)
_INDEX[[ord(c) for c in _ALPHABET]] = np.arange(1, len(_ALPHABET) + 1)
_SIZE = len(_ALPHABET) + 1  # 0: the string's edge

#: Words from which the built-in ordinary samples are put together.
WORDS = (
    "the and for with that this from have are was not you all can will one about more when your out time people into just over after back only new also any first work even most give day find long year make get know look use tell ask need feel try leave call "
    "account address array buffer build cache class client column config connection context count create data database date default delete device directory document element error event field file filter format function group handler header image index input instance "
    "interface item key length level library license list local manager message method model module name network node number object option order output package parameter path pattern position process property query record reference release request response result return "
    "server service session setting source standard state string system table target test thread type update user value variable version view window "
    "und der die das nicht ein eine mit auf ist sich werden haben schule zeitung freiheit entwicklung gesellschaft verbindung les des une est pour dans que qui avec sont mais nous vous leur gouvernement développement los las una con por para como pero más también nosotros información"
).split()


def labelled_samples(n: int = 4000, seed: int = 7, least: int = LEAST) -> list[tuple[str, int]]:
    """``n`` random strings (1) and ``n`` ordinary identifiers (0) of mostly ``least`` characters and more, the same for the same arguments."""
    rng = random.Random(seed)
    words = [w for w in WORDS if w.isascii()]
    alphabets = [string.hexdigits[:16], string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-", string.ascii_uppercase + string.digits]
    out = [("".join(rng.choices(rng.choice(alphabets), k=rng.randint(least, 44 + least))), 1) for _ in range(n)]
    for _ in range(n):
        parts = [rng.choice(words)]
        while len("".join(parts)) < rng.randint(least, 28 + least):
            parts.append(rng.choice(words))
        style = rng.randrange(7)
        if style == 0:
            s = "_".join(parts)
        elif style == 1:
            s = "-".join(parts)
        elif style == 2:
            s = parts[0] + "".join(p.capitalize() for p in parts[1:])
        elif style == 3:
            s = "/".join(parts)
        elif style == 4:
            s = "_".join(parts).upper()
        elif style == 5:
            s = "".join(parts)
        else:
            s = rng.choice(("_", "-", "/")).join([*parts, str(rng.randint(0, 10 ** rng.randint(1, 8)))])
        out.append((s, 0))
    out += [("".join(rng.choices(string.digits, k=rng.randint(least, 20 + least))), 0) for _ in range(n // 20)]
    out += [(rng.choice("-=_x0") * rng.randint(least, 40 + least), 0) for _ in range(n // 20)]
    return out


class MarkovPair:
    """Second-order character models of both classes; ``score`` is the log-likelihood ratio by character.

    ``least``: runs, and stretches and parts of runs, of fewer characters are not looked at.
    """

    def __init__(self, samples: Iterable[tuple[str, int]], smoothing: float = 2.0, least: int = LEAST):
        self.least = least
        self.candidate, self.part = re.compile(rf"[A-Za-z0-9+/_=-]{{{least},}}"), re.compile(rf"[^/_=-]{{{least},}}")
        samples = [(s, y) for s, y in samples if s]
        held, kept = samples[::5], [x for i, x in enumerate(samples) if i % 5]
        self.ratio = self._model([s for s, y in kept if y], smoothing) - self._model([s for s, y in kept if not y], smoothing)
        # The threshold halves the way between the classes' held-out quantiles: few ordinary strings above, few random ones below.
        scores = [(self.score(s), y) for s, y in held]
        low = np.quantile([x for x, y in scores if not y] or [0.0], 0.999)
        high = np.quantile([x for x, y in scores if y] or [1.0], 0.01)
        self.threshold = float((low + high) / 2)

    @staticmethod
    def _encode(s: str) -> np.ndarray:
        codes = np.frombuffer(s.encode("ascii", "replace"), np.uint8) & 127
        return np.concatenate([[0, 0], _INDEX[codes], [0]])

    def _model(self, strings: list[str], smoothing: float) -> np.ndarray:
        """log P(c | a, b), each order smoothed by the one below it."""
        three = np.zeros((_SIZE,) * 3)
        for s in strings:
            x = self._encode(s)
            np.add.at(three, (x[:-2], x[1:-1], x[2:]), 1)
        two = three.sum(0)
        one = (two.sum(0) + 1) / (two.sum() + _SIZE)
        two = (two + smoothing * one) / (two.sum(1, keepdims=True) + smoothing)
        return np.log((three + smoothing * two) / (three.sum(2, keepdims=True) + smoothing))

    def score(self, s: str) -> float:
        x = self._encode(s)
        return float(self.ratio[x[:-2], x[1:-1], x[2:]].mean())

    def is_secret(self, s: str) -> bool:
        return self.score(s) > self.threshold

    def secrets(self, run: str, at: int = 0) -> list[tuple[int, int]]:
        """The whole run if it is a secret, else its stretches and parts that are; (start, end), moved by ``at``."""
        if self.is_secret(run):
            return [(at, at + len(run))]
        out = [s for s in self._stretches(run) if s[1] - s[0] >= self.least and self.is_secret(run[slice(*s)])]
        parts = _clear_of(((m.start(), m.end()) for m in self.part.finditer(run)), list(out))
        out += [(a, b) for a, b in parts if self.is_secret(run[a:b])]
        return sorted((a + at, b + at) for a, b in out)

    def _stretches(self, run: str) -> list[tuple[int, int]]:
        """Disjoint stretches of neighbouring parts whose sum above the threshold rises highest before it falls below 0."""
        x = self._encode(run)
        above = np.concatenate([[0.0], np.cumsum(self.ratio[x[:-2], x[1:-1], x[2:]] - self.threshold)])
        out, first, peak, best = [], None, 0.0, 0
        for m in CUT_PART.finditer(run):
            start = m.start() + len(m[0]) - len(m[0].lstrip("/_=-"))
            if first is None:
                first, peak, best = start, 0.0, start
            total = above[m.end()] - above[first]
            if total > peak:
                peak, best = total, m.end()
            if total < 0:
                if peak > 0:
                    out.append((first, best))
                first = None
        if first is not None and peak > 0:
            out.append((first, best))
        return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base scan, in order; code points, end exclusive."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _clear_of(ranges: Iterable[tuple[int, int]], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The sorted, disjoint ``ranges`` that none of ``taken``, likewise, overlaps."""
    i = 0
    for a, b in ranges:
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if i == len(taken) or taken[i][0] >= b:
            yield a, b


def _free(runs: Iterable[tuple[int, int]], spans: list[tuple[int, int, int]], least: int) -> Iterator[tuple[int, int]]:
    """What the sorted ``spans`` leave of sorted, disjoint runs, where it has ``least`` characters; one pass over both."""
    taken: list[list[int]] = []
    for s, _, e in spans:
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    i = 0
    for start, end in runs:
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        while i < len(taken) and taken[i][0] < end:
            s, e = taken[i]
            if s - start >= least:
                yield start, s
            start = max(start, e)
            if e > end:  # it may reach into the next run
                break
            i += 1
        if end - start >= least:
            yield start, end


def all_spans(text: str, models: MarkovPair) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and those with what the models add outside of them; time grows with the length of the text."""
    base = base_spans(text)
    runs = (m.span() for m in models.candidate.finditer(text))
    added = [(a, 3, b) for start, end in _free(runs, base, models.least) for a, b in models.secrets(text[start:end], start)]
    return base, sorted(base + added)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with each stretch of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def train(labelled: DataFrame | None = None, *, max_rows: int = 50_000, least: int = LEAST) -> MarkovPair:
    """Models from rows (text, label 1 for random, 0 for ordinary), at most ``max_rows`` of them by hash; without any, from the built-in samples.

    Rows without text or label are left out; repeated rows count again; other columns aren't read.
    """
    if labelled is None:
        return MarkovPair(labelled_samples(least=least), least=least)
    rows = labelled.where("text IS NOT NULL AND label IS NOT NULL").select("text", "label").orderBy(F.xxhash64("text", "label")).limit(max_rows).collect()
    return MarkovPair([(r["text"], int(r["label"])) for r in rows], least=least)


def scan(docs: DataFrame, models: MarkovPair | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find secrets in every whole text.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans), spans (all as
    kind:start:end), n_markov and found (the spans as an array of structs). A null text counts as
    empty; a null id stays null; repeated rows give repeated results; other columns are left out; an
    empty table gives no rows. The models look at runs of ``models.least`` characters and more, and
    at what base spans leave of them; random strings below that length are found by the patterns
    only. A map over rows: no shuffle, the models are a fixed-size table, and time is linear in a
    text's length.
    """
    models = models or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, spans = all_spans(text.as_py() or "", models)
                n = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
                rows.append((*n[:3], hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(spans), n[3], [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]))
            found = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.string(), pa.int64(), found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov", "found"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return map_arrow(slim, run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long, found array<struct<kind:string,start:long,end:long>>")


def redacted(docs: DataFrame, models: MarkovPair | None = None, *, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with the secrets in their texts replaced; null texts stay null. No shuffle."""
    models = models or train()
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if (t := x.as_py()) is None else redact(t, all_spans(t, models)[1]) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return map_arrow(docs, run, docs.schema)


def expected_false_rate(models: MarkovPair, n: int = 2000, seed: int = 99) -> tuple[float, float]:
    """Shares of fresh ordinary strings taken for secrets and of fresh random ones missed."""
    fresh = labelled_samples(n, seed)
    wrong = [models.is_secret(s) != bool(y) for s, y in fresh]
    ordinary = [w for w, (_, y) in zip(wrong, fresh) if not y]
    random_ones = [w for w, (_, y) in zip(wrong, fresh) if y]
    return math.fsum(ordinary) / len(ordinary), math.fsum(random_ones) / len(random_ones)
