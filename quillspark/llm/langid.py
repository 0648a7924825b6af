"""Language identification by unigram pieces, summed over all segmentations.

Each language has probabilities for the pieces of a fixed public vocabulary. A word's probability is
the sum, by a forward algorithm, over all ways to cut it into pieces; a text's, the product over its
words. The segmentation itself is never chosen.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .workers import kept, map_arrow

#: Documents of each language, at most, on which the probabilities are fitted; longer runs of letters are learned in stretches of so many.
TRAIN_DOCS, FIT_LETTERS = 2000, 512
#: The share of a character that no piece covers.
UNKNOWN = 1e-7
#: Word scores that a worker keeps, and numbers that a batch of words takes at a position's width; runs of more letters are scored one at a time.
CACHE_SCORES, BATCH_SCORES, LONG = 1_000_000, 160_000, 4096
#: How far below the worst fitted document's log probability a letter a text may be and still count as one of the languages:
#: a short text with a key or code in it stays, a script that few pieces cover (about -16 a letter) doesn't.
MARGIN = 3.0
_WORD = re.compile(r"[^\W\d_]+")
_START = "▁"


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(file: str) -> list[str]:
    """The vocabulary's pieces, lower-cased and without repeats; marks and byte pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=file)
    found = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return list(dict.fromkeys(p for p in found if (p == _START or p.removeprefix(_START).isalpha())))


class Lattice:
    """All segmentations of many words at once, over one vocabulary.

    Substrings are looked up by a rolling hash in a sorted table, one length at a time over all
    words together, so the work is in array operations rather than in a loop over words.
    """

    _BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        self.lengths = sorted({len(p) for p in pieces})

    @classmethod
    def _hash(cls, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(cls._BASE) + ord(c) + 1) & (2**64 - 1)
        return h

    def edges(self, words: list[str]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Word lengths with the start mark, and for each piece length the ids (words x ends, -1: no piece)."""
        return self._edges([_START + w for w in words])

    def _edges(self, marked: list[str]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        size = np.array([len(w) for w in marked])
        codes = np.zeros((len(marked), size.max()), np.uint64)
        codes[np.arange(size.max()) < size[:, None]] = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        prefix = np.zeros((len(marked), size.max() + 1), np.uint64)
        for j in range(size.max()):
            prefix[:, j + 1] = prefix[:, j] * self._BASE + codes[:, j]
        out, power = {}, 1
        for n in range(1, self.lengths[-1] + 1):
            power = power * int(self._BASE) & (2**64 - 1)
            if n > size.max():
                break
            if n not in self.lengths:
                continue
            h = prefix[:, n:] - prefix[:, :-n] * np.uint64(power)
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            ids = np.where(self.hashes[at] == h, self.ids[at], -1)
            ids[np.arange(n, size.max() + 1) > size[:, None]] = -1
            out[n] = ids
        return size, out

    def forward(self, words: list[str], probs: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """Log sums over the segmentations up to each position (words x positions x languages), lengths and edges.

        ``probs``: pieces x languages. Every position can also be reached by one uncovered character
        of probability UNKNOWN. Sums are taken relative to the position before, so none underflows.
        """
        size, edges = self.edges(words)
        width, languages = size.max(), probs.shape[1]
        alpha = np.zeros((len(words), width + 1, languages))
        for j in range(1, width + 1):
            now = np.full((len(words), languages), UNKNOWN)
            for n, ids in edges.items():
                if n <= j:
                    own = ids[:, j - n]
                    hit = np.flatnonzero(own >= 0)
                    if len(hit):
                        now[hit] += np.exp(alpha[hit, j - n] - alpha[hit, j - 1]) * probs[own[hit]]
            alpha[:, j] = alpha[:, j - 1] + np.log(now)
        return alpha, size, edges

    def score(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        """log probability of each word in each language."""
        alpha, size, _ = self.forward(words, probs)
        return alpha[np.arange(len(words)), size]

    def score_long(self, word: str, probs: np.ndarray) -> np.ndarray:
        """As ``score`` for one word of any length: the sums before the last piece's reach are carried from stretch to stretch."""
        marked, reach = _START + word, self.lengths[-1]
        total = np.zeros(probs.shape[1])
        before = np.zeros((reach, probs.shape[1]))  # sums n + 1 positions back, relative to the last
        before[0] = 1
        for at in range(0, len(marked), LONG):
            first = max(0, at - reach)
            part = marked[first : at + LONG]
            _, edges = self._edges([part])
            found = np.full((reach, len(part) + 1), -1)
            for n, ids in edges.items():
                found[n - 1, n:] = ids[0]
            for j in range(at - first + 1, len(part) + 1):
                hit = np.flatnonzero(found[:, j] >= 0)
                now = UNKNOWN + (before[hit] * probs[found[hit, j]]).sum(0)
                total += np.log(now)
                before[1:] = before[:-1] / now
                before[0] = 1
        return total

    def expected(self, words: list[str], counts: np.ndarray, probs: np.ndarray) -> np.ndarray:
        """Expected piece counts (pieces x languages) over all segmentations of counted words: forward, then backward."""
        alpha, size, edges = self.forward(words, probs)
        total = alpha[np.arange(len(words)), size]
        width, languages = size.max(), probs.shape[1]
        back = np.full((len(words), width + 1, languages), -np.inf)
        back[np.arange(len(words)), size] = 0
        out = np.zeros((len(self.pieces), languages))
        for i in range(width - 1, -1, -1):
            grown = back[:, i + 1] + np.log(UNKNOWN)
            for n, ids in edges.items():
                if i + n <= width:
                    own = ids[:, i]
                    hit = np.flatnonzero(own >= 0)
                    if len(hit):
                        through = np.log(probs[own[hit]]) + back[hit, i + n]
                        grown[hit] = np.logaddexp(grown[hit], through)
                        np.add.at(out, own[hit], counts[hit] * np.exp(alpha[hit, i] + through - total[hit]))
            back[:, i] = np.where((i < size)[:, None], grown, back[:, i])
        return out


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]
    probs: np.ndarray  # pieces x languages
    floor: float = -np.inf  # log probability a letter that the worst fitted documents have

    @cached_property
    def key(self) -> str:
        return hashlib.sha256(repr(self.languages).encode() + self.probs.tobytes()).hexdigest()


def _batches(words: list[str], languages: int, scores: int) -> Iterator[list[int]]:
    """Places of words of like length together, so many that a batch's tables stay bounded."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        cut = order[at : at + max(1, scores // ((len(words[order[at]]) + 8) * languages))]
        while len(cut) > 1 and len(words[cut[-1]]) > 2 * len(words[cut[0]]) + 8:
            cut = cut[: len(cut) // 2]
        yield cut
        at += len(cut)


def _sample(docs: DataFrame, train_docs: int, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame, list[str]]:
    """At most ``train_docs`` labelled rows of each language, by a hash of id and text (a row that repeats both is one), and the languages."""
    own = [F.col(id_col).cast("string")] if id_col in docs.columns else []
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    known = known.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(*own, text_col, F.lit("langid")).alias("draw"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # the model's classes
    if not sizes:
        return known, []
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, train_docs / n)) for k, n in sizes.items()], "lang string, share double")
    drawn = known.join(F.broadcast(shares), "lang").where(F.pmod("draw", F.lit(1 << 30)) / float(1 << 30) < F.col("share"))  # a row for each class
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    return drawn.dropDuplicates(["lang", "draw"]).withColumn("place", place).where(F.col("place") <= train_docs).select("text", "lang"), sorted(sizes)


def train(docs: DataFrame, vocabulary_file: str | None = None, *, train_docs: int = TRAIN_DOCS, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit piece probabilities by expectation maximization on labelled rows (``text_col``, ``lang_col``).

    The fit uses a sample of at most ``train_docs`` documents a language, drawn by a hash of id (if
    there is that column) and text; runs of over FIT_LETTERS letters are learned in stretches. All
    labels are learned. Words are counted in Spark, and each round's expected counts are summed
    there; the model, and what the driver gets, is a number for each piece of the fixed vocabulary
    and language. Rows without text or label are left out; without any left the model has no
    languages. ``floor`` is what one in a thousand fitted documents, or fewer, are below in log
    probability a letter.
    """
    pieces, spark = read_pieces(vocabulary_file or default_file()), docs.sparkSession
    sample, languages = _sample(docs, train_docs, id_col, text_col, lang_col)
    if not languages:
        return Model([], pieces, np.zeros((len(pieces), 0)))
    sample = sample.persist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: dict[tuple[str, str], int] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in _WORD.findall(text.lower()):
                    if w.isalpha():
                        for at in range(0, len(w), FIT_LETTERS):
                            key = (lang, w[at : at + FIT_LETTERS])
                            tally[key] = tally.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in tally], pa.string()) for i in (0, 1)] + [pa.array(list(tally.values()), pa.int64())], ["lang", "word", "n"])

    counted = map_arrow(sample, count, "lang string, word string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n")).persist()
    probs = np.full((len(pieces), len(languages)), 1 / len(pieces))
    index = {k: i for i, k in enumerate(languages)}
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(probs)

        def expect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lattice, total = Lattice(pieces), np.zeros((len(pieces), len(languages)))
            for df in frames:
                df = df.groupby(["word", "lang"], as_index=False)["n"].sum()
                words, k, n = df["word"].tolist(), df["lang"].map(index).to_numpy(), df["n"].to_numpy()
                for cut in _batches(words, len(languages), 3 * BATCH_SCORES):
                    counts = np.zeros((len(cut), len(languages)))
                    counts[np.arange(len(cut)), k[cut]] = n[cut]
                    total += lattice.expected([words[i] for i in cut], counts, now.value)
            p, k = np.nonzero(total)
            yield pd.DataFrame({"piece": p, "k": k, "n": total[p, k]})

        got = counted.mapInPandas(expect, "piece long, k long, n double").groupBy("piece", "k").agg(F.sum("n").alias("n")).toPandas()
        now.unpersist()
        counts = np.zeros_like(probs)
        counts[got["piece"], got["k"]] = got["n"]
        probs = (counts + 0.01) / (counts + 0.01).sum(0)
    counted.unpersist()
    model = Model(languages, pieces, probs)
    sent = _send(spark, model)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _judge(sent.value, batch.column(0).to_pylist())[2]
            yield pa.RecordBatch.from_arrays([pa.array(own[np.isfinite(own)], pa.float64())], ["fit"])

    worst = map_arrow(sample, fit, "fit double").agg(F.percentile_approx("fit", 0.001, 10_000)).first()[0]
    sample.unpersist()
    model.floor = -np.inf if worst is None else float(worst)
    return model


def _send(spark: SparkSession, model: Model) -> Broadcast:
    """The model once for each executor: a number for each piece of the vocabulary and language."""
    ship(spark)
    return spark.sparkContext.broadcast(model)


class _Scores:
    """Word scores of one worker: rows of a growing table, dropped when it is full."""

    def __init__(self, model: Model):
        self.lattice, self.model = Lattice(model.pieces), model
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.languages) + 1))  # the last: letters, with the start mark

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """Summed scores of each text, and its letters."""
        languages = len(self.model.languages)
        if len(self.rows) * (languages + 1) > CACHE_SCORES:
            self.clear()
        rows, ids, ends = self.rows, [], []
        old = len(rows)
        for text in texts:
            ids += [rows.setdefault(w, len(rows)) for w in _WORD.findall((text or "").lower())]
            ends.append(len(ids))
        new = list(islice(rows, old, None))
        if len(rows) + 1 > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((len(rows) + 1 - len(self.table) + len(self.table) // 2, self.table.shape[1]))])
        for cut in _batches(new, languages, BATCH_SCORES):
            at = old + np.array(cut)
            self.table[at, :-1] = _scores(self.lattice, [new[i] for i in cut], self.model.probs)
            self.table[at, -1] = [len(new[i]) + 1 for i in cut]
        ends = np.array(ends)
        starts = np.concatenate([[0], ends[:-1]])
        ids = np.array(ids, np.int64)
        out = np.zeros((len(texts), self.table.shape[1]))
        for k in range(len(texts)):
            for a in range(starts[k], ends[k], 65536):
                out[k] += self.table[ids[a : min(ends[k], a + 65536)]].sum(0)
        return out


def _worker(model: Model) -> _Scores:
    """A model's word scores, kept for all tasks of a worker."""
    return kept(("langid", model.key), lambda: _Scores(model))


def _judge(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Predicted languages, posteriors, and log probabilities a letter in the predicted language (-inf: no letter)."""
    letters = [bool(t) and any(map(str.isalpha, t)) for t in texts]
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), -np.inf)
    total = _worker(model).texts(texts)
    total, size = total[:, :-1], total[:, -1]
    posterior = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
    fit = np.where(letters, total.max(1) / np.maximum(size, 1), -np.inf)
    return [model.languages[b] if has else "und" for b, has in zip(total.argmax(1), letters)], np.where(letters, posterior, 0.0), fit


def _scores(lattice: Lattice, words: list[str], probs: np.ndarray) -> np.ndarray:
    """Scores of words; long ones by themselves, which bounds memory."""
    if max(map(len, words)) > LONG:
        return np.array([lattice.score_long(w, probs) for w in words])
    return lattice.score(words, probs)


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text; inputs are the texts alone.

    ``score`` is the posterior of the predicted language under equal priors. A text that is null or
    has no letter, and any text if the model knows no language, is ``und`` with score 0. Ties go to
    the first language by name. Other columns are left out; an empty table gives no rows. A map over
    rows: no shuffle; a worker holds the fixed model and a bounded table of word scores. Repeated rows
    give repeated results and a null id stays null; texts and words of any length are scored whole.
    """
    sent = _send(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                cut = batch.slice(at, 1000)
                langs, scores, _ = _judge(sent.value, cut.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(slim, run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def fold(id_col: str = "doc_id"):
    """Whether a document is held out: crc32 of its id as text, mod 5, is 0. A null id is never held out and never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def identify(docs: DataFrame, vocabulary_file: str | None = None, *, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Learn from the documents that aren't held out and predict all: doc_id, held_out, lang_pred, score."""
    model = train(docs.where(F.col("doc_id").isNotNull() & ~fold()), vocabulary_file, train_docs=train_docs)
    return predict(docs, model).select("doc_id", fold().alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, vocabulary_file: str | None = None, *, least: float = 0.5, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The rows of ``docs`` whose text is in a language that the model recognizes.

    That is: not ``und`` (null, empty, without letters), a posterior of ``least``, and a log
    probability a letter that is not more than MARGIN below what the worst fitted documents have,
    which an unlearned language or script falls below. Without labels nothing is recognized.
    Repeated rows are judged alike; all columns stay; an empty table stays empty.
    """
    model = train(docs.where(F.col("doc_id").isNotNull() & ~fold()), vocabulary_file, train_docs=train_docs)
    at, names, sent = docs.columns.index("text"), docs.columns, _send(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                cut = batch.slice(a, 1000)
                langs, scores, fit = _judge(sent.value, cut.column(at).to_pylist())
                keep = pa.array((scores >= least) & (np.array(langs) != "und") & (fit >= sent.value.floor - MARGIN))
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in cut.columns], names)

    return map_arrow(docs, run, docs.schema)
