"""Word-level BPE with end-of-word marks: encoding by a priority queue over a linked symbol list, and decoding.

The vocabulary file is read from where the caller says (``tokenizer_file``); it is never copied.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workers import kept, map_arrow

#: Characters that str.split() takes for white space and the tokenizer's \s does not.
_ODD_SPACES = regex.compile("[\x1c-\x1f]")
_SPACES = regex.compile("[\t-\r \x85\xa0  -     　]+")

_MARKS = frozenset(".,;:!?")

CACHE_WORDS = 250_000


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBPE:
    """Encoder and decoder of one vocabulary file whose normalizer is NFC, white space, lower case."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        self.words = regex.compile(next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        shared = set.intersection(*map(set, self.special)) if self.special else set()
        self.hint = min(shared, key=lambda c: (c.isalnum(), c), default="")  # a character of all special tokens, a rare one if there is
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[a], self.vocab[b]] = rank, self.vocab[a + b]
        symbols = self.shown = _byte_symbols()
        self.inner = [self.vocab[s] for s in symbols]
        self.final = [self.vocab[s + self.suffix] for s in symbols]

    def merge(self, ids: list[int]) -> list[int]:
        """Apply merges in rank order, leftmost first among equals.

        ``before`` and ``after`` link the live symbols; the queue holds (rank, place, left, right)
        and an entry is stale when its two symbols have changed since it was pushed.
        """
        size, merges = len(ids), self.merges
        if size < 2:
            return ids
        before, after = list(range(-1, size - 1)), [*range(1, size), -1]
        queue = [(m[0], i, ids[i], ids[i + 1]) for i in range(size - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = merges[left, right][1], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((ids[i], ids[k])):
                    heapq.heappush(queue, (m[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], ids[i]))):
                heapq.heappush(queue, (m[0], h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def split(self, chunk: str) -> list[str]:
        """Normalized words of a stretch of text without white space."""
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")  # lower-casing is by character, without final sigma
        chunk = chunk.lower()
        # The two commonest shapes, without the pattern: letters alone, and with a mark behind them.
        if chunk.isalpha():
            return [chunk]
        if chunk[-1] in _MARKS and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.words.findall(chunk)

    def word(self, word: str) -> list[int]:
        """Ids of a normalized word."""
        raw = word.encode()
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.final[raw[-1]]
        return self.merge(ids)

    def symbols(self, word: str) -> str:
        """A word's bytes in their printable stand-ins."""
        return word if word.isalpha() and word.isascii() else "".join([self.shown[b] for b in word.encode()])

    def chunk(self, chunk: str) -> list[int]:
        return [i for w in self.split(chunk) for i in self.word(w)]

    def segments(self, text: str) -> Iterator[tuple[int, list[str]]]:
        """(special id, []) or (-1, chunks between white space) in the text's order."""
        for part in self.cut.split(text) if self.cut and self.hint in text else [text]:
            if part in self.special:
                yield self.special[part], []
            elif part:
                yield -1, [c for c in _SPACES.split(part) if c] if _ODD_SPACES.search(part) else part.split()

    def encode(self, text: str) -> list[int]:
        return [i for s, chunks in self.segments(text) for i in ([s] if s >= 0 else [x for c in chunks for x in self.chunk(c)])]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings; the file has no decoder, so single spaces stand between them."""
        return " ".join([self.strings[i] for i in ids])


class Cache(dict):
    """What chunks of text encode to, for the last CACHE_WORDS to twice as many of them; long ones aren't kept.

    ``encode`` works on a normalized word, ``join`` puts words' results together. A word that is its
    own and only word as a chunk, as nearly all are, shares the cache with chunks.
    """

    def __init__(self, split: Callable, encode: Callable, join: Callable):
        super().__init__()
        self.split, self.encode, self.join, self.old = split, encode, join, {}

    def __missing__(self, chunk: str):
        value = self.old.get(chunk)
        if value is None:
            words = self.split(chunk)
            value = self.encode(chunk) if words == [chunk] else self.join([self[w] if w.isascii() or self.split(w) == [w] else self.encode(w) for w in words])
        if len(chunk) <= 64:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[chunk] = value
        return value


def _worker(file: str) -> tuple[WordBPE, Cache, dict]:
    """One vocabulary and cache for all tasks of a worker."""

    def make():
        bpe = WordBPE(file)
        return bpe, Cache(bpe.split, lambda w: " ".join(map(str, bpe.word(w))), " ".join), {str(i): s for i, s in bpe.strings.items()}

    return kept(("word_bpe", file), make)


def encode_decode(docs: DataFrame, tokenizer_file: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """Encode every whole text and decode the ids.

    Returns ``id_col``, n_tokens, ids_sha256, decoded_sha256 and, with ``keep``, ids (array<int>)
    and decoded. A null text counts as empty: no ids, and the digest of nothing. Repeated rows give
    repeated results; other columns are left out whatever their names; an empty table gives none.
    A map over rows: no shuffle, memory bounded by an Arrow batch and the word cache.
    """
    file = tokenizer_file or default_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache, strings = _worker(file)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                joined = " ".join([p for s, chunks in bpe.segments(text.as_py() or "") if (p := str(s) if s >= 0 else " ".join(map(cache.__getitem__, chunks)))])
                split = joined.split()
                decoded = " ".join([strings[i] for i in split])
                row = (len(split), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                rows.append((*row, list(map(int, split)), decoded) if keep else row)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()][: 5 if keep else 3]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 1 + len(kinds)])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {slim.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep else "")
    return map_arrow(slim, run, schema).withColumnRenamed("id", id_col)
