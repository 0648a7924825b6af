"""Interpolated modified Kneser-Ney n-gram models, counted in Spark and read by workers from memory-mapped hash arrays."""

from __future__ import annotations

import gc
import math
import os
import resource
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .workers import kept, map_arrow

ORDER = 3
#: Tokens that a counting task holds before it passes on what it has, n-grams that a shard aims at, and the count from which a word is hot.
TOKENS_AT_ONCE, SHARD_NGRAMS, HOT = 4_000_000, 2_000_000, 1_000_000
#: Runs that each count a range of shards, so that only its part of the n-grams is in flight at once.
PASSES = 4
#: Ranges of shards to which a task deals; with more shards, ranges are dealt again, by SALTS tasks each.
FAN, SALTS = 512, 16
#: Rows from which a table's commonest values are counted by code rather than sorted.
LONG = 1 << 16
#: Mean keys of a run, which a look-up goes through, that a table's file aims to stay under.
RUN = 6
#: Shard files that a worker has mapped at once; each takes a descriptor. No limit of those is given as -1, which the remainder makes large.
MAPS = min(512, max(16, resource.getrlimit(resource.RLIMIT_NOFILE)[0] // 2 % (1 << 62)))
_SCORE_TOKENS = 1_000_000
# Bytes hashed at once; random numbers for marks and for the places of a word's stretches of eight bytes; which of those bytes a word has.
_BLOCK, _PLACES = 1 << 16, 20260101
BEGIN, END, _SIZE = np.random.default_rng(20260102).integers(0, 1 << 64, 3, np.uint64)
_PLACE = np.random.default_rng(_PLACES).integers(0, 1 << 64, 4096, np.uint64)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_GRAM, _CONTEXT, _TOKEN, _FACTS, _HOT = range(5)


def _mix(x: np.ndarray) -> np.ndarray:
    """``x`` itself, each number replaced by another one to one."""
    for factor, shift in ((0x9E3779B97F4A7C15, 32), (0xD6E8FEB86659FD93, 29)):
        x *= np.uint64(factor)
        x ^= x >> np.uint64(shift)
    return x


def keys_of(grams: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of word hashes, well mixed in its top bits, which name the shard."""
    x = np.full(len(grams), grams.shape[1], np.uint64)
    for j in range(grams.shape[1]):
        x ^= grams[:, j]
        _mix(x)
    return x


class Layout:
    """Which shard holds what. Levels ``order``, ``order`` - 2 ... are primary, the others secondary.

    A primary n-gram of three words and more lies in the shard of its core, the words but the first
    and last. So a shard has all n-grams around a core, and with them, whole, their contexts, the
    n-grams one shorter that end them and the contexts of those. Any other n-gram of two words and
    more lies in the shard of its context. A core or context of hot words alone would overfill a
    shard: its n-grams lie by their own hash, and what is counted by core or context is summed from
    partial counts. Every other core holds a word that isn't hot, which bounds its n-grams.
    """

    def __init__(self, order: int, shards: int, hot: np.ndarray):
        self.order, self.shards, self.hot, self.taken = order, shards, hot, int(math.log2(shards))
        self.maybe = np.zeros(1 << 16, bool)  # by a word's low bits
        self.maybe[hot.astype(np.uint16)] = True

    @classmethod
    def of(cls, folder: str, order: int, shards: int) -> Layout:
        """With the hot words of a model's folder."""
        return cls(order, shards, np.fromfile(f"{folder}/hot", np.uint64))

    def primary(self, level: int) -> bool:
        return (self.order - level) % 2 == 0

    def all_hot(self, words: list[np.ndarray]) -> np.ndarray:
        """The rows of the columns ``words`` whose words are all hot."""
        rows = None
        for w in words:
            own = w if rows is None else w[rows]
            at = np.flatnonzero(self.maybe[own.astype(np.uint16)])
            at = at[self.hot[np.minimum(np.searchsorted(self.hot, own[at]), len(self.hot) - 1)] == own[at]]
            rows = at if rows is None else rows[at]
        return rows

    def keys(self, kind: int, level: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of word hashes, keys whose top bits name the shard, and which are hot."""
        own, hot = keys_of(grams), np.zeros(len(grams), bool)
        if kind == _TOKEN or level == 1:
            return own, hot
        core = grams[:, :-1] if kind == _GRAM else grams
        if self.primary(level) and level > 2:
            core = core[:, 1:]
        hot[self.all_hot([*core.T])] = True
        if not self.taken:
            return own, hot
        low = np.uint64(64 - self.taken)
        return np.where(hot, own, keys_of(core)) >> low << low | own & (np.uint64(1) << low) - np.uint64(1), hot

    def within(self, h: np.ndarray, ends: np.ndarray, first: int, end: int) -> np.ndarray:
        """Of the highest n-grams that end at ``ends`` in ``h``, the ends of those in the shards from ``first`` to before ``end``.

        Only the words that tell the shard are gathered, and a whole n-gram only where those are all hot.
        """
        if self.order == 1:
            shard = self.shard(self.keys(_GRAM, 1, h[ends][:, None])[0])
        else:
            inner = self.order > 2  # the highest level is primary
            words = [h[ends - back] for back in range(self.order - 1 - inner, 0, -1)]
            shard = self.shard(keys_of(np.array(words).T))
            hot = self.all_hot(words)
            shard[hot] = self.shard(keys_of(_grams(h, ends[hot], self.order)))
        return ends[(shard >= first) & (shard < end)]

    def shard(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.taken)).astype(np.int64) if self.taken else np.zeros(len(keys), np.int64)

    def per_row(self) -> int:
        """Shards to a row of partial counts, so that a task deals to FAN ranges at most."""
        return -(-self.shards // FAN)


def _turn(level: int) -> list[int]:
    """Columns of an n-gram with the core first, which shards share."""
    return [*range(1, level - 1), 0, level - 1] if level > 2 else list(range(level))


def _spaces(codes: np.ndarray) -> np.ndarray:
    return (codes == 32) | (codes - np.uint8(9) < 5)


def _lower(codes: np.ndarray) -> np.ndarray:
    """In lower case, and seven zeros."""
    out = np.zeros(len(codes) + 7, np.uint8)
    np.add(codes, (codes - np.uint8(65) < 26).view(np.uint8) * np.uint8(32), out=out[:-7])
    return out


def _stretches(own: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Hashes of stretches of eight bytes by what they are and their places in the word."""
    return _mix(own ^ places)


def word_hashes(raw: bytes | pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of UTF-8 text, A-Z taken as lower case, and where it begins.

    The hash is a number for the first eight bytes and the size, to which one is added for each eight
    bytes more and their place in the word. So all words of a block of bytes are hashed at once, and
    a word longer than a block by its parts.
    """
    codes = np.frombuffer(raw, np.uint8) if len(raw) else np.zeros(0, np.uint8)
    hashes, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(codes):
        own = codes[at : at + _BLOCK]
        gap = np.ones(len(own) + 2, bool)
        gap[1:-1] = _spaces(own)
        if at + len(own) < len(codes):
            spaces = np.flatnonzero(gap[max(1, len(own) - 256) : -1])
            spaces = spaces + max(0, len(own) - 257) if len(spaces) else np.flatnonzero(gap[1:-1])
            if not len(spaces):  # inside a long word
                to = at + len(own)
                while to < len(codes):
                    more = np.flatnonzero(_spaces(codes[to : to + _BLOCK]))
                    to += int(more[0]) if len(more) else len(codes[to : to + _BLOCK])
                    if len(more):
                        break
                total, rng = np.zeros(1, np.uint64), np.random.default_rng(_PLACES)
                for a in range(at, to, 1 << 16):
                    eights = _lower(codes[a : min(to, a + (1 << 16))])
                    eights = eights[: len(eights) // 8 * 8].view(np.uint64)
                    places = rng.integers(0, 1 << 64, len(eights), np.uint64)
                    if a == at:
                        places[:1] = np.array([to - at], np.uint64) * _SIZE
                    total += _stretches(eights, places).sum(dtype=np.uint64)
                hashes.append(total)
                starts.append(np.array([at]))
                at = to
                continue
            own = own[: spaces[-1] + 1]
            gap = gap[: len(own) + 1]
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        first, sizes = edges[::2], edges[1::2] - edges[::2]
        if len(first):
            eights = np.ndarray(len(own), np.uint64, _lower(own), strides=(1,))  # from each byte on
            found = _stretches(eights.take(first) & _MASK.take(sizes, mode="clip"), sizes.astype(np.uint64) * _SIZE)
            long = np.flatnonzero(sizes > 8)
            if len(long):
                more = (sizes[long] - 1) >> 3
                start = np.cumsum(more) - more
                place = np.arange(1, int(more.sum()) + 1) - np.repeat(start, more)
                longest = int(more.max()) + 1
                places = _PLACE if longest <= len(_PLACE) else np.random.default_rng(_PLACES).integers(0, 1 << 64, longest, np.uint64)
                left = np.repeat(sizes[long], more) - 8 * place
                parts = eights.take(np.repeat(first[long], more) + 8 * place) & _MASK.take(left, mode="clip")
                found[long] += np.add.reduceat(_stretches(parts, places[place]), start)
            hashes.append(found)
            starts.append(at + first)
        at += len(own)
    return np.concatenate(hashes), np.concatenate(starts)


def line_up(texts: list[str | None] | pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word hashes of all texts with their marks, where in them each token is, and the tokens of each text."""
    if isinstance(texts, list):
        texts = pa.array([(t or "").encode("utf-8", "surrogatepass") for t in texts], pa.binary())
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else pa.binary()
    lines = pc.binary_join_element_wise(pc.fill_null(texts.cast(kind), b""), pa.scalar(b"", kind), pa.scalar(b"\n", kind))
    ends = np.cumsum(pc.binary_length(lines).to_numpy(), dtype=np.int64)
    found, starts = word_hashes(lines.buffers()[2].slice(0, ends[-1]) if len(ends) else b"")
    sizes = np.diff(np.searchsorted(starts, ends), prepend=0) + 1
    h = np.empty(len(found) + order * len(texts), np.uint64)
    last, inner = np.cumsum(sizes + order - 1) - 1, np.ones(len(h), bool)
    h[last], inner[last] = END, False
    for j in range(1, order):
        h[last - sizes - order + 1 + j], inner[last - sizes - order + 1 + j] = BEGIN, False
    h[inner] = found
    ends = np.repeat((order - 1) * np.arange(1, len(sizes) + 1), sizes) + np.arange(sizes.sum())
    return h, ends, sizes


def _grams(h: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
    """The word hashes of the n-gram that ends at each of ``ends``."""
    out = np.empty((len(ends), order), np.uint64)
    for j in range(order):
        out[:, j] = h[ends - (order - 1 - j)]
    return out


def windows(texts: list[str | None] | pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of the n-gram that ends at each token (tokens x order), and the tokens of each text."""
    h, ends, sizes = line_up(texts, order)
    return _grams(h, ends, order), sizes


def _in_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of ``keys`` in their order, and the keys so.

    Sorts as many bits as a number has room for beside the place, after those that all keys share;
    hashes are mostly told apart by these, and where the result is out of order it is sorted in full.
    """
    if not len(keys):
        return np.zeros(0, np.int64), keys
    bits = np.uint64(len(keys).bit_length())
    shared = np.uint64(64 - max(1, int(np.bitwise_or.reduce(keys ^ keys[0])).bit_length()))
    both = (keys << shared >> bits << bits) | np.arange(len(keys), dtype=np.uint64)
    both.sort()
    both &= (np.uint64(1) << bits) - np.uint64(1)
    order = both.view(np.int64)
    out = keys.take(order)
    if (out[1:] < out[:-1]).any():
        order = np.argsort(keys)
        out = keys.take(order)
    return order, out


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and which of those each key is."""
    order, keys = _in_order(keys)
    new = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return keys[new], back


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, the place of one row of each, and sums of the values by key."""
    order, keys = _in_order(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], order[first], *[np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values]


def _grouped(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one of each distinct code, and which of those each code is; sorts codes and places as one number where both fit."""
    bits = len(codes).bit_length()
    if int(codes.max(initial=0)) < 1 << (63 - bits):
        both = np.sort(codes << bits | np.arange(len(codes)))
        order, codes = both & (1 << bits) - 1, both >> bits
    else:
        order = np.argsort(codes)
        codes = codes[order]
    first = np.concatenate([[True], codes[1:] != codes[:-1]])[: len(codes)]
    back = np.empty(len(codes), np.int64)
    back[order] = np.cumsum(first) - 1
    return order[first], back


def _narrow(values: np.ndarray) -> np.ndarray:
    """In the smallest unsigned type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _pack(words: list[np.ndarray], values: list[np.ndarray]) -> bytes:
    """Rows in order of their words, which become places in a list of the distinct ones; each column byte by byte, for the compressor."""
    names, at = _distinct(np.concatenate(words))
    at = at.reshape(len(words), -1)
    bits = len(names).bit_length()
    if bits * len(at) < 64:  # all places as one number; the last bits, where there is no room for them, needn't be in order
        code = at[0]
        for c in at[1:]:
            code = code << bits | c
        own = len(code).bit_length()
        order = np.sort(code >> max(0, bits * len(at) + own - 63) << own | np.arange(len(code))) & (1 << own) - 1
    else:
        order = np.lexsort(at[::-1])
    columns = [c[order] for c in (*at, *values)]
    columns[0] = np.diff(columns[0], prepend=0)
    columns = [_narrow(c) for c in columns]
    head = np.array([len(names), *[c.itemsize for c in columns]], np.int64)
    planes = [c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), names.tobytes(), *planes]))


def _unpack(blob: bytes, n: int, columns: int, width: int) -> np.ndarray:
    """Columns of ``_pack``, of which the first ``width`` are words."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    distinct, *sizes = raw[: 8 * (columns + 1)].view(np.int64).tolist()
    at = 8 * (columns + 1)
    names = raw[at : at + 8 * distinct].view(np.int64)
    at += 8 * distinct
    out = np.empty((columns, n), np.int64)
    for k, size in enumerate(sizes):
        own = np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(f"u{size}")[:, 0].astype(np.int64)
        out[k] = names[np.cumsum(own) if k == 0 else own] if k < width else own
        at += n * size
    return out


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of each run of equal ``values``."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1, [len(values)]]) if len(values) else np.zeros(1, np.int64)
    return ((int(values[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:]))


def _dealt(kind: int, level: int, ranges: np.ndarray, words: list[np.ndarray], values: list[np.ndarray]) -> Iterator[tuple]:
    """One row for each of the sorted ``ranges`` of shards of the rows of ``words`` and ``values``."""
    for r, a, b in _runs(ranges):
        yield kind, level, r, b - a, _pack([c[a:b] for c in words], [c[a:b] for c in values])


def _facts(level: int, numbers: list[int]) -> list[tuple]:
    """A row for each number, to be summed over all shards."""
    return [(_FACTS, level, i, int(x), None) for i, x in enumerate(numbers)]


def _counts_of_counts(n: np.ndarray) -> list[int]:
    return [n.sum(), *[(n == k).sum() for k in (1, 2, 3, 4)], (n >= 3).sum()]


def _parts(kind: int, level: int, rows: list[tuple[int, bytes]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Word hashes (or contexts' keys) and values of rows (n, blob) of one kind and level."""
    columns, width = {_GRAM: (level + 1, level), _CONTEXT: (level + 3, level - 1), _TOKEN: (2, 1)}[kind]
    parts = np.concatenate([_unpack(blob, n, columns, width) for n, blob in rows], axis=1)
    found = parts[:width].view(np.uint64)
    if kind == _GRAM:
        found = found[np.argsort(_turn(level))]
    return found.T, list(parts[width:])


def _rows_of(layout: Layout, kind: int, level: int, grams: np.ndarray, values: list[np.ndarray]) -> Iterator[tuple]:
    """Rows of partial counts of ``grams``, repeats summed, for ranges of ``layout.per_row()`` shards."""
    keys, at, *sums = _sum_by(layout.keys(kind, level, grams)[0], *values)
    columns = grams[at].T
    return _dealt(kind, level, layout.shard(keys) // layout.per_row(), [columns[j] for j in _turn(level)] if kind == _GRAM else [*columns], sums)


_ROWS = "kind int, level int, shard int, n long, blob binary"


_NAMES, _TYPES = ["kind", "level", "shard", "n", "blob"], (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], _NAMES)


def _arrow(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows)])


def _coded(rows: np.ndarray) -> list[np.ndarray]:
    """A byte for each row, the places of the rows of byte 255, and the distinct rows: the commonest 255 (of those of small numbers, in a long table) by byte, then those of byte 255 by place."""
    if len(rows) < LONG:
        distinct, at = np.unique(keys_of(rows.astype(np.uint64)), return_inverse=True)
        n = np.bincount(at)
    else:  # small numbers side by side, and one more code for all other rows
        bits, at, any_of = 20 // rows.shape[1], np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for j in range(rows.shape[1]):
            at |= rows[:, j] << bits * j
            any_of |= rows[:, j]
        at[any_of >> bits > 0] = 1 << bits * rows.shape[1]
        n = np.bincount(at)
        n[1 << bits * rows.shape[1] :] = 0
    often = np.argsort(-n, kind="stable")[:255]
    often = often[n[often] > 0]
    one = np.empty(len(n), np.int64)
    one[at] = np.arange(len(at))
    rank = np.full(len(n), 255, np.uint8)
    rank[often] = np.arange(len(often))
    code = rank[at]
    odd = np.flatnonzero(code == 255)
    table = np.zeros((255 + len(odd), rows.shape[1]), np.int64)
    table[: len(often)], table[255:] = rows[one[often]], rows[odd]
    return [code, odd.astype(np.uint32), _narrow(table).ravel()]


def _save(path: str, taken: int, tables: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Write a shard's tables of sorted keys and rows of values; a rerun of a lost task puts the same bytes in its place.

    The ``taken`` top bits, which the shard tells, and a key's next bits, by which ``start`` finds a
    short run, aren't stored again: the rest is in ``low`` and ``high``, so that no bit is lost.
    """
    arrays = []
    for keys, rows in tables:
        n = len(keys)
        sizes = {b: (4 << b) + n * np.min_scalar_type((1 << max(0, 32 - taken - b)) - 1).itemsize for b in range(min(n.bit_length() + 1, 32 - taken))}
        bits = min([b for b in sizes if n >> b < RUN] or [max(sizes)], key=sizes.get)
        rest = 64 - taken - bits
        start = np.searchsorted(_run(keys, taken, bits), np.arange((1 << bits) + 1))
        high = (keys & np.uint64((1 << rest) - 1)) >> np.uint64(32)
        arrays += [start.astype(np.uint32), keys.astype(np.uint32), high.astype(np.min_scalar_type((1 << max(0, rest - 32)) - 1)), *_coded(rows)]
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(np.array([len(arrays), *[x for c in arrays for x in (c.itemsize, len(c))]], np.int64).tobytes())
        for c in arrays:
            f.write(c.tobytes() + bytes(-c.nbytes % 8))
    os.replace(part, path)


def _run(keys: np.ndarray, taken: int, bits: int) -> np.ndarray:
    """The ``bits`` after the first ``taken`` of each key."""
    return (keys << np.uint64(taken) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _path(folder: str, name: str, shard: int) -> str:
    return f"{folder}/{name}/{shard >> 10}/{shard}"


class Table:
    """Look-ups in the arrays of one table of ``_save``."""

    def __init__(self, taken: int, start: np.ndarray, low: np.ndarray, high: np.ndarray, code: np.ndarray, odd: np.ndarray, rows: np.ndarray):
        self.start, self.low, self.high, self.code, self.odd, self.rows = start, low, high, code, odd, rows
        self.taken, self.bits = taken, (len(start) - 1).bit_length() - 1
        self.rest = 64 - taken - self.bits

    def _at(self, place: np.ndarray) -> np.ndarray:
        return self.high[place].astype(np.uint64) << np.uint64(32) | self.low[place]

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys there are, and the places of those. Long runs are halved until they are short; then all keys of the runs are compared at once."""
        run, rest = _run(keys, self.taken, self.bits), keys & np.uint64((1 << self.rest) - 1)
        a, b = self.start[run].astype(np.int64), self.start[run + 1].astype(np.int64)
        hit, last = np.zeros(len(keys), bool), len(self.low) - 1
        if last < 0:
            return hit, a[:0]
        while int((b - a).max(initial=0)) > 8 * RUN:
            middle = (a + b) >> 1
            below = self._at(np.minimum(middle, last)) <= rest
            a, b = np.where(below, middle, a), np.where(below, b, middle)
        sizes = b - a
        ends = np.cumsum(sizes)
        at = np.repeat(a - ends + sizes, sizes)
        at += np.arange(len(at))
        same = np.flatnonzero(self.low[at] == np.repeat(rest.astype(np.uint32), sizes))
        place, which = at[same], np.searchsorted(ends, same, "right")
        whole = self.high[place] == rest[which] >> np.uint64(32)
        hit[which[whole]] = True
        return hit, place[whole]

    def values(self, place: np.ndarray, width: int) -> np.ndarray:
        row = self.code[place].astype(np.int64)
        rare = row == 255
        row[rare] += np.searchsorted(self.odd, place[rare])
        return self.rows.reshape(-1, width)[row].astype(np.int64)


def mapped(path: str, taken: int) -> list[Table]:
    """The tables of a file of ``_save``, memory-mapped for as long as any of them is held."""
    raw = np.asarray(np.memmap(path, np.uint8, "r"))
    columns = int(raw[:8].view(np.int64)[0])
    at, arrays = 8 + 16 * columns, []
    for size, n in raw[8:at].view(np.int64).reshape(-1, 2).tolist():
        arrays.append(raw[at : at + n * size].view(f"u{size}"))
        at += n * size + -n * size % 8
    return [Table(taken, *arrays[i : i + 6]) for i in range(0, columns, 6)]


@dataclass
class Level:
    """Sum of counts, and numbers of n-grams counted 1, 2, 3, 4, and 3 or more times."""

    total: int = 0
    of: list[int] = field(default_factory=lambda: [0] * 5)

    @property
    def discounts(self) -> tuple[float, float, float, float]:
        """For counts of 0, 1, 2 and more; where counts of counts are missing, half way to the usual estimate's bounds."""
        n1, n2, n3, n4, _ = self.of
        if not (n1 and n2):
            return 0.0, 0.5, 0.5, 0.5
        y = n1 / (n1 + 2 * n2)
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        return 0.0, *[min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)]


@dataclass
class Model:
    folder: str
    order: int
    shards: int
    levels: dict[int, Level]
    tokens: int  # N
    vocabulary: int  # V


def settle(layout: Layout, level: int, grams: np.ndarray, keys: np.ndarray, n: np.ndarray, hot: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple]]:
    """What a shard makes of its distinct n-grams, sorted by key: tables to store (n-grams, contexts that are whole, and likewise one level down) and rows for other shards."""
    tables, rows = [(keys, n[:, None])], _facts(level, _counts_of_counts(n))
    if level == 1:
        return tables, rows
    parts = [n, *[(n == k).astype(np.int64) for k in (1, 2)], (n >= 3).astype(np.int64)]
    contexts, at, *sums = _sum_by(layout.keys(_CONTEXT, level, grams[:, :-1])[0][~hot], *[x[~hot] for x in parts])
    tables.append((contexts, np.stack(sums, 1)))
    rows += _rows_of(layout, _CONTEXT, level, grams[hot, :-1], [x[hot] for x in parts])
    shorter = grams[:, 1:]
    if layout.primary(level) and level > 2:
        rows += _rows_of(layout, _GRAM, level - 1, shorter[hot], [np.ones(hot.sum(), np.int64)])
        own = shorter[~hot]
        below, at, types = _sum_by(layout.keys(_GRAM, level - 1, own)[0], np.ones(len(own), np.int64))
        more, others = settle(layout, level - 1, own[at], below, types, np.zeros(len(at), bool))
        return tables + more, rows + others
    return tables, rows + list(_rows_of(layout, _GRAM, level - 1, shorter, [np.ones(len(n), np.int64)]))


def train(docs: DataFrame, order: int = ORDER, *, text_col: str = "text") -> Model:
    """Count all of ``docs`` and write the model to the shared folder.

    Level ``order`` holds raw counts, lower levels the numbers of different words seen before an
    n-gram. Words are counted first, which gives the hot ones. Then a task counts its texts' n-grams
    in sorted arrays and passes on one compressed array for each range of shards, so the shuffle has
    rows by task and range rather than by n-gram, and a frequent n-gram is a partial count from each
    task. With more than FAN shards, rows are dealt to ranges of shards first, summed there and
    dealt again, so a row holds many n-grams whatever the size. The number of shards follows the
    size of the texts, which bounds a shard. ``Layout`` says what lies where; a shard's hashes and
    counts are written as sorted arrays, two levels to a file. Every pass reads all texts and counts
    its part of the shards. The driver gets sums over all shards only. Null texts count as empty;
    an empty table gives a model without tokens.
    """
    spark = docs.sparkSession
    slim = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text") + 6)).first()[0] or 0
    shards = 1 << max(0, math.ceil(math.log2(max(1, size / 6 / SHARD_NGRAMS))))
    parts = min(PASSES, shards)
    folder = store.new_path(spark, "ngrams")
    local, hot_count = store.local_view(folder), HOT
    model = Model(local, order, shards, {k: Level() for k in range(1, order + 1)}, 0, 0)

    def counting(kind: int, first: int = 0, end: int = shards) -> Callable:
        """Partial counts of the texts' tokens, or of their n-grams that lie in the shards from ``first`` to before ``end``."""
        width = 1 if kind == _TOKEN else order

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            layout = Layout(order, shards, np.zeros(0, np.uint64)) if kind == _TOKEN else Layout.of(local, order, shards)
            held: list[np.ndarray] = []
            counts: list[np.ndarray] = []

            def flush() -> pa.RecordBatch:
                grams, n = np.concatenate(held), np.concatenate(counts)
                held.clear()
                counts.clear()
                return _batch(list(_rows_of(layout, kind, width, grams, [n])))

            for batch in batches:
                for a in range(0, batch.num_rows, 1000):
                    h, ends, _ = line_up(batch.column(0).slice(a, 1000), width)
                    grams = _grams(h, layout.within(h, ends, first, end) if end - first < shards else ends, width)
                    if width == 1:  # words repeat
                        words, n = np.unique(grams, return_counts=True)
                        held.append(words[:, None])
                        counts.append(n.astype(np.int64))
                    else:
                        held.append(grams)
                        counts.append(np.ones(len(grams), np.int64))
                    if sum(map(len, held)) >= TOKENS_AT_ONCE:
                        yield flush()
            if held:
                yield flush()

        return count

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of ranges of shards, summed as far as memory goes, as rows of single shards."""
        layout = Layout.of(local, order, shards) if os.path.exists(f"{local}/hot") else Layout(order, shards, np.zeros(0, np.uint64))
        held: dict[tuple[int, int, int], list[tuple[int, bytes]]] = {}
        sizes: dict[tuple[int, int, int], int] = {}

        def flush(key: tuple[int, int, int]) -> pa.RecordBatch:
            kind, level, _ = key
            grams, values = _parts(kind, level, held.pop(key))
            del sizes[key]
            keys, at, *sums = _sum_by(layout.keys(kind, level, grams)[0], *values)
            columns = grams[at].T
            return _batch(list(_dealt(kind, level, layout.shard(keys), [columns[j] for j in _turn(level)] if kind == _GRAM else [*columns], sums)))

        for batch in batches:
            for row in batch.to_pylist():
                key = (row["kind"], row["level"], row["shard"])
                held.setdefault(key, []).append((row["n"], row["blob"]))
                sizes[key] = sizes.get(key, 0) + row["n"]
                if sum(sizes.values()) >= TOKENS_AT_ONCE:
                    yield flush(max(sizes, key=sizes.get))
        for key in list(held):
            yield flush(key)

    def merge(table: pa.Table) -> pa.Table:
        """All partial arrays of one kind, level and shard."""
        kind, level, shard = (table.column(c)[0].as_py() for c in ("kind", "level", "shard"))
        grams, values = _parts(kind, level, list(zip(table.column("n").to_pylist(), table.column("blob").to_pylist())))
        if kind == _TOKEN:
            keys, at, n = _sum_by(keys_of(grams), *values)
            _save(_path(local, "tokens", shard), int(math.log2(shards)), [(keys, n[:, None])])
            hot = grams[at, 0][n >= hot_count]
            return _arrow([*_facts(0, [len(keys), n.sum()]), (_HOT, 0, shard, len(hot), hot.tobytes())])
        layout = Layout.of(local, order, shards)
        keys, hot = layout.keys(kind, level, grams)
        keys, at, *sums = _sum_by(keys, *values)
        if kind == _CONTEXT:
            _save(_path(local, f"contexts-{level}", shard), layout.taken, [(keys, np.stack(sums, 1))])
            return _arrow([])
        tables, rows = settle(layout, level, grams[at], keys, sums[0], hot[at])
        _save(_path(local, f"level-{level}", shard), layout.taken, tables)
        return _arrow(rows)

    paths: list[str] = []

    def merged(rows: DataFrame) -> DataFrame:
        """Merge partial counts shard by shard, take up the facts, and return what goes on."""
        if -(-shards // FAN) > 1:
            salt = F.pmod(F.crc32("blob"), F.lit(SALTS))
            rows = map_arrow(rows.repartition("kind", "level", "shard", salt), again, _ROWS)
        out, path = store.materialize(rows.groupBy("kind", "level", "shard").applyInArrow(merge, _ROWS), "partials")
        paths.append(path)
        # At most six sums a level.
        for r in out.where(F.col("kind") == _FACTS).groupBy("level", "shard").agg(F.sum("n").alias("n")).collect():
            level, which, n = r["level"], r["shard"], int(r["n"])
            if level:
                own = model.levels[level]
                own.total, own.of = (own.total + n, own.of) if which == 0 else (own.total, [x + n * (i == which - 1) for i, x in enumerate(own.of)])
            elif which:
                model.tokens = n
            else:
                model.vocabulary = n
        # Shuffle files go when the driver's JVM finds their shuffle unused.
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        return out.where(F.col("kind") != _FACTS)

    def write_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The start mark and all hot words, sorted: at most one for HOT tokens."""
        found = [np.frombuffer(blob, np.uint64) for batch in batches for blob in batch.column(0).to_pylist()]
        hot = np.sort(np.concatenate([[BEGIN], *found]))
        os.makedirs(local, exist_ok=True)
        part = f"{local}/hot.{uuid.uuid4().hex}"
        hot.tofile(part)
        os.replace(part, f"{local}/hot")
        yield pa.RecordBatch.from_arrays([pa.array([len(hot)], pa.int64())], ["n"])

    tokens = merged(map_arrow(slim, counting(_TOKEN), _ROWS))
    map_arrow(tokens.where(F.col("kind") == _HOT).select("blob").coalesce(1), write_hot, "n long").collect()
    on = [merged(map_arrow(slim, counting(_GRAM, i * shards // parts, (i + 1) * shards // parts), _ROWS)) for i in range(parts)]
    for level in range(order - 1, 0, -1):
        # Contexts of the level above are whole when its n-grams have been merged.
        now = reduce(DataFrame.unionByName, on).where(((F.col("kind") == _GRAM) & (F.col("level") == level)) | ((F.col("kind") == _CONTEXT) & (F.col("level") == level + 1)))
        on.append(merged(now))
    for path in paths:
        store.drop(spark, path)
    return model


class Reader:
    """Look-ups in a model's memory-mapped arrays, of which MAPS files at most are mapped at once."""

    def __init__(self, model: Model):
        self.model, self.layout = model, Layout.of(model.folder, model.order, model.shards)
        self.open: OrderedDict[tuple[str, int], list[Table]] = OrderedDict()

    def _tables(self, name: str, shard: int) -> list[Table]:
        at = (name, shard)
        if at not in self.open:
            path = _path(self.model.folder, name, shard)
            self.open[at] = mapped(path, self.layout.taken) if os.path.exists(path) else []
            if len(self.open) > MAPS:
                self.open.popitem(last=False)
        self.open.move_to_end(at)
        return self.open[at]

    def find(self, kind: int, level: int, keys: np.ndarray, hot: np.ndarray, width: int = 1) -> np.ndarray:
        """The values of ``Layout.keys``; zeros where there are none. Looked up shard by shard, roughly in order, which keeps to few pages at a time."""
        shard, out = self.layout.shard(keys), np.zeros((len(keys), width), np.int64)
        rough = (keys >> np.uint64(48)).astype(np.uint16) if self.layout.taken <= 16 else shard
        inner = kind != _TOKEN and not self.layout.primary(level) and level > 1  # stored with the level above, where that is whole
        own = {_TOKEN: "tokens", _GRAM: f"level-{level}", _CONTEXT: f"contexts-{level}"}[kind]
        places = [(hot if inner or kind == _CONTEXT else np.ones(len(keys), bool), own, 0)]
        if kind == _CONTEXT or inner:
            places.append((~hot, f"level-{level + inner}", 2 * inner + (kind == _CONTEXT)))
        for which, name, table in places:
            which = np.flatnonzero(which)
            which = which[np.argsort(rough[which], kind="stable")]
            own, found = keys[which], np.zeros((len(which), width), np.int64)
            for s, a, b in _runs(shard[which]):
                if tables := self._tables(name, s):
                    hit, place = tables[table].places(own[a:b])
                    found[a:b][hit] = tables[table].values(place, width)
            out[which] = found
        return out if width > 1 else out[:, 0]

    def scores(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each row's last word after the others, and that word's count in training.

        ``grams``: rows of ``windows`` in their order, or a stretch of them. Each distinct word,
        context and n-gram is looked up once; all of them are told apart by exact codes of the words.
        """
        model, order = self.model, self.model.order
        names, ids = _distinct(np.concatenate([grams[:, -1], [BEGIN], grams[: order - 1, :-1].ravel()]))
        at = [ids[: len(grams)]]
        for j in range(order - 2, -1, -1):  # mostly the last word of an earlier row
            guess = np.roll(at[0], 1)
            odd = np.flatnonzero(names[guess] != grams[:, j])
            guess[odd] = np.searchsorted(names, grams[odd, j])
            at.insert(0, guess)
        seen, own = (self.find(kind, 1, *self.layout.keys(kind, 1, names[:, None])) for kind in (_TOKEN, _GRAM))
        level = model.levels[1]
        d = np.array(level.discounts)
        new = 1 / (model.vocabulary + 1)
        if level.total:
            spare = (d[1] * level.of[0] + d[2] * level.of[1] + d[3] * level.of[4]) / level.total
            p = np.maximum(own - d[np.minimum(own, 3)], 0) / level.total + spare * new
        else:
            p = np.full(len(names), new)
        p, known = p[at[-1]], seen[at[-1]]
        context, contexts = np.zeros(len(grams), np.int64), 1
        for k in range(2, order + 1):
            d = np.array(model.levels[k].discounts)
            first, context = _grouped(at[-k] * contexts + context)
            contexts = len(first)
            sums = self.find(_CONTEXT, k, *self.layout.keys(_CONTEXT, k, grams.take(first, 0)[:, -k:-1]), 4)
            total = np.maximum(sums[:, 0], 1)
            share = np.where(sums[:, 0] > 0, (sums[:, 1:] * d[1:]).sum(1) / total, 1.0)
            first, back = _grouped(context * len(names) + at[-1])
            n = self.find(_GRAM, k, *self.layout.keys(_GRAM, k, grams.take(first, 0)[:, -k:]))
            p = (np.maximum(n - d[np.minimum(n, 3)], 0) / total[context[first]])[back] + share[context] * p
        return np.log10(p), known


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: doc_id, n_tokens, n_known, train_tokens, base_score, score and perplexity.

    A null text counts as empty, which is one token, the end. Repeated rows give repeated results;
    other columns are left out; an empty table gives no rows, and a model of no text gives every
    token the probability 1. A map over rows: no shuffle; workers of a machine share the mapped
    pages, and each look-up run is sorted first, so that pages are read in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = kept(("kneser_ney", model.folder), lambda: Reader(model))
        floor = model.tokens + model.vocabulary + 1
        def scored(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            ids, texts = (c.combine_chunks() for c in pa.Table.from_batches(held).columns)
            grams, sizes = windows(texts, model.order)
            starts = np.cumsum(sizes) - sizes
            cuts = np.linspace(0, len(grams), -(-len(grams) // _SCORE_TOKENS) + 1).astype(np.int64)
            logs, seen = (np.concatenate(x) for x in zip(*(reader.scores(grams[a:b]) for a, b in zip(cuts[:-1], cuts[1:]))))
            total = np.add.reduceat(logs, starts)
            base = np.add.reduceat(np.log10((seen + 1) / floor), starts)
            columns = [sizes, np.add.reduceat((seen > 0).astype(np.int64), starts), np.full(len(sizes), model.tokens), base, total, 10 ** np.minimum(-total / sizes, 300)]
            return pa.RecordBatch.from_arrays([ids, *map(pa.array, columns)], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

        held, room = [], _SCORE_TOKENS * 6
        for batch in batches:
            at = 0
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy() + 6
            ends = np.cumsum(lengths, dtype=np.int64)
            while at < len(ends):  # up to where the room ends, and a text at least
                before = ends[at - 1] if at else 0
                to = max(int(np.searchsorted(ends, before + room)), at + (not held))
                if to > at:
                    held.append(batch.slice(at, to - at))
                    room -= int(ends[to - 1] - before)
                if to < len(ends):
                    yield scored(held)
                    held, room = [], _SCORE_TOKENS * 6
                at = to
        if held:
            yield scored(held)

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return map_arrow(slim, run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, mod 7, is 2; null for a null id, which is neither held out nor learned from."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(7)) == 2


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Learn from the documents that aren't held out and score all."""
    model = train(docs.where(~held_out()), order)
    return score(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
