"""Best-fit packing of tokenized documents, planned on the histogram of lengths."""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .word_bpe import Cache, WordBPE, default_file
from .workers import kept, map_arrow

CAPACITY = 4096


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths 1..capacity.

    Returns segments (length, rank_from, bins, per_bin, first_sequence, offset): the pieces of that
    length with ranks rank_from .. rank_from + bins * per_bin - 1 go to sequences first_sequence ..,
    per_bin to each, the first at ``offset`` and the others behind it. Bins that are filled alike
    are one run, so work and plan grow with the number of distinct lengths, at most ``capacity``,
    and not with the number of pieces.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, bins)
    rooms: list[int] = []  # sorted
    out: list[tuple[int, int, int, int, int, int]] = []
    opened = 0

    def put(room: int, run: tuple[int, int]) -> None:
        if room:
            if room not in runs:
                bisect.insort(rooms, room)
                runs[room] = []
            runs[room].append(run)

    def fill(length: int, rank: int, left: int, room: int, first: int, bins: int) -> int:
        """Place up to ``left`` pieces into a run of equal bins; returns how many."""
        per = room // length
        whole, rest = min(bins, left // per), 0
        if whole:
            out.append((length, rank, whole, per, first, capacity - room))
            put(room - per * length, (first, whole))
        placed = whole * per
        if whole < bins and left > placed:
            rest = min(per, left - placed)
            out.append((length, rank + placed, 1, rest, first + whole, capacity - room))
            put(room - rest * length, (first + whole, 1))
            placed += rest
        used = whole + bool(rest)
        if used < bins:
            put(room, (first + used, bins - used))
        return placed

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, bins = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    rooms.pop(k)
            else:
                room, first, bins = capacity, opened, -(-left // (capacity // length))
                opened += bins
            placed = fill(length, rank, left, room, first, bins)
            rank, left = rank + placed, left - placed
    return out


def _worker(file: str) -> tuple[WordBPE, Cache]:
    """The tokenizers library's model encodes each distinct word; the cache repeats its ids."""

    def make():
        from tokenizers import Tokenizer

        model, bpe = Tokenizer.from_file(file).model, WordBPE(file)
        return bpe, Cache(bpe.split, lambda w: struct.pack(f"<{len(ids := [t.id for t in model.tokenize(bpe.symbols(w))])}I", *ids), b"".join)

    return kept(("packing", file), make)


def pieces(docs: DataFrame, tokenizer_file: str | None = None, *, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Tokenize whole texts, end each with ``end_id``, and cut those above ``capacity``.

    Returns doc_id, piece, start, length, ids_crc32, task and nth (the piece is the task's nth of its
    length, from 0) and, with ``keep_ids``, ids. A null or empty text is the one token ``end_id``.
    """
    file = tokenizer_file or default_file()
    ending = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = _worker(file)
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            rows, source, ids = [], [], []
            for n, text in enumerate(batch.column(1)):
                raw = b"".join([np.uint32(s).tobytes() if s >= 0 else b"".join(map(cache.__getitem__, chunks)) for s, chunks in bpe.segments(text.as_py() or "")]) + ending
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    cut = raw[at : at + 4 * capacity]
                    rows.append((k, at // 4, len(cut) // 4, zlib.crc32(cut), task, seen[len(cut) // 4]))
                    seen[len(cut) // 4] += 1
                    source.append(n)
                    if keep_ids:
                        ids.append(cut)
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))]
            if keep_ids:
                ends = np.concatenate([[0], np.cumsum([len(c) // 4 for c in ids], dtype=np.int64)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), *columns], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", "ids"][: 1 + len(columns)])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(slim, run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids array<int>" * keep_ids)


def pack(docs: DataFrame, tokenizer_file: str | None = None, *, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id and
    offset. Null texts pack as empty ones, repeated rows as documents of their own; other columns
    are left out; an empty table gives no rows.

    Pieces of one length are alike, so which of them takes which slot doesn't matter: pieces and
    slots meet by (length, rank). A piece's rank is its place among its task's pieces of that
    length plus the counts of earlier tasks; it is written with the piece, so a hot length is
    counted where it lies. The driver sees the histogram (at most ``capacity`` rows) only, and the
    plan's runs are bounded by it too. Pieces are written in buckets of their task, and the tasks'
    counts, a row for each task, are shuffled to them: ids are written once and not shuffled.
    """
    cut = store.materialize_by(pieces(docs, tokenizer_file, end_id=end_id, capacity=capacity, id_col=id_col, text_col=text_col, keep_ids=keep_ids), "pieces", "task")
    by_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shifts, _ = store.materialize(by_task.select("length", "task", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift")), "shifts")
    counts = {r["length"]: r["n"] for r in shifts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    segments = docs.sparkSession.createDataFrame(plan(counts, capacity), "l long, rank_from long, bins long, per_bin long, first_sequence long, first_offset long")
    # A row for each task, with at most ``capacity`` entries.
    shifts = shifts.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("length", "shift"))).alias("shifts"))
    step = F.col("nth") + F.col("shift") - F.col("rank_from")
    return (
        cut.join(shifts.hint("shuffle_hash"), "task")
        .withColumn("shift", F.col("shifts")[F.col("length")])
        .join(
            F.broadcast(segments),  # a few rows for each distinct length, of which there are at most ``capacity``
            (F.col("length") == F.col("l")) & (step >= 0) & (step < F.col("bins") * F.col("per_bin")),
        )
        .select(
            *[c for c in cut.columns if c not in ("task", "nth")],
            (F.col("first_sequence") + F.floor(step / F.col("per_bin"))).cast("long").alias("sequence_id"),
            (F.col("first_offset") + F.pmod(step, F.col("per_bin")) * F.col("length")).cast("long").alias("offset"),
        )
    )
