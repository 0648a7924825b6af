"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .components import connected_components
from .workers import map_arrow

RADIUS = 4
#: Distinct fingerprints of a bucket beyond which it is split by a second set of masks.
CAP = 4096
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_HASHES_AT_ONCE = 1 << 16


def words(text: str | None) -> list[bytes]:
    """The words of a text: A-Z in lower case, cut at the ASCII white space that bytes.split() cuts at."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of the ``width``-word shingles, repeats included: a bit is 1 if set in over half of their XXH64."""
    own = words(text)
    if not own:
        return 0
    joined = b" ".join(own)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    n = max(1, len(own) - width + 1)
    starts = np.concatenate([[0], spaces + 1])[:n].tolist()
    ends = np.concatenate([spaces, [len(joined)]])[min(width, len(own)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _HASHES_AT_ONCE):
        to = at + _HASHES_AT_ONCE
        h = np.array([digest(joined[s:e], 42) for s, e in zip(starts[at:to], ends[at:to])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text, as a signed long. A null text has no words and the fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(slim, run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fp long")


def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """2^(radius+1) - 1 masks over ``bits`` such that any two words that differ in at most ``radius`` of them agree under some mask.

    Each bit has a nonzero vector a of radius + 1 bits, dealt in turn; mask v keeps the bits with
    odd <a, v>. The vectors of ``radius`` differing bits span less than the whole space, so some
    nonzero v is orthogonal to them all and keeps none of them.
    """
    size = (1 << (radius + 1)) - 1
    return [sum(1 << b for k, b in enumerate(bits) if ((k % size + 1) & v).bit_count() & 1) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the distinct fingerprints ``x`` as all links within ``radius`` do: one for each but the first of a component."""
    rest, a, b = np.arange(len(x)), [], []
    stack: list[int] = []
    while len(rest) or stack:
        if not stack:
            stack.append(int(rest[0]))
            rest = rest[1:]
        u = stack.pop()
        near = np.bitwise_count(x[rest] ^ x[u]) <= radius
        if near.any():
            new = rest[near]
            rest = rest[~near]
            a.append(np.full(len(new), u))
            b.append(new)
            stack += new.tolist()
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _links(group: np.ndarray, x: np.ndarray, radius: int, small: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal ``group``: all of a small run's, a spanning forest of a larger one's."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.concatenate([first, [len(x)]]))
    length = np.repeat(size, size)
    a, b = [], []
    i = np.flatnonzero((length > 1) & (length <= small))
    for d in range(1, small):
        i = i[i + d < len(x)]
        i = i[group[i] == group[i + d]]
        if not len(i):
            break
        near = np.bitwise_count(x[i] ^ x[i + d]) <= radius
        a.append(x[i[near]])
        b.append(x[i[near] + d])
    for at, n in zip(first[size > small], size[size > small]):
        own = x[at : at + n]
        p, q = forest(own, radius)
        a.append(own[p])
        b.append(own[q])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between the distinct fingerprints of ``prints`` (fp) that connect all those within ``radius`` bits.

    Every fingerprint goes into one bucket of each of 2^(radius+1) - 1 tables; buckets of one are
    dropped before Python sees them. A bucket of over CAP is dealt out again by covering masks over
    the bits its own mask left out, about 32, which leaves about 16 open: at most 65,536 distinct
    fingerprints, however many rows share them. So a task holds a bounded bucket at a time, and
    emits a spanning forest of it rather than its pairs.
    """
    spark = prints.sparkSession
    masks = covering_masks(list(range(64)), radius)
    table = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(_signed(m)).alias("mask")) for t, m in enumerate(masks)]))
    tables = prints.select("fp", table.alias("m")).select("fp", "m.t", F.col("fp").bitwiseAND(F.col("m.mask")).alias("key"))
    shared = tables.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows, path = store.materialize(tables.join(shared.hint("merge"), ["t", "key"]), "buckets")  # either side has up to 31 rows a fingerprint
    inner = F.create_map(*[x for t, m in enumerate(masks) for x in (F.lit(t), F.array(*[F.lit(_signed(m | s)) for s in covering_masks([b for b in range(64) if not m >> b & 1], radius)]))])
    split = rows.where(F.col("n") > CAP).select("fp", "t", F.posexplode(inner[F.col("t")]).alias("s", "mask"))
    split = split.select("fp", (F.col("t") * 64 + F.col("s") + 1).alias("g"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    buckets = rows.where(F.col("n") <= CAP).select("fp", (F.col("t") * 64).alias("g"), "key").unionByName(split)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None  # the last, perhaps unfinished bucket

        def out(g, key, fp):
            group = np.cumsum(np.concatenate([[False], (g[1:] != g[:-1]) | (key[1:] != key[:-1])]))
            a, b = _links(group, fp.view(np.uint64), radius)
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if kept is not None:
                now = [np.concatenate(x) for x in zip(kept, now)]
            g, key, _ = now
            if not len(g):
                continue
            last = int(np.flatnonzero((g != g[-1]) | (key != key[-1]))[-1]) + 1 if (g[0] != g[-1] or key[0] != key[-1]) else 0
            if last:
                yield out(*[x[:last] for x in now])
            kept = [x[last:] for x in now]
        if kept is not None:
            yield out(*kept)

    ordered = buckets.select("g", "key", "fp").repartition("g", "key").sortWithinPartitions("g", "key")
    found, _ = store.materialize(map_arrow(ordered, run, "a long, b long").distinct(), "links")
    store.drop(spark, path)
    return found


def near_duplicates(docs: DataFrame, radius: int = RADIUS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose fingerprints are linked by up to ``radius`` differing bits, directly or through others.

    Returns doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id of the group.
    Null and wordless texts have the fingerprint 0 and link like any other; null ids take part and
    are no group's smallest unless it has no other; repeated rows come back repeated; other columns
    are left out; an empty table gives no rows. Copies collapse to one fingerprint by a partial
    aggregation before anything is compared, so a group of copies costs one row.
    """
    with store.keeping_only(docs.sparkSession) as kept:
        prints, prints_at = store.materialize(fingerprints(docs, id_col=id_col, text_col=text_col), "prints")
        classes, _ = store.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
        n = classes.count()  # no table that follows has more rows
        found = connected_components(links(classes.select("fp"), radius))
        rooted = classes.join(store.joinable(found.withColumnRenamed("id", "fp"), n), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
        smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
        member, member_at = store.materialize(rooted.join(store.joinable(smallest, n), "root").select("fp", "component_id"), "members")
        kept |= {prints_at, member_at}
    return prints.join(store.joinable(member, n), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, radius: int = RADIUS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their group's smallest. Rows with null ids stay, and all rows of a repeated id if any of them does."""
    groups = near_duplicates(docs, radius, id_col=id_col, text_col=text_col)
    gone = groups.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__gone")).agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("all")).where("all").select("__gone")
    gone, _ = store.materialize(gone, "gone")
    n = gone.count()
    gone = F.broadcast(gone) if n <= store.BROADCAST_ROWS else store.joinable(gone, n)  # else texts and ids are shuffled to each other
    return docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti")
