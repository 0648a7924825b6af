"""Key-value tables: bytes to bytes, as an append-only log of operations.

A log is a folder of Parquet files with rows (seq, node, key, value, deleted). The newest operation
of a key counts: the highest (seq, node). Operations are collected in memory and appended in
batches, at the latest after an interval; compaction keeps the newest of each key. The same files feed replicas as a stream.
"""

from __future__ import annotations

import json
import logging
import threading
import time
import uuid
import zlib
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fs import Files

SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("node", T.IntegerType()), T.StructField("db", T.IntegerType()), T.StructField("table", T.StringType()),
    T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType()), T.StructField("deleted", T.BooleanType()),
])


def newest(log: DataFrame) -> DataFrame:
    """The last operation of each (db, table, key), deletions included. Duplicated operations count once."""
    return (
        log.groupBy("db", "table", "key")
        .agg(F.max_by(F.struct("seq", "node", "value", "deleted"), F.struct("seq", "node")).alias("last"))
        .select("last.seq", "last.node", "db", "table", "key", "last.value", "last.deleted")
    )


def live(log: DataFrame) -> DataFrame:
    """What the log's tables hold now."""
    return newest(log).where(~F.col("deleted")).select("db", "table", "key", "value")


class Log:
    def __init__(self, spark: SparkSession, files: Files, folder: str, node: int, batch_size: int, interval: float):
        self.spark, self.files, self.folder, self.node, self.batch_size, self.interval = spark, files, folder, node, batch_size, interval
        self.buffer: list[tuple] = []
        self.lock = threading.RLock()
        self.timer: threading.Timer | None = None
        self.seq = self._replay()

    @property
    def operations(self) -> str:
        """The folder of appended files, which replicas read as a stream."""
        return f"{self.folder}/operations"

    @property
    def snapshots(self) -> str:
        return f"{self.folder}/snapshots"

    def _replay(self) -> int:
        """The highest sequence number that was written before."""
        if not self._parts():
            return 0
        return self.stored().agg(F.max("seq")).first()[0] or 0

    def _parts(self) -> list[str]:
        ops = [self.operations] if any(n.endswith(".parquet") for n in self.files.list(self.operations)) else []
        snapshot = [f"{self.snapshots}/{n}" for n in self.files.list(self.snapshots) if self.files.exists(f"{self.snapshots}/{n}/_SUCCESS")]
        return snapshot[-1:] + ops

    def stored(self) -> DataFrame:
        parts = self._parts()
        return self.spark.read.schema(SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], SCHEMA)

    def append(self, db: int, table: str, key: bytes, value: bytes | None) -> None:
        """Put, or with no value remove."""
        with self.lock:
            self.seq += 1
            self.buffer.append((self.seq, self.node, db, table, bytes(key), None if value is None else bytes(value), value is None))
            if len(self.buffer) >= self.batch_size:
                self.flush()
            elif self.timer is None:
                self.timer = threading.Timer(self.interval, self._due)
                self.timer.daemon = True
                self.timer.start()

    def put_all(self, rows: DataFrame, db: int, table: str) -> None:
        """Put every (key, value) of a DataFrame by one distributed append."""
        with self.lock:
            self.flush()
            self.seq += 1
            rows.select(F.lit(self.seq).cast("long").alias("seq"), F.lit(self.node).alias("node"), F.lit(db).alias("db"), F.lit(table).alias("table"), F.col("key").cast("binary"), F.col("value").cast("binary"), F.lit(False).alias("deleted")).write.mode("append").parquet(self.operations)

    def flush(self) -> None:
        with self.lock:
            if self.buffer:
                self.spark.createDataFrame(self.buffer, SCHEMA).coalesce(1).write.mode("append").parquet(self.operations)
                self.buffer.clear()
            if self.timer is not None:
                self.timer.cancel()
                self.timer = None

    def _due(self) -> None:
        """Append what has waited for the interval; if that fails, it waits for another one."""
        with self.lock:
            self.timer = None
            try:
                self.flush()
            except Exception:
                logging.getLogger(__name__).exception("operations are still in memory: the log can't be written")
                if self.spark.sparkContext._jsc is not None:
                    self.timer = threading.Timer(self.interval, self._due)
                    self.timer.daemon = True
                    self.timer.start()

    def get(self, db: int, table: str, key: bytes) -> bytes | None:
        with self.lock:
            for seq, _, d, t, k, value, _ in reversed(self.buffer):
                if (d, t, k) == (db, table, bytes(key)):
                    return value
        # Equality on the key reaches the Parquet scan.
        one = self.stored().where((F.col("db") == db) & (F.col("table") == table) & (F.col("key") == F.lit(bytes(key))))
        found = one.agg(F.max_by(F.struct("value", "deleted"), F.struct("seq", "node")).alias("last")).first()["last"]
        return None if found is None or found["deleted"] else bytes(found["value"])

    def table(self, db: int, table: str) -> DataFrame:
        """(key, value) of a table."""
        self.flush()
        return live(self.stored().where((F.col("db") == db) & (F.col("table") == table))).select("key", "value")

    def snapshot(self) -> DataFrame | None:
        """What the newest snapshot holds."""
        found = [x for x in self._parts() if x != self.operations]
        return self.spark.read.schema(SCHEMA).parquet(*found) if found else None

    def register(self, checkpoint: str) -> None:
        """Keep operations until the replica with this checkpoint has read them."""
        self.files.write(f"{self.folder}/replicas/{zlib.crc32(checkpoint.encode()):08x}-{len(checkpoint)}", checkpoint)

    def forget(self, checkpoint: str) -> None:
        """Wait for this replica no longer."""
        self.files.delete(f"{self.folder}/replicas/{zlib.crc32(checkpoint.encode()):08x}-{len(checkpoint)}")

    def _passed(self, checkpoint: str) -> set[str]:
        """Names of the operation files in the finished batches of a stream's checkpoint."""
        last = max((int(n) for n in self.files.list(f"{checkpoint}/commits") if n.isdigit()), default=-1)
        out = set()
        for n in self.files.list(f"{checkpoint}/sources/0"):
            if n.removesuffix(".compact").isdigit():
                entries = map(json.loads, self.files.read(f"{checkpoint}/sources/0/{n}").splitlines()[1:])
                out |= {x["path"].rsplit("/", 1)[-1] for x in entries if x["batchId"] <= last}
        return out

    def compact(self) -> None:
        """Fold snapshot and operations into a new snapshot, in key ranges; deleted keys leave no trace.

        Operation files go when every registered replica has read them; till then they count beside
        the snapshot, which changes nothing, as the newest operation of a key does.
        """
        with self.lock:
            self.flush()
            parts = self._parts()
            names = set(self.files.list(self.operations))
            if not parts:
                return
            for n in self.files.list(f"{self.folder}/replicas"):
                if "." not in n:
                    names &= self._passed(self.files.read(f"{self.folder}/replicas/{n}"))
            at = f"{self.snapshots}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
            last = newest(self.spark.read.schema(SCHEMA).parquet(*parts))
            if names != set(self.files.list(self.operations)):
                kept = last  # a deletion must outweigh the older operations that stay
            else:
                kept = last.where(~F.col("deleted") | (F.col("seq") == self.seq))
            kept.repartitionByRange("db", "table", "key").sortWithinPartitions("db", "table", "key").write.parquet(at)
            for name in names:
                self.files.delete(f"{self.operations}/{name}")
            for old in self.files.list(self.snapshots):
                if not at.endswith(old):
                    self.files.delete(f"{self.snapshots}/{old}")

    def apply(self, operations: Iterable[tuple]) -> None:
        """Take operations of another node as they are, by their own numbers."""
        with self.lock:
            self.flush()
            rows = list(operations)
            if rows:
                self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.operations)
                self.seq = max(self.seq, max(r[0] for r in rows))
