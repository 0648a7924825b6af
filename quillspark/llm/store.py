"""Tables and files in the folder that driver and executors share.

The folder is the one named by ``spark.checkpoint.dir``. Only where that setting is absent, as in
tests on one machine, a temporary folder stands in for it.
"""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

#: Rows of a table that may be sent to every executor rather than joined by a shuffle.
BROADCAST_ROWS = 200_000
_fallback: dict[str, str] = {}
_written: dict[str, set[str]] = {}  # application -> tables that haven't been deleted
_open: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("open", default=None)


def shared_folder(spark: SparkSession) -> str:
    """URI of the shared folder; refuses a machine-local stand-in on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    return _fallback[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/quillspark/{name}-{uuid.uuid4().hex}"


def local_view(uri: str) -> str:
    """The path by which a worker opens a shared file; memory maps need a mounted file system."""
    u = urlparse(uri)
    if u.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted shared folder (file:), not {u.scheme}:")
    return unquote(u.path) if u.scheme else uri


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    _written.setdefault(df.sparkSession.sparkContext.applicationId, set()).add(path)
    if (inner := _open.get()) is not None:
        inner.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize_by(df: DataFrame, name: str, column: str) -> DataFrame:
    """As ``materialize``, in as many buckets of ``column`` as a shuffle has partitions, so that a join on it leaves the rows where they are."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    table = f"quillspark_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).saveAsTable(table)
    _written.setdefault(spark.sparkContext.applicationId, set()).add(path)
    if (inner := _open.get()) is not None:
        inner.append(path)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name alone: the files are its path's
    return out


def joinable(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of ``rows`` at most, as a side of a join: shuffled beyond BROADCAST_ROWS.

    The planner goes by the size of files, which says little of rows: ids in order take a byte or
    two each there, and exploded ones none. A broadcast is built in the driver's memory.
    """
    return df.hint("merge") if rows > BROADCAST_ROWS else df


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table whose readers have all been materialized."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    _written.get(spark.sparkContext.applicationId, set()).discard(path)


@contextlib.contextmanager
def keeping_only(spark: SparkSession) -> Iterator[set[str]]:
    """Delete the tables that are materialized inside, but those whose paths are put into the set."""
    kept: set[str] = set()
    token = _open.set([])
    try:
        yield kept
    finally:
        inner = _open.get() or []
        _open.reset(token)
        live = _written.get(spark.sparkContext.applicationId, set())
        for path in inner:
            if path in live and path not in kept:
                drop(spark, path)
        if (outer := _open.get()) is not None:
            outer += [p for p in inner if p in kept]


def clear(spark: SparkSession) -> None:
    """Delete all of this application's tables in the shared folder; results that read them must have been written."""
    for path in list(_written.get(spark.sparkContext.applicationId, ())):
        drop(spark, path)
