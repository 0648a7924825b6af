"""Versioned Parquet tables.

A version is a list of immutable files. Inserts add files; updates and deletes rewrite only the
files that hold a touched row. A new list takes effect with the catalog's atomic replacement, so
readers and failed statements see whole versions, and undoing a statement is going back to a list.

Beside each write of a full-text table stands its term table: the tokens of each of its files, sorted,
with the number of texts that have them. It is as immutable as the files, so whatever list of files is
current, rollbacks included, has its terms.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fts
from ..types import declared
from .catalog import ROWID, Table
from .fs import Files

FILE = "__file"
_TERMS = "terms-"


class Storage:
    def __init__(self, spark: SparkSession, files: Files):
        self.spark, self.files = spark, files

    def read(self, table: Table, only: list[str] | None = None) -> DataFrame:
        """The rows of the current version, or of some of its files, with their rowids."""
        names = table.files if only is None else only
        if not names:
            return self.spark.createDataFrame([], table.schema)
        return self._scan(table, names).select(*self._named(table))

    def _scan(self, table: Table, names: list[str]) -> DataFrame:
        fields = [T.StructField(ROWID, T.LongType()), *[T.StructField(c.physical, declared(c.type)) for c in table.columns]]
        return self.spark.read.schema(T.StructType(fields)).parquet(*self._paths(table, names))

    @staticmethod
    def _paths(table: Table, names: list[str]) -> list[str]:
        """Whole folders where all of their files are wanted, so a large table is a few paths."""
        by_folder: dict[str, list[str]] = {}
        for n in names:
            by_folder.setdefault(n.split("/")[0], []).append(n)
        return [f"{table.folder}/{p}" for folder, own in by_folder.items() for p in ([folder] if len(own) == table.written.get(folder) else own)]

    @staticmethod
    def _named(table: Table) -> list:
        return [F.col(ROWID), *[F.col(c.physical).alias(c.name) for c in table.columns]]

    def with_files(self, table: Table, only: list[str] | None = None) -> DataFrame:
        """``read`` with the name of each row's file."""
        names = table.files if only is None else only
        if not names:
            return self.read(table, []).withColumn(FILE, F.lit(""))
        file = F.concat_ws("/", F.element_at(F.split("_metadata.file_path", "/"), -2), F.col("_metadata.file_name"))
        return self._scan(table, names).select(*self._named(table), file.alias(FILE))

    def write(self, table: Table, rows: DataFrame) -> list[str]:
        """Write rows (any order of columns) as new files of the table; returns their names. Not yet part of a version.

        The leading column of the first index orders each file, so Parquet's statistics and, for
        indexed columns, Bloom filters let later reads skip row groups.
        """
        folder = f"v{table.version + 1}-{uuid.uuid4().hex[:12]}"
        indexed = list(dict.fromkeys(i.columns[0] for i in table.indexes))
        out = rows.select(F.col(ROWID).cast("long").alias(ROWID), *[F.col(f"`{c.name}`").cast(declared(c.type)).alias(c.physical) for c in table.columns])
        physical = [table.column(c).physical for c in indexed]
        if indexed:
            out = out.sortWithinPartitions(physical[0])
        writer = out.write
        for c in physical:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(f"{table.folder}/{folder}")
        names = [f"{folder}/{n}" for n in self.files.list(f"{table.folder}/{folder}") if n.startswith("part-")]
        table.written[folder] = len(names)
        if table.fts_column and names:
            texts = self.with_files(table, names).select(F.col(FILE).alias("file"), F.col(f"`{table.fts_column}`").alias("text"))
            fts.terms(texts).sortWithinPartitions("token").write.parquet(self._terms(table, folder))
        return names

    @staticmethod
    def _terms(table: Table, folder: str) -> str:
        return f"{table.folder}/{_TERMS}{folder}"

    def found(self, table: Table, wanted: list[str], *, all_of_them: bool = False) -> list[Row]:
        """What the term table says of the query's tokens: (file, docs, tokens, having: token -> docs) of each current file.

        ``all_of_them``: of those files only that have texts with every token. The term table is read
        for the query's tokens alone; a row for each file, as many as the catalog lists, comes back.
        """
        if not table.files:
            return []
        folders = dict.fromkeys(n.split("/")[0] for n in table.files)
        terms = self.spark.read.schema("token string, file string, docs long, tokens long").parquet(*[self._terms(table, f) for f in folders])
        is_whole = F.col("token") == ""
        by_file = terms.where(F.col("token").isin(["", *wanted])).groupBy("file").agg(
            F.sum(F.when(is_whole, F.col("docs"))).alias("docs"),
            F.sum(F.when(is_whole, F.col("tokens"))).alias("tokens"),
            F.map_from_entries(F.collect_list(F.when(~is_whole, F.struct("token", "docs")))).alias("having"),  # one entry for each of the query's tokens
        )
        if all_of_them:
            by_file = by_file.where(F.size("having") == len(set(wanted)))
        current = set(table.files)
        return [r for r in by_file.collect() if r["file"] in current]

    def cluster(self, table: Table, column: str) -> list[str]:
        """All rows rewritten in ranges of a column, so that a range of values is in few files."""
        return self.write(table, self.read(table).repartitionByRange(F.col(f"`{column}`")))

    def compact(self, table: Table) -> list[str]:
        """All rows rewritten in files of Spark's advisory size, in ranges of the first index's column if there is one."""
        if table.indexes:
            return self.cluster(table, table.indexes[0].columns[0])
        return self.write(table, self.read(table).hint("rebalance"))

    def with_rowids(self, table: Table, rows: DataFrame) -> tuple[DataFrame, int]:
        """Rows numbered on from the table's next rowid, and how many there are.

        They are written once to a draft whose files give each row a place; numbers are the place
        plus the count of earlier files, a small table, so nothing passes through one task.
        """
        draft = f"{table.folder}/draft-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(draft)
        kept = self.spark.read.schema(rows.schema).parquet(draft)
        placed = kept.select("*", F.col("_metadata.file_name").alias("__f"), F.col("_metadata.row_index").alias("__i"))
        counts = sorted((r["__f"], r["n"]) for r in placed.groupBy("__f").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each file
        shifts, total = [], 0
        for name, n in counts:
            shifts.append((name, table.next_rowid + total))
            total += n
        base = self.spark.createDataFrame(shifts, "__f string, __base long")
        return placed.join(base, "__f").withColumn(ROWID, F.col("__base") + F.col("__i")).drop("__f", "__i", "__base"), total

    def drop(self, table: Table) -> None:
        self.files.delete(table.folder)

    def vacuum(self, table: Table) -> None:
        """Delete files and drafts that are no part of the current version."""
        used = {n.split("/")[0] for n in table.files}
        table.written = {k: v for k, v in table.written.items() if k in used}
        for name in self.files.list(table.folder):
            if name.removeprefix(_TERMS) not in used:
                self.files.delete(f"{table.folder}/{name}")
