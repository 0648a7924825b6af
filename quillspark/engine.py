"""The engine: databases of SQL tables and key-value tables on Spark."""

from __future__ import annotations

import copy
import itertools
import logging
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as configuration
from . import types
from .errors import EngineError, SchemaError, SqlParseError, TransactionError, UnsupportedError, ViewError
from .functions import fts, json
from .operators.ddl import Definitions
from .operators.dml import Changes
from .plans import tree as t
from .plans.parser import parse
from .plans.render import Relation, Renderer, quote
from .shipping import ship
from .sources import catalog
from .sources.fs import Files
from .sources.kv import Log
from .sources.storage import Storage

log = logging.getLogger("quillspark")
_PASSED_ON = re.compile(r"\s*(SELECT|WITH|VALUES|FROM|TABLE|EXPLAIN|DESCRIBE|DESC|SHOW)\b|\s*\(", re.IGNORECASE)


@dataclass
class Timing:
    params_us: int = 0
    engine_us: int = 0
    encode_us: int = 0
    total_us: int = 0


@dataclass
class QueryResult:
    """What a statement gave: a lazy DataFrame for queries, a count for changes, an id for BEGIN."""

    df: DataFrame | None = None
    affected_rows: int | None = None
    tx_id: int | None = None
    timing: Timing = field(default_factory=Timing)

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys(self.df.columns)) if self.df is not None else []

    def rows(self) -> list[dict[str, Any]]:
        """Rows as JSON objects; of equal column names the first counts. Brings the result to the driver."""
        if self.df is None:
            return []
        names = self.df.columns
        return [{k: types.to_json(v) for k, v in reversed(list(zip(names, r)))} for r in self.df.collect()]

    def to_json(self) -> dict[str, Any]:
        start = time.perf_counter()
        rows = [{c: r[c] for c in self.columns} for r in self.rows()]
        self.timing.encode_us = int((time.perf_counter() - start) * 1e6)
        self.timing.total_us = self.timing.params_us + self.timing.engine_us + self.timing.encode_us
        return {"columns": self.columns, "rows": rows, "affected_rows": self.affected_rows, "tx_id": self.tx_id, "timing": vars(self.timing).copy()}


@dataclass
class Undo:
    """A statement's touched rows: where they were before, and the folder that lists their ids."""

    table: str
    files: list[str]
    touched: str


@dataclass
class Transaction:
    id: int
    db: int
    journal: list[Undo] = field(default_factory=list)


class Engine:
    """One engine on a base folder. ``mode``: "standard" (SQL's nulls) or "compat" (two-valued comparison).

    Statements that change something run one at a time; queries are lazy DataFrames over the
    version that was current when they were planned.
    """

    def __init__(self, spark: SparkSession, config: configuration.Config | str | None = None, *, base_dir: str | None = None, mode: str = "standard"):
        if mode not in ("standard", "compat"):
            raise SqlParseError(f"no mode {mode}")
        self.spark, self.compat = spark, mode == "compat"
        self.config = configuration.load(config) if isinstance(config, str) else config or configuration.Config()
        self.base_dir = (base_dir or self.config.base_dir).rstrip("/")
        self.files = Files(spark)
        self.storage = Storage(spark, self.files)
        self.lock = threading.RLock()
        self.databases = {d.id: catalog.load(self.files, self._catalog_path(d.id), d.id, d.name) for d in self.config.databases}
        self.frames: dict[int, dict[str, DataFrame | Callable[[], DataFrame]]] = {d: {} for d in self.databases}
        self.transactions: dict[int, Transaction] = {}
        self._next_tx = itertools.count(1)
        self._searches: list[str] = []  # views that the statement under way made
        self._views = f"quill_{uuid.uuid4().hex[:8]}"
        self.log = Log(spark, self.files, f"{self.base_dir}/kv", self.config.server_id, self.config.batch_size, self.config.flush_interval_secs)
        self.definitions, self.changes = Definitions(self), Changes(self)
        ship(spark)
        json.register(spark)

    # --- databases

    def _catalog_path(self, db: int) -> str:
        return f"{self.base_dir}/db_{db}/catalog.json"

    def db_id(self, name: str) -> int | None:
        return next((d.id for d in self.databases.values() if d.name == name), None)

    def database(self, db: int | str) -> catalog.Database:
        if isinstance(db, str):
            found = self.db_id(db)
            if found is None:
                raise SchemaError(f"no database {db}")
            db = found
        if db not in self.databases:
            raise SchemaError(f"no database {db}")
        return self.databases[db]

    def publish(self, db: catalog.Database) -> None:
        self.files.write(self._catalog_path(db.id), db.to_json())

    def register(self, db: int | str, name: str, df: DataFrame | Callable[[], DataFrame]) -> None:
        """Let queries of a database read a DataFrame under a name; numbers widen to the dialect's types. A function is called when a query first names it."""
        if callable(df):
            self.frames[self.database(db).id][name] = df
            return
        wide = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}
        self.frames[self.database(db).id][name] = df.select(*[df[c].cast(wide[k]).alias(c) if k in wide else df[c] for c, k in df.dtypes])

    # --- queries

    def query(self, db: int | str, sql: str, params: Sequence[Any] = (), tx_id: int | None = None) -> QueryResult:
        """Run one statement. Errors of Spark come as this engine's."""
        start = time.perf_counter()
        values = [types.from_json(p) for p in params]
        params_us = int((time.perf_counter() - start) * 1e6)
        try:
            out = self._run(self.database(db), sql, values, tx_id)
        except PySparkException as e:
            raise self._translated(e) from e
        total = int((time.perf_counter() - start) * 1e6)
        out.timing = Timing(params_us, total - params_us, 0, total)
        log.info("db=%s sql=%r engine=%dus params=%dus", db, sql[:57] + "..." if len(sql) > 60 else sql, out.timing.engine_us, params_us)
        return out

    @staticmethod
    def _translated(e: PySparkException) -> EngineError:
        condition = e.getCondition() or ""
        text = str(e).split("\n\nJVM stacktrace")[0][:1000]
        if condition.startswith(("UNRESOLVED_ROUTINE", "UNSUPPORTED")):
            return UnsupportedError(text)
        if condition.startswith(("UNRESOLVED", "TABLE_OR_VIEW", "AMBIGUOUS")):
            return SchemaError(text)
        return SqlParseError(text)

    def _run(self, db: catalog.Database, sql: str, params: list[Any], tx_id: int | None) -> QueryResult:
        if tx_id is not None and tx_id not in self.transactions:
            raise TransactionError(f"no transaction {tx_id}")
        try:
            statement = parse(sql).statement
        except (SqlParseError, UnsupportedError):
            if _PASSED_ON.match(sql):
                with self.lock:
                    return QueryResult(self._pass_on(db, sql, params), tx_id=tx_id)
            raise
        if isinstance(statement, t.Query):
            with self.lock:  # names of views are shared; only planning and looking up terms happen under it
                try:
                    return QueryResult(self.spark.sql(self.renderer(db, params).query(statement)), tx_id=tx_id)
                finally:
                    self._forget_searches()
        if isinstance(statement, t.Transaction):
            if statement.action == "BEGIN":
                return QueryResult(tx_id=self.begin(db.id))
            if tx_id is None:
                raise TransactionError(f"{statement.action} needs a transaction's id")
            (self.commit if statement.action == "COMMIT" else self.rollback)(tx_id)
            return QueryResult()
        with self.lock, self._whole(db):
            if isinstance(statement, (t.Insert, t.Update, t.Delete, t.Truncate)):
                journal = self.transactions[tx_id].journal if tx_id is not None else None
                return QueryResult(affected_rows=self.changes.run(db, statement, params, journal), tx_id=tx_id)
            self.definitions.run(db, statement)
            return QueryResult(tx_id=tx_id)

    @contextmanager
    def _whole(self, db: catalog.Database) -> Iterator[None]:
        """All of a statement or none: the catalog is replaced at the end, or goes back.

        Lists of files are replaced and never changed, so they are kept as they are.
        """
        before = copy.deepcopy((db.tables, db.views, db.triggers), {id(x.files): x.files for x in db.tables.values()})
        lengths = {i: len(x.journal) for i, x in self.transactions.items()}
        try:
            yield
            self.publish(db)
        except BaseException:
            db.tables, db.views, db.triggers = before
            for i, n in lengths.items():
                del self.transactions[i].journal[n:]
            raise
        finally:
            self._forget_searches()

    def _forget_searches(self) -> None:
        while self._searches:
            self.spark.catalog.dropTempView(self._searches.pop())

    def renderer(self, db: catalog.Database, params: Sequence[Any] = (), rows: dict | None = None) -> Renderer:
        return Renderer(list(params), lambda name: self._resolve(db, name), self.compat, rows or {})

    def _resolve(self, db: catalog.Database, name: str, within: tuple[str, ...] = ()) -> Relation | None:
        if name in db.views:
            if name in within:
                raise ViewError(f"view {name} reads itself")
            view = db.views[name]
            inner = Renderer([], lambda n: self._resolve(db, n, (*within, name)), self.compat)
            text = inner.query(parse(view.text).statement)
            return Relation(f"({text})" if not view.columns else f"(SELECT * FROM ({text}) AS v({', '.join(map(quote, view.columns))}))")
        if name in db.tables:
            table = db.tables[name]
            return Relation(self.view_of(self.storage.read(table).drop(catalog.ROWID), f"{db.id}_{name}"), table.fts_column, lambda queries: self._having(table, queries))
        if name in self.frames[db.id]:
            if callable(self.frames[db.id][name]):
                self.register(db.id, name, self.frames[db.id][name]())
            return Relation(self.view_of(self.frames[db.id][name], f"{db.id}_f_{name}"))
        return None

    def files_having(self, table: catalog.Table, queries: list[str]) -> list[str]:
        """The files of a full-text table that have texts with each of the queries' tokens; none of them for a query without tokens."""
        asked = [fts.query_tokens(q) for q in queries]
        return [r["file"] for r in self.storage.found(table, [w for words in asked for w in words], all_of_them=True)] if all(asked) else []

    def _having(self, table: catalog.Table, queries: list[str]) -> str:
        """Spark SQL's name for the rows of those files. The statement that asked drops it."""
        self._searches.append(f"{self._views}_search_{uuid.uuid4().hex}")
        self.storage.read(table, self.files_having(table, queries)).drop(catalog.ROWID).createOrReplaceTempView(self._searches[-1])
        return quote(self._searches[-1])

    def view_of(self, df: DataFrame, name: str) -> str:
        """Spark SQL's name for a DataFrame."""
        view = f"{self._views}_{name}"
        df.createOrReplaceTempView(quote(view))
        return quote(view)

    def _pass_on(self, db: catalog.Database, sql: str, params: list[Any]) -> DataFrame:
        """A query beyond the dialect, as Spark reads it, over this database's tables under their own names."""
        names = [n for n in (*db.tables, *db.views, *self.frames[db.id]) if re.search(rf"(?<!\w){re.escape(n)}(?!\w)", sql)]
        for name in names:
            self.spark.sql(f"SELECT * FROM {self._resolve(db, name).sql}").createOrReplaceTempView(quote(name))
        try:
            return self.spark.sql(sql, args=params) if params else self.spark.sql(sql)
        finally:
            for name in names:
                self.spark.catalog.dropTempView(name)

    def load(self, db: int | str, table: str, path: str, format: str = "parquet", **options: Any) -> int:
        """Insert the rows of files, column by column of the same name; columns that the files lack take their defaults."""
        rows = self.spark.read.format(format).options(**options).load(path)
        found = self.database(db)
        with self.lock, self._whole(found):
            target = found.table(table)
            columns = [c.name for c in target.columns if c.name.lower() in {x.lower() for x in rows.columns}]
            try:
                return self.changes._insert_frame(found, table, columns, rows.select(*[f"`{c}`" for c in columns]), None, 0, listed=False)
            except PySparkException as e:
                raise self._translated(e) from e

    def export(self, db: int | str, sql: str, path: str, format: str = "parquet", params: Sequence[Any] = (), **options: Any) -> None:
        """Write a query's rows as files of any format that Spark writes."""
        self.query(db, sql, params).df.write.format(format).options(**options).mode("overwrite").save(path)

    def fts_search(self, db: int | str, table: str, query: str) -> DataFrame:
        """Rows of a full-text table with any of the query's tokens: its columns and score, best first."""
        found = self.database(db).table(table)
        if not found.fts_column:
            raise SchemaError(f"{table} is no full-text table")
        terms = self.storage.found(found, fts.query_tokens(query))
        rows = self.storage.read(found, [r["file"] for r in terms if r["having"]])
        return fts.rank(rows, found.fts_column, query, terms).orderBy(F.col("score").desc(), catalog.ROWID).drop(catalog.ROWID)

    def table(self, db: int | str, name: str) -> DataFrame:
        """The rows of a table or view."""
        with self.lock:
            found = self._resolve(self.database(db), name)
            if found is None:
                raise SchemaError(f"no table or view {name}")
            try:
                return self.spark.sql(f"SELECT * FROM {found.sql}")
            finally:
                self._forget_searches()

    # --- transactions

    def begin(self, db: int | str) -> int:
        with self.lock:
            id = next(self._next_tx)
            self.transactions[id] = Transaction(id, self.database(db).id)
            return id

    def _end(self, tx_id: int) -> Transaction:
        if tx_id not in self.transactions:
            raise TransactionError(f"no transaction {tx_id}")
        return self.transactions.pop(tx_id)

    def commit(self, tx_id: int) -> None:
        with self.lock:
            for entry in self._end(tx_id).journal:
                self.files.delete(entry.touched)

    def rollback(self, tx_id: int) -> None:
        """Put back what each statement touched, the last one first."""
        with self.lock:
            tx = self._end(tx_id)
            db = self.databases[tx.db]
            with self._whole(db):
                for entry in reversed(tx.journal):
                    if entry.table in db.tables:
                        self.changes.undo(db.tables[entry.table], entry)
            for entry in tx.journal:
                self.files.delete(entry.touched)

    # --- key-value tables

    def put(self, db: int | str, table: str, key: bytes, value: bytes) -> None:
        self.log.append(self.database(db).id, table, key, value)

    def get(self, db: int | str, table: str, key: bytes) -> bytes | None:
        return self.log.get(self.database(db).id, table, key)

    def remove(self, db: int | str, table: str, key: bytes) -> None:
        self.log.append(self.database(db).id, table, key, None)

    def kv_table(self, db: int | str, table: str) -> DataFrame:
        return self.log.table(self.database(db).id, table)

    # --- storage

    def flush(self) -> None:
        """Write what is collected, and delete files that no version, statement or transaction reads any more."""
        with self.lock:
            self.log.flush()
            for db in self.databases.values():
                self.publish(db)
                if not self.transactions:
                    for table in db.tables.values():
                        self.storage.vacuum(table)

    def optimize(self, db: int | str, table: str) -> None:
        """Rewrite a table of many small files as few large ones; what it holds and its rowids stay."""
        found = self.database(db)
        with self.lock, self._whole(found):
            target = found.table(table)
            if target.files:
                target.files = self.storage.compact(target)
                target.version += 1

    def get_config(self) -> configuration.Config:
        return self.config
