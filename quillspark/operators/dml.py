"""INSERT, UPDATE, DELETE, with their constraints, triggers and foreign-key actions; whole statements at a time."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConstraintViolation, SchemaError, SqlParseError, TriggerError, UnsupportedError
from ..plans import tree as t
from ..plans.parser import parse, parse_expr
from ..plans.render import Renderer, literal, quote
from ..sources.catalog import ROWID, Database, Table
from ..sources.storage import FILE
from ..types import declared
from .constraints import validate, without
from .ddl import check_sql, default_sql

if TYPE_CHECKING:
    from ..engine import Engine, Undo

#: How deep triggers and foreign-key actions may set each other off.
DEPTH = 32


def mentions(x: Any, names: frozenset[str] = frozenset({"OLD", "NEW"})) -> bool:
    """Whether an expression or statement has a column qualified by one of ``names``."""
    if isinstance(x, t.Column):
        return len(x.parts) == 2 and x.parts[0].upper() in names
    if isinstance(x, tuple):
        return any(mentions(y, names) for y in x)
    return any(mentions(v, names) for v in getattr(x, "__dict__", {}).values())


def _has_query(x: Any) -> bool:
    if isinstance(x, (t.Scalar, t.Exists, t.InQuery)) or isinstance(x, t.Call) and x.name == "json_set":
        return True
    if isinstance(x, tuple):
        return any(map(_has_query, x))
    return any(map(_has_query, x.__dict__.values())) if isinstance(x, t.Expr) else False


def _joins_rows(where: t.Expr | None) -> bool:
    """Whether a condition ties the target to OLD or NEW by an equality, so that they can be joined."""
    if isinstance(where, t.Binary) and where.op == "AND":
        return _joins_rows(where.a) or _joins_rows(where.b)
    return isinstance(where, t.Binary) and where.op in ("=", "<=>") and any(isinstance(a, t.Column) and not mentions(a) and mentions(b) for a, b in ((where.a, where.b), (where.b, where.a)))


class Changes:
    def __init__(self, engine: Engine):
        self.engine = engine

    @property
    def storage(self):
        return self.engine.storage

    def run(self, db: Database, s: Any, params: list[Any], journal: list[Undo] | None, depth: int = 0, rows: dict | None = None) -> int:
        """Run a statement; returns the number of rows that it inserted, changed or deleted itself."""
        if depth > DEPTH:
            raise TriggerError(f"triggers or actions set each other off more than {DEPTH} deep")
        if isinstance(s, t.Insert):
            return self._insert(db, s, params, journal, depth, rows)
        if isinstance(s, t.Update):
            return self._update(db, s, params, journal, depth, rows)
        if isinstance(s, t.Delete):
            return self._delete(db, s, params, journal, depth, rows)
        if isinstance(s, t.Truncate):
            return self._truncate(db, s, journal)
        return 0  # a SELECT in a trigger changes nothing

    # --- inserts

    def _insert(self, db: Database, s: t.Insert, params: list[Any], journal: list | None, depth: int, rows: dict | None) -> int:
        names = self._columns(db, s.table)
        columns = list(s.columns) or names
        known = {n.lower(): n for n in names}
        for c in columns:
            if c.lower() not in known:
                raise SchemaError(f"no column {c} in {s.table}")
        columns = [known[c.lower()] for c in columns]
        render = self.engine.renderer(db, params, rows)
        if s.query is not None:
            given = self.engine.spark.sql(render.query(s.query))
            if len(given.columns) != len(columns):
                raise SqlParseError(f"{len(columns)} columns are wanted, the query has {len(given.columns)}")
            return self._insert_frame(db, s.table, columns, given, journal, depth, listed=False, conflict=s.conflict, render=render)
        width = {len(r) for r in s.rows}
        if len(width) > 1 or (s.columns and width != {len(columns)}) or max(width) > len(columns):
            raise SqlParseError(f"{len(columns)} values are wanted in each row of {s.table}")
        columns = columns[: width.pop()]
        if any(_has_query(r) for r in s.rows):
            text = " UNION ALL ".join("SELECT " + ", ".join([*map(render.value, r), f"{n}L"]) for n, r in enumerate(s.rows))
        else:
            text = "SELECT * FROM VALUES " + ", ".join("(" + ", ".join([*map(render.value, r), f"{n}L"]) + ")" for n, r in enumerate(s.rows))
        return self._insert_frame(db, s.table, columns, self.engine.spark.sql(text), journal, depth, listed=True, conflict=s.conflict, render=render)

    def _columns(self, db: Database, name: str) -> list[str]:
        if name in db.tables:
            return [c.name for c in db.tables[name].columns]
        if name in db.views:
            return self.engine.table(db.id, name).columns
        raise SchemaError(f"no table {name}")

    def _insert_frame(self, db: Database, name: str, columns: list[str], given: DataFrame, journal: list | None, depth: int, *, listed: bool, conflict: t.Conflict | None = None, render: Renderer | None = None) -> int:
        """Insert the rows of ``given``, by position into ``columns``. ``listed``: a last column numbers them from 0."""
        given = given.toDF(*[f"v{i}" for i in range(len(columns))], *["__n"] * listed)
        at = {c: f"v{i}" for i, c in enumerate(columns)}
        if self._instead(db, name, "INSERT"):
            if conflict:
                raise UnsupportedError("ON CONFLICT where INSTEAD OF triggers stand in for the INSERT")
            names = self._columns(db, name)
            new = F.struct(*[(F.col(at[c]) if c in at else F.lit(None)).alias(c) for c in names])
            transition, n = self.storage.with_rowids(Table(name, f"{self.engine.base_dir}/db_{db.id}/drafts", []), given.select(new.alias("NEW")))
            self._fire(db, name, "INSTEAD OF", "INSERT", transition, journal, depth)
            return n
        table = db.table(name)
        if listed:
            numbered = given.coalesce(1).withColumn(ROWID, F.col("__n") + table.next_rowid)
        else:
            numbered, _ = self.storage.with_rowids(table, given)

        def value(c):
            if c.name in at:
                return F.col(at[c.name]).cast(declared(c.type))
            if c.name == table.integer_key:
                return F.col(ROWID)
            return F.expr(default_sql(c)).cast(declared(c.type))

        rows, updated = numbered.select(ROWID, *[value(c).alias(c.name) for c in table.columns]), 0
        if conflict:
            rows, updated = self._resolved(db, table, rows, conflict, render, journal, depth)
        files = self.storage.write(table, rows)
        new, was = self.storage.read(table, files), list(table.files)
        facts = self._validate(db, table, new, self.storage.read(table))
        table.next_rowid = max(table.next_rowid + facts["rows"], (facts["highest"] or 0) + 1)
        transition = new.select(ROWID, self._struct(table, "NEW"))
        self._fire(db, name, "BEFORE", "INSERT", transition, journal, depth)
        if journal is not None:
            self._note(journal, table, was, new)
        table.files = table.files + files
        table.version += 1
        self._fire(db, name, "AFTER", "INSERT", transition, journal, depth)
        return facts["rows"] + updated

    def _resolved(self, db: Database, table: Table, rows: DataFrame, conflict: t.Conflict, render: Renderer, journal: list | None, depth: int) -> tuple[DataFrame, int]:
        """The rows whose key isn't there yet, and how many rows that have the key of another one were updated.

        Keys with a null never meet. Of several new rows with one key, the first is inserted if the
        others do nothing; an update by several rows is refused, as which comes last would be chance.
        """
        key = [table.column(c).name for c in conflict.columns]
        if not key and len(table.keys) == 1:
            key = table.keys[0]
        if not any(set(key) == set(k) for k in table.keys):
            raise SchemaError(f"ON CONFLICT wants the columns of one of {table.name}'s keys")
        rows, names = self._draft(table, rows), [f"__k{i}" for i in range(len(key))]
        table.next_rowid = max(table.next_rowid, (rows.agg(F.max(ROWID)).first()[0] or 0) + 1)  # numbers of rows that fall out aren't used again
        keyed = rows.select("*", *[F.col(f"`{c}`").alias(k) for c, k in zip(key, names)])
        held = self.storage.read(table).select(*[F.col(f"`{c}`").alias(k) for c, k in zip(key, names)])
        firsts = keyed.na.drop("any", subset=names).groupBy(*names).agg(F.min(ROWID).alias("__first"), F.count(F.lit(1)).alias("__n"))
        if not conflict.sets:
            firsts = firsts.join(held, names, "left_anti")
            loose = F.lit(False)
            for k in names:
                loose = loose | F.col(k).isNull()
            kept = keyed.where(loose).select(ROWID).unionAll(firsts.select(F.col("__first").alias(ROWID)))
            return self._draft(table, rows.join(kept, ROWID, "left_semi")), 0
        twice = firsts.where("__n > 1").select(*names).limit(1).collect()
        if twice:
            raise ConstraintViolation(f"ON CONFLICT ({', '.join(key)}) of {table.name}: several rows have {tuple(twice[0])}")
        sets = dict(zip([table.column(c).name for c, _ in conflict.sets], [x for _, x in conflict.sets]))
        texts = {c: render.value(x) for c, x in sets.items()}
        excluded = keyed.select(*names, F.struct(*[F.col(f"`{c.name}`") for c in table.columns]).alias("excluded"))
        here = self.storage.with_files(table)
        view, other = self.engine.view_of(here, f"{db.id}_{table.name}_held"), self.engine.view_of(excluded, f"{db.id}_{table.name}_excluded")
        mine = quote(table.name)
        listed = [f"CAST({texts[c.name] if c.name in texts else f'{mine}.{quote(c.name)}'} AS {declared(c.type).simpleString()}) AS {quote(c.name)}" for c in table.columns]
        on = " AND ".join(f"{mine}.{quote(c)} = __new.{k}" for c, k in zip(key, names))
        bound = f" WHERE {render.predicate(conflict.where)}" if conflict.where is not None else ""
        matched = self._draft(table, self.engine.spark.sql(f"SELECT {mine}.{ROWID}, {mine}.{FILE}, {', '.join(listed)} FROM {view} AS {mine} JOIN {other} AS __new ON {on}{bound}"))
        fresh = self._draft(table, keyed.join(held, names, "left_anti").drop(*names))
        return fresh, self._change(db, table, matched, set(sets), journal, depth)

    def _truncate(self, db: Database, s: t.Truncate, journal: list | None) -> int:
        """Empty a table without reading its rows and without triggers; refused while another table's rows refer to it."""
        table = db.table(s.table)
        for child in db.tables.values():
            if child is not table and any(fk.table == table.name for fk in child.foreign) and not self.storage.read(child).isEmpty():
                raise ConstraintViolation(f"TRUNCATE: {child.name} refers to {table.name}")
        rows = self.storage.read(table)
        n = rows.count()
        if journal is not None:
            self._note(journal, table, list(table.files), rows)
        table.files, table.version = [], table.version + 1
        return n

    # --- updates and deletes

    def _matched(self, db: Database, table: Table, select: list[str], where: t.Expr | None, params: list[Any], rows: dict | None, sets: tuple = ()) -> str:
        """Spark SQL for the rowid and file of the rows that a statement is about, and ``select``ed values."""
        render = self._renderer(db, table, params, rows)
        queries = render.required(where, t.Table(table.name)).get(table.name) if table.fts_column else None
        only = self.engine.files_having(table, queries) if queries else None
        view = self.engine.view_of(self.storage.with_files(table, only), f"{db.id}_{table.name}_dml")
        values = {c.lower(): render.value(x) for c, x in sets}  # SET before WHERE, as parameters are numbered
        listed = [f"CAST({values[c.lower()]} AS {declared(table.column(c).type).simpleString()}) AS {quote(c)}" if c.lower() in values else quote(c) for c in select]
        return f"SELECT {', '.join([ROWID, FILE, *listed])} FROM {view} AS {quote(table.name)}" + (f" WHERE {render.predicate(where)}" if where is not None else "")

    def _renderer(self, db: Database, table: Table, params: list[Any], rows: dict | None) -> Renderer:
        render = self.engine.renderer(db, params, rows)
        render._fts.append({table.name: (table.name, table.fts_column)} if table.fts_column else {})
        return render

    def _draft(self, table: Table, rows: DataFrame) -> DataFrame:
        """Rows worked out once, to be read again however often."""
        path = f"{table.folder}/draft-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(path)
        return self.engine.spark.read.schema(rows.schema).parquet(path)

    def _sets(self, db: Database, name: str, s: t.Update) -> list[str]:
        known = {n.lower(): n for n in self._columns(db, name)}
        for c, _ in s.sets:
            if c.lower() not in known:
                raise SchemaError(f"no column {c} in {name}")
        return [known[c.lower()] for c, _ in s.sets]

    def _update(self, db: Database, s: t.Update, params: list[Any], journal: list | None, depth: int, rows: dict | None) -> int:
        changed = self._sets(db, s.table, s)
        if self._instead(db, s.table, "UPDATE"):
            return self._instead_of(db, s, dict(zip(changed, [x for _, x in s.sets])), params, journal, depth, rows)
        table = db.table(s.table)
        matched = self.engine.spark.sql(self._matched(db, table, [c.name for c in table.columns], s.where, params, rows, s.sets))
        return self._change(db, table, self._draft(table, matched), set(changed), journal, depth)

    def _delete(self, db: Database, s: t.Delete, params: list[Any], journal: list | None, depth: int, rows: dict | None) -> int:
        if self._instead(db, s.table, "DELETE"):
            return self._instead_of(db, s, {}, params, journal, depth, rows)
        table = db.table(s.table)
        matched = self.engine.spark.sql(self._matched(db, table, [], s.where, params, rows))
        return self._change(db, table, self._draft(table, matched), None, journal, depth)

    def _change(self, db: Database, table: Table, matched: DataFrame, changed: set[str] | None, journal: list | None, depth: int) -> int:
        """Give the ``matched`` rows (rowid, file, and all values) their new values, or delete them (``changed`` is None).

        Only files that hold a matched row are read and written again.
        """
        event = "DELETE" if changed is None else "UPDATE"
        counts = {r[FILE]: r["n"] for r in matched.groupBy(FILE).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each touched file
        if not counts:
            return 0
        was = list(table.files)
        old = self.storage.read(table, sorted(counts)).join(matched.select(ROWID), ROWID, "left_semi")
        transition = old.select(ROWID, self._struct(table, "OLD"))
        new_files: list[str] = []
        if changed is not None:
            new_files = self.storage.write(table, matched)
            new = self.storage.read(table, new_files)
            facts = self._validate(db, table, new, without(self.storage.read(table), matched), changed)
            table.next_rowid = max(table.next_rowid, (facts["highest"] or 0) + 1)
            transition = transition.join(new.select(ROWID, self._struct(table, "NEW")), ROWID)
        version = table.version
        self._fire(db, table.name, "BEFORE", event, transition, journal, depth)
        touched = sorted(counts)
        if table.version != version:  # a trigger changed this table meanwhile
            now = self.storage.with_files(table).join(matched.select(ROWID), ROWID, "left_semi")
            touched = sorted(r[0] for r in now.select(FILE).distinct().collect())
        kept = self.storage.write(table, without(self.storage.read(table, touched), matched)) if touched else []
        if journal is not None:
            self._note(journal, table, was, matched)
        table.files = [f for f in table.files if f not in set(touched)] + kept + new_files
        table.version += 1
        self._follow(db, table, old, transition, changed, journal, depth)
        self._fire(db, table.name, "AFTER", event, transition, journal, depth)
        return sum(counts.values())

    def _follow(self, db: Database, table: Table, old: DataFrame, transition: DataFrame, changed: set[str] | None, journal: list | None, depth: int) -> None:
        """Declared foreign-key actions of the tables that refer to this one."""
        for child in list(db.tables.values()):
            for fk in child.foreign:
                action = fk.on_delete if changed is None else fk.on_update
                other = fk.other or table.primary
                if fk.table != table.name or not action or changed is not None and not changed & set(other):
                    continue
                if depth > DEPTH:
                    raise TriggerError("foreign-key actions run in circles")
                if changed is None:
                    keys = old.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(other)]).na.drop("any").distinct()
                else:
                    moved = transition.select(*[F.col(f"OLD.`{c}`").alias(f"k{i}") for i, c in enumerate(other)], *[F.col(f"NEW.`{c}`").alias(f"n{i}") for i, c in enumerate(other)])
                    same = F.lit(True)
                    for i in range(len(other)):
                        same = same & F.col(f"k{i}").eqNullSafe(F.col(f"n{i}"))
                    keys = moved.where(~same).na.drop("any", subset=[f"k{i}" for i in range(len(other))])
                # Keys that the parent still has keep their children.
                keys = keys.join(self.storage.read(table).select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(other)]), [f"k{i}" for i in range(len(other))], "left_anti")
                rows = self.storage.with_files(child)
                on = F.lit(True)
                for i, c in enumerate(fk.columns):
                    on = on & (F.col(f"`{c}`") == F.col(f"k{i}"))
                hit = rows.join(keys, on, "inner")
                if action == "RESTRICT":
                    if not hit.isEmpty():
                        raise ConstraintViolation(f"FOREIGN KEY ({', '.join(fk.columns)}) of {child.name} still refers to {table.name}")
                    continue
                if action == "CASCADE" and changed is None:
                    self._change(db, child, self._draft(child, hit.select(ROWID, FILE)), None, journal, depth + 1)
                    continue
                new = {c: F.col(f"n{i}") if action == "CASCADE" else F.expr(default_sql(child.column(c))) if action == "SET DEFAULT" else F.lit(None) for i, c in enumerate(fk.columns)}
                values = [(new[c.name].cast(declared(c.type)) if c.name in new else F.col(f"`{c.name}`")).alias(c.name) for c in child.columns]
                self._change(db, child, self._draft(child, hit.select(ROWID, FILE, *values)), set(fk.columns), journal, depth + 1)

    def _validate(self, db: Database, table: Table, new: DataFrame, rest: DataFrame, changed: set[str] | None = None) -> dict:
        parents = lambda name: self.storage.read(db.tables[name]) if name in db.tables else None
        return validate(new, rest, table, parents, lambda text: check_sql(text, self.engine.compat), lambda name: db.table(name).primary, changed)

    # --- undo

    def _note(self, journal: list, table: Table, was: list[str], rows: DataFrame) -> None:
        from ..engine import Undo

        path = f"{self.engine.base_dir}/undo/{uuid.uuid4().hex}"
        rows.select(ROWID).write.parquet(path)
        journal.append(Undo(table.name, was, path))

    def undo(self, table: Table, entry: Undo) -> None:
        """Put the touched rows back as they were; rows of other statements stay."""
        touched = self.engine.spark.read.schema(f"{ROWID} long").parquet(entry.touched)
        hit = sorted(r[0] for r in self.storage.with_files(table).join(touched, ROWID, "left_semi").select(FILE).distinct().collect())
        files = [f for f in table.files if f not in set(hit)]
        if hit:
            files += self.storage.write(table, without(self.storage.read(table, hit), touched))
        if entry.files:
            files += self.storage.write(table, self.storage.read(table, entry.files).join(touched, ROWID, "left_semi"))
        table.files = files
        table.version += 1

    # --- triggers

    @staticmethod
    def _struct(table: Table, name: str):
        return F.struct(*[F.col(f"`{c.name}`") for c in table.columns]).alias(name)

    def _instead(self, db: Database, name: str, event: str) -> bool:
        return any((x.table, x.timing, x.event) == (name, "INSTEAD OF", event) for x in db.triggers.values())

    def _instead_of(self, db: Database, s: Any, sets: dict[str, t.Expr], params: list[Any], journal: list | None, depth: int, rows: dict | None) -> int:
        """Fire INSTEAD OF triggers for the rows that an UPDATE or DELETE of a view or table is about."""
        names = self._columns(db, s.table)
        render = self.engine.renderer(db, params, rows)
        new = "named_struct(" + ", ".join(f"{literal(c)}, {render.value(sets[c]) if c in sets else quote(c)}" for c in names) + ") AS NEW"
        old = "named_struct(" + ", ".join(f"{literal(c)}, {quote(c)}" for c in names) + ") AS OLD"
        source = self.engine.view_of(self.engine.table(db.id, s.table), f"{db.id}_{s.table}_instead")
        text = f"SELECT {old}{', ' + new if isinstance(s, t.Update) else ''} FROM {source} AS {quote(s.table)}" + (f" WHERE {render.predicate(s.where)}" if s.where is not None else "")
        transition, n = self.storage.with_rowids(Table(s.table, f"{self.engine.base_dir}/db_{db.id}/drafts", []), self.engine.spark.sql(text))
        self._fire(db, s.table, "INSTEAD OF", "UPDATE" if isinstance(s, t.Update) else "DELETE", transition, journal, depth)
        return n

    def _fire(self, db: Database, name: str, timing: str, event: str, transition: DataFrame, journal: list | None, depth: int) -> None:
        """Run the triggers of an event over its rows (rowid, OLD and NEW as far as the event has them).

        Triggers go row by row: every statement of every trigger for one row, then the next row. Where
        no statement reads or writes a table that another one writes, statement by statement comes to
        the same, and each runs over all rows at once if it can.
        """
        bound = {k: self._field(k) for k in ("OLD", "NEW") if k in transition.columns}
        missing = {"OLD", "NEW"} - set(bound)
        todo = []
        for trigger in [x for x in db.triggers.values() if (x.table, x.timing, x.event) == (name, timing, event)]:
            condition = self.engine.renderer(db, rows=bound).predicate(parse_expr(trigger.condition)) if trigger.condition else "true"
            if transition.where(condition).isEmpty():
                continue
            statements = [parse(text).statement for text in trigger.body]
            if any(mentions(s, frozenset(missing)) for s in statements):
                raise TriggerError(f"{trigger.name}: {event} has no {' or '.join(sorted(missing))}")
            todo.append((condition, statements))
        if self._independent(db, [s for _, statements in todo for s in statements]):
            for condition, statements in todo:
                for s in statements:
                    rows = transition.where(condition)
                    if not self._at_once(db, s, rows, bound, journal, depth):
                        self._row_by_row(db, [(None, [s])], rows, journal, depth)
            return
        flags = {f"__when{n}": F.coalesce(F.expr(condition), F.lit(False)) for n, (condition, _) in enumerate(todo)}
        self._row_by_row(db, [(f"__when{n}", statements) for n, (_, statements) in enumerate(todo)], transition.withColumns(flags), journal, depth)

    def _independent(self, db: Database, statements: list[Any]) -> bool:
        """Whether no statement reads or writes a table that another one writes, itself or through triggers and foreign keys."""
        effects = [self._effects(db, s) for s in statements]
        return not any(writes & (reads | others) for i, (_, writes) in enumerate(effects) for j, (reads, others) in enumerate(effects) if i != j)

    @staticmethod
    def _effects(db: Database, statement: Any) -> tuple[set[str], set[str]]:
        """The tables that a statement reads, and those that it writes, with all that follows from it."""
        reads, writes, todo = set(), set(), [statement]

        def read(x: Any) -> None:
            if isinstance(x, tuple):
                for y in x:
                    read(y)
            elif isinstance(x, t.Table) or isinstance(x, t.Call) and x.name == "fts_match":
                for name in [x.name] if isinstance(x, t.Table) else re.findall(r"\w+", repr(x)):
                    if name not in reads and (name in db.tables or name in db.views):
                        reads.add(name)
                        if name in db.views:
                            read(parse(db.views[name].text).statement)
            else:
                for y in getattr(x, "__dict__", {}).values():
                    read(y)

        while todo:
            s = todo.pop()
            read(s)
            if not isinstance(s, (t.Insert, t.Update, t.Delete, t.Truncate)):
                continue
            if not isinstance(s, t.Insert) or s.conflict:
                reads.add(s.table)
            if isinstance(s, t.Truncate):
                reads |= {child.name for child in db.tables.values() if any(fk.table == s.table for fk in child.foreign)}
            if s.table in writes:
                continue
            writes.add(s.table)
            todo += [parse(text).statement for x in db.triggers.values() if x.table == s.table for text in x.body]
            if s.table in db.tables:
                reads |= {fk.table for fk in db.tables[s.table].foreign}
            todo += [t.Delete(child.name, None) for child in db.tables.values() if any(fk.table == s.table and (fk.on_delete or fk.on_update) for fk in child.foreign)]
        return reads, writes

    @staticmethod
    def _field(name: str) -> Callable[[str], str]:
        return lambda column: f"{quote(name)}.{quote(column)}"

    def _at_once(self, db: Database, s: Any, rows: DataFrame, bound: dict, journal: list | None, depth: int) -> bool:
        """One statement for all rows: VALUES as a projection of them, UPDATE and DELETE as a join that meets each target once."""
        if isinstance(s, t.Query):
            return True
        if depth >= DEPTH:
            raise TriggerError(f"triggers set each other off more than {DEPTH} deep")
        spark = self.engine.spark
        if isinstance(s, t.Insert) and s.query is None and not _has_query(s.rows) and not (s.conflict and s.conflict.sets):
            if any(len(r) != len(s.columns or self._columns(db, s.table)) for r in s.rows):
                return False
            view = self.engine.view_of(rows.orderBy(ROWID), f"{db.id}_rows_{depth}")
            render = self.engine.renderer(db, rows=bound)
            text = " UNION ALL ".join(f"SELECT {', '.join(map(render.value, r))} FROM {view}" for r in s.rows)
            known = {n.lower(): n for n in self._columns(db, s.table)}
            columns = [known.get(c.lower()) for c in s.columns] or list(known.values())
            if None in columns:
                raise SchemaError(f"no such column in {s.table}: {s.columns}")
            self._insert_frame(db, s.table, columns, spark.sql(text), journal, depth + 1, listed=False, conflict=s.conflict, render=render)
            return True
        if isinstance(s, (t.Update, t.Delete)) and s.table in db.tables and _joins_rows(s.where) and not self._instead(db, s.table, "UPDATE" if isinstance(s, t.Update) else "DELETE"):
            table = db.tables[s.table]
            sets = self._sets(db, s.table, s) if isinstance(s, t.Update) else None
            view = self.engine.view_of(rows.select(*[F.col(k).alias(k) for k in bound]), f"{db.id}_rows_{depth}")
            target = self.engine.view_of(self.storage.with_files(table), f"{db.id}_{table.name}_dml")
            render = self._renderer(db, table, [], bound)
            own = {c.name: f"{quote(table.name)}.{quote(c.name)}" for c in table.columns}
            values = {c: render.value(x) for c, (_, x) in zip(sets or (), getattr(s, "sets", ()))}
            listed = [f"CAST({values.get(c.name, own[c.name])} AS {declared(c.type).simpleString()}) AS {quote(c.name)}" for c in table.columns] if sets is not None else []
            met = self._draft(table, spark.sql(f"SELECT {', '.join([ROWID, FILE, *listed])} FROM {target} AS {quote(table.name)} JOIN {view} ON {render.predicate(s.where)}"))
            if met.groupBy(ROWID).count().where("count > 1").isEmpty():
                self._change(db, table, met, None if sets is None else set(sets), journal, depth + 1)
                return True
        return False

    def _row_by_row(self, db: Database, todo: list[tuple[str | None, list[Any]]], rows: DataFrame, journal: list | None, depth: int) -> None:
        """The statements of each (flag, statements) for each row in order, where a later one may see what an earlier one did."""
        for row in rows.orderBy(ROWID).toLocalIterator():
            bound = {k: self._constant(row[k]) for k in ("OLD", "NEW") if k in rows.columns}
            for flag, statements in todo:
                if flag is None or row[flag]:
                    for s in statements:
                        if not isinstance(s, t.Query):
                            self.run(db, s, [], journal, depth + 1, bound)

    @staticmethod
    def _constant(row: Any) -> Callable[[str], str]:
        values = {k.lower(): v for k, v in row.asDict().items()}

        def text(column: str) -> str:
            if column.lower() not in values:
                raise TriggerError(f"no column {column} in OLD or NEW")
            return literal(values[column.lower()])

        return text
