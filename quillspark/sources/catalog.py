"""What a database holds: tables, views, triggers; as JSON beside the data."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import types as T

from ..errors import SchemaError
from ..types import declared
from .fs import Files

ROWID = "_rowid"


@dataclass
class Column:
    name: str
    type: str
    not_null: bool = False
    unique: bool = False
    default: Any = None  # JSON value; bytes as {"__blob__": base64}
    check: str | None = None
    physical: str = ""  # its name in files, which renaming leaves and a later column doesn't reuse


@dataclass
class ForeignKey:
    columns: list[str]
    table: str
    other: list[str]
    on_delete: str | None = None
    on_update: str | None = None


@dataclass
class Index:
    name: str
    columns: list[str]
    unique: bool = False


@dataclass
class Table:
    """A table's schema and its current version: the files that hold its rows."""

    name: str
    folder: str
    columns: list[Column]
    primary: list[str] = field(default_factory=list)
    uniques: list[list[str]] = field(default_factory=list)
    foreign: list[ForeignKey] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    indexes: list[Index] = field(default_factory=list)
    fts_column: str | None = None
    next_rowid: int = 1
    next_column: int = 1
    version: int = 0
    files: list[str] = field(default_factory=list)  # below ``folder``: a write's folder and a file's name
    written: dict[str, int] = field(default_factory=dict)  # files that each write's folder was given

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise SchemaError(f"no column {name} in {self.name}")

    def add(self, column: Column) -> None:
        column.physical, self.next_column = f"c{self.next_column}", self.next_column + 1
        self.columns.append(column)

    def has(self, name: str) -> bool:
        return any(c.name.lower() == name.lower() for c in self.columns)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(ROWID, T.LongType()), *[T.StructField(c.name, declared(c.type)) for c in self.columns]])

    @property
    def integer_key(self) -> str | None:
        """The single integer primary key, which takes the rowid where it is left out."""
        if len(self.primary) == 1 and isinstance(declared(self.column(self.primary[0]).type), T.LongType):
            return self.column(self.primary[0]).name
        return None

    @property
    def keys(self) -> list[list[str]]:
        """Column groups that no two rows may share: keys, unique columns and unique indexes."""
        found = [self.primary] * bool(self.primary) + [[c.name] for c in self.columns if c.unique] + self.uniques + [i.columns for i in self.indexes if i.unique]
        return [list(k) for k in dict.fromkeys(tuple(self.column(c).name for c in k) for k in found)]


@dataclass
class View:
    name: str
    columns: list[str]
    text: str


@dataclass
class Trigger:
    name: str
    timing: str
    event: str
    table: str
    condition: str | None
    body: list[str]


@dataclass
class Database:
    id: int
    name: str
    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, View] = field(default_factory=dict)
    triggers: dict[str, Trigger] = field(default_factory=dict)

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise SchemaError(f"no table {name}")
        return self.tables[name]

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @staticmethod
    def from_json(text: str) -> Database:
        raw = json.loads(text)
        tables = {}
        for name, x in raw["tables"].items():
            x = dict(x)
            x["columns"] = [Column(**c) for c in x["columns"]]
            x["foreign"] = [ForeignKey(**c) for c in x["foreign"]]
            x["indexes"] = [Index(**c) for c in x["indexes"]]
            tables[name] = Table(**x)
        return Database(raw["id"], raw["name"], tables, {k: View(**v) for k, v in raw["views"].items()}, {k: Trigger(**v) for k, v in raw["triggers"].items()})


def load(files: Files, path: str, id: int, name: str) -> Database:
    """The stored catalog; one that can't be read is put aside and an empty one starts."""
    if not files.exists(path):
        return Database(id, name)
    try:
        out = Database.from_json(files.read(path))
    except (ValueError, KeyError, TypeError):
        files.rename(path, f"{path}.bak")
        return Database(id, name)
    out.name = name
    return out
