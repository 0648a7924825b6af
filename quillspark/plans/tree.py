"""Statements and expressions of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class Expr:
    pass


@dataclass(frozen=True)
class Literal(Expr):
    value: Any  # None, bool, int, float, str or bytes


@dataclass(frozen=True)
class Column(Expr):
    parts: tuple[str, ...]

    @property
    def name(self) -> str:
        return self.parts[-1]


@dataclass(frozen=True)
class Param(Expr):
    index: int  # from 0, in the order of the text


@dataclass(frozen=True)
class Unary(Expr):
    op: str  # - + NOT
    x: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    a: Expr
    b: Expr


@dataclass(frozen=True)
class IsNull(Expr):
    x: Expr
    negated: bool


@dataclass(frozen=True)
class Between(Expr):
    x: Expr
    low: Expr
    high: Expr
    negated: bool


@dataclass(frozen=True)
class InList(Expr):
    x: Expr
    items: tuple[Expr, ...]
    negated: bool


@dataclass(frozen=True)
class InQuery(Expr):
    x: Expr
    query: Any
    negated: bool


@dataclass(frozen=True)
class Exists(Expr):
    query: Any


@dataclass(frozen=True)
class Scalar(Expr):
    query: Any


@dataclass(frozen=True)
class Like(Expr):
    x: Expr
    pattern: Expr
    negated: bool
    any_case: bool


@dataclass(frozen=True)
class Case(Expr):
    operand: Expr | None
    whens: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr | None


@dataclass(frozen=True)
class Cast(Expr):
    x: Expr
    type: str


@dataclass(frozen=True)
class Order:
    x: Expr
    descending: bool = False
    nulls: str | None = None  # FIRST, LAST


@dataclass(frozen=True)
class Over:
    partition: tuple[Expr, ...]
    order: tuple[Order, ...]
    frame: str  # as written


@dataclass(frozen=True)
class Call(Expr):
    name: str  # lower case
    args: tuple[Expr, ...]
    distinct: bool = False
    star: bool = False
    where: Expr | None = None
    over: Over | None = None


@dataclass(frozen=True)
class Star(Expr):
    table: str | None = None


@dataclass(frozen=True)
class Item:
    x: Expr
    alias: str | None
    text: str  # as written, with single spaces


@dataclass(frozen=True)
class Table:
    name: str
    alias: str | None = None


@dataclass(frozen=True)
class Derived:
    query: Any
    alias: str


@dataclass(frozen=True)
class Join:
    left: Any
    right: Any
    kind: str  # INNER, LEFT, RIGHT, FULL, CROSS, LEFT SEMI, LEFT ANTI
    on: Expr | None = None
    using: tuple[str, ...] = ()
    natural: bool = False


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    source: Any = None
    where: Expr | None = None
    group: tuple[Expr, ...] = ()
    group_all: bool = False
    having: Expr | None = None
    distinct: bool = False


@dataclass(frozen=True)
class Compound:
    left: Any
    op: str  # UNION, UNION ALL, INTERSECT, ...
    right: Any


@dataclass(frozen=True)
class Query:
    """A select or compound with what comes before and after it."""

    body: Any
    order: tuple[Order, ...] = ()
    limit: Expr | None = None
    offset: Expr | None = None
    ctes: tuple[tuple[str, Any], ...] = ()


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    not_null: bool = False
    primary: bool = False
    unique: bool = False
    default: Expr | None = None
    check: str | None = None
    references: tuple | None = None  # (table, column or None, on delete, on update)


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[ColumnDef, ...]
    uniques: tuple[tuple[str, ...], ...] = ()
    primary: tuple[str, ...] = ()
    foreign: tuple[tuple, ...] = ()  # (columns, table, columns, on delete, on update)
    checks: tuple[str, ...] = ()
    if_not_exists: bool = False


@dataclass(frozen=True)
class CreateVirtual:
    name: str
    module: str
    columns: tuple[str, ...]
    if_not_exists: bool = False


@dataclass(frozen=True)
class CreateIndex:
    name: str | None
    table: str
    columns: tuple[str, ...]
    unique: bool
    if_not_exists: bool


@dataclass(frozen=True)
class CreateView:
    name: str
    columns: tuple[str, ...]
    text: str


@dataclass(frozen=True)
class CreateTrigger:
    name: str
    timing: str  # BEFORE, AFTER, INSTEAD OF
    event: str
    table: str
    condition: str | None
    body: tuple[str, ...]
    if_not_exists: bool = False


@dataclass(frozen=True)
class Drop:
    kind: str  # TABLE, VIEW, INDEX, TRIGGER
    names: tuple[str, ...]
    if_exists: bool


@dataclass(frozen=True)
class Alter:
    table: str
    steps: tuple[tuple, ...]  # ("add", ColumnDef, if not exists) ("drop", name, if exists) ("column", old, new) ("table", new)


@dataclass(frozen=True)
class Conflict:
    """What an INSERT does with rows whose key is there: nothing, or an update of the row that has it."""

    columns: tuple[str, ...] = ()
    sets: tuple[tuple[str, Expr], ...] = ()
    where: Expr | None = None


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    rows: tuple[tuple[Expr, ...], ...] = ()
    query: Any = None
    conflict: Conflict | None = None


@dataclass(frozen=True)
class Truncate:
    table: str


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple[tuple[str, Expr], ...]
    where: Expr | None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Expr | None


@dataclass(frozen=True)
class Transaction:
    action: str  # BEGIN, COMMIT, ROLLBACK


@dataclass
class Parsed:
    statement: Any
    params: int = field(default=0)
