"""Constraints, checked on whole statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConstraintViolation
from ..sources.catalog import ROWID, Table


def _key(columns: list[str]) -> list:
    return [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(columns)]


def violations_of_keys(new: DataFrame, rest: DataFrame, columns: list[str]) -> DataFrame:
    """Keys (k0, k1 ...) of ``new`` rows that another new row or one of ``rest`` has too; keys with a null are exempt."""
    mine = new.select(*_key(columns)).na.drop("any")
    names = mine.columns
    twice = mine.groupBy(*names).count().where("count > 1").select(*names)
    return twice.unionAll(mine.join(rest.select(*_key(columns)), names, "left_semi"))


def orphans(new: DataFrame, columns: list[str], parent: DataFrame, other: list[str]) -> DataFrame:
    """Keys of ``new`` rows without a row of ``parent``; keys with a null are exempt."""
    mine = new.select(*_key(columns)).na.drop("any")
    return mine.join(parent.select(*_key(other)), mine.columns, "left_anti")


def row_facts(new: DataFrame, table: Table, check: Callable[[str], str]) -> dict:
    """One pass over new rows: their number, the highest integer key, and the rows that break NOT NULL or a CHECK.

    ``check`` renders a condition's text; it decides what a null outcome means.
    """
    required = {c.name for c in table.columns if c.not_null} | set(table.primary)
    conditions = [c.check for c in table.columns if c.check] + table.checks
    key = table.integer_key
    return new.agg(
        F.count(F.lit(1)).alias("rows"),
        (F.max(f"`{key}`") if key else F.lit(None).cast("long")).alias("highest"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"null {c}") for c in sorted(required)],
        *[F.count_if(~F.expr(check(text))).alias(f"check {text}") for text in conditions],
    ).first().asDict()


def validate(new: DataFrame, rest: DataFrame, table: Table, parents: Callable[[str], DataFrame | None], check: Callable[[str], str], parent_key: Callable[[str], list[str]], changed: set[str] | None = None) -> dict:
    """Raise for the first violated constraint of ``new`` rows beside the ``rest``; returns ``row_facts``.

    ``changed``: the columns that an update sets; keys without any of them can't newly collide.
    """
    facts = row_facts(new, table, check)
    for name, n in facts.items():
        if n and name.startswith("null "):
            raise ConstraintViolation(f"NOT NULL: {table.name}.{name[5:]} is null in {n} rows")
        if n and name.startswith("check "):
            raise ConstraintViolation(f"CHECK ({name[6:]}) of {table.name} fails for {n} rows")
    touched = lambda columns: changed is None or bool(changed & set(columns))
    for columns in table.keys:
        if touched(columns):
            found = violations_of_keys(new, rest, columns).limit(1).collect()
            if found:
                raise ConstraintViolation(f"UNIQUE ({', '.join(columns)}) of {table.name}: {tuple(found[0])} is there already")
    for fk in table.foreign:
        if not touched(fk.columns):
            continue
        parent = parents(fk.table)
        if parent is None:
            continue  # no parent table, nothing to hold against
        if fk.table == table.name:
            parent = rest.unionByName(new.select(*rest.columns))
        other = fk.other or parent_key(fk.table)
        found = orphans(new, fk.columns, parent, other).limit(1).collect()
        if found:
            raise ConstraintViolation(f"FOREIGN KEY ({', '.join(fk.columns)}) of {table.name}: {tuple(found[0])} isn't in {fk.table}")
    return facts


def without(rows: DataFrame, touched: DataFrame) -> DataFrame:
    return rows.join(touched.select(ROWID), ROWID, "left_anti")
