"""Scalar functions of the dialect, as Spark SQL text.

Each takes the rendered arguments. Branches on ``typeof`` fold away when Spark optimizes the plan,
as a column's type is known by then.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from ..errors import SqlParseError

_SPACE_START, _SPACE_END = r"(?U)^\\s+", r"(?U)\\s+$"


def kind_is(x: str, *kinds: str) -> str:
    return f"typeof({x}) IN ({', '.join(repr(k) for k in kinds)})"


def number(x: str, kind: str | None = None) -> str:
    """The value of a numeric expression; text and bytes have none. ``kind``: what is known of the type without asking Spark."""
    if kind in ("number", "bool"):
        return x
    if kind in ("text", "blob"):
        return "CAST(NULL AS DOUBLE)"
    return f"CASE WHEN {kind_is(x, 'string', 'binary')} THEN NULL ELSE {x} END"


def text(x: str, kind: str | None = None) -> str:
    """How || shows a value: whole reals without a fraction, bytes as x'hex', truth as 1 or 0."""
    if kind == "text":
        return x
    real = f"try_cast(CAST({x} AS STRING) AS DOUBLE)"
    return (
        f"CASE WHEN {kind_is(x, 'string')} THEN CAST({x} AS STRING) "
        f"WHEN {kind_is(x, 'binary')} THEN concat('x\\'', lower(hex(CAST(CAST({x} AS STRING) AS BINARY))), '\\'') "
        f"WHEN {kind_is(x, 'boolean')} THEN CASE CAST({x} AS STRING) WHEN 'true' THEN '1' WHEN 'false' THEN '0' END "
        f"WHEN {kind_is(x, 'double', 'float')} AND {real} = floor({real}) AND abs({real}) < 1e15D THEN CAST(try_cast({real} AS BIGINT) AS STRING) "
        f"ELSE CAST({x} AS STRING) END"
    )


def truth(x: str, kind: str | None = None) -> str:
    """Whether a value counts as true: not null, zero or empty."""
    if kind == "bool":
        return x
    if kind == "number":
        return f"{x} <> 0"
    if kind == "text":
        return f"{x} <> ''"
    return (
        f"CASE WHEN {kind_is(x, 'string', 'binary')} THEN octet_length(CAST({x} AS STRING)) > 0 "
        f"WHEN {kind_is(x, 'boolean')} THEN CAST({x} AS STRING) = 'true' ELSE try_cast(CAST({x} AS STRING) AS DOUBLE) <> 0D END"
    )


def _length(x: str, kind: str | None = None) -> str:
    if kind == "text":
        return f"char_length({x})"
    return f"CASE WHEN {kind_is(x, 'string')} THEN char_length(CAST({x} AS STRING)) WHEN {kind_is(x, 'binary')} THEN octet_length(CAST({x} AS STRING)) END"


def _round(x: str, n: str = "0L", *, kind: str | None = None) -> str:
    real = f"try_cast({number(x, kind)} AS DOUBLE)"
    if n == "0L":
        return f"round({real}, 0)"
    power = f"power(10D, CAST({n} AS DOUBLE))"
    return f"(round({real} * {power}, 0) / {power})"


def _substr(x: str, start: str, size: str | None = None, *, kind: str | None = None) -> str:
    """From 1, or back from the end if negative (no further than the start); nothing from 0 or for a negative size."""
    x = x if kind == "text" else f"CAST({x} AS STRING)"
    rest = f", greatest(CAST({size} AS INT), 0)" if size else ""
    if m := re.fullmatch(r"([1-9]\d{0,8})L", start):
        return f"substring({x}, {m[1]}{rest})"
    at = f"CAST({start} AS INT)"
    return f"CASE WHEN {at} > 0 THEN substring({x}, {at}{rest}) WHEN {at} < 0 THEN substring({x}, greatest(char_length({x}) + {at} + 1, 1){rest}) WHEN {at} = 0 AND {x} IS NOT NULL THEN '' END"


def _trim(*patterns: str) -> Callable[..., str]:
    def render(x: str, chars: str | None = None) -> str:
        if chars:
            side = {(_SPACE_START, _SPACE_END): "BOTH", (_SPACE_START,): "LEADING", (_SPACE_END,): "TRAILING"}[patterns]
            return f"trim({side} {chars} FROM {x})"
        return f"regexp_replace({x}, '{'|'.join(patterns)}', '')"

    return render


def _typeof(x: str) -> str:
    return (
        f"CASE WHEN {x} IS NULL THEN 'null' WHEN {kind_is(x, 'tinyint', 'smallint', 'int', 'bigint', 'boolean')} THEN 'integer' "
        f"WHEN {kind_is(x, 'float', 'double')} OR typeof({x}) LIKE 'decimal%' THEN 'real' WHEN {kind_is(x, 'string')} THEN 'text' WHEN {kind_is(x, 'binary')} THEN 'blob' ELSE typeof({x}) END"
    )


def _hex(x: str) -> str:
    return f"CASE WHEN {kind_is(x, 'string', 'binary')} THEN lower(hex(CAST(CAST({x} AS STRING) AS BINARY))) END"


def _replace(x: str, old: str, new: str) -> str:
    return f"replace({x}, {old}, {new})"


#: name -> (fewest arguments, most, text)
FUNCTIONS: dict[str, tuple[int, int, Callable[..., str]]] = {
    "upper": (1, 1, lambda x: f"upper({x})"),
    "lower": (1, 1, lambda x: f"lower({x})"),
    "length": (1, 1, _length),
    "len": (1, 1, _length),
    "abs": (1, 1, lambda x, kind=None: f"abs({number(x, kind)})"),
    "round": (1, 2, _round),
    "coalesce": (1, 255, lambda *x: f"coalesce({', '.join(x)})"),
    "ifnull": (2, 2, lambda a, b: f"coalesce({a}, {b})"),
    "nullif": (2, 2, lambda a, b: f"nullif({a}, {b})"),
    "trim": (1, 2, _trim(_SPACE_START, _SPACE_END)),
    "ltrim": (1, 2, _trim(_SPACE_START)),
    "rtrim": (1, 2, _trim(_SPACE_END)),
    "substr": (2, 3, _substr),
    "substring": (2, 3, _substr),
    "replace": (3, 3, _replace),
    "typeof": (1, 1, _typeof),
    "hex": (1, 1, _hex),
}


#: Functions that look at their first argument's type, and the type that a call has.
TYPED = frozenset({"length", "len", "abs", "round", "substr", "substring"})
KINDS = dict.fromkeys(["upper", "lower", "trim", "ltrim", "rtrim", "substr", "substring", "replace", "typeof", "hex", "json_extract", "json_array", "json_object", "json_set"], "text") | dict.fromkeys(["length", "len", "abs", "round", "count"], "number")


def render(name: str, args: list[str], kind: str | None = None) -> str | None:
    """Text of a call, with what is known of its first argument's type; None if the dialect doesn't define the name."""
    if name not in FUNCTIONS:
        return None
    fewest, most, write = FUNCTIONS[name]
    if not fewest <= len(args) <= most:
        raise SqlParseError(f"{name} takes {fewest} to {most} arguments, not {len(args)}")
    return write(*args, kind=kind) if name in TYPED else write(*args)
