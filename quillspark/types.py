"""Declared types, and values as JSON carries them."""

from __future__ import annotations

import base64
import datetime
import decimal
import json
import math
import re
from typing import Any

from pyspark.sql import types as T

from .errors import SchemaError, SerializationError

_DECLARED = {
    "INT": T.LongType(), "INTEGER": T.LongType(), "BIGINT": T.LongType(), "SMALLINT": T.LongType(), "TINYINT": T.LongType(), "MEDIUMINT": T.LongType(),
    "REAL": T.DoubleType(), "FLOAT": T.DoubleType(), "DOUBLE": T.DoubleType(), "DOUBLE PRECISION": T.DoubleType(),
    "TEXT": T.StringType(), "STRING": T.StringType(), "VARCHAR": T.StringType(), "CHAR": T.StringType(), "CHARACTER": T.StringType(),
    "BLOB": T.BinaryType(), "BINARY": T.BinaryType(), "VARBINARY": T.BinaryType(), "BYTEA": T.BinaryType(),
    "BOOLEAN": T.BooleanType(), "BOOL": T.BooleanType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampType(), "DATETIME": T.TimestampType(),
}


def declared(name: str) -> T.DataType:
    """The Spark type of a declared one; integers are 64 bits wide and reals double."""
    name = " ".join(name.upper().split())
    m = re.fullmatch(r"(DECIMAL|NUMERIC)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?", name)
    if m:
        return T.DecimalType(int(m[2] or 10), int(m[3] or 0))
    bare = re.sub(r"\s*\(.*\)$", "", name)
    if bare not in _DECLARED:
        raise SchemaError(f"unknown type {name}")
    return _DECLARED[bare]


def from_json(value: Any) -> Any:
    """A parameter as JSON gives it: booleans are 1 and 0, {"__blob__": base64} is bytes, other arrays and objects the bytes of their JSON text."""
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, int):
        return value if -(2**63) <= value < 2**63 else float(value)
    if value is None or isinstance(value, (float, str, bytes)):
        return value
    if isinstance(value, (bytearray, memoryview)):
        return bytes(value)
    if isinstance(value, dict) and set(value) == {"__blob__"}:
        try:
            return base64.b64decode(value["__blob__"], validate=True)
        except (ValueError, TypeError) as e:
            raise SerializationError(f"bad base64 in a blob: {e}") from e
    if isinstance(value, (list, dict)):
        return json.dumps(value, separators=(",", ":"), ensure_ascii=False).encode()
    if isinstance(value, (datetime.date, decimal.Decimal)):
        return value
    raise SerializationError(f"no value for a {type(value).__name__}")


def to_json(value: Any) -> Any:
    """A cell as plain JSON: bytes as base64, NaN and infinities as null, times as text."""
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, (bytes, bytearray)):
        return base64.b64encode(value).decode()
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (datetime.date, datetime.timedelta)):
        return str(value)
    if isinstance(value, T.Row):
        return {k: to_json(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): to_json(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [to_json(v) for v in value]
    return value
