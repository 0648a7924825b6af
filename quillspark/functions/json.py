"""JSON functions of the dialect."""

from __future__ import annotations

import base64
import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..errors import JsonError

SET_FUNCTION = "quillspark_json_set"
#: Calls whose results are JSON already, and so nest as they are.
MAKERS = frozenset({"json_array", "json_object", "json_set"})


def steps(path: str) -> list[str | int]:
    """Keys and positions of a path: ``$.a.b``, ``a.b``, ``$.a[0]`` and ``$.a.[0]`` alike."""
    out: list[str | int] = []
    for part in path.strip().removeprefix("$").split("."):
        m = re.fullmatch(r"([^\[\]]*)((?:\[\d+\])*)", part)
        if not m:
            raise JsonError(f"bad JSON path {path!r}")
        if m[1]:
            out.append(m[1])
        out += [int(x) for x in re.findall(r"\d+", m[2])]
    return out


def spark_path(path: str) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" if re.search(r"[^\w]", s) else f".{s}" for s in steps(path))


def element(x: str, is_json: bool) -> str:
    """A value as JSON text; null stays null."""
    if is_json:
        return f"coalesce({x}, 'null')"
    listed = f"to_json(array({x}))"
    return f"substring({listed}, 2, char_length({listed}) - 2)"


def array(items: list[str]) -> str:
    return "concat('[', " + ", ',', ".join(items) + ", ']')" if items else "'[]'"


def object_(pairs: list[tuple[str, str]]) -> str:
    """``pairs`` of key text and value text; a null key makes a null object."""
    if not pairs:
        return "'{}'"
    listed = lambda k: f"to_json(array(CAST({k} AS STRING)))"
    return "concat('{', " + ", ',', ".join(f"substring({listed(k)}, 2, char_length({listed(k)}) - 2), ':', {v}" for k, v in pairs) + ", '}')"


def put(document: str | None, path: str | None, value: Any) -> str | None:
    """``document`` with ``value`` at ``path``: missing objects on the way are made, positions must exist."""
    if document is None or path is None:
        return None
    try:
        root = json.loads(document)
        way = steps(path)
    except (ValueError, JsonError):
        return None
    if not way:
        return json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    now = root
    for at, step in enumerate(way):
        last = at == len(way) - 1
        if isinstance(step, int):
            if not isinstance(now, list) or step >= len(now):
                return None
            if last:
                now[step] = value
            now = now[step]
        else:
            if not isinstance(now, dict):
                return None
            if last:
                now[step] = value
            elif step not in now or not isinstance(now[step], (dict, list)):
                now[step] = {}
            now = now[step]
    return json.dumps(root, separators=(",", ":"), ensure_ascii=False, sort_keys=True)


def register(spark: SparkSession) -> None:
    """Spark has no function that changes JSON text, so this one works on Arrow batches."""

    def set_all(document: pd.Series, path: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([put(d, p, json.loads(v)) for d, p, v in zip(document, path, value)], dtype=object)

    spark.udf.register(SET_FUNCTION, F.pandas_udf(set_all, "string"))


def encode_bytes(value: bytes) -> Any:
    """Bytes inside JSON: the JSON that they spell, or else base64."""
    try:
        return json.loads(value)
    except ValueError:
        return base64.b64encode(value).decode()
