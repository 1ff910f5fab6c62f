"""Values of rows that were read: typed getters, deep comparison, and rows as text."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Row

from lodemill.errors import NotFound, TypeMismatch

#: Order of values of different types.
_RANK = {type(None): 0, bool: 1, int: 2, float: 2, str: 3, bytes: 4, list: 5, dict: 6}


def plain(value: Any) -> Any:
    """Rows as dicts and byte arrays as bytes, at any depth."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return bytes(value) if isinstance(value, bytearray) else value


def get(row: Row | dict, path: str) -> Any:
    """The value under its exact name, else by a path into objects."""
    here = plain(row)
    if path in here:
        return here[path]
    for part in path.split("."):
        if not isinstance(here, dict) or part not in here:
            raise NotFound(f"no value {path}")
        here = here[part]
    return here


def _typed(row: Row | dict, path: str, kind: type) -> Any:
    value = get(row, path)
    if type(value) is not kind:
        raise TypeMismatch(f"{path} is {value!r}")
    return value


def get_int(row: Row | dict, path: str) -> int:
    return _typed(row, path, int)


def get_float(row: Row | dict, path: str) -> float:
    """Whole numbers are widened."""
    value = get(row, path)
    return float(value) if type(value) is int else _typed(row, path, float)


def get_bool(row: Row | dict, path: str) -> bool:
    return _typed(row, path, bool)


def get_text(row: Row | dict, path: str) -> str:
    return _typed(row, path, str)


def get_blob(row: Row | dict, path: str) -> bytes:
    return _typed(row, path, bytes)


def get_array(row: Row | dict, path: str) -> list:
    return _typed(row, path, list)


def get_object(row: Row | dict, path: str) -> dict:
    return _typed(row, path, dict)


def compare(a: Any, b: Any) -> int:
    """-1, 0 or 1: null first, then numbers by value, texts and bytes by code, arrays and objects element by element."""
    a, b = plain(a), plain(b)
    x, y = _RANK[type(a)], _RANK[type(b)]
    if x != y or a is None:
        return (x > y) - (x < y)
    if isinstance(a, dict):
        a, b = ([v for pair in sorted(d.items()) for v in pair] for d in (a, b))
    if isinstance(a, list):
        found = next((c for p, q in zip(a, b, strict=False) if (c := compare(p, q))), 0)
        return found or (len(a) > len(b)) - (len(a) < len(b))
    return (a > b) - (a < b)


def as_text(value: Any) -> str:
    value = plain(value)
    if isinstance(value, dict):
        return "{" + ", ".join(f"{k}: {as_text(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ", ".join(map(as_text, value)) + "]"
    if isinstance(value, bytes):
        return f"<blob:{len(value)} bytes>"
    return "NULL" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def row_lines(df: DataFrame, limit: int = 100) -> list[str]:
    """The first rows as lines of ``name: value``."""
    return [as_text(r) for r in df.limit(limit).collect()]


def schema_lines(schema: list[dict]) -> list[str]:
    """A line for each column of ``Database.get_schema``, with its modifiers."""
    flags = (("not_null", "NOT NULL"), ("unique", "UNIQUE"), ("indexed", "INDEX"))
    return [" ".join([c["name"], c["type"], *[word for key, word in flags if c.get(key)], *([f"DEFAULT {as_text(c['default'])}"] if "default" in c else [])]) for c in schema]
