"""Types of the data model and literals in filter strings."""

from __future__ import annotations

import re

from pyspark.sql import types as T

INT, FLOAT, BOOL, TEXT, BLOB = "INT", "FLOAT", "BOOL", "TEXT", "BLOB"
NUMERIC = (INT, FLOAT, BOOL)

#: Type names of the dialect.
TYPE_NAMES = {
    "INT": INT, "INTEGER": INT, "FLOAT": FLOAT, "REAL": FLOAT, "DOUBLE": FLOAT, "BOOL": BOOL, "BOOLEAN": BOOL,
    "TEXT": TEXT, "STRING": TEXT, "VARCHAR": TEXT, "CHAR": TEXT, "BLOB": BLOB,
}
SPARK_TYPES = {INT: T.LongType(), FLOAT: T.DoubleType(), BOOL: T.BooleanType(), TEXT: T.StringType(), BLOB: T.BinaryType()}

_NULLS = ("", "null", "nil")
_TRUE, _FALSE = ("true", "yes", "1"), ("false", "no", "0")
_INT = re.compile(r"[+-]?[0-9]+\Z")
_FLOAT = re.compile(r"[+-]?(?:[0-9]+\.[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|[0-9]+[eE][+-]?[0-9]+)\Z")


def infer_literal(text: str | None) -> None | bool | int | float | str:
    """Null, boolean, integer, float or string, tried in that order."""
    if text is None or text.lower() in _NULLS:
        return None
    low = text.lower()
    if low in _TRUE or low in _FALSE:
        return low in _TRUE
    if _INT.match(text):
        return int(text)
    if _FLOAT.match(text):
        return float(text)
    return text


def type_of(data_type: T.DataType) -> str | None:
    """The dialect's type of a Spark type; None for those that it has no name for."""
    if isinstance(data_type, T.BooleanType):
        return BOOL
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return FLOAT
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT
    if isinstance(data_type, T.BinaryType):
        return BLOB
    return None


def type_of_value(value: object) -> str | None:
    for kind, name in ((bool, BOOL), (int, INT), (float, FLOAT), (str, TEXT), (bytes, BLOB)):
        if isinstance(value, kind):
            return name
    return None
