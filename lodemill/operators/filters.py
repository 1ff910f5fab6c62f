"""Filter strings ``column[__operator]=value`` as one boolean column, for pushdown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodemill.errors import SyntaxProblem
from lodemill.functions.literals import BOOL, NUMERIC, TEXT, infer_literal, type_of, type_of_value
from lodemill.functions.patterns import like_pattern, regexp_pattern

OPERATORS = ("eq", "neq", "gt", "gte", "lt", "lte", "contains", "startswith", "endswith", "between", "in", "like", "ilike", "regexp", "isnull", "isnotnull")
_TEXT = {"contains", "startswith", "endswith", "like", "ilike", "regexp"}


def resolve(schema: T.StructType, path: str) -> tuple[Column | None, T.DataType | None]:
    """A column by its exact name, else by a path into structs; (None, None) where nothing has that name."""
    if path in schema.names:
        return F.col(f"`{path}`"), schema[path].dataType
    parts, here, out = path.split("."), schema, None
    for p in parts:
        if not isinstance(here, T.StructType) or p not in here.names:
            return None, None
        out = F.col(f"`{p}`") if out is None else out.getField(p)
        here = here[p].dataType
    return out, here


def split_key(text: str) -> tuple[str, str, str]:
    """(column, operator, value)"""
    key, equals, value = text.partition("=")
    column, mark, op = key.rpartition("__")
    if mark and op in OPERATORS:
        key = column
    else:
        op = "eq"
    if not key or (not equals and op not in ("isnull", "isnotnull")):
        raise SyntaxProblem(f"not a filter: {text!r}")
    return key, op, value


def _compared(column: Column, kind: str | None, text: str, op: str) -> Column:
    """The literal takes the column's type; types that don't compare are never equal, less or greater."""
    value: object = text if kind == TEXT else infer_literal(text)
    own = type_of_value(value)
    if value is None:
        return F.lit(False)
    if kind is not None and not (kind == own or (kind in NUMERIC and own in NUMERIC)):
        return F.lit(False)
    if kind == BOOL and own == BOOL:
        lit = F.lit(value)
    elif kind in NUMERIC and (kind == BOOL or own == BOOL):
        column = column.cast("int").cast("double") if kind == BOOL else column
        lit = F.lit(float(value))
    else:
        lit = F.lit(value)
    return {"eq": column == lit, "neq": column != lit, "gt": column > lit, "gte": column >= lit, "lt": column < lit, "lte": column <= lit}[op]


def filter_column(schema: T.StructType, text: str) -> Column:
    key, op, value = split_key(text)
    column, data_type = resolve(schema, key)
    if column is None:  # a path that isn't there is null
        return F.lit(op == "isnull")
    kind = type_of(data_type)
    if op == "isnull":
        return column.isNull()
    if op == "isnotnull":
        return column.isNotNull()
    if op in _TEXT:
        if kind != TEXT:
            return F.lit(False)
        return {
            "contains": column.contains(value),
            "startswith": column.startswith(value),
            "endswith": column.endswith(value),
            "like": column.like(like_pattern(value)),
            "ilike": column.ilike(like_pattern(value)),
            "regexp": column.rlike(regexp_pattern(value)),
        }[op]
    if op == "between":
        low, comma, high = value.partition(",")
        if not comma:
            raise SyntaxProblem(f"between takes two values: {text!r}")
        return _compared(column, kind, low, "gte") & _compared(column, kind, high, "lte")
    if op == "in":
        return reduce(lambda a, b: a | b, [_compared(column, kind, v, "eq") for v in value.split(",")])
    return _compared(column, kind, value, op)


def filters_to_column(schema: T.StructType, filters: list[str]) -> Column:
    """Filters are joined by AND; one that begins with ``OR:`` opens a new group, and groups are joined by OR."""
    groups: list[list[Column]] = [[]]
    for text in filters:
        if text.startswith("OR:"):
            groups.append([])
            text = text[3:]
        groups[-1].append(filter_column(schema, text))
    joined = [reduce(lambda a, b: a & b, g) for g in groups if g]
    return reduce(lambda a, b: a | b, joined) if joined else F.lit(True)
