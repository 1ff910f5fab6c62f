"""Scalar functions of the dialect as Spark SQL text. Arguments come as (SQL text, type)."""

from __future__ import annotations

from lodemill.errors import SyntaxProblem
from lodemill.functions.literals import BLOB, BOOL, FLOAT, INT, NUMERIC, TEXT

Arg = tuple[str, str | None]
#: Names with the least and the largest number of arguments.
ARITY = {
    "UPPER": (1, 1), "LOWER": (1, 1), "LENGTH": (1, 1), "TRIM": (1, 1), "SUBSTR": (2, 3), "SUBSTRING": (2, 3), "CONCAT": (2, 4),
    "ROUND": (1, 2), "ABS": (1, 1), "CEIL": (1, 1), "CEILING": (1, 1), "FLOOR": (1, 1), "MOD": (2, 2), "COALESCE": (2, 4),
    "NULLIF": (2, 2), "NOW": (0, 0),
}
SPARK_NAMES = {INT: "BIGINT", FLOAT: "DOUBLE", BOOL: "BOOLEAN", TEXT: "STRING", BLOB: "BINARY"}
_SPACE = "' \\t\\n\\u000B\\f\\r'".replace("\\f", "\\u000C")


def null(kind: str) -> Arg:
    return f"CAST(NULL AS {SPARK_NAMES[kind]})", kind


def as_double(arg: Arg) -> str:
    sql, kind = arg
    if kind == BOOL:
        return f"CAST(CAST({sql} AS INT) AS DOUBLE)"
    return f"CAST({sql} AS DOUBLE)" if kind in NUMERIC else null(FLOAT)[0]


def as_text(arg: Arg) -> str:
    sql, kind = arg
    if kind == FLOAT:  # whole numbers without a fraction
        return f"regexp_replace(CAST({sql} AS STRING), '[.]0$', '')"
    return f"CAST({sql} AS STRING)"


def call(name: str, args: list[Arg]) -> Arg:
    low, high = ARITY[name]
    if not low <= len(args) <= high:
        raise SyntaxProblem(f"{name} takes {low} to {high} arguments")
    texts = all(k == TEXT for _, k in args[:1])
    numbers = all(k in (INT, FLOAT) for _, k in args)
    a = [s for s, _ in args]
    if name in ("UPPER", "LOWER"):
        return (f"{name.lower()}({a[0]})", TEXT) if texts else null(TEXT)
    if name == "LENGTH":
        return (f"CAST(octet_length({a[0]}) AS BIGINT)", INT) if texts else null(INT)
    if name == "TRIM":
        return (f"btrim({a[0]}, {_SPACE})", TEXT) if texts else null(TEXT)
    if name in ("SUBSTR", "SUBSTRING"):
        if not texts or any(k not in (INT, FLOAT) for _, k in args[1:]):
            return null(TEXT)
        start = f"CAST(greatest({a[1]}, 1) AS INT)"
        if len(a) == 2:
            return f"substring({a[0]}, {start})", TEXT
        return f"CASE WHEN {a[2]} >= 0 THEN substring({a[0]}, {start}, CAST({a[2]} AS INT)) END", TEXT
    if name == "CONCAT":
        return f"concat({', '.join(as_text(x) for x in args)})", TEXT
    if name == "ROUND":
        if not numbers:
            return null(FLOAT)
        power = f"power(10D, {a[1]})" if len(a) == 2 else "1D"
        x = f"({as_double(args[0])} * {power})"
        return f"(CASE WHEN {x} >= 0 THEN floor({x} + 0.5D) ELSE ceil({x} - 0.5D) END / {power})", FLOAT
    if name == "ABS":
        return (f"abs({a[0]})", args[0][1]) if numbers else null(FLOAT)
    if name in ("CEIL", "CEILING", "FLOOR"):
        return (f"CAST({'floor' if name == 'FLOOR' else 'ceil'}({a[0]}) AS BIGINT)", INT) if numbers else null(INT)
    if name == "MOD":
        if not numbers:
            return null(FLOAT)
        if all(k == INT for _, k in args):
            return f"try_mod({a[0]}, {a[1]})", INT
        return f"try_mod({as_double(args[0])}, {as_double(args[1])})", FLOAT
    if name == "COALESCE":
        kind = common_type(args)
        return f"coalesce({', '.join(converted(x, kind) for x in args)})", kind
    if name == "NULLIF":
        same = args[0][1] == args[1][1] or all(k in NUMERIC for _, k in args)
        if not same:
            return args[0]
        if args[0][1] != args[1][1]:
            return f"CASE WHEN {as_double(args[0])} = {as_double(args[1])} THEN NULL ELSE {a[0]} END", args[0][1]
        return f"nullif({a[0]}, {a[1]})", args[0][1]
    return "unix_timestamp()", INT  # NOW


def common_type(args: list[Arg]) -> str:
    kinds = {k for _, k in args if k}
    if len(kinds) == 1:
        return kinds.pop()
    return FLOAT if kinds and kinds <= set(NUMERIC) else TEXT


def converted(arg: Arg, kind: str) -> str:
    if arg[1] == kind:
        return arg[0]
    return as_double(arg) if kind == FLOAT else as_text(arg)


def soft_cast(arg: Arg, kind: str) -> Arg:
    """CAST that never fails: a string gives the number it begins with, else 0; null stays null."""
    sql, own = arg
    if own == kind:
        return arg
    if kind == TEXT:
        return as_text(arg), TEXT
    if own == TEXT:
        if kind == BOOL:
            return f"CASE WHEN {sql} IS NOT NULL THEN lower({sql}) IN ('true', 'yes', '1') END", BOOL
        pattern = "'^\\\\s*([+-]?[0-9]+)'" if kind == INT else "'^\\\\s*([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)'"
        number = f"coalesce(try_cast(nullif(regexp_extract({sql}, {pattern}, 1), '') AS {SPARK_NAMES[kind]}), {'0L' if kind == INT else '0D'})"
        return f"CASE WHEN {sql} IS NOT NULL THEN {number} END", kind
    if own in NUMERIC:
        if kind == FLOAT:
            return as_double(arg), FLOAT
        if kind == INT:
            return f"CAST({sql} AS BIGINT)", INT
        if kind == BOOL:
            return f"({as_double(arg)} <> 0)", BOOL
    return null(kind)
