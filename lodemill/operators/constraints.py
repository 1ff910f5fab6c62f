"""NOT NULL, UNIQUE, CHECK and foreign keys on staged DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemill.errors import ConstraintViolation, InvalidArgument

COMPARISONS = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}
ACTIONS = ("RESTRICT", "CASCADE", "SET NULL")


def check_column(check: dict) -> Column:
    return COMPARISONS[check["op"]](F.col(f"`{check['column']}`"), F.lit(check["value"]))


def any_row(df: DataFrame) -> bool:
    return not df.isEmpty()


def constrained(meta: dict) -> bool:
    """Whether ``check_rows`` looks at any row."""
    return bool(meta["checks"]) or any(a.get("not_null") or a.get("unique") for a in meta["columns"].values())


def check_rows(name: str, meta: dict, rows: DataFrame, others: DataFrame | None = None) -> None:
    """rows: the new or changed rows; others: the rest of the table, for UNIQUE. A null passes UNIQUE and CHECK."""
    for column, about in meta["columns"].items():
        c = F.col(f"`{column}`")
        if about.get("not_null") and any_row(rows.filter(c.isNull())):
            raise ConstraintViolation(f"{name}.{column} is NOT NULL")
        if about.get("unique"):
            every = rows.select(c.alias("v")).filter("v is not null")
            if others is not None:
                twice = every.join(others.select(c.alias("v")), "v", "left_semi")
                if any_row(twice):
                    raise ConstraintViolation(f"{name}.{column} is UNIQUE")
            if any_row(every.groupBy("v").count().filter("count > 1")):
                raise ConstraintViolation(f"{name}.{column} is UNIQUE")
    for check in meta["checks"]:
        if any_row(rows.filter(~check_column(check))):
            raise ConstraintViolation(f"{name}: CHECK ({check['column']} {check['op']} {check['value']!r})")


def all_set(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in columns])


def check_parents(name: str, meta: dict, rows: DataFrame, read: Callable[[str], DataFrame], changed: set[str] | None = None) -> None:
    """Every child key without a null has a parent. Keys without a changed column need no look."""
    for fk in meta["fks"]:
        if changed is not None and not changed & set(fk["columns"]):
            continue
        keys = rows.filter(all_set(fk["columns"])).select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(fk["columns"])]).distinct()
        parents = read(fk["table"]).select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(fk["refs"])])
        if fk["table"] == name:  # a row may refer to one of the same statement
            parents = parents.unionByName(rows.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(fk["refs"])]))
        if any_row(keys.join(parents, [f"k{i}" for i in range(len(fk["columns"]))], "left_anti")):
            raise ConstraintViolation(f"{name} ({', '.join(fk['columns'])}) has no row in {fk['table']}")


def check_fk(columns: list[str], refs: list[str], on_delete: str, on_update: str, meta: dict) -> None:
    if len(columns) != len(refs):
        raise InvalidArgument("a foreign key has as many columns as it refers to")
    for action in (on_delete, on_update):
        if action not in ACTIONS:
            raise InvalidArgument(f"no action {action}")
        if action == "SET NULL" and any(meta["columns"].get(c, {}).get("not_null") for c in columns):
            raise InvalidArgument("SET NULL needs columns that may be null")
