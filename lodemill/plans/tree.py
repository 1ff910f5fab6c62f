"""Syntax tree of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass
class Lit:
    value: Any


@dataclass
class Col:
    name: str
    table: str | None = None


@dataclass
class Arith:
    op: str
    left: Any
    right: Any


@dataclass
class Call:
    name: str
    args: list


@dataclass
class Cast:
    arg: Any
    kind: str


@dataclass
class Case:
    branches: list
    default: Any


@dataclass
class Over:
    partition: list
    order: list  # (Col, ascending)
    frame: tuple | None  # (ROWS or RANGE, from, to); a bound is a number or UP, UF


@dataclass
class Agg:
    name: str
    arg: Any  # None: *
    distinct: bool = False
    sep: str | None = None
    where: Any = None
    over: Over | None = None


@dataclass
class Win:
    name: str
    args: list
    over: Over


@dataclass
class Item:
    expr: Any  # None: *
    alias: str | None
    text: str


@dataclass
class Cmp:
    op: str
    left: Any
    right: Any


@dataclass
class Between:
    left: Any
    low: Any
    high: Any


@dataclass
class In:
    left: Any
    values: Any  # list of Lit, or Select


@dataclass
class Like:
    kind: str
    left: Any
    pattern: str


@dataclass
class IsNull:
    left: Any
    negated: bool


@dataclass
class Exists:
    query: Any
    negated: bool


@dataclass
class Junction:
    op: str
    parts: list


@dataclass
class Table:
    name: str | None
    alias: str | None
    query: Any = None


@dataclass
class Join:
    kind: str
    table: Table
    on: list


@dataclass
class Core:
    distinct: bool
    items: list
    table: Table | None
    joins: list = field(default_factory=list)
    where: Any = None
    group: list | None = None
    grouping: str | None = None  # ROLLUP, CUBE, SETS
    sets: list | None = None
    having: Any = None


@dataclass
class Select:
    ctes: list  # (name, columns, Select, recursive)
    cores: list
    ops: list
    order: list = field(default_factory=list)
    limit: int = 0
    offset: int = 0
