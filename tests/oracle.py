"""Compare a registered query with its DuckDB SQL: names, types by family, and rows in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _plain(v):
    if v is None or isinstance(v, (str, bool)):
        return repr(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return f"{float(v):.9g}" if isinstance(v, int) else str(v)


def differences(spark, run, sql: str, sf_dir: str) -> list[str]:
    df = run(spark, sf_dir)
    found = views(sf_dir).sql(sql)
    out = []
    if sorted(df.columns) != sorted(found.columns):
        return [f"columns {sorted(df.columns)} and {sorted(found.columns)}"]
    family = {"TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "FLOAT": "float", "VARCHAR": "string", "BOOLEAN": "boolean"}
    kinds = dict(df.dtypes)
    for name, kind in zip(found.columns, map(str, found.types), strict=True):
        if family.get(kind, kinds[name]) != kinds[name]:
            out.append(f"{name} is {kinds[name]} and {kind}")
    order = sorted(df.columns)
    ours = sorted(tuple(_plain(r[c]) for c in order) for r in df.collect())
    at = [found.columns.index(c) for c in order]
    theirs = sorted(tuple(_plain(r[i]) for i in at) for r in found.fetchall())
    if len(ours) != len(theirs):
        out.append(f"{len(ours)} and {len(theirs)} rows")
    elif ours != theirs:
        out.append(f"rows differ, first {next((a, b) for a, b in zip(ours, theirs, strict=True) if a != b)}")
    return out
