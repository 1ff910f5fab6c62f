"""Run SELECT statements of the dialect on a set of DataFrames."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from lodemill.errors import NotFound
from lodemill.plans.compiler import Compiler
from lodemill.plans.parser import parse_select
from lodemill.plans.recursive import fixpoint


def views_of(tables: Mapping[str, DataFrame] | Callable[[str], DataFrame]) -> Callable[[str], tuple[str, DataFrame]]:
    """A resolver that registers each table under a name of its own when it is first used."""
    known: dict[str, tuple[str, DataFrame]] = {}

    def resolve(table: str) -> tuple[str, DataFrame]:
        key = table.lower()
        if key not in known:
            if callable(tables):
                df = tables(table)
            else:
                df = {k.lower(): v for k, v in tables.items()}.get(key)
            if df is None:
                raise NotFound(f"no table {table}")
            view = f"lm_{table}_{uuid.uuid4().hex[:8]}"
            df.createOrReplaceTempView(view)
            known[key] = (view, df)
        return known[key]

    return resolve


def to_spark_sql(spark: SparkSession, text: str, resolve: Callable[[str], tuple[str, DataFrame]], params: list | tuple = ()) -> str:
    rounds = lambda cte, names, base, step: fixpoint(spark, cte, names, base, step)
    return Compiler(spark, resolve, rounds).select(parse_select(text, params))[0]


def run_select(spark: SparkSession, text: str, tables: Mapping[str, DataFrame] | Callable[[str], DataFrame], params: list | tuple = ()) -> DataFrame:
    return spark.sql(to_spark_sql(spark, text, views_of(tables), params))
