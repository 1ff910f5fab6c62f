"""All registered queries with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from lodemill.plans import document_queries, sql_queries, statement_queries
from lodemill.plans.dialect import run_select

FLAGSHIP = "SELECT l_returnflag, COUNT(*) AS n, SUM(l_quantity) AS q, MAX(l_extendedprice) AS p FROM lineitem WHERE l_quantity >= 10 GROUP BY l_returnflag"


class Tables(Mapping):
    """The Parquet tables of a folder; a table is opened when it is asked for."""

    NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.NAMES:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __iter__(self):
        return iter(self.NAMES)

    def __len__(self) -> int:
        return len(self.NAMES)


def _dialect(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_select(spark, text, lambda name: Tables(spark, sf_dir).get(name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {"flagship": _dialect(FLAGSHIP)}
    out |= {name: _dialect(text) for name, (text, _) in sql_queries.QUERIES.items()}
    return out | {name: run for name, (run, _) in (document_queries.QUERIES | statement_queries.QUERIES).items()}


def oracle_sql() -> dict[str, str]:
    out = {"flagship": FLAGSHIP}
    out |= {name: sql or text for name, (text, sql) in sql_queries.QUERIES.items()}
    return out | {name: sql for name, (_, sql) in (document_queries.QUERIES | statement_queries.QUERIES).items()}
