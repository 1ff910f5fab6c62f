"""Aggregation pipeline of the document API: every stage is a function from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodemill.errors import InvalidArgument, NotFound
from lodemill.functions.literals import BOOL, NUMERIC, type_of
from lodemill.operators.filters import filters_to_column, resolve

Stage = Callable[[DataFrame], DataFrame]

#: Rows, skipped ones included, up to which a limit after a sort and a skip holds its rows in memory instead of sorting all.
PAGE_ROWS = 100_000


def match(*filters: str) -> Stage:
    return lambda df: df.filter(filters_to_column(df.schema, list(filters)))


def _number(df: DataFrame, field: str) -> Column:
    column, data_type = resolve(df.schema, field)
    kind = type_of(data_type) if data_type else None
    if kind not in NUMERIC:
        return F.lit(None).cast("double")
    return (column.cast("int") if kind == BOOL else column).cast("double")


def group(by: list[str], **accumulators: tuple[str, str | None]) -> Stage:
    """accumulators: output name = (COUNT, SUM, AVG, MIN or MAX, field). Sums and averages of nothing are 0.0."""

    def run(df: DataFrame) -> DataFrame:
        out = []
        for name, (kind, field) in accumulators.items():
            kind = kind.upper()
            if kind == "COUNT":
                column = F.count("*") if field is None else F.count(resolve(df.schema, field)[0])
            elif kind in ("SUM", "AVG"):
                column = F.coalesce((F.sum if kind == "SUM" else F.avg)(_number(df, field)), F.lit(0.0))
            elif kind in ("MIN", "MAX"):
                found = resolve(df.schema, field)[0]
                column = (F.min if kind == "MIN" else F.max)(F.lit(None) if found is None else found)
            else:
                raise InvalidArgument(f"no accumulator {kind}")
            out.append(column.alias(name))
        keys = [(F.lit(None) if c is None else c).alias(k) for k in by for c in [resolve(df.schema, k)[0]]]
        if not out:
            return df.select(*keys).distinct()
        return df.groupBy(*keys).agg(*out)

    return run


def sort(*keys: tuple[str, bool]) -> Stage:
    """keys: (field, ascending). Nulls come first ascending, last descending."""

    def run(df: DataFrame) -> DataFrame:
        found = [(resolve(df.schema, k)[0], up) for k, up in keys]
        out = df.orderBy(*[c.asc_nulls_first() if up else c.desc_nulls_last() for c, up in found if c is not None])
        out._lodemill_sorted = any(c is not None for c, _ in found)
        return out

    return run


def limit(n: int) -> Stage:
    """0 keeps no row."""

    def run(df: DataFrame) -> DataFrame:
        ordered, skipped = getattr(df, "_lodemill_skipped", (None, 0))
        if ordered is not None and skipped + n <= PAGE_ROWS:
            return ordered.offset(skipped).limit(n)
        return df.limit(n)

    return run


def skip(n: int) -> Stage:
    """The rows after the first n, in their order. One task orders them, unless a small limit comes next."""

    def run(df: DataFrame) -> DataFrame:
        if n == 0:
            return df
        # An offset reads sorted partitions in the order in which executors send them, so rows are put in order where they meet.
        placed = df.select("*", F.monotonically_increasing_id().alias("_skip_at"))
        out = placed.repartition(1).sortWithinPartitions("_skip_at").drop("_skip_at").offset(n)
        if getattr(df, "_lodemill_sorted", False):
            out._lodemill_skipped = (df, n)
        return out

    return run


def project(*fields: str) -> Stage:
    """Fields in the order given; missing ones are left out."""

    def run(df: DataFrame) -> DataFrame:
        found = [(resolve(df.schema, f)[0], f) for f in fields]
        return df.select(*[c.alias(f) for c, f in found if c is not None])

    return run


def lookup(foreign: DataFrame, local_field: str, foreign_field: str, as_field: str) -> Stage:
    """Left join: all matching foreign rows as an array of structs, in order of id; a null key matches nothing."""

    def run(df: DataFrame) -> DataFrame:
        column, _ = resolve(df.schema, local_field)
        other, _ = resolve(foreign.schema, foreign_field)
        if other is None:
            raise NotFound(f"no field {foreign_field}")
        rows = foreign.select(other.alias("_lookup_key"), F.struct(*[F.col(f"`{c}`") for c in foreign.columns]).alias("_lookup_row"))
        items = F.collect_list("_lookup_row")
        if "id" in foreign.columns:
            order = "(a, b) -> CASE WHEN a.id < b.id THEN -1 WHEN a.id > b.id THEN 1 ELSE 0 END"
            nested = rows.groupBy("_lookup_key").agg(items.alias("_rows")).withColumn("_rows", F.expr(f"array_sort(_rows, {order})"))
        else:
            nested = rows.groupBy("_lookup_key").agg(F.array_sort(items).alias("_rows"))
        key = F.lit(None) if column is None else column
        joined = df.join(nested, key == F.col("_lookup_key"), "left")
        return joined.withColumn(as_field, F.coalesce("_rows", F.array().cast(nested.schema["_rows"].dataType))).drop("_lookup_key", "_rows")

    return run


def unwind(field: str) -> Stage:
    """A row for each element; rows without an array, or with an empty one, go."""

    def run(df: DataFrame) -> DataFrame:
        column, data_type = resolve(df.schema, field)
        if not isinstance(data_type, T.ArrayType):
            return df.filter(F.lit(False))
        if field in df.columns:
            return df.select(*[F.explode(column).alias(field) if c == field else F.col(f"`{c}`") for c in df.columns])
        return df.select("*", F.explode(column).alias(field))

    return run


def aggregate(df: DataFrame, stages: list[Stage]) -> DataFrame:
    return reduce(lambda d, stage: stage(d), stages, df)
