"""Text files in and out: key=value lines, CSV and JSON exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodemill.functions.literals import _FALSE, _TRUE, BOOL, FLOAT, INT, SPARK_TYPES, TEXT

#: What literals of whole and other numbers look like, as in filter strings.
INT_LOOK = r"^[+-]?[0-9]+$"
FLOAT_LOOK = r"^[+-]?(?:[0-9]+\.[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|[0-9]+[eE][+-]?[0-9]+)$"


def read_pairs(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(rows as a map of strings, number of bad lines) of a file with ``a=1 b=2`` in each line.

    Empty lines and lines that begin with # are skipped. A line with a part that has no name and = is bad.
    """
    lines = spark.read.text(path).select(F.btrim("value").alias("line")).filter("line <> '' and not startswith(line, '#')")
    parts = F.filter(F.split("line", r"\s+"), lambda p: p != "")
    good = F.forall(parts, lambda p: F.instr(p, "=") > 1)
    # The last of repeated names counts.
    entry = "named_struct('k', substring_index(p, '=', 1), 'v', substring(p, instr(p, '=') + 1))"
    last = "filter(e, (x, i) -> NOT exists(slice(e, i + 2, size(e)), y -> y.k = x.k))"
    entries = lines.filter(good).select(parts.alias("parts")).select(F.expr(f"transform(parts, p -> {entry})").alias("e"))
    keyed = entries.select(F.expr(f"map_from_entries({last})").alias("pairs"))
    return keyed, lines.filter(~good).count()


def typed_pairs(pairs: DataFrame) -> DataFrame:
    """A column for each name, in order; its type is what all its values look like, or text."""
    entries = pairs.select(F.explode("pairs").alias("k", "v"))
    look = F.lower("v")
    null = F.col("v").isNull() | look.isin("", "null", "nil")
    kinds = entries.groupBy("k").agg(
        F.bool_and(null | look.isin(*_TRUE, *_FALSE)).alias(BOOL),
        F.bool_and(null | (F.col("v").rlike(INT_LOOK) & F.col("v").try_cast("long").isNotNull())).alias(INT),
        F.bool_and(null | F.col("v").rlike(INT_LOOK) | F.col("v").rlike(FLOAT_LOOK)).alias(FLOAT),
        F.bool_and(null).alias("none"),
    )
    columns = []
    for r in kinds.orderBy("k").collect():  # a row for each column
        kind = next((t for t in (BOOL, INT, FLOAT) if r[t] and not r["none"]), TEXT)
        v = F.col("pairs")[r["k"]]
        none = v.isNull() | F.lower(v).isin("", "null", "nil")
        value = F.lower(v).isin(*_TRUE) if kind == BOOL else v.cast(SPARK_TYPES[kind])
        columns.append(F.when(~none, value).alias(r["k"]))
    return pairs.select(*columns)


def _flat(column: Column, kind: T.DataType) -> Column:
    """Nested values as a short note; a null as an empty cell."""
    if isinstance(kind, T.ArrayType):
        return F.when(column.isNotNull(), F.concat(F.lit("<array:"), F.size(column).cast("string"), F.lit(" items>")))
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.lit(f"<object:{len(kind)} fields>"))
    if isinstance(kind, T.BinaryType):
        return F.when(column.isNotNull(), F.concat(F.lit("<blob:"), F.octet_length(column).cast("string"), F.lit(" bytes>")))
    return column.cast("string")


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """With a header; cells with a comma, quote or line end are quoted, and quotes doubled."""
    flat = df.select(*[_flat(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])
    flat.write.mode(mode).csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="")


def write_json(df: DataFrame, path: str, limit: int = 0, mode: str = "error") -> None:
    """One object a line; nested values stay nested."""
    (df.limit(limit) if limit else df).write.mode(mode).json(path, ignoreNullFields=False)


def read_blob(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
