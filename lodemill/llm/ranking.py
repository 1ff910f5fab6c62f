"""Numbers within a key that no task has to hold: block totals first, then ranks inside a block."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, key: list[str], order: list[str], out: str) -> DataFrame:
    """df with ``out``: 0, 1, ... for the rows of each key.

    df has a column ``block`` that spreads the rows of a key; one task orders one block of one key, by ``order``. The
    key columns and ``block`` are not null. Rows alike in all of ``order`` are numbered in any order.
    """
    inside = Window.partitionBy(*key, "block").orderBy(*order)
    sizes = df.groupBy(*key, "block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*key, "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = df.withColumn("_in", F.row_number().over(inside) - 1)
    return inner.join(starts, [*key, "block"]).withColumn(out, (F.col("_start") + F.col("_in")).cast("long")).drop("_start", "_in")
