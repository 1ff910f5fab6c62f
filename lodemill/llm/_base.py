"""Plumbing that the operators of this subpackage share: tables in the shared folder and Arrow batches cut by bytes."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into numpy arrays at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_own_root: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one, and only on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own_root.setdefault("root", tempfile.mkdtemp(prefix="lodemill-"))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)
    except Exception:  # the session may have ended before the interpreter
        pass


class Scratch:
    """Tables written to the shared folder, each of which cuts the lineage of what is read from it.

    They survive lost executors. ``drop`` deletes one; the rest go when the interpreter ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(_remove_quietly, spark, self.root)

    def written(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        """Write df and read it again."""
        path = f"{self.root}/{self.count}"
        self.count += 1
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
        again = self.spark.read.schema(df.schema).parquet(path)
        again._lodemill_path = path
        return again

    def drop(self, df: DataFrame) -> None:
        remove(self.spark, df._lodemill_path)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a cluster gets it by --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [*paths, root]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def packed(df: DataFrame) -> DataFrame:
    """One column ``d`` that holds all others, so that none clashes with a name that an operator adds."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("d"))


def byte_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most ``limit`` bytes of the column, or one row."""
    for batch in batches:
        at, i = 0, batch.schema.get_field_index(column)
        if not batch.num_rows:
            continue
        ends = pc.cumulative_sum(pc.fill_null(pc.cast(pc.binary_length(batch.column(i)), pa.int64()), 0)).to_numpy()
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(ends.searchsorted(base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
