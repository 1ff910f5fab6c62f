"""From raw documents to packed training sequences, in five stages.

Each stage works on all rows that the stage before it kept; its result is written as Parquet and read again. All stages
take null ids and texts, empty and very long texts, ties, repeated rows, empty tables and further columns of any name; all
but the last return the columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodemill.llm import decontaminate, line_dedup, near_dup, packing, quality_net
from lodemill.llm._base import Scratch, importable, table
from lodemill.llm.queries import vocabulary


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the classifier rejects go, the rest is unchanged.

    It is fitted on docs. Null and empty texts are judged as padding; a row is judged by its text alone, so repeated rows
    share their fate; labels with a null id or a null label are not learned from. Nothing stays of an empty table.
    """
    return quality_net.keep_good(docs, table(spark, sf_dir, "labels"))


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: lines that an earlier document holds go; every row stays.

    Null texts stay null. A null id is one document before all others; rows that share an id are one document, and
    repeated rows keep the same lines.
    """
    return line_dedup.drop_repeated_lines(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each group of near duplicates stays, the one with the smallest id (null first).

    Of texts without words one stays, and of repeated rows one. Rows that share an id or have none are judged by their
    texts.
    """
    importable(spark)
    return near_dup.keep_one_of_each(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents with passages of two or more benchmark items go; from others the passages are cut.

    Null and empty texts hold no passage, null and empty items have none; repeated rows share their fate.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="both")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the token pieces of what is left, with their places in sequences.

    A null or empty text is one piece with the end id alone; repeated rows are packed each.
    """
    importable(spark)
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", first_lines),
    ("n-gram jaccard join", one_of_each),
    ("benchmark decontamination", no_benchmark),
    ("best-fit packing", packed_sequences),
]

#: Learned weights, connected groups and tokens are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
