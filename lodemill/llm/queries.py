"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.llm import decontaminate, html_extract, line_dedup, near_dup, packing, quality_net, quality_rules, sharding, suffix_dedup, url_filter
from lodemill.llm._base import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels beside the rules: the number that ends a path is the id of the document that the page shows."""
    pages = table(spark, sf_dir, "pages")
    _, path = url_filter.host_and_path(F.col("url"))
    number = F.expr("try_cast(regexp_extract(_path, '([0-9]+)(?:[.][a-z]+)?/?$', 1) as long)")
    urls = pages.select("url").filter("url is not null").distinct().withColumn("_path", path).withColumn("doc_id", number)
    quality = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("good"))
    labels = urls.join(quality, "doc_id").select("url", "good")
    return url_filter.url_verdicts(pages, labels)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.drop_repeats(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_net.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its class, its copies and its links; links between different texts make the classes."""
    classes, _ = near_dup.near_duplicates(table(spark, sf_dir, "documents"))
    return classes


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_quality_rules,
        op2_url_filter,
        op3_sharding,
        op4_line_dedup,
        op5_suffix_dedup,
        op6_html_extraction,
        op7_quality_classifier,
        op8_ngram_jaccard,
        op9_decontamination,
        op10_packing,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": url_filter.URL_FILTER_SQL, "op4_line_dedup": line_dedup.LINE_DIGEST_SQL, "op9_decontamination": decontaminate.SCAN_SQL}
