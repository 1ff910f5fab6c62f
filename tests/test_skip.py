"""Skip after a sort: the limit of the registered query's SQL, and the order of rows that several executors send."""

import subprocess
import sys

from conftest import ROOT
from oracle import views
from pyspark.sql import functions as F

from lodemill.operators import pipeline as p
from lodemill.plans import registry

# Without a common order, a reader takes the rows that its own executor sorted before those of the others.
_CLUSTER = """
import sys
from pyspark.sql import SparkSession
from lodemill.operators import pipeline as p

conf = {"spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.local.dir": sys.argv[1], "spark.sql.warehouse.dir": sys.argv[1]}
spark = SparkSession.builder.master("local-cluster[3,1,1024]").config(map=conf).getOrCreate()
rows = spark.range(20000, numPartitions=12).selectExpr("id * 7919 % 20000 AS k")
for _ in range(5):
    found = p.aggregate(rows, [p.sort(("k", True)), p.skip(1000), p.project("k")]).toArrow()["k"].to_pylist()
    print("skip:", len(found), min(found), found == sorted(found))
spark.stop()
"""


def test_skip_on_executors(tmp_path):
    said = subprocess.run([sys.executable, "-c", _CLUSTER, str(tmp_path)], cwd=ROOT, capture_output=True, text=True, timeout=300)
    told = [x for x in said.stdout.splitlines() if x.startswith("skip:")]
    assert told == ["skip: 19000 1000 True"] * 5, f"{told} {said.stderr[-2000:] * (len(told) < 5)}"


def test_query_has_the_limit_of_its_sql(spark, tmp_path):
    spark.range(1_005_000).select(F.col("id").alias("p_partkey"), F.lit("x").alias("p_name")).coalesce(1).write.parquet(f"{tmp_path}/w")
    next((tmp_path / "w").glob("*.parquet")).rename(tmp_path / "part.parquet")
    name = "pipe_sort_skip_project"
    found = registry.queries()[name](spark, str(tmp_path)).agg(F.count("*"), F.min("p_partkey"), F.max("p_partkey")).collect()
    (told,) = views(str(tmp_path)).sql(f"SELECT COUNT(*), MIN(p_partkey), MAX(p_partkey) FROM ({registry.oracle_sql()[name]})").fetchall()
    assert tuple(found[0]) == told == (1_000_000, 1990, 1_001_989)


def test_skip_pages(spark):
    rows = spark.range(3000, numPartitions=5).selectExpr("id * 7 % 3000 AS k")
    run = lambda *stages: [r.k for r in p.aggregate(rows, list(stages)).collect()]
    up = p.sort(("k", True))
    assert run(up, p.skip(10), p.limit(5)) == list(range(10, 15))
    assert run(up, p.skip(2995), p.limit(p.PAGE_ROWS)) == list(range(2995, 3000))
    assert run(up, p.skip(0), p.limit(2)) == [0, 1] and run(up, p.skip(3), p.limit(0)) == [] and run(up, p.skip(3000)) == []
    assert run(up, p.skip(5), p.skip(5), p.limit(2)) == [10, 11] and run(up, p.limit(20), p.skip(15)) == list(range(15, 20))
    page = p.aggregate(rows, [up, p.skip(10), p.limit(5)])
    assert "TakeOrderedAndProject(limit=15, offset=10" in page._jdf.queryExecution().executedPlan().toString()
