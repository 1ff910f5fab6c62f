"""The Spark session of this package."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "lodemill", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution, ANSI casts and UTC. Recursive queries may run as many rounds as the dialect allows."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    fixed = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.cteRecursionLevelLimit": "10000",
        "spark.sql.cteRecursionRowLimit": "-1",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (fixed | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
