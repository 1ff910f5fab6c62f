"""WITH RECURSIVE ... UNION: rounds until nothing new appears, so cycles end."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from lodemill.errors import InvalidArgument
from lodemill.sources.scratch import written

ROUNDS = 10_000
#: Rounds after which the parts seen so far become one table.
MERGE = 16


def fixpoint(spark: SparkSession, cte: str, names: list[str], base: str, step: str, rounds: int = ROUNDS) -> str:
    """Name of a temporary view with the distinct rows that base and repeated steps give. ``cte`` is the name that the
    step reads under; it must be nobody else's.

    Each round runs the step on the rows that the round before found new, keeps what has not been seen, and writes it.
    """
    delta = written(spark.sql(base).toDF(*names).distinct(), cte)
    seen, parts = delta, 1
    for _ in range(rounds):
        if delta.isEmpty():
            break
        delta.createOrReplaceTempView(cte)
        found = spark.sql(step).toDF(*names)
        cast = [found[n].cast(seen.schema[n].dataType).alias(n) for n in names]
        delta = written(found.select(*cast).subtract(seen), cte)
        seen, parts = seen.unionAll(delta), parts + 1
        if parts >= MERGE:
            seen, parts = written(seen, cte), 1
    else:
        raise InvalidArgument(f"{cte} goes on after {rounds} rounds")
    spark.catalog.dropTempView(cte)
    view = f"{cte}_{uuid.uuid4().hex[:8]}"
    seen.createOrReplaceTempView(view)
    return view
