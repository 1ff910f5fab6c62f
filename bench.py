"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from lodemill.plans.registry import queries
from lodemill.session import session

#: One query for each part of the inventory.
HEADLINE = (
    "flagship", "scan_project", "filter_range", "filter_arith", "select_distinct", "join_inner", "join_chain", "join_band", "agg_multi_key", "agg_count_distinct",
    "agg_cube", "win_rank", "win_rows_moving", "topk", "union_all", "sub_correlated_scalar", "recursive_all", "fn_cast", "pipe_match_group_sort_limit", "text_any",
    "geo_near", "dml_insert_select", "dml_update", "dml_delete",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    known, took = queries(), {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):  # the first warms up
            began = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 4)
    # The operations that the baseline names: rows a second over the order lines.
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = lines.count()
    rates = {}
    for name, run in (("find_full_scan", lambda: lines.write.format("noop").mode("overwrite").save()), ("count", lines.count)):
        times = []
        for _ in range(RUNS):
            began = time.perf_counter()
            run()
            times.append(time.perf_counter() - began)
        rates[f"{name}_rows_per_sec"] = round(n / statistics.median(times))
    # Writes alone, on a table of a million rows: the insert of all, then an update of a third of them.
    from lodemill.plans.statement_queries import with_tables

    rows = lines.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    while (n := rows.count()) < 1_000_000:
        rows = rows.unionAll(rows)
    inserts, updates, deletes = [], [], []
    for _ in range(RUNS):
        db = with_tables(spark, sf_dir)
        began = time.perf_counter()
        with db.change() as state:
            db.insert_frame(state, "lines", rows, rows.columns)
        inserts.append(time.perf_counter() - began)
        began = time.perf_counter()
        db.exec_sql("UPDATE lines SET l_returnflag = 'X', l_quantity = 1.5 WHERE id % 3 = 0")
        updates.append(time.perf_counter() - began)
        began = time.perf_counter()
        db.exec_sql("DELETE FROM lines WHERE l_returnflag = 'X'")
        deletes.append(time.perf_counter() - began)
    rates["insert_rows_per_sec"] = round(n / statistics.median(inserts))
    rates["update_rows_per_sec"] = round(n / 3 / statistics.median(updates))
    rates["delete_rows_per_sec"] = round(n / 3 / statistics.median(deletes))
    print(json.dumps({"metric": "total of median times", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "rates": rates, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
