"""One query for each operator of the dialect: (text in the dialect, DuckDB SQL for the same rows)."""

from __future__ import annotations

#: name -> (dialect, DuckDB). Null: the text is the same.
QUERIES: dict[str, tuple[str, str | None]] = {
    # scans, filters and predicates
    "scan_project": ("SELECT n_nationkey, n_name FROM nation", None),
    "filter_eq": ("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'", None),
    "filter_neq": ("SELECT p_partkey FROM part WHERE p_brand <> 'Brand#11' AND p_size != 7", None),
    "filter_range": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000.5 AND o_totalprice <= 150000 AND o_orderkey >= 10 AND o_orderkey < 9000", None),
    "filter_between": ("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 9", None),
    "filter_in": ("SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 3, 50)", None),
    "filter_like": ("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%_1%9'", None),
    "filter_ilike": ("SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE '%Build_ng%'", None),
    "filter_regexp": ("SELECT c_custkey, c_name FROM customer WHERE c_name REGEXP '^Cust.*0[13]+$'", "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '^Cust.*0[13]+$')"),
    "filter_isnull": (
        "SELECT n_name, s_suppkey FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 9000 WHERE s_suppkey IS NULL",
        "SELECT n_name, s_suppkey FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 9000 WHERE s_suppkey IS NULL",
    ),
    "filter_isnotnull": ("SELECT n_name, s_suppkey FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 9000 WHERE s_suppkey IS NOT NULL", None),
    "filter_or": ("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 400000 AND o_orderpriority = '1-URGENT'", None),
    "filter_paren": ("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'P' OR o_totalprice > 200000) AND (o_orderpriority = '1-URGENT' OR o_custkey < 50)", None),
    "filter_arith": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity * l_extendedprice - l_tax > 2000000", None),
    "filter_incomparable": ("SELECT c_custkey FROM customer WHERE c_name > 5 OR c_custkey = 3", "SELECT c_custkey FROM customer WHERE c_custkey = 3"),
    # projections and expressions
    "select_alias": ("SELECT o.o_orderkey AS k, o.o_totalprice price FROM orders AS o WHERE o.o_orderkey < 100", None),
    "select_star": ("SELECT * FROM part WHERE p_size = 3", None),
    "select_literal": ("SELECT 'x' AS t, 1.5 AS f, TRUE AS b, r_name FROM region", "SELECT 'x' AS t, CAST(1.5 AS DOUBLE) AS f, TRUE AS b, r_name FROM region"),
    "select_arith": (
        "SELECT l_orderkey, l_linenumber, l_quantity * 2 + 1 - l_discount AS a, l_quantity % 7 AS m, -l_linenumber AS neg, l_tax / 0 AS z FROM lineitem WHERE l_orderkey < 400",
        "SELECT l_orderkey, l_linenumber, l_quantity * 2 + 1 - l_discount AS a, l_quantity % 7 AS m, CAST(-l_linenumber AS DOUBLE) AS neg, CAST(NULL AS DOUBLE) AS z FROM lineitem WHERE l_orderkey < 400",
    ),
    "select_case": ("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 AND p_retailprice > 1200 THEN 'mid' ELSE 'large' END AS c, CASE WHEN p_size = 1 THEN 'one' END AS d FROM part", None),
    "select_distinct": ("SELECT DISTINCT p_brand, p_size FROM part", None),
    "select_derived": ("SELECT d.c AS c, d.n AS n FROM (SELECT o_custkey AS c, COUNT(*) AS n FROM orders GROUP BY o_custkey) AS d WHERE d.n > 12", None),
    "select_comments": ("SELECT r_name /* a name */ FROM region -- all\n WHERE r_name <> 'it''s'", None),
    # joins
    "join_inner": ("SELECT c.c_name AS c_name, o.o_orderkey AS o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 300000", None),
    "join_left": ("SELECT c.c_custkey AS c_custkey, o.o_orderkey AS o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 350000", None),
    "join_right": ("SELECT s.s_suppkey AS s_suppkey, n.n_name AS n_name FROM supplier s RIGHT OUTER JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000", None),
    "join_full": ("SELECT a.s_suppkey AS x, b.n_nationkey AS y FROM supplier a FULL JOIN nation b ON a.s_suppkey = b.n_nationkey", None),
    "join_cross": ("SELECT r.r_name AS r_name, n.n_name AS n_name FROM region r CROSS JOIN nation n", None),
    "join_theta": ("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey != b.n_regionkey", None),
    "join_band": (
        "SELECT p.p_partkey AS p_partkey, b.lo AS lo FROM part p JOIN (SELECT n_nationkey * 100 + 0 AS lo, n_nationkey * 100 + 100 AS hi FROM nation) b ON p.p_retailprice >= b.lo AND p.p_retailprice < b.hi",
        "SELECT p.p_partkey AS p_partkey, b.lo AS lo FROM part p JOIN (SELECT CAST(n_nationkey * 100 AS DOUBLE) AS lo, n_nationkey * 100 + 100 AS hi FROM nation) b ON p.p_retailprice >= b.lo AND p.p_retailprice < b.hi",
    ),
    "join_chain": (
        "SELECT r.r_name AS r_name, COUNT(*) AS n FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY r.r_name",
        None,
    ),
    "join_cte": ("WITH big AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 300000) SELECT c.c_name AS c_name, b.o_orderkey AS o_orderkey FROM customer c JOIN big b ON b.o_custkey = c.c_custkey", None),
    # aggregates
    "agg_global": (
        "SELECT COUNT(*) AS n, COUNT(l_tax) AS c, SUM(l_quantity) AS s, MIN(l_shipdate) AS lo, MAX(l_returnflag) AS hi FROM lineitem",
        None,
    ),
    "agg_group": ("SELECT l_returnflag, COUNT(*) AS n, SUM(l_quantity) AS q FROM lineitem GROUP BY l_returnflag", None),
    "agg_multi_key": ("SELECT l_returnflag, l_linestatus, MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "agg_avg": (
        "SELECT q.k AS k, ROUND(q.a, 4) AS a FROM (SELECT p_brand AS k, AVG(p_retailprice) AS a FROM part GROUP BY p_brand) q",
        "SELECT p_brand AS k, ROUND(AVG(p_retailprice), 4) AS a FROM part GROUP BY p_brand",
    ),
    "agg_count_distinct": ("SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderpriority", None),
    "agg_string_agg": ("SELECT n_regionkey, STRING_AGG(n_name, '|') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_filter": (
        "SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS f, COUNT(DISTINCT o_custkey) FILTER (WHERE o_totalprice > 100000) AS d FROM orders GROUP BY o_orderpriority",
        None,
    ),
    "agg_rollup": ("SELECT p_brand, p_size, COUNT(*) AS n FROM part GROUP BY ROLLUP(p_brand, p_size)", None),
    "agg_cube": ("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE(o_orderstatus, o_orderpriority)", None),
    "agg_grouping_sets": ("SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS q FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", None),
    "agg_having": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n * 10 > 150 AND COUNT(*) < 40", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) * 10 > 150 AND COUNT(*) < 40"),
    "agg_empty_input": (
        "SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, AVG(o_totalprice) AS a, MAX(o_orderstatus) AS m FROM orders WHERE o_orderkey < 0",
        "SELECT COUNT(*) AS n, COALESCE(SUM(o_totalprice), 0.0) AS s, COALESCE(AVG(o_totalprice), 0.0) AS a, MAX(o_orderstatus) AS m FROM orders WHERE o_orderkey < 0",
    ),
    "agg_distinct_result": ("SELECT DISTINCT COUNT(*) AS n FROM orders GROUP BY o_custkey", None),
    "agg_group_without_aggregate": ("SELECT p_type FROM part GROUP BY p_type", None),
    # windows
    "win_row_number": ("SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS r FROM orders", None),
    "win_rank": ("SELECT p_partkey, RANK() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r FROM part", None),
    "win_dense_rank": ("SELECT p_partkey, DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part", None),
    "win_rank_without_order": ("SELECT n_name, RANK() OVER (PARTITION BY n_regionkey) AS r FROM nation", None),
    "win_lag": (
        "SELECT o_orderkey, LAG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, LAG(o_totalprice, 2, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders",
        None,
    ),
    "win_lead": ("SELECT o_orderkey, LEAD(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS a FROM orders", None),
    "win_first_last": (
        "SELECT o_orderkey, FIRST_VALUE(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, LAST_VALUE(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders",
        "SELECT o_orderkey, FIRST_VALUE(o_totalprice) OVER w AS a, LAST_VALUE(o_totalprice) OVER w AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    ),
    "win_ntile": ("SELECT p_partkey, NTILE(4) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS q FROM part", None),
    "win_partition_total": (
        "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, MAX(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders",
        "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey) AS n, MAX(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders",
    ),
    "win_rows_running": ("SELECT o_orderkey, SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS s FROM orders", None),
    "win_rows_moving": ("SELECT o_orderkey, MIN(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM orders", None),
    "win_rows_forward": (
        "SELECT o_orderkey, SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS s FROM orders",
        "SELECT o_orderkey, COALESCE(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0.0) AS s FROM orders",
    ),
    "win_range_peers": ("SELECT p_partkey, COUNT(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM part", None),
    "win_inverted_frame": (
        "SELECT n_name, COUNT(*) OVER (ORDER BY n_nationkey ROWS BETWEEN 2 FOLLOWING AND 1 FOLLOWING) AS n FROM nation",
        "SELECT n_name, CAST(0 AS BIGINT) AS n FROM nation",
    ),
    "win_whole_table": ("SELECT n_name, COUNT(*) OVER () AS n FROM nation", None),
    "win_whole_join": (
        "SELECT a.n_name AS n_name, SUM(b.n_nationkey) OVER () AS s, MAX(a.n_name) OVER () AS m FROM nation a JOIN nation b ON a.n_nationkey = b.n_regionkey WHERE b.n_nationkey > 7",
        "SELECT a.n_name, CAST(SUM(b.n_nationkey) OVER () AS DOUBLE) AS s, MAX(a.n_name) OVER () AS m FROM nation a JOIN nation b ON a.n_nationkey = b.n_regionkey WHERE b.n_nationkey > 7",
    ),
    # order and limits
    "order_multi": ("SELECT p_brand, p_size, p_partkey FROM part ORDER BY p_brand DESC, p_size, p_partkey LIMIT 50", None),
    "order_not_selected": ("SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5", None),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 5", None),
    "limit_zero": ("SELECT r_name FROM region LIMIT 0", "SELECT r_name FROM region"),
    "topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", None),
    # set operations
    "union": ("SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier", None),
    "union_all": ("SELECT n_nationkey AS k FROM nation UNION ALL SELECT s_nationkey FROM supplier UNION ALL SELECT c_nationkey FROM customer", None),
    "intersect": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", None),
    "intersect_all": ("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", None),
    "except": ("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier", None),
    "except_all": ("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", None),
    # subqueries, CTEs, recursion
    "sub_scalar": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) AS a FROM orders)", None),
    "sub_in": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000)", None),
    "sub_exists": ("SELECT n_name FROM nation n WHERE EXISTS (SELECT s_suppkey FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 8000)", None),
    "sub_not_exists": ("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey)", None),
    "sub_correlated_scalar": ("SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT AVG(i.o_totalprice) AS a FROM orders i WHERE i.o_custkey = o.o_custkey)", None),
    "sub_correlated_in": ("SELECT c_custkey FROM customer c WHERE 'F' IN (SELECT o.o_orderstatus FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)", None),
    "cte": ("WITH t AS (SELECT o_custkey AS c, SUM(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT c FROM t WHERE s > 2500000", None),
    "cte_chain": ("WITH a AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation), b AS (SELECT r, COUNT(*) AS n FROM a GROUP BY r) SELECT a.k AS k, b.n AS n FROM a JOIN b ON a.r = b.r", None),
    "recursive_all": (
        "WITH RECURSIVE t (x) AS (SELECT r_regionkey AS x FROM region UNION ALL SELECT x + 5 AS x FROM t WHERE x < 100) SELECT x FROM t",
        "WITH RECURSIVE t (x) AS (SELECT r_regionkey AS x FROM region UNION ALL SELECT CAST(x + 5 AS INTEGER) AS x FROM t WHERE x < 100) SELECT x FROM t",
    ),
    "recursive_union": (
        "WITH RECURSIVE t (x) AS (SELECT r_regionkey AS x FROM region UNION SELECT (x + 3) % 11 AS x FROM t) SELECT x FROM t",
        "WITH RECURSIVE t (x) AS (SELECT r_regionkey AS x FROM region UNION SELECT CAST((x + 3) % 11 AS INTEGER) AS x FROM t) SELECT x FROM t",
    ),
    # scalar functions
    "fn_upper_lower": ("SELECT n_nationkey, UPPER(n_name) AS u, LOWER(n_name) AS l FROM nation", None),
    "fn_length": ("SELECT doc_id, LENGTH(text) AS n FROM documents", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n FROM documents"),
    "fn_trim": ("SELECT n_nationkey, TRIM('  a b ') AS t FROM nation", "SELECT n_nationkey, 'a b' AS t FROM nation"),
    "fn_substr": ("SELECT p_partkey, SUBSTR(p_name, 3, 4) AS a, SUBSTRING(p_name, 0) AS b FROM part", "SELECT p_partkey, substr(p_name, 3, 4) AS a, p_name AS b FROM part"),
    "fn_concat": ("SELECT n_nationkey, CONCAT(n_name, '-', n_regionkey) AS c FROM nation", "SELECT n_nationkey, n_name || '-' || n_regionkey AS c FROM nation"),
    "fn_round": ("SELECT p_partkey, ROUND(p_retailprice, 1) AS r, ROUND(p_retailprice) AS w FROM part", "SELECT p_partkey, floor(p_retailprice * 10 + 0.5) / 10 AS r, floor(p_retailprice + 0.5) AS w FROM part"),
    "fn_abs": ("SELECT c_custkey, ABS(c_acctbal) AS a FROM customer", None),
    "fn_ceil_floor": ("SELECT c_custkey, CEIL(c_acctbal) AS c, FLOOR(c_acctbal) AS f FROM customer", "SELECT c_custkey, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(floor(c_acctbal) AS BIGINT) AS f FROM customer"),
    "fn_mod": ("SELECT o_orderkey, MOD(o_orderkey, 7) AS m, MOD(o_orderkey, 0) AS z FROM orders", "SELECT o_orderkey, o_orderkey % 7 AS m, CAST(NULL AS BIGINT) AS z FROM orders"),
    "fn_coalesce": (
        "SELECT n.n_name AS n_name, COALESCE(s.s_acctbal, -1.0) AS b FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 9000",
        "SELECT n.n_name, COALESCE(s.s_acctbal, CAST(-1.0 AS DOUBLE)) AS b FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 9000",
    ),
    "fn_nullif": ("SELECT n_nationkey, NULLIF(n_name, 'NATION_3') AS a FROM nation", None),
    "fn_cast": (
        "SELECT p_partkey, CAST(p_retailprice AS INT) AS i, CAST(p_size AS TEXT) AS t, CAST(p_size AS FLOAT) AS f, CAST('12abc' AS INT) AS p, CAST('abc' AS FLOAT) AS z FROM part",
        "SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS i, CAST(p_size AS VARCHAR) AS t, CAST(p_size AS DOUBLE) AS f, CAST(12 AS BIGINT) AS p, CAST(0 AS DOUBLE) AS z FROM part",
    ),
}
