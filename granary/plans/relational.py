"""The guarded SQL surface over the registered tables: the same statement runs in Spark, after the read-only gate, and in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.operators.guard import validate_read_only
from granary.sources.readers import register

# Statements that both engines read alike; every computed column is named and doubles are rounded.
STATEMENTS: dict[str, str] = {
    "sql_pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
 round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "sql_inner_join": """SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "sql_left_join": """SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""",
    "sql_full_join": """SELECT coalesce(s_nationkey, c_nationkey) AS nationkey, s_n, c_n FROM (SELECT s_nationkey, count(*) AS s_n FROM supplier GROUP BY s_nationkey) s FULL JOIN (SELECT c_nationkey, count(*) AS c_n FROM customer WHERE c_acctbal > 9000 GROUP BY c_nationkey) c ON s_nationkey = c_nationkey""",
    "sql_semi_join": """SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)""",
    "sql_anti_join": """SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)""",
    "sql_range_join": """SELECT b.lo, count(*) AS n FROM (SELECT 0 AS lo, 1000 AS hi UNION ALL SELECT 1000, 1500 UNION ALL SELECT 1500, 3000) b JOIN part ON p_retailprice >= b.lo AND p_retailprice < b.hi GROUP BY b.lo""",
    "sql_rollup": """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "sql_cube": """SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
    "sql_grouping_sets": """SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())""",
    "sql_window_rank": """SELECT c_nationkey, c_custkey, r FROM (SELECT c_nationkey, c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) t WHERE r <= 3""",
    "sql_window_running": """SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders""",
    "sql_window_lag": """SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM events""",
    "sql_union": """SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier""",
    "sql_intersect": """SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier""",
    "sql_except": """SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40""",
    "sql_distinct": """SELECT DISTINCT p_brand, p_type FROM part""",
    "sql_having": """SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12""",
    "sql_correlated": """SELECT p_brand, p_partkey FROM part p WHERE p_retailprice > (SELECT 1.05 * avg(p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)""",
    "sql_case_pivot": """SELECT c_mktsegment, sum(CASE WHEN n_regionkey = 0 THEN 1 ELSE 0 END) AS r0, sum(CASE WHEN n_regionkey = 1 THEN 1 ELSE 0 END) AS r1, sum(CASE WHEN n_regionkey = 2 THEN 1 ELSE 0 END) AS r2 FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_mktsegment""",
    "sql_topk": """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""",
    "sql_sessions": """SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM
 (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '12' HOUR THEN 1 ELSE 0 END AS new FROM events) a) b GROUP BY user_id, s""",
    "sql_q3_shipping": """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderdate""",
    "sql_q5_region": """SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    "sql_q6_forecast": """SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
}


def _run(statement: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir)
        return spark.sql(validate_read_only(statement, spark))

    return run


QUERIES = {name: (_run(sql), sql) for name, sql in STATEMENTS.items()}
