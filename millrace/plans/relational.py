"""SQL through the query facade: joins, aggregates, windows, sets and parameters over views of the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.sql_handle import SparkSql

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: SQL that both engines read; name, text, parameters.
TEXTS: dict[str, tuple[str, list]] = {
    "sql_pricing": ("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-01' GROUP BY l_returnflag, l_linestatus", []),
    "sql_segments": ("SELECT c_mktsegment, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = ? GROUP BY c_mktsegment, n_name", ["F"]),
    "sql_top_orders": ("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) t WHERE k <= 2", []),
    "sql_idle_customers": ("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", []),
    "sql_active_suppliers": ("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > ?)", [49]),
    "sql_all_nations": ("SELECT r_name, n_name, count(c_custkey) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name, n_name", []),
    "sql_set_ops": ("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier UNION SELECT n_regionkey FROM nation", []),
    "sql_rollup": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", []),
    "sql_running_total": ("SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS last3 FROM events", []),
    "sql_distinct": ("SELECT event_type, count(DISTINCT user_id) AS users, min(value) AS low, max(value) AS high FROM events GROUP BY event_type", []),
}


def _query(text: str, params: list) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for name in TABLES:
            if f" {name} " in f" {text} ".replace(")", " ").replace("\n", " "):
                spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
        return SparkSql(spark).query(text, params)

    return run


def _literal(text: str, params: list) -> str:
    for p in params:
        text = text.replace("?", repr(p), 1)
    return text


QUERIES = {name: (_query(*x), _literal(*x)) for name, x in TEXTS.items()}
