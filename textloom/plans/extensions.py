"""Relational queries that the surveyed project has no counterpart of, over the tables of orders and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import relational
from textloom.sources.adapters import table


def _asof(s, d):
    events = table(s, d, "events")
    views = events.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id")).groupBy("user_id", "ts").agg(F.max("view_id").alias("view_id"))
    bought = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return relational.as_of_join(bought, views, "user_id", "ts", "view_id").select("event_id", "user_id", "view_id")


def _sessions(s, d):
    out = relational.sessions(table(s, d, "events"), "user_id", "ts", 6 * 3600)
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def _ranks(s, d):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(s, d, "part").select("p_brand", "p_partkey", F.row_number().over(w).alias("place"), F.lag("p_partkey").over(w).alias("before")).filter("place <= 3")


def _revenue(s, d):
    tables = {n: table(s, d, n) for n in ("lineitem", "orders", "customer", "nation")}
    rows = tables["lineitem"].join(tables["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(tables["customer"], F.col("o_custkey") == F.col("c_custkey")).join(tables["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("items"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


QUERIES = {
    "ext_rollup_returns": (
        lambda s, d: relational.rolled_up(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], n=F.count("*"), quantity=F.sum("l_quantity")),
        "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    ),
    "ext_asof_purchases": (
        _asof,
        """WITH v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT p.event_id, p.user_id, v.view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""",
    ),
    "ext_sessions": (
        _sessions,
        """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 21600000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g), c AS (SELECT user_id, session, count(*) AS n FROM n GROUP BY ALL)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1""",
    ),
    "ext_idle_customers": (
        lambda s, d: table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n")),
        "SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY 1",
    ),
    "ext_active_customers": (
        lambda s, d: table(s, d, "customer").join(table(s, d, "orders").filter("o_orderstatus = 'O'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n")),
        "SELECT c_mktsegment, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') GROUP BY 1",
    ),
    "ext_top_parts": (_ranks, "SELECT p_brand, p_partkey, (row_number() OVER w)::INT AS place, lag(p_partkey) OVER w AS before FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) QUALIFY place <= 3"),
    "ext_revenue_by_nation": (
        _revenue,
        "SELECT n_name, count(*) AS items, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    ),
    "ext_event_props": (
        lambda s, d: table(s, d, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n")),
        "SELECT (props::JSON ->> '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1",
    ),
    "ext_orders_by_month": (
        lambda s, d: table(s, d, "orders").groupBy(F.date_format(F.date_trunc("month", F.col("o_orderdate").cast("timestamp")), "yyyy-MM").alias("month"), "o_orderpriority").agg(F.count("*").alias("n")),
        "SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL",
    ),
}
