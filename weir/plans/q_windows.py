"""Queries of window functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..session import table
from .catalogue import query

_W = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@query(f"SELECT o_orderkey, row_number() {_W} AS rn, rank() {_W} AS rk, dense_rank() {_W} AS dr, ntile(3) {_W} AS nt, round(percent_rank() {_W}, 6) AS pr, round(cume_dist() {_W}, 6) AS cd FROM orders")
def q_window_rank(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    cols = {"rn": F.row_number(), "rk": F.rank(), "dr": F.dense_rank(), "nt": F.ntile(3)}
    o = table(spark, d, "orders")
    return o.select("o_orderkey", *[f.over(w).cast("long").alias(n) for n, f in cols.items()], F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"))


@query(f"SELECT o_orderkey, lag(o_totalprice) {_W} AS before, lead(o_totalprice, 2, 0.0) {_W} AS after, first_value(o_orderkey) {_W} AS first, nth_value(o_orderkey, 2) {_W} AS second FROM orders")
def q_window_navigation(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.lag("o_totalprice").over(w).alias("before"), F.lead("o_totalprice", 2, 0.0).over(w).alias("after"), F.first("o_orderkey").over(w).alias("first"), F.nth_value("o_orderkey", 2).over(w).alias("second"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS s FROM events")
def q_window_rows_frame(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 1)
    return table(spark, d, "events").select("event_id", F.round(F.sum("value").over(w), 4).alias("s"))


@query("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_returnflag, l_partkey % 50 ORDER BY l_quantity RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM lineitem")
def q_window_range_frame(spark, d):
    w = Window.partitionBy("l_returnflag", F.col("l_partkey") % 50).orderBy("l_quantity").rangeBetween(-5, 5)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.count("*").over(w).alias("n"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def q_qualify_top_order(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return R.qualify(table(spark, d, "orders"), r=F.row_number().over(w)).where("r = 1").select("o_custkey", "o_orderkey")


@query("SELECT DISTINCT o_orderpriority, round(quantile_cont(o_totalprice, 0.3) OVER (PARTITION BY o_orderpriority), 4) AS p FROM orders")
def q_percentile_cont(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.percentile("o_totalprice", 0.3), 4).alias("p"))


@query("SELECT DISTINCT o_orderpriority, count(DISTINCT o_custkey) OVER (PARTITION BY o_orderpriority) AS n FROM orders")
def q_window_count_distinct(spark, d):
    return R.count_distinct_over(table(spark, d, "orders"), "o_custkey", "n", "o_orderpriority").select("o_orderpriority", "n").distinct()


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_buy FROM events")
def q_window_ignore_nulls(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("last_buy"))
