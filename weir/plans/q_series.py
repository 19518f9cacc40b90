"""Queries of time series: buckets, gaps, sessions, streams against batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import temporal as T
from ..operators import timeseries as S
from ..session import table
from .catalogue import query


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1950-01-01') AS b, event_type, count(*) AS n, round(sum(value), 3) AS v FROM events GROUP BY ALL")
def q_bucket_hourly(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(T.datetime_bucket("ts", 6, "HOUR").alias("b"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("v"))


_GRID = """WITH e AS (SELECT user_id, ts, max(value) AS value FROM events GROUP BY ALL),
 g AS (SELECT user_id, unnest(generate_series(time_bucket(INTERVAL 1 DAY, min(ts) - INTERVAL 1 MICROSECOND) + INTERVAL 1 DAY, time_bucket(INTERVAL 1 DAY, max(ts)), INTERVAL 1 DAY)) AS ts FROM e GROUP BY user_id)"""


def _daily(spark, d, method):
    e = table(spark, d, "events").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return S.gap_fill(e, "ts", 1, "DAY", partition_by=("user_id",), values={"value": method})


@query(_GRID + " SELECT g.ts, g.user_id, e.value FROM g ASOF LEFT JOIN e ON g.user_id = e.user_id AND g.ts >= e.ts")
def q_gap_fill_locf(spark, d):
    return _daily(spark, d, "locf")


@query(
    _GRID
    + """, b AS (SELECT g.*, e.ts AS t0, e.value AS v0 FROM g ASOF LEFT JOIN e ON g.user_id = e.user_id AND g.ts >= e.ts),
 f AS (SELECT b.*, e.ts AS t1, e.value AS v1 FROM b ASOF LEFT JOIN e ON b.user_id = e.user_id AND b.ts <= e.ts)
 SELECT ts, user_id, round(CASE WHEN t0 = ts THEN v0 ELSE v0 + (v1 - v0) * (epoch_us(ts) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0)) END, 6) AS value FROM f"""
)
def q_gap_fill_linear(spark, d):
    out = _daily(spark, d, "linear")
    return out.withColumn("value", F.round("value", 6))


@query(
    """WITH r AS (SELECT event_id, user_id, ts AS s, ts + INTERVAL 12 HOUR AS e FROM events),
 m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM r),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e, event_id ROWS UNBOUNDED PRECEDING) AS k FROM m)
 SELECT event_id, min(s) OVER (PARTITION BY user_id, k) AS session_start, max(e) OVER (PARTITION BY user_id, k) AS session_end FROM g"""
)
def q_sessionize_events(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").alias("s"), (F.col("ts") + F.expr("interval 12 hours")).alias("e"))
    return S.range_sessionize(e, "s", "e", ("user_id",)).select("event_id", "session_start", "session_end")


@query("SELECT user_id, count(*) AS n FROM (SELECT user_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) WHERE gap IS NULL OR gap >= INTERVAL 8 HOUR GROUP BY user_id")
def q_session_window(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "8 hours")).agg(F.count("*").alias("c")).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 3) AS v FROM events GROUP BY ALL")
def q_stream_tumbling(spark, d):
    """The same windows from a stream of the file, run to its end."""
    from ..streaming.events import tumbling

    return tumbling(spark, f"{d}/events.parquet", "1 hour").select("event_type", F.col("start").cast("timestamp_ntz").alias("hour"), "n", F.round("v", 3).alias("v"))
