"""Streaming queries. Check SQL: the batch windows that end before the final watermark."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillmark.catalog.base import query
from tillmark.catalog.market import Z
from tillmark.plans import market as M
from tillmark.sources.tables import MONEY
from tillmark.streaming import live as L
from tillmark.streaming import timers

STAMP = "'%Y-%m-%d %H:%M:%S'"


def priced_events(t):
    return L.read_stream(t.spark, t.folder, "events", "ts").withColumn("value", F.col("value").cast(MONEY))


@query("stream_tumbling_revenue", "", f"""SELECT strftime(date_trunc('day', ts), {STAMP}) AS window_start, event_type, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
    count(*) AS receipts FROM events GROUP BY date_trunc('day', ts), event_type
    HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def _(t):
    return L.run_available(L.tumbling_revenue(priced_events(t), "ts", "value", "event_type"), "tumbling")


@query("stream_hopping_visits", "", f"""WITH w AS (SELECT TIMESTAMP '2023-11-30' + to_days(CAST(k AS INTEGER)) AS s FROM range(120) r(k) WHERE epoch(TIMESTAMP '2023-11-30' + to_days(CAST(k AS INTEGER))) % (7 * 86400) = 0)
    SELECT strftime(s, {STAMP}) AS window_start, strftime(s + INTERVAL 30 DAY, {STAMP}) AS window_end, user_id, count(*) AS visits, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS spend
    FROM w JOIN events ON ts >= s AND ts < s + INTERVAL 30 DAY GROUP BY s, user_id HAVING s + INTERVAL 30 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def _(t):
    return L.run_available(L.hopping_visits(priced_events(t), "ts", "value", "user_id"), "hopping")


SPELLS = """WITH g AS (SELECT {key}, {ts} AS ts, CASE WHEN lag({ts}) OVER w IS NULL OR epoch_us({ts}) - epoch_us(lag({ts}) OVER w) > {gap} THEN 1 ELSE 0 END AS starts
    FROM {table} WINDOW w AS (PARTITION BY {key} ORDER BY {ts})), s AS (SELECT *, sum(starts) OVER (PARTITION BY {key} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g),
    x AS (SELECT {key}, sid, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY 1, 2)
    SELECT {out} FROM x WHERE epoch_us(last_ts) + {gap} <= (SELECT epoch_us(max({ts})) - 86400000000 FROM {table})"""


@query("stream_sessions", "", SPELLS.format(key="user_id", ts="ts", gap=6 * 3600 * 1_000_000, table="events",
    out=f"user_id, strftime(first_ts, {STAMP}) AS session_start, strftime(last_ts + INTERVAL 6 HOUR, {STAMP}) AS session_end, n AS events"))
def _(t):
    return L.run_available(L.sessions(priced_events(t), "ts", "user_id"), "sessions")


@query("stream_churn_timer", "", SPELLS.format(key="o_custkey", ts="o_orderdate", gap=28 * 86400 * 1_000_000, table="orders",
    out=f"o_custkey, strftime(last_ts, {STAMP}) AS last_purchase, strftime(last_ts + INTERVAL 28 DAY, {STAMP}) AS alarm_at, n AS purchases"))
def _(t):
    stream = L.read_stream(t.spark, t.folder, "orders", "o_orderdate")
    return L.run_available(L.churn_alarms(stream, "o_orderdate", "o_custkey"), "churn")


@query("stream_monthly_customers", "", f"""SELECT strftime(m, '%Y-%m-%d') AS month, store_code, count(DISTINCT o_custkey) AS customers,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, count(*) AS receipts
    FROM (SELECT date_trunc('month', o_orderdate) AS m, CAST(o_orderkey % 4 AS BIGINT) AS store_code, o_custkey, o_totalprice FROM orders) x
    GROUP BY m, store_code HAVING m + INTERVAL 1 MONTH <= (SELECT date_trunc('month', max(o_orderdate)) + INTERVAL 1 MONTH
    - INTERVAL 1 MICROSECOND - INTERVAL 31 DAY FROM orders)""")
def _(t):
    stream = L.read_stream(t.spark, t.folder, "orders", "o_orderdate")
    stream = stream.withColumn("store_code", F.col("o_orderkey") % 4).withColumn("amount", F.col("o_totalprice").cast(MONEY))
    return L.run_available(L.monthly_customers(stream, "o_orderdate", "amount", "store_code", "o_custkey"), "months")


@query("stream_bounce_rate", "", f"""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000 THEN 1 ELSE 0 END AS starts
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g),
    x AS (SELECT user_id, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS n FROM s GROUP BY user_id, sid)
    SELECT strftime(date_trunc('day', ended - INTERVAL 1 MICROSECOND), {STAMP}) AS window_start, CAST(user_id % 4 AS BIGINT) AS segment, count(*) AS sessions,
    count(*) FILTER (n = 1) AS bounces, CAST(count(*) FILTER (n = 1) AS DOUBLE) / count(*) AS bounce_rate
    FROM x GROUP BY date_trunc('day', ended - INTERVAL 1 MICROSECOND), user_id % 4
    HAVING date_trunc('day', ended - INTERVAL 1 MICROSECOND) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def _(t):
    stream = priced_events(t).withColumn("segment", F.col("user_id") % 4)
    return L.run_available(L.session_bounces(stream, "ts", "user_id", "segment"), "bounces")


@query("stream_shock_streaks", "single", """SELECT entity_id, strftime(date, '%Y-%m-%d') AS date, daily_return, shock_polarity FROM single
    WHERE date + INTERVAL 2 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def _(t):
    stats = M.daily_return(t.bars).groupBy("entity_id").agg(F.avg("daily_return").alias("mean"), F.stddev_samp("daily_return").alias("std"))
    stream = L.read_stream(t.spark, t.folder, "events", "ts").withColumnRenamed("user_id", "entity_id")
    return L.run_available(timers.shock_streaks(stream, stats, "ts", "entity_id", "value", "event_id", Z), "streaks")


@query("stream_quiet_alarms", "", f"""WITH g AS (SELECT o_custkey, o_orderdate AS ts, lag(o_orderdate) OVER w AS before, lead(o_orderdate) OVER w AS after,
    CASE WHEN lag(o_orderdate) OVER w IS NULL OR o_orderdate - lag(o_orderdate) OVER w > INTERVAL 28 DAY THEN 1 ELSE 0 END AS starts
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)),
    s AS (SELECT *, sum(starts) OVER (PARTITION BY o_custkey ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g),
    x AS (SELECT o_custkey, max(ts) AS last_ts, count(*) AS n, max(after) AS after FROM s GROUP BY o_custkey, sid),
    y AS (SELECT x.*, (SELECT max(o_orderdate) - INTERVAL 1 DAY FROM orders) AS w FROM x)
    SELECT o_custkey, 'alarm' AS event, strftime(last_ts, {STAMP}) AS last_purchase, strftime(last_ts + INTERVAL 28 DAY, {STAMP}) AS "at", n AS purchases
    FROM y WHERE last_ts + INTERVAL 28 DAY < w
    UNION ALL SELECT o_custkey, 'return', strftime(last_ts, {STAMP}), strftime(after, {STAMP}), n FROM y WHERE after > last_ts AND after < w AND after - last_ts <= INTERVAL 730 DAY""")
def _(t):
    stream = L.read_stream(t.spark, t.folder, "orders", "o_orderdate")
    return L.run_available(timers.quiet_alarms(stream, "o_orderdate", "o_custkey"), "alarms")
