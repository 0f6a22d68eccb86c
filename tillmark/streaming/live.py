"""Windowed metrics on Structured Streaming.

All queries run in append mode with a watermark: a window or session is
emitted once, when it can no longer change, and late rows beyond the watermark
are dropped. State is bounded by the open windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillmark.sources.files import run_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, folder: str, table: str, ts: str, files_per_batch: int | None = None,
                bytes_per_batch: int = 16 << 30) -> DataFrame:
    """Parquet files as a stream; the event time becomes a zoned timestamp, as watermarks require.

    A batch takes files up to `bytes_per_batch`, or `files_per_batch` files; state is kept in RocksDB.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}*.parquet")
    limit = ("maxFilesPerTrigger", files_per_batch) if files_per_batch else ("maxBytesPerTrigger", bytes_per_batch)
    reader = reader.option(*limit)
    return reader.parquet(folder).withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling_revenue(stream: DataFrame, ts: str, amount: str, by: str, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    windows = stream.withWatermark(ts, delay).groupBy(F.window(ts, width), by)
    return windows.agg(F.sum(amount).alias("revenue"), F.count(F.lit(1)).alias("receipts")).select(
        F.col("window.start").alias("window_start"), by, "revenue", "receipts"
    )


def hopping_visits(stream: DataFrame, ts: str, amount: str, by: str, size: str = "30 days", slide: str = "7 days",
                   delay: str = "1 day") -> DataFrame:
    """Visits and spend in overlapping look-back windows."""
    windows = stream.withWatermark(ts, delay).groupBy(F.window(ts, size, slide), by)
    return windows.agg(F.count(F.lit(1)).alias("visits"), F.sum(amount).alias("spend")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), by, "visits", "spend"
    )


def sessions(stream: DataFrame, ts: str, by: str, gap: str = "6 hours", delay: str = "1 day") -> DataFrame:
    """Activity sessions per key; sessions merge inside each input partition before the shuffle."""
    stream.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    windows = stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("s"), by)
    return windows.agg(F.count(F.lit(1)).alias("events")).select(
        F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), by, "events"
    )


def churn_alarms(stream: DataFrame, ts: str, by: str, days: int = 28, delay: str = "1 day") -> DataFrame:
    """One alarm per spell of `days` without a purchase.

    A session with that gap closes exactly when the spell is complete; its end
    is the moment of the alarm.
    """
    closed = sessions(stream, ts, by, f"{days} days", delay)
    return closed.select(
        by,
        F.expr(f"session_end - INTERVAL {days} DAYS").alias("last_purchase"),
        F.col("session_end").alias("alarm_at"),
        F.col("events").alias("purchases"),
    )


def session_bounces(stream: DataFrame, ts: str, user: str, by: str, gap: str = "6 hours", width: str = "1 day",
                    delay: str = "1 day") -> DataFrame:
    """Sessions and bounces (sessions of one event) per group and window of the session's end.

    Two stateful steps in append mode: sessions close when the watermark passes their end and are then counted in
    tumbling windows, which close behind them. The group is taken from the session's first events; it must not change
    within one.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    closed = stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("s"), user, by).agg(F.count(F.lit(1)).alias("events"))
    ended = closed.select(F.window_time("s").alias("ended_at"), by, "events")
    counted = ended.groupBy(F.window("ended_at", width).alias("w"), by).agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("events") == 1).alias("bounces"))
    return counted.select(F.col("w.start").alias("window_start"), by, "sessions", "bounces",
                          (F.col("bounces") / F.col("sessions")).alias("bounce_rate"))


def monthly_customers(stream: DataFrame, ts: str, amount: str, by: str, customer: str, delay: str = "31 days") -> DataFrame:
    """Distinct customers, revenue and receipts per calendar month and group.

    The event time is the last moment of a row's month. A first step keeps one state row per month, group and customer,
    a second one counts them, so that distinct counts are exact and no task ever holds the customers of a month. With a
    delay of 31 days a month is reported when the second month after it begins; until then late rows are taken in.
    A null customer counts in the revenue and receipts alone.
    """
    last = F.expr(f"CAST(add_months(trunc({ts}, 'MM'), 1) AS TIMESTAMP) - INTERVAL 1 MICROSECOND")
    rows = stream.withColumn("month_close", last).withWatermark("month_close", delay)
    each = rows.groupBy(F.window("month_close", "1 day").alias("w"), by, customer).agg(
        F.sum(amount).alias("revenue"), F.count(F.lit(1)).alias("receipts"))
    each = each.select(F.window_time("w").alias("month_close"), by, customer, "revenue", "receipts")
    months = each.groupBy(F.window("month_close", "1 day").alias("w"), by).agg(
        F.count(customer).alias("customers"), F.sum("revenue").alias("revenue"), F.sum("receipts").alias("receipts"))
    return months.select(F.trunc(F.to_date("w.start"), "MM").alias("month"), by, "customers", "revenue", "receipts")


def run_available(df: DataFrame, label: str) -> DataFrame:
    """Process what is there into parquet files of the shared folder and return them as a table."""
    spark = df.sparkSession
    out = run_folder(spark, label)
    query = (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{out}/data")
        .option("checkpointLocation", f"{out}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/data")
