"""Streams give the batch result for closed windows and drop late rows."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from tillmark.operators import chunked
from tillmark.streaming import live as L
from tillmark.streaming import timers


def write(spark, folder, name, rows):
    spark.createDataFrame(rows, "k int, ts timestamp_ntz, v double").coalesce(1).write.parquet(f"{folder}/{name}")


def test_late_rows_are_dropped(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    day = dt.datetime(2024, 1, 1)
    write(spark, folder, "a", [(1, day, 1.0), (1, day + dt.timedelta(days=10), 1.0)])
    write(spark, folder, "b", [(1, day + dt.timedelta(hours=1), 50.0), (1, day + dt.timedelta(days=20), 1.0)])
    out = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    results = []
    for part in ("a", "b"):
        schema = spark.read.parquet(f"{folder}/a").schema
        stream = spark.readStream.schema(schema).parquet(f"{folder}/[{'a' if part == 'a' else 'ab'}]")
        stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
        df = L.tumbling_revenue(stream, "ts", "v", "k", "1 day", "1 day")
        query = (
            df.writeStream.format("parquet").outputMode("append").option("path", f"{out}/data")
            .option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        results.append({r.window_start: r.revenue for r in spark.read.schema(df.schema).parquet(f"{out}/data").collect()})
    assert results[0] == {day: 1.0}
    assert results[1] == {day: 1.0, day + dt.timedelta(days=10): 1.0}


def test_churn_alarm_after_a_quiet_spell(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    day = dt.datetime(2024, 1, 1)
    days = {1: [0, 28, 90], 2: [0, 29, 90], 3: [80]}
    rows = [(k, day + dt.timedelta(days=d), 1.0) for k, ds in days.items() for d in ds]
    write(spark, folder, "orders", rows)
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/orders").schema).parquet(f"{folder}/orders")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    alarms = L.run_available(L.churn_alarms(stream, "ts", "k"), "churn-test").collect()
    got = sorted((r.k, (r.alarm_at - day).days, r.purchases) for r in alarms)
    # A purchase exactly 28 days later still counts as a return.
    assert got == [(1, 56, 2), (2, 28, 1), (2, 57, 1)]


def run_parts(spark, build, parts, shape="k int, ts timestamp_ntz, v double, u int"):
    """Feed the parts one after the other through one checkpoint: every part is a restart. Rows after each part."""
    source, out, results = tempfile.mkdtemp(prefix="run-", dir="/tmp"), tempfile.mkdtemp(prefix="run-", dir="/tmp"), []
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{source}/part{i}")
        stream = spark.readStream.schema(shape).option("recursiveFileLookup", True).parquet(source)
        df = build(stream.withColumn("ts", F.col("ts").cast("timestamp")))
        query = (
            df.writeStream.format("parquet").outputMode("append").option("path", f"{out}/data")
            .option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        results.append([tuple(r) for r in spark.read.schema(df.schema).parquet(f"{out}/data").collect()])
    return results


def at(day, hour=0.0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)


def test_alarms_fire_are_withdrawn_and_survive_restarts(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", L.ROCKSDB)
    first = [(1, at(0), 1.0, 0), (2, at(5), 1.0, 0), (3, at(0), 1.0, 0), (None, at(0), 1.0, 0), (9, at(40), 1.0, 0)]
    # 1 stays away; 2 is said to be back on day 33, but behind the watermark of day 39; 3 comes back after its alarm
    second = [(3, at(45), 1.0, 0), (2, at(33), 1.0, 0), (9, at(44), 1.0, 0), (3, at(44), 1.0, 0)]
    third = [(9, at(100), 1.0, 0), (1, at(99.5), 1.0, 0), (2, at(10), 1.0, 0)]
    fourth = [(9, at(103), 1.0, 0)]

    def build(stream):
        return timers.quiet_alarms(stream, "ts", "k", forget_days=60)

    stages = run_parts(spark, build, [first, second, third, fourth])
    days = [sorted((r[0], r[1], (r[2] - at(0)).days, (r[3] - at(0)).days, r[4]) for r in rows) for rows in stages]
    assert days[0] == [(1, "alarm", 0, 28, 1), (2, "alarm", 5, 33, 1), (3, "alarm", 0, 28, 1)]
    assert days[1] == days[0]  # the return on day 44 is final when the watermark has passed that day
    # the late row of key 2 (day 10) is dropped; key 1 was forgotten 60 days after day 0, so it starts anew
    want = sorted([*days[0], (3, "return", 0, 44, 1), (3, "alarm", 45, 73, 2), (9, "alarm", 44, 72, 2)])
    assert days[2] == want
    assert days[3] == sorted([*want, (9, "return", 44, 100, 2)])


def test_alarms_do_not_depend_on_batches(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", L.ROCKSDB)
    rows = [(k, at((k * 37 + i * i * 11) % 300), 1.0, 0) for k in range(6) for i in range(8)]
    rows = sorted(rows, key=lambda r: r[1])

    def build(stream):
        return timers.quiet_alarms(stream, "ts", "k")

    whole = run_parts(spark, build, [rows])[-1]
    pieces = run_parts(spark, build, [rows[:15], rows[15:30], rows[30:]])[-1]
    assert sorted(whole) == sorted(pieces) and {r[1] for r in whole} == {"alarm", "return"}


def test_bounces_of_closed_windows_equal_the_batch(spark):
    times = [(1, at(0, 1)), (1, at(0, 3)), (1, at(0, 20)), (2, at(0, 5)), (3, at(1, 1)), (3, at(1, 2)), (1, at(2)), (9, at(9))]
    rows = [(u % 2, t, 1.0, u) for u, t in times]
    out = run_parts(spark, lambda s: L.session_bounces(s, "ts", "u", "k"), [rows[:5], rows[5:]])[-1]
    summed = {}
    for _, k, sessions, bounces, _ in out:
        a, b = summed.get(k, (0, 0))
        summed[k] = a + sessions, b + bounces
    closed = spark.createDataFrame(rows[:-1], "k int, ts timestamp_ntz, v double, u int")
    batch = {r["k"]: (r["sessions"], r["bounces"]) for r in chunked.bounce_rate(closed, "u", "ts", 6 * 3600, by="k").collect()}
    assert summed == batch


def test_distinct_customers_of_closed_months_and_late_rows(spark):
    rows = [(1, at(0), 5.0, 7), (1, at(20), 5.0, 7), (1, at(21), 1.0, 8), (2, at(3), 1.0, 7), (1, at(22), 1.0, None), (1, at(35), 2.0, 7)]
    late = [(1, at(30, 23), 4.0, 9), (1, at(40), 2.0, 7), (1, at(70), 1.0, 1)]  # a January row in February is taken in
    dropped = [(1, at(5), 100.0, 99), (1, at(130), 1.0, 1)]
    stages = run_parts(spark, lambda s: L.monthly_customers(s, "ts", "v", "k", "u"), [rows, late, dropped])
    assert stages[0] == []
    january = [(dt.date(2024, 1, 1), 1, 3, 16.0, 5), (dt.date(2024, 1, 1), 2, 1, 1.0, 1)]
    assert sorted(stages[1]) == january
    assert sorted(stages[2]) == sorted([*january, (dt.date(2024, 2, 1), 1, 1, 4.0, 2), (dt.date(2024, 3, 1), 1, 1, 1.0, 1)])


def test_streaks_keep_their_state_between_batches(spark):
    closes = {0: 10.0, 1: 20.0, 2: 40.0, 3: 40.5, 5: 10.0, 6: 10.1, 7: 30.0, 12: 30.0}
    rows = [(1, at(d, 12), c, i) for i, (d, c) in enumerate(closes.items())]
    stats = spark.createDataFrame([(1, 0.0, 0.2)], "k int, mean double, std double")

    def build(stream):
        return timers.shock_streaks(stream, stats, "ts", "k", "v", "u")

    want = [(dt.date(2024, 1, 3), "positive"), (dt.date(2024, 1, 6), "negative"), (dt.date(2024, 1, 8), "positive")]
    for parts in ([rows], [rows[:2], rows[2:5], rows[5:]]):
        got = run_parts(spark, build, parts)[-1]
        assert sorted((r[1], r[3]) for r in got) == want
