"""Updates rewrite touched partitions alone; laid-out facts meet without a shuffle."""

import datetime as dt
import os

from pyspark.sql import functions as F

from tillmark.plans import retail
from tillmark.sources import updates


def files_of(path):
    return {f"{os.path.basename(d)}/{name}" for d, _, names in os.walk(path.removeprefix("file:")) for name in names if name.endswith(".parquet")}


def rows_of(spark, path):
    return [(r["id"], r["g"], r["v"]) for r in spark.read.parquet(path).collect()]


def test_only_touched_partitions_are_written_anew(spark):
    rows = [(i, i % 5, float(i) if i % 7 else None) for i in range(100)]
    path = updates.store_partitioned(spark.createDataFrame(rows, "id int, g int, v double"), "upd", "g")
    before = files_of(path)
    n = updates.update_where(spark, path, "g", (F.col("g") == 2) & F.col("v").isNull(), {"v": F.lit(-1)})
    assert n == 1
    after = files_of(path)
    assert {f for f in before if not f.startswith("g=2/")} == {f for f in after if not f.startswith("g=2/")}
    assert not {f for f in before if f.startswith("g=2/")} & after
    want = sorted(((i, g, -1.0 if g == 2 and v is None else v) for i, g, v in rows), key=str)
    assert sorted(rows_of(spark, path), key=str) == want
    assert updates.update_where(spark, path, "g", F.col("v") > 1e9, {"v": F.lit(0)}) == 0
    assert files_of(path) == after


def test_update_from_an_aggregate_of_the_table_itself(spark):
    rows = [(1, 0, 10.0), (2, 0, 99.0), (3, 0, 20.0), (4, 1, 99.0), (5, 1, 7.0), (6, 2, 5.0), (7, 3, 99.0)]
    path = updates.store_partitioned(spark.createDataFrame(rows, "id int, g int, v double"), "upd", "g")
    means = spark.read.parquet(path).where("v <> 99").groupBy("g").agg(F.avg("v").alias("mean"))
    assert updates.update_where(spark, path, "g", F.col("v") == 99, {"v": F.col("mean")}, means, "g") == 3
    got = {r["id"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert got == {1: 10.0, 2: 15.0, 3: 20.0, 4: 7.0, 5: 7.0, 6: 5.0, 7: None}


def test_null_partitions_are_updated_too(spark):
    path = updates.store_partitioned(spark.createDataFrame([(1, None, 1.0), (2, 3, 1.0)], "id int, g int, v double"), "upd", "g")
    assert updates.update_where(spark, path, "g", F.col("id") == 1, {"v": F.lit(9.0)}) == 1
    assert {r["id"]: r["v"] for r in spark.read.parquet(path).collect()} == {1: 9.0, 2: 1.0}


def test_laid_out_facts_are_joined_where_they_lie(spark):
    receipts = spark.createDataFrame([(i, dt.datetime(2024, 1 + i % 3, 5), i % 2) for i in range(60)],
                                     "receipt_id long, purchased_at timestamp_ntz, store_code int")
    lines = spark.createDataFrame([(i % 60, float(i)) for i in range(300)], "receipt_id long, value double")
    facts = retail.stored_facts(receipts, lines, buckets=4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = retail.stored_monthly_revenue(*facts, dt.date(2024, 2, 1), dt.date(2024, 3, 1))
        got = sorted(map(tuple, out.collect()))
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    final = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert final.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in final  # the one of the report's groups
    assert "PartitionFilters" in final and "month" in final
    want = {}
    for i in range(300):
        key = (dt.date(2024, 1 + (i % 60) % 3, 1), (i % 60) % 2)
        if key[0] >= dt.date(2024, 2, 1):
            want.setdefault(key, [0.0, set()])
            want[key][0] += float(i)
            want[key][1].add(i % 60)
    assert got == sorted((m, s, v, len(r)) for (m, s), (v, r) in want.items())


def test_bucket_counts_are_powers_of_two():
    assert [updates.bucket_count(n) for n in (0, 10, 17_000_000, 10**9)] == [8, 8, 16, 512]
