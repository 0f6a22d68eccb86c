"""Sketch roll-ups stay within their error bounds; months added later equal one pass over everything."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tillmark.plans import sketches as K
from tillmark.sources.files import run_folder

SHAPE = "store int, customer int, at timestamp_ntz, spend double"


def receipts(spark, n=30_000):
    rng = random.Random(8)
    rows = [(rng.randrange(3), None if i % 997 == 0 else int(rng.paretovariate(0.6)) % 9000, dt.datetime(2024, 1 + i % 4, 1 + i % 28),
             round(rng.expovariate(0.02), 2)) for i in range(n)]
    return spark.createDataFrame(rows, SHAPE)


def test_roll_ups_are_within_their_bounds(spark):
    facts = receipts(spark)
    states = K.sketches(facts, ["store"], "at", "customer", "spend")
    assert states.count() == 12
    for by in ([], ["store"], ["month"]):
        exact = facts.withColumn("month", F.trunc("at", "MM")).groupBy(*by).agg(
            F.count(F.lit(1)).alias("receipts"), F.count_distinct("customer").alias("customers"))
        want = {tuple(r[c] for c in by): r for r in exact.collect()}
        for row in K.rolled_up(states, by).collect():
            key = tuple(row[c] for c in by)
            assert row["receipts"] == want[key]["receipts"]
            assert abs(row["customers"] - want[key]["customers"]) <= 0.03 * want[key]["customers"]
            own = facts.withColumn("month", F.trunc("at", "MM"))
            for c, v in zip(by, key, strict=True):
                own = own.where(F.col(c) == v)
            for q in (50, 90):  # the share of rows below the sketched quantile
                share = own.agg(F.avg((F.col("spend") <= row[f"spend_p{q}"]).cast("double"))).first()[0]
                assert abs(share - q / 100) < 0.03


def test_months_added_later_equal_one_pass(spark):
    facts = receipts(spark, 5000)
    path = run_folder(spark, "sketches")
    early = facts.where("at < '2024-03-01'")
    K.add_months(path, K.sketches(early, ["store"], "at", "customer", "spend"))
    K.add_months(path, K.sketches(facts.where("at >= '2024-03-01'"), ["store"], "at", "customer", "spend"))
    stored = spark.read.parquet(path)
    assert stored.count() == 12
    whole = {r["store"]: (r["receipts"], r["customers"]) for r in K.rolled_up(
        K.sketches(facts, ["store"], "at", "customer", "spend"), ["store"]).collect()}
    assert {r["store"]: (r["receipts"], r["customers"]) for r in K.rolled_up(stored, ["store"]).collect()} == whole
    # a corrected month takes the place of the old one
    K.add_months(path, K.sketches(facts.where("at >= '2024-04-01' AND store = 0"), ["store"], "at", "customer", "spend"))
    assert spark.read.parquet(path).count() == 10


def test_empty_facts(spark):
    states = K.sketches(spark.createDataFrame([], SHAPE), ["store"], "at", "customer", "spend")
    assert states.count() == 0 and K.rolled_up(states, ["store"]).count() == 0
