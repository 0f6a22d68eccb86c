"""Ordered target means equal a loop over the rows; a row never sees its own target."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tillmark.operators import encoding


def brute(rows, weight, prior):
    sums, out = {}, {}
    for key, category, target in sorted(rows, key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
        s, n = sums.get(category, (0.0, 0))
        out[key] = (s + prior * weight) / (n + weight)
        if target is not None:
            sums[category] = (s + target, n + 1)
    return out


@pytest.mark.parametrize("digits", [None, 1, 3])
def test_equals_a_loop(spark, digits):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "b", None, ""]), rng.choice([None, 0, 1, 5])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, cat string, y int")
    known = [y for _, _, y in rows if y is not None]
    for weight, prior in ((1.0, None), (4.0, 0.25)):
        got = encoding.ordered_target_mean(df, "cat", "y", ["id"], weight, prior, digits=digits)
        assert got.columns == ["id", "cat", "y", "encoded"]
        want = brute(rows, weight, sum(known) / len(known) if prior is None else prior)
        assert {r["id"]: r["encoded"] for r in got.collect()} == pytest.approx(want)


def test_own_target_does_not_leak(spark):
    df = spark.createDataFrame([(i, "x", i % 2) for i in range(50)], "id int, cat string, y int")
    first = {r["id"]: r["encoded"] for r in encoding.ordered_target_mean(df, "cat", "y", ["id"], prior=0.5).collect()}
    flipped = df.withColumn("y", F.when(F.col("id") == 7, 1 - F.col("y")).otherwise(F.col("y")))
    second = {r["id"]: r["encoded"] for r in encoding.ordered_target_mean(flipped, "cat", "y", ["id"], prior=0.5).collect()}
    assert first[7] == second[7] and first != second


def test_empty_table(spark):
    assert encoding.ordered_target_mean(spark.createDataFrame([], "id int, cat string, y int"), "cat", "y", ["id"]).count() == 0
