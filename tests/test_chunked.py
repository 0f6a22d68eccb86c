"""Splitting dominant keys must not change any result."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillmark.operators import chunked
from tillmark.operators.asof import asof_join


@pytest.fixture
def split_all(monkeypatch):
    monkeypatch.setattr(chunked, "HOT_ROWS", 120)


@pytest.fixture(scope="module")
def facts(spark):
    """Key 1 and the null key hold most rows; times tie and values are partly null."""
    rng = random.Random(5)
    rows = []
    for i in range(400):
        key = rng.choice([1, 1, 1, None, None, 2, 3, 4])
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 20))
        rows.append((i, key, ts, None if rng.random() < 0.4 else rng.randrange(100)))
    return spark.createDataFrame(rows, "id int, key int, ts timestamp, value int")


def same(a, b):
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_some_keys_are_hot_and_some_are_not(split_all, facts):
    hot = chunked.hot_keys(facts, ["key"], chunked.HOT_ROWS).collect()
    assert {r.key for r in hot} == {1}
    tagged = chunked.with_chunks(facts, ["key"], "ts", 1.0)
    assert tagged.filter("key = 1").select("_chunk").distinct().count() > 5
    assert tagged.filter("key = 2").select("_chunk").distinct().count() == 1


@pytest.mark.parametrize("rows", [0, 120])
@pytest.mark.parametrize("forward", [False, True])
def test_neighbour_equals_window(monkeypatch, facts, rows, forward):
    monkeypatch.setattr(chunked, "HOT_ROWS", rows)
    w = Window.partitionBy("key").orderBy("ts", "id")
    expected = facts.withColumn("out", (F.lead if forward else F.lag)("value").over(w))
    got = chunked.neighbour(facts, ["key"], "ts", "value", "out", 1.0, ["id"], forward)
    same(got, expected)


def test_last_known_equals_window(split_all, facts):
    w = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    expected = facts.withColumn("out", F.last("value", ignorenulls=True).over(w))
    same(chunked.last_known(facts, ["key"], "ts", "value", "out", 1.0, ["id"]), expected)


def test_running_sum_equals_window(split_all, facts):
    w = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    expected = facts.withColumn("out", F.sum("value").over(w))
    same(chunked.running_sum(facts, ["key"], "ts", "value", "out", 1.0, ["id"]), expected)


def test_asof_equals_pandas_for_split_and_whole_keys(split_all, spark, facts):
    left = facts.filter("key IS NOT NULL").select("id", "key", "ts")
    rng = random.Random(9)
    dims = [(rng.choice([1, 1, 2, 9]), dt.datetime(2024, 1, 1) + dt.timedelta(hours=3 * rng.randrange(160)), i) for i in range(60)]
    dims = list({(k, t): (k, t, v) for k, t, v in dims}.values())
    right = spark.createDataFrame(dims, "key int, at timestamp, price int")
    got = {r.id: r.price for r in asof_join(left, right, "ts", "at", ["key"], 2, 1.0).collect()}
    lp = pd.DataFrame([r.asDict() for r in left.collect()]).sort_values("ts")
    rp = pd.DataFrame(dims, columns=["key", "at", "price"]).sort_values("at")
    want = pd.merge_asof(lp, rp, left_on="ts", right_on="at", by="key", tolerance=pd.Timedelta(days=2))
    assert got == {r.id: (None if pd.isna(r.price) else int(r.price)) for r in want.itertuples()}


def test_asof_boundaries(spark):
    day = dt.datetime(2024, 3, 1)
    left = spark.createDataFrame(
        [(1, 1, day), (2, 1, day + dt.timedelta(days=5)), (3, 1, day + dt.timedelta(days=5, seconds=1)), (4, 2, day)],
        "id int, key int, ts timestamp",
    )
    right = spark.createDataFrame(
        [(1, day, None), (1, day + dt.timedelta(days=9), 7), (2, day + dt.timedelta(seconds=1), 8)],
        "key int, at timestamp, price int",
    )
    rows = {r.id: (r.price, r.seen) for r in asof_join(left, right, "ts", "at", ["key"], 5, None, keep_time="seen").collect()}
    assert rows[1] == (None, day)  # the same instant matches and its null is kept
    assert rows[2] == (None, day)  # exactly at the tolerance
    assert rows[3] == (None, None)  # beyond it
    assert rows[4] == (None, None)  # nothing from the future


def test_bounce_rate_with_split_keys(split_all, facts):
    events = facts.filter("key IS NOT NULL")
    row = chunked.bounce_rate(events, "key", "ts", 6 * 3600, tiebreak=["id"]).first()
    pdf = pd.DataFrame([r.asDict() for r in events.collect()]).sort_values(["key", "ts", "id"])
    gap = pdf.groupby("key")["ts"].diff()
    pdf["session"] = ((gap.isna()) | (gap > pd.Timedelta(hours=6))).groupby(pdf["key"]).cumsum()
    sizes = pdf.groupby(["key", "session"]).size()
    assert (row.sessions, row.bounces) == (len(sizes), int((sizes == 1).sum()))
