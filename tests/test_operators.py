"""Operators against brute force on small or awkward inputs."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from tillmark.functions import scalars as S
from tillmark.operators import evaluation as E
from tillmark.operators import quality as Q
from tillmark.operators import ranking, series, stats
from tillmark.operators.quantiles import exact_quantiles
from tillmark.operators.timegrid import Grid, lookahead, lookback, since, split_by_date
from tillmark.plans import campaign, churn, retail
from tillmark.sources.tables import Tables, region_reference

GRID = Grid(dt.date(1998, 1, 1), 14, 7)


def test_quantiles_with_heavy_ties_and_nulls(spark):
    rng = random.Random(1)
    rows = [(float(rng.choice([5.0, 5.0, 5.0, rng.random() * 9])), None if i % 7 == 0 else rng.gauss(0, 1)) for i in range(999)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(5)
    qs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {(r.column, r.q): r.value for r in exact_quantiles(df, ["a", "b"], qs).collect()}
    for i, c in enumerate("ab"):
        values = [r[i] for r in rows if r[i] is not None]
        for q in qs:
            assert got[(c, q)] == pytest.approx(np.quantile(values, q), abs=1e-12)


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [1.0, 2.0, 4.0, 8.0], [2.0] * 50])
def test_quantiles_of_tiny_columns(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "a double")
    for r in exact_quantiles(df, ["a"], [0.25, 0.5, 0.9]).collect():
        assert r.value == pytest.approx(np.quantile(values, r.q))


def test_quantiles_of_a_large_column(spark):
    df = spark.range(200_000).select((F.pmod(F.col("id") * 7919, F.lit(200_003)) / 3).alias("a"))
    values = np.array([r.a for r in df.collect()])
    for r in exact_quantiles(df, ["a"], [0.1, 0.5, 0.999]).collect():
        assert r.value == pytest.approx(np.quantile(values, r.q), rel=1e-12)


def test_winsorize_and_median(spark):
    df = spark.createDataFrame([(float(i), None if i % 2 else float(i)) for i in range(101)], "a double, b double")
    top = Q.winsorize(df, ["a"]).agg(F.max("a")).first()[0]
    assert top == pytest.approx(99.0)
    assert Q.impute_median(df, ["b"]).filter("a = 1").first().b == pytest.approx(50.0)


def test_ranks_and_positions(spark):
    rng = random.Random(2)
    values = [float(rng.randrange(40)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    got = {r.id: r.avg_rank for r in ranking.average_ranks(df, "v", descending=True, ranges=7).collect()}
    want = pd.Series(values).rank(ascending=False)
    assert [got[i] for i in range(300)] == list(want)
    placed = sorted(r.p for r in ranking.positions(df, ["id"], "p", seed=3, buckets=16).collect())
    assert placed == list(range(300))


@pytest.mark.parametrize("rows", [
    [(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1), (0.8, 1), (0.9, 0)],
    [(0.5, 1), (0.5, 0)],
])
def test_auc_counts_ties_half(spark, rows):
    df = spark.createDataFrame(rows, "score double, label int")
    wins = [(1.0 if p > n else 0.5 if p == n else 0.0) for p, a in rows if a for n, b in rows if not b]
    assert E.roc_auc(df, ranges=3).first().auc == pytest.approx(sum(wins) / len(wins))


def test_auc_agrees_with_the_library(spark):
    rng = random.Random(4)
    rows = [(rng.random(), rng.randrange(2)) for _ in range(500)]
    df = spark.createDataFrame(rows, "score double, label int")
    auc = BinaryClassificationEvaluator(rawPredictionCol="score").evaluate(df)
    assert E.roc_auc(df, ranges=16).first().auc == pytest.approx(auc)


def test_auc_scores_each_row_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def scored(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = spark.range(200).selectExpr("id / 200D AS score", "CAST(id % 3 = 0 AS INT) AS label").mapInPandas(scored, "score double, label int")
    assert E.roc_auc(df).count() == 1 and seen.value == 200


def test_auc_without_positives_is_null(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 0)], "score double, label int")
    assert E.roc_auc(df).first().auc is None


def test_lookback_matches_range_join_at_the_borders(spark):
    d0 = dt.datetime(1998, 1, 1)
    stamps = [d0 + dt.timedelta(days=k, minutes=m) for k in range(-95, 120) for m in (0, 1, 1439)]
    events = spark.createDataFrame(list(enumerate(stamps)), "id int, ts timestamp_ntz")
    for hi, lo, closed in ((30, 1, "both"), (60, 30, "right"), (90, 60, "right"), (60, 0, "left")):
        got = {(r.id, r.prediction_date) for r in lookback(events, GRID, "ts", hi, lo, closed).collect()}
        want = set()
        for i, t in enumerate(stamps):
            for d in GRID.dates:
                at = dt.datetime.combine(d, dt.time())
                a, b = at - dt.timedelta(days=hi), at - dt.timedelta(days=lo)
                if (a < t if closed == "right" else a <= t) and (t < b if closed == "left" else t <= b):
                    want.add((i, d))
        assert got == want, (hi, lo, closed)
    ahead = {(r.id, r.prediction_date) for r in lookahead(events, GRID, "ts", 28).collect()}
    later = {(r.id, r.prediction_date) for r in since(events, GRID, "ts").collect()}
    for i, t in enumerate(stamps):
        for d in GRID.dates:
            at = dt.datetime.combine(d, dt.time())
            assert ((i, d) in ahead) == (at < t <= at + dt.timedelta(days=28))
            assert ((i, d) in later) == (t < at)


def test_one_pass_features_equal_joined_features(spark, folder):
    t = Tables(spark, folder)
    r = churn.Retail(t.receipts, t.lines, t.products, t.customers, GRID)
    a, b = churn.featured_table(r), churn.joined_features(r)
    assert a.count() > 100
    b = b.select(*a.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_temporal_split_is_eight_three_three(spark):
    df = spark.createDataFrame([(d,) for d in GRID.dates], "prediction_date date")
    out = split_by_date(df, "prediction_date", {"train": GRID.dates[8], "val": GRID.dates[11]}, "test")
    assert {r.data_split: r["count"] for r in out.groupBy("data_split").count().collect()} == {"train": 8, "val": 3, "test": 3}


def test_rsi_matches_exponential_smoothing(spark):
    rng = random.Random(6)
    prices = [100.0]
    for _ in range(59):
        prices.append(prices[-1] + rng.choice([-2.0, -0.5, 0.0, 1.0, 3.0]))
    rows = [(1, dt.date(2024, 1, 1) + dt.timedelta(days=i), p) for i, p in enumerate(prices)]
    flat = [(2, dt.date(2024, 1, 1) + dt.timedelta(days=i), 5.0) for i in range(20)]
    df = spark.createDataFrame(rows + flat, "e int, d date, close double")
    out = {(r.e, r.d): r.rsi for r in series.rsi(df, "e", "d", "close", 14).collect()}
    diff = pd.Series(prices).diff()
    up, down = diff.where(diff > 0, 0.0), -diff.where(diff < 0, 0.0)
    a = up.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    b = down.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    for i, want in enumerate(100 - 100 / (1 + a / b)):
        got = out[(1, rows[i][1])]
        assert got is None if i < 13 else got == pytest.approx(want, abs=1e-9)
    assert out[(2, dt.date(2024, 1, 20))] == 100.0


def test_rsi_carries_over_blocks(spark):
    rng = random.Random(8)
    prices = np.cumsum([rng.gauss(0, 1) for _ in range(700)]) + 500
    rows = [(1, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(p)) for i, p in enumerate(prices)]
    df = spark.createDataFrame(rows, "e int, d date, close double")
    whole = {r.d: r.rsi for r in series.rsi(df, "e", "d", "close").collect()}
    cut = {r.d: r.rsi for r in series.rsi(df, "e", "d", "close", block=400).collect()}
    assert all((whole[d] is None and cut[d] is None) or abs(whole[d] - cut[d]) < 1e-9 for d in whole)


def test_streaks(spark):
    days = [1, 2, 3, 6, 9, 10]
    df = spark.createDataFrame([(1, dt.date(2024, 1, d)) for d in days], "e int, d date")
    ids = [r.streak_id for r in series.streaks(df, "e", "d").orderBy("d").collect()]
    assert ids == [1, 1, 1, 2, 3, 3]
    kept = [r.d.day for r in series.last_of_streak(df, "e", "d").orderBy("d").collect()]
    assert kept == [3, 6, 10]


def test_history_is_padded_in_front(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(4)], "e int, d int, v double")
    out = {r.d: [x.v for x in r.feature_window] for r in series.history_array(df, "e", "d", ["v"], 3).collect()}
    assert out[0] == [None, None, None] and out[2] == [None, 0.0, 1.0] and out[3] == [0.0, 1.0, 2.0]


def test_rolling_full_window_only(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(5)], "e int, d int, v double")
    out = [r.m for r in series.rolling(df, "e", "d", "v", 3, out="m", min_periods=3).orderBy("d").collect()]
    assert out == [None, None, 1.0, 2.0, 3.0]


def test_moments_match_pandas(spark):
    values = [1.0, 2.0, 2.0, 3.0, 9.0, 4.5]
    row = stats.moments(spark.createDataFrame([(v,) for v in values], "x double"), ["x"]).first()
    s = pd.Series(values)
    assert (row["skew"], row.kurtosis) == (pytest.approx(s.skew()), pytest.approx(s.kurtosis()))


def test_penetration_golden_values(spark):
    counts = {"Birmingham": 3969, "London": 3750, "Nottingham": 2383}
    store = {"Birmingham": 1, "London": 2, "Nottingham": 0}
    receipts = spark.createDataFrame(
        [(store[r] * 100_000 + i, store[r]) for r, n in counts.items() for i in range(n)], "customer_id int, store_code int"
    )
    stores = spark.createDataFrame([(0,), (1,), (2,), (3,)], "store_code int")
    out = {r.region: r.market_penetration_percentage for r in retail.market_penetration(receipts, stores, region_reference(spark)).collect()}
    want = {"Birmingham": 0.340380207007, "London": 0.041921413782, "Nottingham": 0.723708985775}
    assert all(out[k] == pytest.approx(v, abs=1e-11) for k, v in want.items())


def test_scalars(spark):
    rows = [("£1,234.50", "2023Q1"), ("n/a", "2023Q5"), ("-£2.00", "bad"), (None, "2024Q4")]
    df = spark.createDataFrame(rows, "money string, label string")
    out = df.select(S.parse_currency(F.col("money")).cast("double").alias("m"), S.quarter_end(F.col("label")).alias("q")).collect()
    assert [r.m for r in out] == [1234.5, None, -2.0, None]
    assert [r.q for r in out] == [dt.date(2023, 3, 31), None, None, dt.date(2024, 12, 31)]
    zs = spark.createDataFrame([(z / 4,) for z in range(0, 25)], "z double").select("z", S.normal_tail(F.col("z")).alias("p")).collect()
    assert all(abs(r.p - 0.5 * math.erfc(r.z / math.sqrt(2))) < 1e-7 for r in zs)


def test_ztest_with_zero_counts_is_null(spark):
    df = spark.createDataFrame([("a", 0, 10, 0, 4), ("b", 10, 10, 0, 0)], "k string, control_responses long, exposed_responses long, control_considered long, exposed_considered long")
    rows = {r.k: r for r in campaign.ztest(df).collect()}
    assert rows["a"].z is None and rows["b"].z is None


def test_group_folds_keep_groups_together(spark):
    df = spark.createDataFrame([(i % 17, i) for i in range(200)], "g int, i int")
    per_group = E.group_folds(df, "g", 3).groupBy("g").agg(F.countDistinct("fold").alias("n")).agg(F.max("n")).first()[0]
    assert per_group == 1


def test_sentinel_repair_only_touches_sentinels(spark):
    df = spark.createDataFrame([(1, 10.0), (1, 20.0), (1, 99.0), (2, 5.0), (3, 99.0)], "k int, v double")
    out = sorted((r.k, r.v) for r in Q.repair_sentinel(df, "k", "v", 99.0).na.fill({"v": -1.0}).collect())
    assert out == [(1, 10.0), (1, 15.0), (1, 20.0), (2, 5.0), (3, -1.0)]


def test_silhouette_matches_pairwise(spark):
    rng = np.random.default_rng(3)
    points, labels = rng.normal(size=(40, 3)), rng.integers(0, 3, 40)
    labels[0] = 7  # a cluster of one
    df = spark.createDataFrame([(i, [float(x) for x in p], int(c)) for i, (p, c) in enumerate(zip(points, labels))], "i int, e array<double>, c int")
    got = {r.i: r.silhouette for r in E.silhouette(df, "e", "c").collect()}
    dist = ((points[:, None, :] - points[None, :, :]) ** 2).sum(-1)
    for i in range(40):
        own = (labels == labels[i]) & (np.arange(40) != i)
        if not own.any():
            assert got[i] == 0.0
            continue
        a = dist[i][own].mean()
        b = min(dist[i][labels == c].mean() for c in set(labels) if c != labels[i])
        assert got[i] == pytest.approx((b - a) / max(a, b))


def test_panes_are_dealt_by_their_number(spark, monkeypatch):
    start = dt.datetime(2024, 1, 1)
    receipts = [(i, i % 40, start + dt.timedelta(days=i % 80 - 20)) for i in range(600)]
    lines = [(i, i % 9, 2, i % 7) for i in range(600) for _ in range(2)]
    r = churn.Retail(
        spark.createDataFrame(receipts, "receipt_id long, customer_id long, purchased_at timestamp_ntz"),
        spark.createDataFrame(lines, "receipt_id long, product_code long, qty int, value int").withColumn("value", F.col("value").cast("decimal(18,2)")),
        spark.createDataFrame([(i, f"d{i % 3}", f"c{i % 4}") for i in range(9)], "product_code long, department_name string, category_code string"),
        spark.createDataFrame([(i, dt.date(1980, 1, 1)) for i in range(40)], "customer_id long, dob date"), Grid(dt.date(2024, 1, 10), 6, 7))
    few = sorted(map(tuple, churn.enriched_table(r).collect()), key=str)
    monkeypatch.setattr(churn, "ROWS_PER_TASK", 20)
    panes = r.receipts.select("customer_id")
    rows = r.reachable.count() + 1200 * r.reachable.count() // 600
    assert churn.dealt_by_customer(panes, r).rdd.getNumPartitions() == -(-rows // 20) > 4
    assert sorted(map(tuple, churn.enriched_table(r).collect()), key=str) == few and few
