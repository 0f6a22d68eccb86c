"""Interval joins equal DuckDB's range joins; no nested loops; long intervals do not fan out."""

import datetime as dt
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillmark.operators import intervals as I

POINTS = "p long, k int, at double"
SPANS = "i long, k int, lo double, hi double"


def data(seed, n=300):
    draw = random.Random(seed)
    spans = []
    for i in range(80):
        lo = draw.uniform(-50, 1000)
        hi = lo + draw.choice([0.0, 0.5, draw.uniform(0, 8), draw.uniform(0, 60), draw.uniform(0, 5000), -1.0])
        spans.append((i, draw.choice([1, 2, None]), lo, hi))
    spans += [(90, 1, None, 5.0), (91, 1, 5.0, None), (92, 1, -1e9, 1e9), (92, 1, -1e9, 1e9)]
    points = [(i, draw.choice([1, 2, None]), draw.uniform(-60, 1100)) for i in range(n)]
    points += [(1000 + j, 1, s[2]) for j, s in enumerate(spans) if s[2] is not None]  # on the bounds
    points += [(2000 + j, 2, s[3]) for j, s in enumerate(spans) if s[3] is not None] + [(3000, 1, None), (3001, 1, 7.0), (3001, 1, 7.0)]
    return points, spans


def sql(query, points, spans):
    con = duckdb.connect()
    con.register("pv", pd.DataFrame(points, columns=["p", "k", "at"]))
    con.register("sv", pd.DataFrame(spans, columns=["i", "k", "lo", "hi"]))
    con.execute("""CREATE TABLE p AS SELECT p, CAST(k AS INT) AS k, nullif("at", 'nan'::DOUBLE) AS "at" FROM pv""")
    con.execute("CREATE TABLE s AS SELECT i, CAST(k AS INT) AS k, nullif(lo, 'nan'::DOUBLE) AS lo, nullif(hi, 'nan'::DOUBLE) AS hi FROM sv")
    return sorted(con.execute(query).fetchall(), key=str)


BOUNDS = {"both": (">=", "<="), "left": (">=", "<"), "right": (">", "<="), "neither": (">", "<")}


@pytest.mark.parametrize("closed", list(BOUNDS))
@pytest.mark.parametrize("by", [(), ("k",)])
def test_points_in_intervals_equal_a_range_join(spark, closed, by):
    points, spans = data(len(closed) + len(by))
    p, s = spark.createDataFrame(points, POINTS), spark.createDataFrame(spans, SPANS)
    p, s = (p, s) if by else (p.drop("k"), s.drop("k"))
    a, b = BOUNDS[closed]
    keys = "AND p.k = s.k" if by else ""
    want = sql(f"SELECT i, p FROM p JOIN s ON \"at\" {a} lo AND \"at\" {b} hi {keys} AND lo <= hi", points, spans)
    for width in (None, 0.3, 1e7):
        joined = I.points_in_intervals(p, s, "at", "lo", "hi", by, closed, width=width)
        assert sorted(map(tuple, joined.select("i", "p").collect()), key=str) == want
    plan = joined._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_left_join_keeps_intervals_without_points(spark):
    points, spans = data(9, 20)
    spans = [x for x in spans if x[0] != 92]
    p, s = spark.createDataFrame(points, POINTS).drop("k"), spark.createDataFrame(spans, SPANS).drop("k")
    want = sql("SELECT i, p FROM s LEFT JOIN p ON \"at\" >= lo AND \"at\" <= hi AND lo <= hi", points, spans)
    joined = I.points_in_intervals(p, s, "at", "lo", "hi", how="left", key=("i",))
    assert sorted(map(tuple, joined.select("i", "p").collect()), key=str) == want
    totals = I.interval_totals(p, s, "at", "lo", "hi", ("i",), {"n": F.count("p")})
    assert {r["i"]: r["n"] or 0 for r in totals.collect()} == dict(
        sql("SELECT i, count(p) FROM s LEFT JOIN p ON \"at\" >= lo AND \"at\" <= hi AND lo <= hi GROUP BY i", points, spans))


def test_overlapping_intervals(spark):
    _, spans = data(4)
    left, right = spans[:45], spans[40:]
    a = spark.createDataFrame(left, SPANS)
    b = spark.createDataFrame(right, SPANS).withColumnsRenamed({"i": "j", "lo": "low", "hi": "high"})
    got = sorted((r["i"], r["j"]) for r in I.overlapping(a, b, ("lo", "hi"), ("low", "high"), by=("k",)).collect())
    want = sorted((x[0], y[0]) for x in left for y in right if None not in (*x, *y) and x[1] == y[1]
                  and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3])
    assert got == want and got


def test_a_very_long_interval_touches_two_bins(spark):
    spans = spark.createDataFrame([(i, float(i), i + 1.0) for i in range(500)] + [(-1, 0.0, 1e12)], "i long, lo double, hi double")
    width = I.typical_length(spans, F.col("hi") - F.col("lo"))
    level = I.level_of(F.col("hi") - F.col("lo"), width)
    bins = spans.select("i", (I.bin_of(F.col("hi"), level, width) - I.bin_of(F.col("lo"), level, width) + 1).alias("n"))
    assert bins.agg(F.max("n")).first()[0] <= 2
    assert spans.select(level).distinct().count() == 2


def test_counts_equal_a_range_join_without_its_pairs(spark):
    draw, day = random.Random(5), dt.datetime(2024, 1, 1)
    points = [(draw.choice([None, i]), draw.choice([None, *range(12)]),
               draw.choice([None, day + dt.timedelta(hours=draw.choice([0, 0, 1, 12, 23]), days=draw.randrange(40))])) for i in range(400)]
    points += points[:30]
    spans = []
    for i in range(120):
        lo = day.date() + dt.timedelta(days=draw.randrange(-5, 45))
        spans.append((draw.choice([None, i]), lo, lo + dt.timedelta(days=draw.choice([-1, 0, 1, 7, 400]))))
    spans += [*spans[:20], (500, None, day.date()), (501, day.date(), None)]
    p, s = spark.createDataFrame(points, "p long, c int, at timestamp_ntz"), spark.createDataFrame(spans, "i int, lo date, hi date")
    out = I.counts_in_intervals(p, s, "at", "lo", "hi", ("i",), "p", "c", ("n", "m"))
    want = I.points_in_intervals(p, s, "at", "lo", "hi").groupBy("i", "lo", "hi").agg(F.count("p").alias("n"), F.count_distinct("c").alias("m"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and want.count() > 60


def test_counts_do_not_grow_with_the_pairs(spark):
    """Sixteen million pairs; no operator may put out as many rows."""
    start = dt.date(2024, 1, 1)
    points = spark.range(8000).select(F.col("id").alias("p"), (F.col("id") % 50).alias("c"),
                                      F.date_add(F.lit(start), (F.col("id") % 30).cast("int")).cast("timestamp_ntz").alias("at"))
    spans = spark.range(2000).select(F.col("id").alias("i"), F.lit(start).alias("lo"), F.date_add(F.lit(start), 60).alias("hi"))
    out = I.counts_in_intervals(points, spans, "at", "lo", "hi", ("i",), "p", "c", ("n", "m"))
    assert out.groupBy("n", "m").count().collect() == [(8000, 50, 2000)]
    node, rows = [out._jdf.queryExecution().executedPlan()], []
    out.collect()
    while node:
        at = node.pop()
        name = at.nodeName()
        if name == "AdaptiveSparkPlan":
            node.append(at.executedPlan())
        elif name.endswith("QueryStage"):
            node.append(at.plan())
        metric = at.metrics().get("numOutputRows")
        rows += [metric.get().value()] if metric.isDefined() else []
        node += [at.children().apply(i) for i in range(at.children().size())]
    assert rows and max(rows) <= 16_000


def test_dates_and_times(spark):
    day = dt.date(2024, 1, 1)
    spans = spark.createDataFrame([(1, day, day + dt.timedelta(days=1)), (2, day, day)], "i int, lo date, hi date")
    points = spark.createDataFrame([(7, dt.datetime(2024, 1, 1)), (8, dt.datetime(2024, 1, 1, 12)), (9, dt.datetime(2024, 1, 2))],
                                   "p int, at timestamp_ntz")
    got = sorted((r["i"], r["p"]) for r in I.points_in_intervals(points, spans, "at", "lo", "hi").collect())
    assert got == [(1, 7), (1, 8), (1, 9), (2, 7)]


def test_refusals_and_empty_tables(spark):
    points, spans = spark.createDataFrame([], POINTS), spark.createDataFrame([], SPANS)
    assert I.points_in_intervals(points.drop("k"), spans.drop("k"), "at", "lo", "hi").count() == 0
    assert I.points_in_intervals(points, spans, "at", "lo", "hi", ("k",), how="left", key=("i",)).count() == 0
    for kwargs in ({"how": "left"}, {"closed": "open"}, {"how": "outer"}):
        with pytest.raises(ValueError):
            I.points_in_intervals(points, spans, "at", "lo", "hi", ("k",), **kwargs)
    with pytest.raises(ValueError):
        I.points_in_intervals(points, spans, "at", "lo", "hi")
