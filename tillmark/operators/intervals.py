"""Joins on intervals of any position and length.

An interval is put on the level whose bin width is the first to reach its length; widths grow by `FAN` from a typical
length, so it touches two neighbouring bins at most, however long it is. A point has one bin on each level in use. Points and
intervals then meet by equality of the keys, the level and the bin, and the exact bounds are tested on what meets. A
point and an interval share exactly one bin, so every pair comes out once. Nothing is compared with everything: a plan
has sort-merge or hash joins only, and a crowded bin is split by adaptive execution like any skewed key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillmark.functions.scalars import micros

FAN = 8


def position(c: Column, kind: str) -> Column:
    """Times in microseconds, numbers as they are."""
    return micros(c) if kind in ("date", "timestamp", "timestamp_ntz") else c.cast("double")


def typical_length(intervals: DataFrame, length: Column) -> float:
    """Median of the positive lengths, from a mergeable sketch; 1 where there are none."""
    found = intervals.select(length.cast("double").alias("n")).where("n > 0").agg(F.percentile_approx("n", 0.5, 1000)).first()[0]
    return float(found) if found else 1.0


def level_of(length: Column, width: float) -> Column:
    steps = F.ceil(F.log(float(FAN), F.greatest(length.cast("double") / F.lit(width), F.lit(1.0))) - F.lit(1e-9))
    return F.greatest(F.lit(0), steps).cast("int")


def bin_of(at: Column, level: Column, width: float) -> Column:
    return F.floor(at.cast("double") / (F.lit(width) * F.pow(F.lit(float(FAN)), level))).cast("long")


def within(at: Column, start: Column, end: Column, closed: str) -> Column:
    lower = at >= start if closed in ("both", "left") else at > start
    upper = at <= end if closed in ("both", "right") else at < end
    return lower & upper


def points_in_intervals(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, by: tuple[str, ...] = (),
                        closed: str = "both", how: str = "inner", key: tuple[str, ...] = (), width: float | None = None) -> DataFrame:
    """Every pair of a point and an interval that holds it; with how="left", intervals without a point too.

    A left join needs columns `key` that identify an interval.

    Both sides keep their columns, which must have different names except for the keys `by`. `closed` says which ends
    belong to the interval: both, left, right or neither. Null keys, points and ends match nothing, as do intervals
    that end before they start. `width` is the narrowest bin (by default the median length).
    """
    if clash := (set(points.columns) & set(intervals.columns)) - set(by):
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    if how not in ("inner", "left") or (how == "left" and not key) or closed not in ("both", "left", "right", "neither"):
        raise ValueError(f"how={how}, closed={closed}")
    kind = points.schema[at].dataType.typeName()
    lo, hi = (position(F.col(c), intervals.schema[c].dataType.typeName()) for c in (start, end))
    where = position(F.col(at), kind)
    placed = intervals.withColumns({"_lo": lo, "_hi": hi})
    width = width or typical_length(placed, F.col("_hi") - F.col("_lo"))
    placed = placed.withColumn("_level", level_of(F.col("_hi") - F.col("_lo"), width))
    real = placed.where(F.col("_lo") <= F.col("_hi"))
    levels = [r[0] for r in real.select("_level").distinct().collect()]  # a few: lengths grow by FAN from one to the next
    spread = real.withColumn("_bin", F.explode(F.sequence(*[bin_of(F.col(c), F.col("_level"), width) for c in ("_lo", "_hi")])))
    dealt = points.withColumn("_at", where).where(F.col("_at").isNotNull()).withColumn(
        "_level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
    dealt = dealt.withColumn("_bin", bin_of(F.col("_at"), F.col("_level"), width))
    met = dealt.join(spread, [*by, "_level", "_bin"]).where(within(F.col("_at"), F.col("_lo"), F.col("_hi"), closed))
    names = [*by, *[c for c in intervals.columns if c not in by], *[c for c in points.columns if c not in by]]
    pairs = met.select(*names)
    if how == "inner":
        return pairs
    alone = intervals.join(pairs.select(*key).distinct(), list(key), "left_anti")
    return pairs.unionByName(alone, allowMissingColumns=True)


def overlapping(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str],
                by: tuple[str, ...] = (), width: float | None = None) -> DataFrame:
    """Every pair of a left and a right interval that share a moment; ends belong to the intervals.

    Either the right one starts within the left one, or the left one starts within the right one after its start; no
    pair does both.
    """
    (a, b), (c, d) = left_ends, right_ends
    left, right = left.where(F.col(a) <= F.col(b)), right.where(F.col(c) <= F.col(d))
    first = points_in_intervals(right, left, c, a, b, by, "both", width=width)
    second = points_in_intervals(left, right, a, c, d, by, "right", width=width)
    return first.unionByName(second)


def interval_totals(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, key: tuple[str, ...],
                    totals: dict[str, Column], by: tuple[str, ...] = (), closed: str = "both", width: float | None = None) -> DataFrame:
    """Each interval with `totals` over its points, null where it has none. `key` identifies an interval.

    Points are summed per interval before they meet its other columns, so an interval that holds very many points is
    summed up in many tasks.
    """
    slim = intervals.select(*dict.fromkeys((*by, *key, start, end)))
    pairs = points_in_intervals(points, slim, at, start, end, by, closed, width=width)
    return intervals.join(pairs.groupBy(*key).agg(*[c.alias(name) for name, c in totals.items()]), list(key), "left")


def half_day(at: Column, kind: str) -> Column:
    """Midnight as it is and any other time as its noon: bounds that are dates do not tell more times of a day apart."""
    day = F.to_date(at).cast(kind)
    return F.when(at == day, day).otherwise(day + F.expr("INTERVAL 12 HOURS"))


def counts_in_intervals(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, key: tuple[str, ...],
                        count: str, distinct: str, names: tuple[str, str]) -> DataFrame:
    """Every interval that holds a point, with its points (non-null `count`) and its different values of `distinct`.

    The same as `points_in_intervals` and an aggregation by `key` and both ends, which are dates, but pairs are not listed:
    they grow with the product of both tables. A value is counted where it occurs first at or after the start, which is
    where its previous occurrence lies before the start. So points fold to half days with the half day of the previous
    one, those meet the different starts, and running sums up to each end are looked up. Every group of a window is
    bounded by the calendar.
    """
    if {intervals.schema[c].dataType.typeName() for c in (start, end)} != {"date"}:
        raise ValueError("both ends must be dates")
    kind = points.schema[at].dataType.simpleString()
    halves = points.where(F.col(at).isNotNull()).withColumn("_half", half_day(F.col(at), kind))
    folded = halves.groupBy(F.col(distinct).alias("_value"), "_half").agg(F.count(count).alias("_n"))
    previous = F.lag("_half").over(Window.partitionBy("_value").orderBy("_half"))
    steps = folded.withColumn("_previous", previous).groupBy("_half", "_previous").agg(
        F.sum("_n").alias("_n"), F.count("_value").alias("_d"))

    spans = intervals.where(F.col(start) <= F.col(end)).groupBy(*key, start, end).agg(F.count(F.lit(1)).alias("_copies"))
    ends = spans.select(F.col(start).alias("_start"), F.col(end).alias("_end")).distinct()
    reach = ends.groupBy("_start").agg(F.max("_end").alias("_end"))
    asked = points_in_intervals(halves.select("_half").distinct(), reach, "_half", "_start", "_end")
    # a value whose previous half day is the start itself was met there, so starts come before equal half days
    rows = steps.select("_half", F.col("_previous").alias("_at"), F.lit(1).alias("_order"), F.lit(None).cast("date").alias("_start"), "_n", "_d")
    rows = rows.unionByName(asked.select(
        "_half", F.col("_start").cast(kind).alias("_at"), F.lit(0).alias("_order"), "_start", F.lit(0).alias("_n"), F.lit(0).alias("_d")))
    whole = Window.partitionBy("_half")
    earlier = whole.orderBy(F.asc_nulls_first("_at"), "_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.select("_start", "_half", F.sum("_n").over(whole).alias("_n"), F.sum("_d").over(earlier).alias("_d")).where("_start IS NOT NULL")

    marks = met.select("_start", F.col("_half").alias("_at"), F.lit(None).cast("date").alias("_end"), F.lit(0).alias("_order"), "_n", "_d")
    marks = marks.unionByName(ends.select(
        "_start", F.col("_end").cast(kind).alias("_at"), "_end", F.lit(1).alias("_order"), F.lit(0).alias("_n"), F.lit(0).alias("_d")))
    upto = Window.partitionBy("_start").orderBy("_at", "_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = marks.select(
        "_start", "_end", F.count_if(F.col("_order") == 0).over(upto).alias("_halves"),
        F.sum("_n").over(upto).alias("_n"), F.sum("_d").over(upto).alias("_d")).where("_end IS NOT NULL AND _halves > 0")
    totals = totals.select(F.col("_start").alias(start), F.col("_end").alias(end), "_n", "_d")
    return spans.join(totals, [start, end]).select(
        *key, start, end, (F.col("_n") * F.col("_copies")).alias(names[0]), F.col("_d").alias(names[1]))
