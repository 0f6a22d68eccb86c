"""Point-in-time grids: match events to evenly spaced prediction dates.

The grid is arithmetic, so each event computes which grid indexes it belongs to
and is expanded to exactly those. That turns the range join of events and dates
into a projection; no date table is joined and nothing is cross joined.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.functions.scalars import DAY_MICROS, micros


@dataclass(frozen=True)
class Grid:
    """`n` prediction dates from `start`, `step` days apart."""

    start: dt.date = dt.date(2021, 7, 1)
    n: int = 14
    step: int = 7

    @property
    def dates(self) -> list[dt.date]:
        return [self.start + dt.timedelta(days=self.step * k) for k in range(self.n)]

    @property
    def last(self) -> dt.date:
        return self.dates[-1]

    def date_of(self, k: Column) -> Column:
        return F.date_add(F.lit(self.start), (k * self.step).cast("int"))

    def offset(self, ts: Column) -> Column:
        """Microseconds from the first grid date to `ts`."""
        return micros(ts) - micros(F.lit(self.start))

    def first_at_or_after(self, ts: Column, days: int) -> Column:
        """Smallest k with date_k >= ts + days."""
        step = self.step * DAY_MICROS
        return -F.floor(-(self.offset(ts) + days * DAY_MICROS) / F.lit(float(step)))

    def first_after(self, ts: Column, days: int) -> Column:
        """Smallest k with date_k > ts + days."""
        return self.last_at_or_before(ts, days) + 1

    def last_at_or_before(self, ts: Column, days: int) -> Column:
        """Largest k with date_k <= ts + days."""
        step = self.step * DAY_MICROS
        return F.floor((self.offset(ts) + days * DAY_MICROS) / F.lit(float(step)))

    def last_before(self, ts: Column, days: int) -> Column:
        """Largest k with date_k < ts + days."""
        return self.first_at_or_after(ts, days) - 1


def prediction_grid(spark, grid: Grid) -> DataFrame:
    return spark.range(grid.n).select(grid.date_of(F.col("id")).alias("prediction_date"))


def expand(df: DataFrame, grid: Grid, first: Column, last: Column, out: str = "prediction_date") -> DataFrame:
    """One row per grid index in [first, last], clipped to the grid."""
    lo = F.greatest(first, F.lit(0)).cast("int")
    hi = F.least(last, F.lit(grid.n - 1)).cast("int")
    tagged = df.withColumn("_lo", lo).withColumn("_hi", hi).filter("_lo <= _hi")
    return (
        tagged.withColumn("_k", F.explode(F.sequence("_lo", "_hi")))
        .withColumn(out, grid.date_of(F.col("_k")))
        .drop("_lo", "_hi", "_k")
    )


def lookback(events: DataFrame, grid: Grid, ts: str, hi: int, lo: int, closed: str = "both") -> DataFrame:
    """Events with every grid date d whose look-back window holds them.

    closed="both":  d - hi <= ts <= d - lo
    closed="right": d - hi <  ts <= d - lo
    closed="left":  d - hi <= ts <  d - lo
    """
    c = F.col(ts)
    reach = events.filter(
        (c >= F.lit(grid.start - dt.timedelta(days=hi))) & (c <= F.lit(grid.last - dt.timedelta(days=lo)))
    )
    first = grid.first_after(c, lo) if closed == "left" else grid.first_at_or_after(c, lo)
    last = grid.last_before(c, hi) if closed == "right" else grid.last_at_or_before(c, hi)
    return expand(reach, grid, first, last)


def in_window(ts: Column, date: Column, hi: int, lo: int, closed: str = "both") -> Column:
    """Is `ts` in the look-back window of `date`? Same bounds as `lookback`."""
    start, end = F.date_sub(date, hi), F.date_sub(date, lo)
    lower = ts > start if closed == "right" else ts >= start
    upper = ts < end if closed == "left" else ts <= end
    return lower & upper


def lookahead(events: DataFrame, grid: Grid, ts: str, days: int) -> DataFrame:
    """Events with every grid date d for which d < ts <= d + days."""
    c = F.col(ts)
    reach = events.filter((c > F.lit(grid.start)) & (c <= F.lit(grid.last + dt.timedelta(days=days))))
    return expand(reach, grid, grid.first_at_or_after(c, -days), grid.last_before(c, 0))


def since(events: DataFrame, grid: Grid, ts: str) -> DataFrame:
    """Events with every grid date after them."""
    reach = events.filter(F.col(ts) < F.lit(grid.last))
    return expand(reach, grid, grid.first_after(F.col(ts), 0), F.lit(grid.n - 1))


def split_by_date(df: DataFrame, date: str, cutoffs: dict[str, dt.date], last: str, out: str = "data_split") -> DataFrame:
    """Label rows by the first cutoff their date lies before, else `last`."""
    label = None
    for name, cutoff in cutoffs.items():
        test = F.col(date) < F.lit(cutoff)
        label = F.when(test, name) if label is None else label.when(test, name)
    return df.withColumn(out, label.otherwise(last))


def split_by_range(df: DataFrame, date: str, ranges: dict[str, tuple[dt.date, dt.date]], out: str = "data_split") -> DataFrame:
    """Label rows by closed date range; rows in none are dropped."""
    label = F.lit(None).cast("string")
    for name, (start, end) in reversed(ranges.items()):
        label = F.when(F.col(date).between(F.lit(start), F.lit(end)), name).otherwise(label)
    return df.withColumn(out, label).filter(F.col(out).isNotNull())
