"""Row-order operators that split dominant keys into time chunks.

`lag`, `last non-null` and running totals over one key normally put the whole
key into one task. Here keys that hold an unusual share of the rows are found
first and cut into chunks of the order column; the window runs inside (key,
chunk), and a summary with one row per (hot key, chunk) carries the state across
chunk borders. All other keys stay whole. The result equals the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tillmark.functions.scalars import DAY_MICROS, micros

CHUNK = "_chunk"
HOT = "_hot"

# A key is hot above this many rows, whatever the size of the table.
HOT_ROWS = 1_000_000


def time_chunk(ts: str, days: float) -> Column:
    return F.floor(micros(F.col(ts)) / F.lit(float(days * DAY_MICROS)))


def null_safe(keys: Sequence[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys])


def hot_keys(df: DataFrame, by: Sequence[str], rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than `rows` rows."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows).drop("_n")


def chunk_key(by: Sequence[str], number: Column) -> Column:
    """Key and chunk number in one struct. Null keys inside a struct equal each other, so the same column
    serves the window and the join that follows, and the rows are shuffled once for both."""
    return F.struct(*by, number.cast("bigint").alias("_n"))


def with_chunks(df: DataFrame, by: Sequence[str], ts: str, days: float, rows: int | None = None) -> DataFrame:
    """Add the chunk: time-based for hot keys, one for each of the rest."""
    hot = hot_keys(df.select(*by), by, HOT_ROWS if rows is None else rows)
    marked = hot.withColumnsRenamed({k: f"_h{k}" for k in by}).withColumn(HOT, F.lit(True))
    joined = df.join(marked, null_safe(by, "_h"), "left").drop(*[f"_h{k}" for k in by])
    joined = joined.withColumn(HOT, F.coalesce(HOT, F.lit(False)))
    return joined.withColumn(CHUNK, chunk_key(by, F.when(F.col(HOT), time_chunk(ts, days)).otherwise(0)))


def across_chunks(by: Sequence[str]) -> WindowSpec:
    """Order of the chunks of one key."""
    return Window.partitionBy(*[F.col(CHUNK)[k] for k in by]).orderBy(F.col(CHUNK)["_n"])


def neighbour(
    df: DataFrame,
    by: Sequence[str],
    ts: str,
    value: str,
    out: str,
    days: float,
    tiebreak: Sequence[str] = (),
    forward: bool = False,
    chunks: DataFrame | None = None,
) -> DataFrame:
    """`lag(value)` (or `lead`) over (partition by `by` order by `ts`, tiebreak).

    `chunks` takes the frame from `with_chunks` where several operators share it;
    the chunk columns are then kept.
    """
    order = [F.col(ts), *[F.col(c) for c in tiebreak]]
    chunked = chunks if chunks is not None else with_chunks(df, by, ts, days)
    inside = Window.partitionBy(CHUNK).orderBy(*order)
    across = across_chunks(by)
    boxed = F.struct(F.col(value).alias("v"))
    pick = F.min_by if forward else F.max_by
    shift = F.lead if forward else F.lag
    edges = chunked.filter(HOT).groupBy(CHUNK).agg(pick(boxed, F.struct(*order)).alias("_edge"))
    edges = edges.withColumn("_edge", shift("_edge").over(across))
    near = chunked.withColumn("_near", shift(boxed).over(inside))
    found = near.join(edges, CHUNK, "left").withColumn(out, F.coalesce("_near", "_edge")["v"]).drop("_near", "_edge")
    return found if chunks is not None else found.drop(CHUNK, HOT)


def last_known(
    df: DataFrame,
    by: Sequence[str],
    ts: str,
    value: str,
    out: str,
    days: float,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Latest non-null `value` up to and including each row."""
    order = F.struct(F.col(ts), *[F.col(c) for c in tiebreak])
    chunked = with_chunks(df, by, ts, days)
    inside = Window.partitionBy(CHUNK).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    across = across_chunks(by).rowsBetween(Window.unboundedPreceding, -1)
    edges = chunked.filter(HOT).groupBy(CHUNK).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), order)).alias("_edge")
    )
    edges = edges.withColumn("_edge", F.last("_edge", ignorenulls=True).over(across))
    near = chunked.withColumn("_near", F.last(value, ignorenulls=True).over(inside))
    return near.join(edges, CHUNK, "left").withColumn(out, F.coalesce("_near", "_edge")).drop("_near", "_edge", CHUNK, HOT)


def running_sum(
    df: DataFrame,
    by: Sequence[str],
    ts: str,
    value: str,
    out: str,
    days: float,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Sum of `value` from the start of the key up to and including each row."""
    order = F.struct(F.col(ts), *[F.col(c) for c in tiebreak])
    chunked = with_chunks(df, by, ts, days)
    inside = Window.partitionBy(CHUNK).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    across = across_chunks(by).rowsBetween(Window.unboundedPreceding, -1)
    totals = chunked.filter(HOT).groupBy(CHUNK).agg(F.sum(value).alias("_before"))
    totals = totals.withColumn("_before", F.sum("_before").over(across))
    near = chunked.withColumn("_near", F.sum(value).over(inside))
    # A key with no value yet stays null, as with the plain window.
    total = F.when(
        F.col("_near").isNotNull() | F.col("_before").isNotNull(),
        F.coalesce("_near", F.lit(0)) + F.coalesce("_before", F.lit(0)),
    )
    return near.join(totals, CHUNK, "left").withColumn(out, total).drop("_near", "_before", CHUNK, HOT)


def bounce_rate(
    events: DataFrame, user: str, ts: str, gap_seconds: int, by: str | None = None,
    days: float = 1.0, tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Sessions of a single event as a share of all sessions.

    A session starts where the gap before exceeds the limit and is a bounce
    where the gap after does too, so no session id is needed.
    """
    limit = gap_seconds * 1_000_000
    chunks = with_chunks(events, [user], ts, days)
    df = neighbour(events, [user], ts, ts, "_prev", days, tiebreak, chunks=chunks)
    df = neighbour(df, [user], ts, ts, "_next", days, tiebreak, forward=True, chunks=df)
    now = micros(F.col(ts))
    starts = F.col("_prev").isNull() | (now - micros(F.col("_prev")) > limit)
    ends = F.col("_next").isNull() | (micros(F.col("_next")) - now > limit)
    grouped = df.groupBy(by) if by else df.groupBy()
    return grouped.agg(
        F.count_if(starts).alias("sessions"), F.count_if(starts & ends).alias("bounces")
    ).withColumn("bounce_rate", F.try_divide(F.col("bounces").cast("double"), F.col("sessions").cast("double")))
