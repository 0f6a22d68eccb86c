"""Backward as-of join by key with a tolerance, split into time chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillmark.functions.scalars import DAY_MICROS, micros
from tillmark.operators.chunked import CHUNK, HOT, across_chunks, chunk_key, with_chunks


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    right_on: str,
    by: Sequence[str],
    tolerance_days: float = 100,
    chunk_days: float | None = 30,
    keep_time: str | None = None,
    lag_days: int = 0,
) -> DataFrame:
    """Attach to each left row the latest right row of its key at or before its time.

    Both sides are stacked and ordered by time inside the key; a dominant key is
    cut into time chunks and a small summary carries the newest right row into
    later chunks (`chunk_days=None` leaves keys whole, for panels whose keys are
    bounded by the calendar). Matches older than
    the tolerance (boundary included) become null, and nulls inside the matched
    row are kept. `lag_days` delays when a right row becomes known. Of several
    right rows at one instant the largest is taken.
    """
    payload = [c for c in right.columns if c not in by and c != right_on]
    time = F.col(right_on) if not lag_days else F.date_add(right_on, lag_days)
    facts = left.select(
        *by, F.col(on).cast("timestamp").alias("_t"), F.lit(1).alias("_is_left"), F.struct(*left.columns).alias("_row"),
    )
    known = right.select(
        *by,
        time.cast("timestamp").alias("_t"),
        F.lit(0).alias("_is_left"),
        F.struct(F.col(right_on).alias("at"), *payload).alias("_match"),
    )
    stacked = facts.unionByName(known, allowMissingColumns=True)
    # The known time travels with the match so that the tolerance can be checked after the carry.
    stacked = stacked.withColumn("_match", F.when(F.col("_is_left") == 0, F.struct("_t", F.col("_match").alias("m"))))
    if chunk_days is None:
        stacked = stacked.withColumn(CHUNK, chunk_key(by, F.lit(0)))
    else:
        stacked = with_chunks(stacked, by, "_t", chunk_days)
    inside = (
        Window.partitionBy(CHUNK).orderBy("_t", "_is_left", "_match").rowsBetween(Window.unboundedPreceding, 0)
    )
    found = stacked.withColumn("_found", F.last("_match", ignorenulls=True).over(inside)).filter("_is_left = 1")
    if chunk_days is not None:
        across = across_chunks(by).rowsBetween(Window.unboundedPreceding, -1)
        edges = stacked.filter(HOT).groupBy(CHUNK).agg(F.max("_match").alias("_carry"))
        edges = edges.withColumn("_carry", F.last("_carry", ignorenulls=True).over(across))
        found = found.join(edges, CHUNK, "left").withColumn("_found", F.coalesce("_found", "_carry"))
    age = micros(F.col("_t")) - micros(F.col("_found._t"))
    fresh = F.when(age <= int(tolerance_days * DAY_MICROS), F.col("_found.m"))
    extra = [F.col(f"_fresh.{c}").alias(c) for c in payload]
    if keep_time:
        extra.append(F.col("_fresh.at").alias(keep_time))
    return found.withColumn("_fresh", fresh).select("_row.*", *extra)
