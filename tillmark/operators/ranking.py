"""Ranks, prefix sums and consecutive positions over a whole table.

The table is cut into value ranges (or hash buckets); a window runs inside each
range and a small table of range totals supplies the offset, so no task sees
the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillmark.functions.scalars import hash_bucket

RANGE = "_range"
ROWS_PER_RANGE = 100_000


def enough_ranges(df: DataFrame) -> int:
    """So many that each holds about ROWS_PER_RANGE rows."""
    return max(1, -(-df.count() // ROWS_PER_RANGE))


def value_ranges(df: DataFrame, order: str, ranges: int | None = None) -> DataFrame:
    """Tag each row with the value range it falls into; ranges hold similar row counts."""
    ranges = enough_ranges(df) if ranges is None else ranges
    probabilities = [i / ranges for i in range(1, ranges)]
    inner = sorted(set(df.approxQuantile(order, probabilities, 0.5 / ranges))) if ranges > 1 else []
    splits = [float("-inf"), *inner, float("inf")]
    if len(splits) < 3:
        return df.withColumn(RANGE, F.lit(0.0))
    return Bucketizer(splits=splits, inputCol=order, outputCol=RANGE).transform(df)


def prefix_sums(df: DataFrame, order: str, cols: Sequence[str], ranges: int | None = None, by: Sequence[str] = (),
                exact: Column | None = None) -> DataFrame:
    """Add `<col>_before`: the sum of `col` over the rows (of the same `by`) with a smaller `order` value.

    `order` must be unique (within `by`); aggregate by it first. If it is a rounded form of a wider key, `exact` orders
    the rows that share it.
    """
    tagged = value_ranges(df, order, ranges)
    ahead = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = tagged.groupBy(*by, RANGE).agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    offsets = offsets.select(
        *by, RANGE, *[F.coalesce(F.sum(f"_t_{c}").over(ahead), F.lit(0)).alias(f"_o_{c}") for c in cols]
    )
    inside = Window.partitionBy(*by, RANGE).orderBy(order, *([] if exact is None else [exact])).rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_i_{c}") for c in cols])
    joined = local.join(offsets, [*by, RANGE])
    return joined.select(*df.columns, *[(F.col(f"_i_{c}") + F.col(f"_o_{c}")).alias(f"{c}_before") for c in cols])


def average_ranks(df: DataFrame, col: str, out: str = "avg_rank", descending: bool = False, ranges: int | None = None) -> DataFrame:
    """Rank of each row's value, ties sharing the mean of their ranks."""
    sign = -1 if descending else 1
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("_key", F.col(col).cast("double") * sign)
    ranked = prefix_sums(counts, "_key", ["n"], ranges, exact=F.desc(col) if descending else F.asc(col))
    ranked = ranked.select(col, (F.col("n_before") + (F.col("n") + 1) / 2.0).alias(out))
    return df.join(ranked, col, "left")


def positions(df: DataFrame, key: Sequence[str], out: str, seed: int = 0, buckets: int | None = None) -> DataFrame:
    """Number the rows 0..n-1 in a repeatable shuffled order; `key` must be unique."""
    buckets = enough_ranges(df) if buckets is None else buckets
    parts = [F.lit(seed), *[F.col(c) for c in key]]
    tagged = df.withColumn(RANGE, hash_bucket(buckets, *parts)).withColumn(
        "_h", F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    )
    ahead = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = tagged.groupBy(RANGE).agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.select(RANGE, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(RANGE).orderBy("_h", *key)
    return (
        tagged.withColumn("_p", F.row_number().over(inside) - 1)
        .join(offsets, RANGE)
        .withColumn(out, F.col("_p") + F.col("_o"))
        .drop(RANGE, "_h", "_p", "_o")
    )
