"""Data repair, imputation and outlier treatment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.operators.quantiles import with_quantiles


def repair_sentinel(
    df: DataFrame, key: str, col: str, sentinel, only: Column | None = None, out: str | None = None
) -> DataFrame:
    """Replace a sentinel by the mean of the other values of the same key."""
    known = F.when(F.col(col) != sentinel, F.col(col))
    # One aggregate of the table finds the keys that need a mean and the mean; only those keys are joined.
    means = df.groupBy(key).agg(
        F.try_divide(F.sum(known).cast("double"), F.count(known).cast("double")).alias("_mean"),
        F.max(F.col(col) == sentinel).alias("_damaged"),
    ).filter("_damaged").drop("_damaged")
    hit = F.col(col) == sentinel
    if only is not None:
        hit = hit & only
    repaired = F.when(hit, F.col("_mean")).otherwise(F.col(col).cast("double"))
    return df.join(means, key, "left").withColumn(out or col, repaired).drop("_mean")


def fill_nulls(df: DataFrame, values: dict) -> DataFrame:
    return df.na.fill(values)


def iqr_outliers(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """Rows outside the fences, counted per column."""
    boxed = with_quantiles(df, cols, [0.25, 0.75])
    row = boxed.agg(*[F.count_if(_outside(F.col(c).cast("double"), F.col("_q")[c], k)).alias(c) for c in cols])
    return row.unpivot([], [*cols], "column", "outliers")


def _outside(value: Column, quartiles: Column, k: float) -> Column:
    q1, q3 = F.get(quartiles, F.lit(0)), F.get(quartiles, F.lit(1))
    return (value < q1 - k * (q3 - q1)) | (value > q3 + k * (q3 - q1))


def high_outliers(df: DataFrame, cols: Sequence[str], q: float = 0.99) -> DataFrame:
    boxed = with_quantiles(df, cols, [q])
    row = boxed.agg(*[F.count_if(F.col(c).cast("double") > F.get(F.col("_q")[c], F.lit(0))).alias(c) for c in cols])
    return row.unpivot([], [*cols], "column", "outliers")


def winsorize(df: DataFrame, cols: Sequence[str], q: float = 0.99) -> DataFrame:
    """Clip each column at its own upper quantile; nulls stay null."""
    boxed = with_quantiles(df, cols, [q])
    clipped = {
        c: F.when(F.col(c).isNotNull(), F.least(F.col(c).cast("double"), F.get(F.col("_q")[c], F.lit(0)))) for c in cols
    }
    return boxed.withColumns(clipped).drop("_q")


def impute_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    boxed = with_quantiles(df, cols, [0.5])
    filled = {c: F.coalesce(F.col(c).cast("double"), F.get(F.col("_q")[c], F.lit(0))) for c in cols}
    return boxed.withColumns(filled).drop("_q")


def negative_totals(lines: DataFrame, products: DataFrame) -> DataFrame:
    totals = lines.groupBy("product_code").agg(F.sum("value").alias("total_value_spent"))
    return (
        totals.filter(F.col("total_value_spent") < 0)
        .join(products.select("product_code", "product_details"), "product_code")
        .select("product_code", "product_details", "total_value_spent")
    )


def suspicious_lines(lines: DataFrame, products: DataFrame, qty: int = 72, value: float = 100) -> DataFrame:
    flagged = lines.filter((F.col("qty") == qty) | (F.col("value") > value))
    return flagged.join(products.select("product_code", "product_details"), "product_code").select(
        "receipt_line_id", "receipt_id", "product_code", "product_details", "qty", "value"
    )


def duplicates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("occurrences"))
    return counted.filter(F.col("occurrences") > 1)


def backfill_from_lines(
    wide: DataFrame, lines: DataFrame, key: str, category: str, wanted: str, amount: str, out: str
) -> DataFrame:
    """Add a column the summary table lacks, summed from the line table, 0 where absent."""
    spend = lines.filter(F.col(category) == wanted).groupBy(key).agg(F.sum(amount).alias(out))
    return wide.drop(out).join(spend, key, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def split_drift(df: DataFrame, cols: Sequence[str], split: str, splits: Sequence[str]) -> DataFrame:
    """Mean and standard deviation of each feature per split; constant features are left out."""
    long = []
    for c in cols:
        value = F.col(c).cast("double")
        long += [
            F.struct(
                F.min(value).alias("lo"),
                F.max(value).alias("hi"),
                *[F.avg(F.when(F.col(split) == s, value)).alias(f"mean_{s}") for s in splits],
                *[F.stddev_samp(F.when(F.col(split) == s, value)).alias(f"std_{s}") for s in splits],
            ).alias(c)
        ]
    fields = [f"mean_{s}" for s in splits] + [f"std_{s}" for s in splits]
    row = df.filter(F.col(split).isin(list(splits))).agg(*long)
    cells = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(c)["lo"].alias("lo"),
            F.col(c)["hi"].alias("hi"),
            *[F.col(c)[f].alias(f) for f in fields],
        )
        for c in cols
    ]
    out = row.select(F.inline(F.array(*cells)))
    return out.filter(F.col("lo") < F.col("hi")).drop("lo", "hi")
