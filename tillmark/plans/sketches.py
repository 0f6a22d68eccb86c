"""Mergeable states per store and month: distinct customers and spend quantiles without rescanning facts.

One row of sketches stands for all receipts of a store in a month. Rows of any months and stores merge to a roll-up, and
a late month is one more row; nothing that was summed up before is read again. Customers are counted by HyperLogLog
(standard error 1.04 / sqrt(2^precision)), spends by a KLL sketch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRECISION = 14  # standard error 0.8 %


def sketches(receipts: DataFrame, by: Sequence[str], ts: str, customer: str, amount: str, precision: int = PRECISION) -> DataFrame:
    """(by, month, receipts, customers, spends): one row of states for each group and calendar month."""
    return receipts.groupBy(*by, F.trunc(ts, "MM").alias("month")).agg(
        F.count(F.lit(1)).alias("receipts"), F.hll_sketch_agg(customer, precision).alias("customers"),
        F.kll_sketch_agg_double(F.col(amount).cast("double")).alias("spends"))


def rolled_up(states: DataFrame, by: Sequence[str] = (), quantiles: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """Receipts, distinct customers and spend quantiles of any union of states, from the states alone."""
    merged = states.groupBy(*by).agg(
        F.sum("receipts").alias("receipts"), F.hll_sketch_estimate(F.hll_union_agg("customers")).alias("customers"),
        F.kll_merge_agg_double("spends").alias("_spends"))
    return merged.select(*by, "receipts", "customers", *[
        F.kll_sketch_get_quantile_double("_spends", F.lit(float(q))).alias(f"spend_p{round(100 * q)}") for q in quantiles])


def add_months(path: str, states: DataFrame) -> None:
    """Store the states of some months, replacing those months only; others keep their files."""
    states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
