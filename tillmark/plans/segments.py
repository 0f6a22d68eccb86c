"""Customer segmentation features, one row per customer."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.functions import scalars as S
from tillmark.operators import chunked
from tillmark.operators.quality import impute_median
from tillmark.operators.reshape import pivot_sum

KEY = "customer_number"
TS = "purchase_time"


def categories_of(baskets: DataFrame, most: int = 1000) -> list[str]:
    """The categories in the data, sorted. They become columns, so more than `most` are refused."""
    found = baskets.select("category").where("category IS NOT NULL").distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} categories cannot become columns")
    return sorted(r[0] for r in found)


def category_quantities(baskets: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    return pivot_sum(baskets, [KEY], "category", categories or categories_of(baskets), "basket_quantity", "QUANTITY_")


def category_spends(baskets: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    return pivot_sum(baskets, [KEY], "category", categories or categories_of(baskets), "basket_spend")


def basket_sums(baskets: DataFrame) -> DataFrame:
    columns = ["basket_quantity", "basket_spend", "basket_categories"]
    return baskets.groupBy(KEY).agg(*[F.sum(c).alias(f"SUM_{c}") for c in columns])


def customer_summary(baskets: DataFrame) -> DataFrame:
    """Baskets, totals and averages per customer."""
    return baskets.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("baskets"),
        F.sum("basket_quantity").alias("total_quantity"),
        F.sum("basket_spend").alias("total_spend"),
        S.ratio(F.sum("basket_quantity"), F.count(F.lit(1))).alias("average_quantity"),
        S.ratio(F.sum("basket_spend"), F.count(F.lit(1))).alias("average_spend"),
    )


def wide_table(*parts: DataFrame, key: str = KEY) -> DataFrame:
    """Inner join of tables with one row per key; sides aggregated on the key need no new exchange."""
    return reduce(lambda a, b: a.join(b, key), parts)


def rollup(wide: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Replace the member columns of each group by their sum."""
    members = [c for cols in groups.values() for c in cols]
    return wide.withColumns({name: S.row_sum([F.col(c) for c in cols]) for name, cols in groups.items()}).drop(*members)


def column_averages(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    row = df.agg(*[S.ratio(F.sum(c), F.count(c)).alias(c) for c in cols])
    return row.unpivot([], [*cols], "category", "average")


def monthly_visits(baskets: DataFrame, unit: str = "month") -> DataFrame:
    """Distinct visit times per period, averaged per customer."""
    per_period = baskets.filter(F.col(KEY).isNotNull()).groupBy(KEY, F.trunc(TS, unit).alias("period")).agg(
        F.countDistinct(TS).alias("visits")
    )
    return per_period.groupBy(KEY).agg(S.ratio(F.sum("visits"), F.count(F.lit(1))).alias("avg_visits_monthly"))


def basket_ratios(summary: DataFrame) -> DataFrame:
    return summary.select(
        KEY,
        S.safe_ratio(F.col("total_spend"), F.col("total_quantity")).alias("avg_spend_per_item"),
        S.safe_ratio(F.col("total_spend"), F.col("baskets")).alias("avg_basket_spend"),
        S.safe_ratio(F.col("total_quantity"), F.col("baskets")).alias("avg_item_count"),
    )


def largest_share(spends: str, k: int = 3) -> Column:
    """Share of the k largest values of an array in their sum."""
    zero = F.lit(0).cast("decimal(28,2)")

    def total(values):
        return F.aggregate(values, zero, lambda a, x: (a + x).cast("decimal(28,2)"))

    return S.safe_ratio(total(F.slice(F.sort_array(spends, asc=False), 1, k)), total(F.col(spends)))


def spend_concentration(baskets: DataFrame, k: int = 3) -> DataFrame:
    """Share of spend in the customer's k largest categories, whatever categories there are."""
    spends = baskets.groupBy(KEY, "category").agg(F.coalesce(F.sum("basket_spend"), F.lit(0)).alias("spend"))
    return spends.groupBy(KEY).agg(F.collect_list("spend").alias("spends")).select(
        KEY, largest_share("spends", k).alias("spend_concentration"))


def recency(baskets: DataFrame) -> DataFrame:
    """Whole days between each customer's last purchase and the newest one of all."""
    newest = baskets.agg(F.max(TS)).scalar()
    last = baskets.groupBy(KEY).agg(F.max(TS).alias("last"))
    return last.select(KEY, S.elapsed_days(F.col("last"), newest).alias("recency_last_purchase"))


def time_shares(baskets: DataFrame) -> DataFrame:
    weekend, morning = S.is_weekend(F.col(TS)), S.is_morning(F.col(TS))
    return baskets.groupBy(KEY).agg(
        S.ratio(F.count_if(weekend), F.count(F.lit(1))).alias("weekend_shopper"),
        S.ratio(F.count_if(morning), F.count(F.lit(1))).alias("morning_shopper"),
    )


def category_specialization(baskets: DataFrame) -> DataFrame:
    return baskets.groupBy(KEY).agg(
        S.ratio(F.sum("basket_categories"), F.count("basket_categories")).alias("category_specialization")
    )


def mean_visit_gap(baskets: DataFrame, chunk_days: float = 1.0) -> DataFrame:
    """Mean whole days between consecutive visits; null for a single visit."""
    pairs = chunked.neighbour(
        baskets.select(KEY, TS, "basket_id"), [KEY], TS, TS, "previous", chunk_days, tiebreak=["basket_id"]
    )
    gap = S.elapsed_days(F.col("previous"), F.col(TS))
    return pairs.groupBy(KEY).agg(S.ratio(F.sum(gap), F.count(gap)).alias("churn_risk"))


def rfm(baskets: DataFrame) -> DataFrame:
    """Recency, frequency, monetary value and the engineered features in one table.

    Everything that is a plain aggregate of the baskets comes from one pass;
    visits per period and visit gaps need a step of their own.
    """
    newest = baskets.agg(F.max(TS)).scalar()
    per_category = baskets.groupBy(KEY, "category").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("basket_quantity").alias("_quantity"),
        F.sum("basket_spend").alias("_spend"),
        F.max(TS).alias("_last"),
        F.count_if(S.is_weekend(F.col(TS))).alias("_weekend"),
        F.count_if(S.is_morning(F.col(TS))).alias("_morning"),
        F.sum("basket_categories").alias("_categories"),
        F.count("basket_categories").alias("_counted"),
    )
    n, quantity, spend = F.sum("_n"), F.sum("_quantity"), F.sum("_spend")
    base = per_category.groupBy(KEY).agg(
        n.alias("frequency"),
        spend.cast("double").alias("monetary"),
        F.max("_last").alias("_last"),
        S.ratio(F.sum("_weekend"), n).alias("weekend_shopper"),
        S.ratio(F.sum("_morning"), n).alias("morning_shopper"),
        S.ratio(F.sum("_categories"), F.sum("_counted")).alias("category_specialization"),
        S.safe_ratio(spend, quantity).alias("avg_spend_per_item"),
        S.safe_ratio(spend, n).alias("avg_basket_spend"),
        S.safe_ratio(quantity, n).alias("avg_item_count"),
        F.collect_list(F.coalesce("_spend", F.lit(0))).alias("_spends"),
    )
    base = base.withColumns(
        {
            "recency_last_purchase": S.elapsed_days(F.col("_last"), newest),
            "spend_concentration": largest_share("_spends"),
        }
    ).drop("_last", "_spends")
    table = base.join(monthly_visits(baskets), KEY, "left").join(mean_visit_gap(baskets), KEY, "left")
    # Recency and category counts exist for every customer with a basket; a single visit leaves no gap.
    return impute_median(table, ["churn_risk"]).withColumn(
        "recency_last_purchase", F.col("recency_last_purchase").cast("double")
    )


def log_minmax(df: DataFrame, cols: Sequence[str], log: bool = True) -> DataFrame:
    """log1p and scale to [0, 1]; a constant column becomes 0."""
    values = {c: (F.log1p(F.col(c).cast("double")) if log else F.col(c).cast("double")) for c in cols}
    logged = df.withColumns(values)
    bounds = logged.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in cols])
    boxed = logged.withColumn("_b", bounds.select(F.struct(*cols)).scalar())

    def scaled(c: str):
        lo, hi = F.col("_b")[c]["lo"], F.col("_b")[c]["hi"]
        return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.when(F.col(c).isNotNull(), 0.0))

    return boxed.withColumns({c: scaled(c) for c in cols}).drop("_b")
