"""Retail KPIs over receipts, receipt lines and their dimensions.

Lines are summed per receipt (or per product) before they meet another table,
so a receipt, product or store that owns a large share of the rows is reduced
on the map side and the joins run one row to one row.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillmark.functions import scalars as S
from tillmark.sources import updates



def receipt_totals(lines: DataFrame, key: str = "receipt_id", value: str = "value") -> DataFrame:
    return lines.groupBy(key).agg(F.sum(value).alias("total_value"))


def with_receipt_totals(receipts: DataFrame, lines: DataFrame) -> DataFrame:
    """Receipts that have lines, each with its total and line count."""
    totals = lines.groupBy("receipt_id").agg(F.sum("value").alias("total_value"), F.count(F.lit(1)).alias("n_lines"))
    return receipts.join(totals, "receipt_id")


def customer_store_spend(receipts: DataFrame, lines: DataFrame, by: str = "store_code") -> DataFrame:
    return with_receipt_totals(receipts, lines).groupBy("customer_id", by).agg(
        F.sum("total_value").alias("total_spent"),
        F.count(F.lit(1)).alias("num_receipts"),
        F.sum("n_lines").alias("num_lines"),
    )


def valid_customers(receipts: DataFrame, customer: str = "customer_id", unknown: int = -1) -> DataFrame:
    return receipts.filter(F.col(customer).isNotNull() & (F.col(customer) != unknown))


def yearly_customers(receipts: DataFrame, by: str = "store_code") -> DataFrame:
    return (
        valid_customers(receipts)
        .groupBy(F.year("purchased_at").alias("year"), by)
        .agg(F.countDistinct("customer_id").alias("total_customers"))
    )


def distinct_products(receipts: DataFrame, lines: DataFrame, by: str = "store_code") -> DataFrame:
    pairs = lines.select("receipt_id", "product_code").distinct()
    return pairs.join(receipts, "receipt_id").groupBy(by).agg(F.countDistinct("product_code").alias("product_count"))


def department_breadth(products: DataFrame) -> DataFrame:
    """Categories and products per department."""
    return products.groupBy("department_name").agg(
        F.countDistinct("category_code").alias("n_categories"),
        F.countDistinct("product_code").alias("n_products"),
    )


def assortment_counts(products: DataFrame) -> DataFrame:
    """Departments, categories and products of the whole assortment."""
    return products.agg(
        F.countDistinct("department_name").alias("n_departments"),
        F.countDistinct("category_code").alias("n_categories"),
        F.countDistinct("product_code").alias("n_products"),
    )


def product_totals(lines: DataFrame) -> DataFrame:
    return lines.groupBy("product_code").agg(
        F.sum("qty").alias("total_quantity_sold"), F.sum("value").alias("total_value_spent")
    )


def top_products(lines: DataFrame, k: int = 10) -> DataFrame:
    return product_totals(lines).orderBy(F.desc("total_value_spent"), "product_code").limit(k)


def receipts_per_customer(receipts: DataFrame) -> DataFrame:
    return receipts.groupBy("customer_id").agg(F.countDistinct("receipt_id").alias("unique_receipts"))


def shoppers_per_store(receipts: DataFrame, by: str = "store_code") -> DataFrame:
    return receipts.groupBy(by).agg(F.countDistinct("customer_id").alias("unique_shoppers"))


def receipts_per_store(receipts: DataFrame, by: str = "store_code") -> DataFrame:
    return receipts.groupBy(by).agg(F.count("receipt_id").alias("receipt_count"))


def dataset_span(receipts: DataFrame) -> DataFrame:
    return receipts.agg(F.min("purchased_at").alias("min_date"), F.max("purchased_at").alias("max_date")).withColumn(
        "span_days", F.datediff("max_date", "min_date")
    )


def repeat_receipt_count(receipts: DataFrame) -> DataFrame:
    """Receipts beyond each customer's first."""
    return receipts.agg((F.count("customer_id") - F.countDistinct("customer_id")).alias("repeat_customer_count"))


def multi_store_customers(receipts: DataFrame, by: str = "store_code") -> DataFrame:
    counted = receipts.groupBy("customer_id").agg(F.countDistinct(by).alias("n_stores"))
    return counted.filter(F.col("n_stores") > 1)


def spend_leaderboard(customers: DataFrame, receipts: DataFrame, lines: DataFrame) -> DataFrame:
    spend = with_receipt_totals(receipts, lines).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_visits"), F.sum("total_value").alias("total_value_spent")
    )
    return (
        customers.select("customer_id", "first", "last")
        .join(spend, "customer_id")
        .orderBy(F.desc("total_value_spent"), "customer_id")
    )


def in_period(receipts: DataFrame, start: dt.date, end: dt.date, ts: str = "purchased_at") -> DataFrame:
    """Closed period whose upper end is midnight of the last day."""
    return receipts.filter(F.col(ts).between(F.lit(start), F.lit(end)))


def active_customers(receipts: DataFrame, start: dt.date, end: dt.date, by: str = "store_code") -> DataFrame:
    period = in_period(receipts, start, end)
    return period.groupBy(by).agg(F.countDistinct("customer_id").alias("active_customers"))


def active_repeat_customers(receipts: DataFrame, start: dt.date, end: dt.date, by: str = "store_code") -> DataFrame:
    visits = in_period(receipts, start, end).groupBy("customer_id", by).agg(F.count(F.lit(1)).alias("n"))
    return visits.filter(F.col("n") > 1).groupBy(by).agg(F.count("customer_id").alias("active_repeat_customers"))


def first_last(receipts: DataFrame, by: str = "store_code") -> DataFrame:
    return receipts.groupBy("customer_id", by).agg(
        F.min("purchased_at").alias("first_purchase"),
        F.max("purchased_at").alias("last_purchase"),
        F.count(F.lit(1)).alias("n_receipts"),
    )


def repeat_customers(receipts: DataFrame, by: str = "store_code") -> DataFrame:
    """Customers who came back to the same store at a later instant."""
    return first_last(receipts, by).filter(F.col("last_purchase") > F.col("first_purchase")).select("customer_id", by)


def retention(receipts: DataFrame, by: str = "store_code") -> DataFrame:
    returned = F.col("last_purchase") > F.col("first_purchase")
    return first_last(receipts, by).groupBy(by).agg(
        S.ratio(F.count_if(returned) * 100, F.count("customer_id")).alias("retention_rate")
    )


def lifetime_value(receipts: DataFrame, lines: DataFrame, by: str = "store_code") -> DataFrame:
    return customer_store_spend(receipts, lines, by).groupBy(by).agg(
        S.ratio(F.sum("total_spent"), F.count(F.lit(1))).alias("avg_customer_lifetime_value")
    )


def churn_share(cutoff: dt.date) -> Column:
    churned = F.col("last_purchase") < F.lit(cutoff)
    return S.ratio(F.count_if(churned) * 100, F.count("customer_id"))


def churn_rate(receipts: DataFrame, cutoff: dt.date, by: str = "store_code") -> DataFrame:
    return first_last(receipts, by).groupBy(by).agg(churn_share(cutoff).alias("churn_rate"))


def single_visit_rate(receipts: DataFrame, by: str = "store_code") -> DataFrame:
    return first_last(receipts, by).groupBy(by).agg(
        S.ratio(F.count_if(F.col("n_receipts") == 1) * 100, F.count("customer_id")).alias("single_visit_rate")
    )


def churn_rate_by_month(
    receipts: DataFrame, cutoff: dt.date, by: str = "store_code", with_year: bool = False
) -> DataFrame:
    """Churn share by month of the last purchase; the plain month ignores the year."""
    last = F.col("last_purchase")
    month = F.trunc(last, "month") if with_year else F.month(last)
    return (
        first_last(receipts, by)
        .groupBy(by, month.alias("last_purchase_month"))
        .agg(churn_share(cutoff).alias("churn_rate"))
    )


def value_split_by_receipt(
    receipts: DataFrame, lines: DataFrame, threshold: float = 50, by: str = "store_code"
) -> DataFrame:
    """Customers of a store with a receipt at or above / below the threshold anywhere; both can hold."""
    flags = with_receipt_totals(receipts, lines).groupBy("customer_id").agg(
        F.bool_or(F.col("total_value") >= threshold).alias("high"),
        F.bool_or(F.col("total_value") < threshold).alias("low"),
    )
    visits = receipts.select("customer_id", by).distinct()
    return visits.join(flags, "customer_id").groupBy(by).agg(
        F.count_if("high").alias("high_value_customers"), F.count_if("low").alias("low_value_customers")
    )


def value_split(receipts: DataFrame, lines: DataFrame, threshold: float = 50, by: str = "store_code") -> DataFrame:
    return customer_store_spend(receipts, lines, by).groupBy(by).agg(
        F.count_if(F.col("total_spent") >= threshold).alias("high_value_customers"),
        F.count_if(F.col("total_spent") < threshold).alias("low_value_customers"),
    )


def region_of(store: Column) -> Column:
    return S.lookup(store.cast("int"), S.STORE_REGIONS)


def market_penetration(receipts: DataFrame, stores: DataFrame, regions: DataFrame) -> DataFrame:
    """Active customers as a percentage of the region's population."""
    visits = receipts.select("customer_id", "store_code").distinct().join(stores.select("store_code"), "store_code")
    active = visits.groupBy(region_of(F.col("store_code")).alias("region")).agg(
        F.countDistinct("customer_id").alias("active_customers")
    )
    return active.join(regions, "region").select(
        "region",
        "active_customers",
        "population",
        S.ratio(F.col("active_customers") * 100, F.col("population")).alias("market_penetration_percentage"),
    )


def spend_income_ratio(receipts: DataFrame, lines: DataFrame, stores: DataFrame, regions: DataFrame) -> DataFrame:
    """Mean spend per customer and store set against disposable income."""
    spend = customer_store_spend(receipts, lines).join(stores.select("store_code"), "store_code")
    by_region = spend.groupBy(region_of(F.col("store_code")).alias("region")).agg(
        S.ratio(F.sum("total_spent"), F.count(F.lit(1))).alias("avg_customer_spending")
    )
    return by_region.join(regions, "region").select(
        "region",
        "avg_customer_spending",
        "disposable_income",
        S.ratio(F.col("avg_customer_spending"), F.col("disposable_income")).alias("spending_vs_income_ratio"),
    )


def store_spenders(receipts: DataFrame, lines: DataFrame, store: int, k: int = 100) -> DataFrame:
    spend = customer_store_spend(receipts.filter(F.col("store_code") == store), lines)
    return (
        spend.select("customer_id", "total_spent", "num_receipts")
        .orderBy(F.desc("total_spent"), "customer_id")
        .limit(k)
    )


def repeat_line_value(receipts: DataFrame, lines: DataFrame, store: int, k: int = 100) -> DataFrame:
    """Repeat customers of a store ranked by their mean line value."""
    spend = customer_store_spend(receipts.filter(F.col("store_code") == store), lines)
    return (
        spend.filter(F.col("num_receipts") > 1)
        .select(
            "customer_id",
            F.col("num_receipts").alias("visit_count"),
            S.ratio(F.col("total_spent"), F.col("num_lines")).alias("avg_line_value"),
        )
        .orderBy(F.desc("avg_line_value"), "customer_id")
        .limit(k)
    )


def product_mix(receipts: DataFrame, lines: DataFrame, store: int, k: int = 20) -> DataFrame:
    per_product = lines.groupBy("receipt_id", "product_code").agg(F.sum("value").alias("value"))
    return (
        per_product.join(receipts.filter(F.col("store_code") == store), "receipt_id")
        .groupBy("product_code")
        .agg(F.sum("value").alias("total_value"))
        .orderBy(F.desc("total_value"), "product_code")
        .limit(k)
    )


def monthly_revenue(receipts: DataFrame, lines: DataFrame, by: str = "store_code") -> DataFrame:
    return (
        with_receipt_totals(receipts, lines)
        .groupBy(F.trunc("purchased_at", "month").alias("month"), by)
        .agg(F.sum("total_value").alias("revenue"))
        .orderBy("month", by)
    )


def monthly_customers(receipts: DataFrame, by: str = "store_code", window: int = 3) -> DataFrame:
    """Distinct customers per month with a centred rolling mean."""
    half = window // 2
    monthly = (
        receipts.filter(F.col("customer_id").isNotNull())
        .groupBy(F.trunc("purchased_at", "month").alias("month"), by)
        .agg(F.countDistinct("customer_id").alias("customer_count"))
    )
    around = Window.partitionBy(by).orderBy("month").rowsBetween(-half, half)
    return monthly.withColumn(
        "smoothed_customer_count",
        S.ratio(F.sum("customer_count").over(around), F.count(F.lit(1)).over(around)),
    )


def first_time_purchases(receipts: DataFrame, unit: str = "month") -> DataFrame:
    """Customers by the period of their first purchase."""
    first = receipts.groupBy("customer_id").agg(F.min("purchased_at").alias("first_purchase"))
    return first.groupBy(F.trunc("first_purchase", unit).alias("period")).agg(F.count(F.lit(1)).alias("new_customers"))


def journey_funnel(events: DataFrame, stages: list[str], user: str = "user_id", stage: str = "event_type") -> DataFrame:
    """Users who reached each stage and all stages before it, with drop-off."""
    reached = events.groupBy(user).agg(
        *[F.max((F.col(stage) == name).cast("int")).alias(f"s{i}") for i, name in enumerate(stages)]
    )
    through = [F.lit(True)]
    for i in range(len(stages)):
        through.append(through[-1] & (F.col(f"s{i}") == 1))
    counts = reached.agg(*[F.count_if(through[i + 1]).alias(f"n{i}") for i in range(len(stages))])
    steps = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("step"),
                F.lit(name).alias("stage"),
                F.col(f"n{i}").alias("users"),
                F.col(f"n{max(i - 1, 0)}").alias("previous_users"),
            )
            for i, name in enumerate(stages)
        ]
    )
    return counts.select(F.inline(steps)).select(
        "step", "stage", "users", S.safe_ratio(F.col("users"), F.col("previous_users")).alias("step_rate")
    )


def engagement_rate(events: DataFrame, interactions: list[str], by: str, kind: str = "event_type") -> DataFrame:
    return events.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_events"),
        S.ratio(F.count_if(F.col(kind).isin(interactions)), F.count(F.lit(1))).alias("engagement_rate"),
    )


def stored_facts(receipts: DataFrame, lines: DataFrame, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Receipts by month and receipt bucket, lines by receipt bucket; reports over them shuffle neither of the two."""
    spark = receipts.sparkSession
    buckets = buckets or updates.bucket_count(lines.count())
    names = (updates.store_bucketed(receipts, "receipts", "receipt_id", buckets, month="purchased_at"),
             updates.store_bucketed(lines, "receipt_lines", "receipt_id", buckets))
    return tuple(spark.table(name) for name in names)


def stored_monthly_revenue(receipts: DataFrame, lines: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """Revenue and receipts per store for months from `first` to `last`, from laid-out facts: months outside are not read."""
    chosen = receipts.where((F.col("month") >= F.lit(first)) & (F.col("month") <= F.lit(last)))
    sums = lines.groupBy("receipt_id").agg(F.sum("value").alias("value"))
    joined = chosen.select("receipt_id", "month", "store_code").join(sums, "receipt_id")
    return joined.groupBy("month", "store_code").agg(F.sum("value").alias("revenue"), F.count(F.lit(1)).alias("receipts"))
