"""Base tables and the logical tables the analytics read.

Each logical table is a lazily planned projection or aggregation of the given
parquet tables; nothing is collected and nothing is cached here.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillmark.functions import scalars as S
from tillmark.session import apply_defaults

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "labels", "embeddings", "pages", "benchmark", "conversations",
)

MONEY = "decimal(18,2)"
SENTINEL_PRICE = 9999999
CATEGORIES = ["click", "error", "purchase", "signup", "view"]
EPOCH = dt.date(2024, 1, 1)
BANK_REFERENCE = dt.date(2001, 8, 1)

# Population, disposable income and weekly grocery spend by region.
REGION_REFERENCE = [
    ("Nottingham", 329276, 15434, "184.66"),
    ("Birmingham", 1166049, 16950, "157.34"),
    ("London", 8945309, 32330, "153.12"),
]


def literal_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """Small in-line table. Spark knows its size, so its own broadcast threshold applies to it."""
    columns = {name: [row[i] for row in rows] for i, name in enumerate(names)}
    return spark.createDataFrame(pa.table(columns))


def region_reference(spark: SparkSession) -> DataFrame:
    """Three-row reference table with declared types."""
    rows = literal_table(spark, REGION_REFERENCE, ["region", "population", "disposable_income", "spend"])
    return rows.select(
        "region", F.col("population").cast("int").alias("population"),
        F.col("disposable_income").cast("int").alias("disposable_income"),
        F.col("spend").cast("decimal(10,2)").alias("grocery_spending"),
    )


class Tables:
    """Access to one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = apply_defaults(spark)
        self.folder = folder.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # ---- retail star -----------------------------------------------------
    @cached_property
    def receipts(self) -> DataFrame:
        return self.base("orders").select(
            F.col("o_orderkey").alias("receipt_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").alias("purchased_at"),
            (F.col("o_orderkey") % 4).cast("int").alias("store_code"),
        )

    @cached_property
    def raw_receipts(self) -> DataFrame:
        """Receipts with planted unknown customers (null and -1)."""
        unknown = (
            F.when(F.col("receipt_id") % 53 == 0, F.lit(None))
            .when(F.col("receipt_id") % 59 == 0, F.lit(-1))
            .otherwise(F.col("customer_id"))
        )
        return self.receipts.withColumn("customer_id", unknown.cast("bigint"))

    @cached_property
    def lines(self) -> DataFrame:
        return self.base("lineitem").select(
            F.col("l_orderkey").alias("receipt_id"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("receipt_line_id"),
            F.col("l_partkey").alias("product_code"),
            F.col("l_quantity").cast("int").alias("qty"),
            F.col("l_extendedprice").cast(MONEY).alias("value"),
        )

    @cached_property
    def dirty_lines(self) -> DataFrame:
        """Lines with planted sentinel prices, null quantities and negative values."""
        price = F.col("l_extendedprice").cast(MONEY)
        return self.base("lineitem").select(
            F.col("l_orderkey").alias("receipt_id"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("receipt_line_id"),
            F.col("l_partkey").alias("product_code"),
            F.when(F.col("l_suppkey") % 37 != 0, F.col("l_quantity").cast("int")).alias("qty"),
            F.when((F.col("l_partkey") % 97 == 0) & (F.col("l_linenumber") == 1), F.lit(SENTINEL_PRICE).cast(MONEY))
            .when(F.col("l_returnflag") == "R", -price)
            .otherwise(price)
            .cast(MONEY)
            .alias("value"),
        )

    @cached_property
    def products(self) -> DataFrame:
        return self.base("part").select(
            F.col("p_partkey").alias("product_code"),
            F.col("p_name").alias("product_details"),
            F.col("p_type").alias("department_name"),
            F.col("p_brand").alias("category_code"),
        )

    @cached_property
    def customers(self) -> DataFrame:
        return self.base("customer").select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_mktsegment").alias("first"),
            F.concat(F.lit("L"), (F.col("c_custkey") % 1000).cast("string")).alias("last"),
            F.date_add(F.lit(dt.date(1940, 1, 1)), ((F.col("c_custkey") * 37) % 20000).cast("int")).alias("dob"),
        )

    @cached_property
    def stores(self) -> DataFrame:
        return self.base("region").select(
            F.col("r_regionkey").alias("store_code"), F.col("r_name").alias("address")
        )

    @cached_property
    def regions(self) -> DataFrame:
        return region_reference(self.spark)

    # ---- baskets ---------------------------------------------------------
    @cached_property
    def baskets(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        return self.base("events").select(
            F.col("user_id").alias("customer_number"),
            F.col("event_id").alias("basket_id"),
            F.col("ts").alias("purchase_time"),
            F.col("event_type").alias("category"),
            k.alias("basket_quantity"),
            F.col("value").cast(MONEY).alias("basket_spend"),
            (k % 5 + 1).alias("basket_categories"),
        )

    @cached_property
    def bank(self) -> DataFrame:
        """One row per customer with contact history and the outcome flag `y`."""
        cutoff = BANK_REFERENCE - dt.timedelta(days=90)
        before = F.col("o_orderdate") < F.lit(cutoff)
        history = self.base("orders").groupBy(F.col("o_custkey").alias("customer_id")).agg(
            F.count_if(before).alias("campaign"),
            F.max(F.when(before, F.to_date("o_orderdate"))).alias("last_contact"),
            F.max_by("o_orderstatus", F.when(before, F.struct("o_orderdate", "o_orderkey"))).alias("poutcome"),
            F.max((~before).cast("int")).alias("y"),
        )
        people = self.base("customer").select(
            F.col("c_custkey").alias("customer_id"),
            F.floor(
                F.datediff(
                    F.lit(BANK_REFERENCE),
                    F.date_add(F.lit(dt.date(1940, 1, 1)), ((F.col("c_custkey") * 37) % 20000).cast("int")),
                ) / 365.25
            ).alias("age"),
            F.col("c_acctbal").alias("balance"),
            F.col("c_mktsegment").alias("job"),
        )
        return people.join(history, "customer_id", "left").select(
            "customer_id", "age", "balance", "job",
            F.coalesce("campaign", F.lit(0)).alias("campaign"),
            F.coalesce(F.datediff(F.lit(cutoff), "last_contact"), F.lit(-1)).alias("pdays"),
            F.coalesce("poutcome", F.lit("unknown")).alias("poutcome"),
            F.coalesce("y", F.lit(0)).alias("y"),
        )

    @cached_property
    def scored(self) -> DataFrame:
        """One scored row per order: a deterministic score and a related label."""
        s = (F.col("o_custkey") * 7919 + F.col("o_orderkey") * 13) % 1000
        return self.base("orders").select(
            F.col("o_orderkey").alias("row_id"),
            (s / F.lit(1000.0)).alias("score"),
            (((F.col("o_orderkey") * 104729) % 1000) * 10 < 2000 + 6 * s).cast("int").alias("label"),
        )

    # ---- market series ---------------------------------------------------
    @cached_property
    def bars(self) -> DataFrame:
        """One row per entity and day, so a busy entity never exceeds its calendar."""
        from tillmark.plans.market import daily_bars

        return daily_bars(
            self.base("events"), entity="user_id", ts="ts", price="value", tiebreak="event_id"
        ).withColumn("ticker", F.concat(F.lit("T"), (F.col("entity_id") % 7).cast("string")))

    @cached_property
    def company_metadata(self) -> DataFrame:
        """One row per entity seen in the events, named after its customer row."""
        ratings = list(S.CREDIT_RATING_RANKS) + ["NR"]
        pick = F.element_at(F.array(*[F.lit(r) for r in ratings]), (F.col("c_custkey") % len(ratings) + 1).cast("int"))
        return self.base("customer").select(
            F.col("c_custkey").alias("SP_ENTITY_ID"),
            F.col("c_name").alias("SP_ENTITY_NAME"),
            F.concat(F.lit("T"), (F.col("c_custkey") % 7).cast("string")).alias("SP_TICKER"),
            pick.alias("RD_CREDIT_RATING_GLOBAL"),
            F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal").cast(MONEY)).alias("SP_COMMON_DIV_DECLARED"),
        )

    @cached_property
    def periodic(self) -> DataFrame:
        """Long metric table: entity, ten-day period end, metric, value."""
        block = F.floor(F.datediff("ts", F.lit(EPOCH)) / 10)
        wide = self.base("events").groupBy(F.col("user_id").alias("entity_id"), block.alias("block")).agg(
            F.sum(F.col("value").cast(MONEY)).cast("double").alias("sum_value"),
            F.count(F.lit(1)).cast("double").alias("n_events"),
        )
        long = wide.unpivot(["entity_id", "block"], ["sum_value", "n_events"], "metric", "value")
        return long.select(
            "entity_id",
            F.date_add(F.lit(EPOCH), (F.col("block") * 10 + 9).cast("int")).alias("period_end"),
            "metric",
            "value",
        )

    @cached_property
    def macro(self) -> DataFrame:
        """Daily series with every third day missing."""
        day = F.to_date("ts")
        daily = self.base("events").filter(F.col("event_type") == "error").groupBy(day.alias("date")).agg(
            S.ratio(F.sum(F.col("value").cast(MONEY)), F.count(F.lit(1))).alias("spread")
        )
        return daily.filter(F.datediff("date", F.lit(EPOCH)) % 3 != 2)

    # ---- campaigns and posts ---------------------------------------------
    @cached_property
    def lift_responses(self) -> DataFrame:
        return self.base("events").select(
            F.col("event_type").alias("campaign_name"),
            F.concat(F.lit("M"), (F.col("user_id") % 4).cast("string")).alias("market"),
            F.concat(F.lit("C"), (F.col("user_id") % 3).cast("string")).alias("channel"),
            F.when(F.col("event_id") % 2 == 0, "control").otherwise("exposed").alias("arm"),
            (F.col("value") > F.when(F.col("event_id") % 2 == 0, 45.0).otherwise(35.0)).cast("int").alias("considered"),
        )

    @cached_property
    def campaign_history(self) -> DataFrame:
        """Spend, reach and conversions per campaign, market and channel."""
        responses = self.base("events").select(
            F.col("event_type").alias("campaign_name"),
            F.concat(F.lit("M"), (F.col("user_id") % 4).cast("string")).alias("market"),
            F.concat(F.lit("C"), (F.col("user_id") % 3).cast("string")).alias("channel"),
            F.col("value").cast(MONEY).alias("spend"),
            (F.get_json_object("props", "$.k").cast("int") >= 80).alias("converted"),
        )
        return responses.groupBy("campaign_name", "market", "channel").agg(
            F.sum("spend").alias("spend"),
            F.count(F.lit(1)).alias("reach"),
            F.count_if("converted").alias("conversions"),
        )

    @cached_property
    def posts(self) -> DataFrame:
        return self.base("documents").select(
            F.col("doc_id").alias("post_id"),
            "text",
            F.col("source").alias("brand"),
            F.col("lang").alias("country"),
            F.date_add(F.lit(EPOCH), (F.col("doc_id") % 60).cast("int")).alias("created_on"),
            (F.col("n_chars") % 101).alias("engagement"),
        )
