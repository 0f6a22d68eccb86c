"""Churn features per (prediction date, customer).

Lines are summed per receipt before receipts are expanded over the overlapping
windows. Every feature ends in one aggregation on (prediction_date,
customer_id); partial aggregation absorbs a customer with very many receipts.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.functions import scalars as S
from tillmark.functions.scalars import DAY_MICROS
from tillmark.operators import chunked, intervals
from tillmark.operators.timegrid import Grid, expand, in_window, lookahead, lookback, since, split_by_date

KEYS = ["prediction_date", "customer_id"]
TS = "purchased_at"

# Defaults for missing features before training.
IMPUTATION = {
    "visits_30days": 0,
    "total_spend_30days": 0.0,
    "avg_basket_value": 0.0,
    "median_days_between_visits": 30,
    "max_days_between_visits": 30,
    "most_common_department": "Unknown",
    "avg_items_per_visit": 0.0,
    "unique_categories_30days": 0,
    "shop_weekend_pct": 0.0,
    "habitual_then_stopped": 0,
    "visits_lag1_30days": 0,
    "total_spend_lag1_30days": 0.0,
    "unique_categories_lag1_30days": 0,
    "avg_basket_value_lag1_30days": 0.0,
    "visits_lag2_30days": 0,
    "total_spend_lag2_30days": 0.0,
    "unique_categories_lag2_30days": 0,
    "avg_basket_value_lag2_30days": 0.0,
    "delta_visits": 0,
    "delta_total_spend": 0.0,
    "delta_unique_categories": 0,
    "delta_avg_basket_value": 0.0,
}


@dataclass(frozen=True)
class Retail:
    """The four tables the features read, with the grid."""

    receipts: DataFrame
    lines: DataFrame
    products: DataFrame
    customers: DataFrame
    grid: Grid

    @property
    def known(self) -> DataFrame:
        return self.receipts.select("receipt_id", "customer_id", TS)

    @property
    def reachable(self) -> DataFrame:
        """Receipts any window of the grid can reach (90 days back)."""
        start = self.grid.start - dt.timedelta(days=90)
        return self.known.filter((F.col(TS) >= F.lit(start)) & (F.col(TS) < F.lit(self.grid.last)))

    def totals(self) -> DataFrame:
        """Reachable receipts with line sums; receipts without lines drop out."""
        per_receipt = self.lines.groupBy("receipt_id").agg(F.sum("value").alias("spend"), F.sum("qty").alias("items"))
        return self.reachable.join(per_receipt, "receipt_id")

    def line_mix(self) -> DataFrame:
        """Lines of reachable receipts summed by department and category; `known` marks listed products.

        An inner join, so either side may be split where one receipt dominates.
        """
        named = self.products.select("product_code", "department_name", "category_code", F.lit(True).alias("known"))
        lines = self.lines.select("receipt_id", "product_code", "value", "qty")
        joined = lines.join(self.reachable, "receipt_id").join(named, "product_code", "left")
        keys = ["receipt_id", "customer_id", TS, "department_name", "category_code", "known"]
        return joined.groupBy(*keys).agg(F.sum("value").alias("spend"), F.sum("qty").alias("items")).withColumn(
            "known", F.coalesce("known", F.lit(False))
        )

    def product_mix(self) -> DataFrame:
        """Per receipt, department and category: spend and items of known products."""
        return self.line_mix().filter("known").drop("known")


def recent(df: DataFrame, grid: Grid) -> DataFrame:
    """The closed window [d-30, d-1]."""
    return lookback(df, grid, TS, 30, 1)


def visits_30days(r: Retail) -> DataFrame:
    return recent(r.reachable, r.grid).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("visits_30days"))


def total_spend_30days(r: Retail) -> DataFrame:
    return recent(r.totals(), r.grid).groupBy(*KEYS).agg(F.sum("spend").cast("double").alias("total_spend_30days"))


def avg_basket_value(r: Retail) -> DataFrame:
    return recent(r.totals(), r.grid).groupBy(*KEYS).agg(
        S.rounded_ratio(F.sum("spend"), F.count(F.lit(1))).alias("avg_basket_value")
    )


def avg_items_per_visit(r: Retail) -> DataFrame:
    return recent(r.totals(), r.grid).groupBy(*KEYS).agg(
        S.rounded_ratio(F.sum("items"), F.count(F.lit(1))).alias("avg_items_per_visit")
    )


def days_since_last_visit(r: Retail) -> DataFrame:
    """Calendar days since the latest purchase before each date, over the whole history.

    Receipts shrink to one row per customer and first following date before they
    are spread over the later dates.
    """
    grid = r.grid
    step = F.greatest(grid.first_after(F.col(TS), 0), F.lit(0)).cast("int")
    before = r.known.filter(F.col(TS) < F.lit(grid.last))
    per_step = before.groupBy("customer_id", step.alias("k")).agg(F.max(TS).alias("last_seen"))
    spread = expand(per_step, grid, F.col("k"), F.lit(grid.n - 1))
    return spread.groupBy(*KEYS).agg(F.max("last_seen").alias("last_seen")).select(
        *KEYS, F.datediff("prediction_date", "last_seen").alias("days_since_last_visit")
    )


def visit_gaps(r: Retail) -> DataFrame:
    """Days between consecutive visits that both lie in the window of a date.

    The previous visit is found once per receipt; a pair belongs to the dates
    whose window holds both ends.
    """
    grid = r.grid
    near = r.reachable.filter(F.col(TS) >= F.lit(grid.start - dt.timedelta(days=30)))
    pairs = chunked.neighbour(near, ["customer_id"], TS, TS, "previous_at", days=7, tiebreak=["receipt_id"])
    pairs = pairs.filter(F.col("previous_at").isNotNull())
    first, last = grid.first_at_or_after(F.col(TS), 1), grid.last_at_or_before(F.col("previous_at"), 30)
    return expand(pairs, grid, first, last).select(
        *KEYS, F.datediff(TS, "previous_at").alias("days_between_visits")
    )


def visit_gap_stats(r: Retail) -> DataFrame:
    return visit_gaps(r).groupBy(*KEYS).agg(
        F.percentile_approx("days_between_visits", 0.5).alias("median_days_between_visits"),
        F.max("days_between_visits").alias("max_days_between_visits"),
    )


def most_common_department(r: Retail) -> DataFrame:
    """Department with most items; equal counts go to the first name."""
    items = (
        recent(r.product_mix().filter(F.col("department_name").isNotNull()), r.grid)
        .groupBy(*KEYS, "department_name")
        .agg(F.sum("items").alias("items"))
    )
    best = F.min_by("department_name", F.struct(-F.col("items"), F.col("department_name")))
    return items.groupBy(*KEYS).agg(best.alias("most_common_department"))


def unique_categories_30days(r: Retail) -> DataFrame:
    pairs = r.product_mix().filter(F.col("category_code").isNotNull())
    return recent(pairs, r.grid).groupBy(*KEYS).agg(F.countDistinct("category_code").alias("unique_categories_30days"))


def customer_age(r: Retail) -> DataFrame:
    """Age of every customer at every date; each customer is expanded over the grid dates."""
    people = r.customers.filter(F.col("dob").isNotNull()).select("customer_id", "dob")
    dated = expand(people, r.grid, F.lit(0), F.lit(r.grid.n - 1))
    return dated.select(
        *KEYS, F.floor(F.datediff("prediction_date", "dob") / 365.25).cast("bigint").alias("customer_age")
    )


def shop_weekend_pct(r: Retail) -> DataFrame:
    weekend = S.is_weekend(F.col(TS)).cast("int")
    return recent(r.reachable, r.grid).groupBy(*KEYS).agg(
        S.rounded_ratio(100 * F.sum(weekend), F.count(F.lit(1))).alias("shop_weekend_pct")
    )


def habitual_then_stopped(r: Retail, visits: int = 3) -> DataFrame:
    seen = lookback(r.reachable, r.grid, TS, 60, 1)
    ts, d = F.col(TS), F.col("prediction_date")
    earlier, later = F.count_if(in_window(ts, d, 60, 31)), F.count_if(in_window(ts, d, 30, 1))
    return seen.groupBy(*KEYS).agg(((earlier >= visits) & (later == 0)).cast("int").alias("habitual_then_stopped"))


def lag_features(r: Retail, hi: int, lo: int, name: str) -> DataFrame:
    """Visits, spend, categories and basket value over (d-hi, d-lo]; known products only."""
    seen = lookback(r.product_mix(), r.grid, TS, hi, lo, closed="right")
    per_receipt = seen.groupBy(*KEYS, "receipt_id").agg(F.sum("spend").alias("spend"))
    visits = per_receipt.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum("spend").alias("s"))
    categories = seen.groupBy(*KEYS).agg(F.countDistinct("category_code").alias(f"unique_categories_{name}_30days"))
    return visits.join(categories, KEYS).select(
        *KEYS,
        F.col("n").alias(f"visits_{name}_30days"),
        F.col("s").cast("double").alias(f"total_spend_{name}_30days"),
        f"unique_categories_{name}_30days",
        S.ratio(F.col("s"), F.col("n")).alias(f"avg_basket_value_{name}_30days"),
    )


def active_grid(receipts: DataFrame, grid: Grid) -> DataFrame:
    """(customer, date) for every date after the customer's first purchase."""
    first = receipts.groupBy("customer_id").agg(F.min(TS).alias(TS))
    return since(first, grid, TS).select("customer_id", "prediction_date")


def churn_labels(receipts: DataFrame, grid: Grid, horizon_days: int = 28) -> DataFrame:
    """1 where an active customer buys nothing in (d, d + horizon]; one aggregation, no join."""
    active = active_grid(receipts, grid).withColumn("future", F.lit(0))
    known = receipts.filter(F.col("customer_id").isNotNull())  # an unknown customer never returns
    coming = lookahead(known.select("customer_id", TS), grid, TS, horizon_days)
    coming = coming.select("customer_id", "prediction_date", F.lit(1).alias("future"))
    merged = active.unionByName(coming).groupBy(*KEYS).agg(
        F.min("future").alias("only_future"), (1 - F.max("future")).alias("churned")
    )
    return merged.filter(F.col("only_future") == 0).select(*KEYS, "churned")


def irregular_labels(observed: DataFrame, receipts: DataFrame, horizon_days: int = 28) -> DataFrame:
    """Labels at dates of any kind: purchases in (observed_on, observed_on + horizon] of each observed receipt's customer."""
    dated = observed.select("receipt_id", "customer_id", F.col(TS).alias("observed_on")).withColumn(
        "until", F.expr(f"observed_on + INTERVAL {horizon_days} DAYS"))
    later = receipts.select("customer_id", F.col(TS).alias("later_at"))
    out = intervals.interval_totals(
        later, dated, "later_at", "observed_on", "until", ("receipt_id",), {f"purchases_{horizon_days}d": F.count(F.lit(1))},
        by=("customer_id",), closed="right", width=float(horizon_days * DAY_MICROS))
    count = F.coalesce(f"purchases_{horizon_days}d", F.lit(0))
    return out.select("receipt_id", "customer_id", "observed_on", count.alias(f"purchases_{horizon_days}d"),
                      (count == 0).cast("int").alias("churned"))


# ---- the assembled table ----------------------------------------------------
PANE = ["_day", "_opens"]


def paned(df: DataFrame) -> DataFrame:
    """With the pane of each row: a day, or its first instant, which alone lies on the bounds of windows.

    All bounds are midnights, so every window of every date is a union of panes, and a sum over a window is a sum of
    sums over its panes.
    """
    day = F.to_date(TS)
    return df.withColumn("_day", day).withColumn("_opens", F.col(TS) == day.cast("timestamp_ntz"))


def reachable_lines(r: Retail) -> DataFrame:
    """Lines of receipts that some window can reach, with their products; others are left before anything is summed."""
    named = r.products.select("product_code", "department_name", "category_code", F.lit(True).alias("known"))
    lines = r.lines.select("receipt_id", "product_code", "value", "qty").join(r.reachable, "receipt_id")
    return lines.join(named, "product_code", "left")


def receipt_panes(r: Retail) -> DataFrame:
    """Per customer and pane: receipts, those with lines and with known products, and their sums."""
    sums = reachable_lines(r).groupBy("receipt_id").agg(
        F.sum("value").alias("spend"), F.sum("qty").alias("items"), F.sum(F.when(F.col("known"), F.col("value"))).alias("known_spend"),
        F.max("known").alias("known"))
    joined = paned(r.reachable.join(sums, "receipt_id", "left"))
    return joined.groupBy("customer_id", *PANE).agg(
        F.max(TS).alias(TS), F.count(F.lit(1)).alias("visits"), F.count("spend").alias("with_lines"),
        F.count_if(S.is_weekend(F.col(TS))).alias("weekend"), F.count("known").alias("known"),
        *[F.sum(c).alias(c) for c in ("spend", "items", "known_spend")])


def product_panes(r: Retail) -> DataFrame:
    """Per customer, pane, department and category: items of listed products."""
    lines = reachable_lines(r).where("known")
    return paned(lines).groupBy("customer_id", *PANE, "department_name", "category_code").agg(
        F.max(TS).alias(TS), F.sum("qty").alias("items"))


ROWS_PER_TASK = 20_000  # of both kinds of panes, before dates: a row takes some 13 KB of sums by date and key


def dealt_by_customer(panes: DataFrame, r: Retail) -> DataFrame:
    """Panes by customer, in so many parts that the sums of one stay small however large the tables are.

    The parts multiply by dates only after the shuffle, so its size says too little. The rows are estimated from the counts
    of receipts and lines and the share of receipts that a window can reach. Few rows are left to Spark's own setting.
    """
    receipts, reachable = r.receipts.count(), r.reachable.count()
    rows = reachable + r.lines.count() * reachable // max(receipts, 1)
    parts = -(-rows // ROWS_PER_TASK)
    own = int(panes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return panes.repartition("customer_id") if rows <= 2 * ROWS_PER_TASK else panes.repartition(max(parts, own), "customer_id")


def feature_block(r: Retail, with_lags: bool) -> DataFrame:
    """All features that need lines, from sums over shared panes.

    Lines become one row per customer, pane, department and category, and receipts one per customer and pane, before
    anything is multiplied by dates; so a customer never has more rows than the calendar allows. These rows are dealt
    out by customer once, and the expansion to dates, the sums per key and the fold to (date, customer) stay there.
    """
    both = receipt_panes(r).withColumn("kind", F.lit("r")).unionByName(
        product_panes(r).withColumn("kind", F.lit("p")), allowMissingColumns=True).drop(*PANE)
    seen = lookback(dealt_by_customer(both, r), r.grid, TS, 90 if with_lags else 60, 0, closed="left")
    ts, d = F.col(TS), F.col("prediction_date")
    now = in_window(ts, d, 30, 1)
    lags = {}
    if with_lags:
        lags = {"lag1": in_window(ts, d, 60, 30, "right"), "lag2": in_window(ts, d, 90, 60, "right")}
    # Departments and categories count inside the feature windows only.
    rows = seen.filter((F.col("kind") == "r") | reduce(lambda a, b: a | b, [now, *lags.values()]))
    keys = F.when(F.col("kind") == "r", F.array(F.struct(F.lit("r").alias("kind"), F.lit("").alias("key")))).otherwise(F.array(
        F.struct(F.lit("d").alias("kind"), F.col("department_name").alias("key")),
        F.struct(F.lit("c").alias("kind"), F.col("category_code").alias("key"))))
    rows = rows.withColumn("_u", F.explode(keys)).filter("_u.key IS NOT NULL")
    summed = ["visits", "with_lines", "weekend", "spend", "items"]
    per_key = rows.groupBy(*KEYS, F.col("_u.kind").alias("kind"), F.col("_u.key").alias("key")).agg(
        F.max(TS).alias("seen"),
        F.bool_or(now).alias("now"),
        F.sum(F.when(in_window(ts, d, 60, 31), F.col("visits"))).alias("earlier"),
        *[F.sum(F.when(now, F.col(c))).alias(c) for c in summed],
        *[F.bool_or(w).alias(name) for name, w in lags.items()],
        *[F.sum(F.when(w, F.col(c))).alias(f"{c}_{name}") for name, w in lags.items() for c in ("known", "known_spend")],
    )
    receipt, department, category = (F.col("kind") == k for k in "rdc")

    def of_receipts(c: str) -> Column:
        return F.sum(F.when(receipt, F.col(c)))

    n_lines, visits = F.coalesce(of_receipts("with_lines"), F.lit(0)), F.coalesce(of_receipts("visits"), F.lit(0))
    spend, items = of_receipts("spend"), of_receipts("items")
    rank = F.struct(-F.coalesce("items", F.lit(0)), F.col("key"))
    n_categories = F.count_if(category & F.col("now"))
    measures = [
        visits.alias("visits_30days"),
        spend.cast("double").alias("total_spend_30days"),
        F.datediff("prediction_date", F.max("seen")).alias("days_since_last_visit"),
        S.rounded_ratio(spend, n_lines).alias("avg_basket_value"),
        F.min_by("key", F.when(department & F.col("now"), rank)).alias("most_common_department"),
        S.rounded_ratio(items, n_lines).alias("avg_items_per_visit"),
        F.when(n_categories > 0, n_categories).alias("unique_categories_30days"),
        S.rounded_ratio(100 * of_receipts("weekend"), visits).alias("shop_weekend_pct"),
        ((F.coalesce(of_receipts("earlier"), F.lit(0)) >= 3) & (visits == 0)).cast("int").alias("habitual_then_stopped"),
    ]
    for name in lags:
        n, s = of_receipts(f"known_{name}"), of_receipts(f"known_spend_{name}")
        measures += [
            F.when(n > 0, n).alias(f"visits_{name}_30days"),
            F.when(n > 0, s.cast("double")).alias(f"total_spend_{name}_30days"),
            F.when(n > 0, F.count_if(category & F.col(name))).alias(f"unique_categories_{name}_30days"),
            F.when(n > 0, S.ratio(s, n)).alias(f"avg_basket_value_{name}_30days"),
        ]
    return per_key.groupBy(*KEYS).agg(*measures).filter(F.col("visits_30days") > 0)


BASE_FEATURES = [
    "visits_30days", "total_spend_30days", "days_since_last_visit", "avg_basket_value",
    "median_days_between_visits", "max_days_between_visits", "most_common_department", "avg_items_per_visit",
    "unique_categories_30days", "customer_age", "shop_weekend_pct", "habitual_then_stopped",
]


def featured_table(r: Retail, with_lags: bool = False) -> DataFrame:
    """The grid of recent visitors with all features."""
    block = feature_block(r, with_lags)
    ages = r.customers.filter(F.col("dob").isNotNull()).select("customer_id", "dob")
    table = block.join(visit_gap_stats(r), KEYS, "left").join(ages, "customer_id", "left")
    age = F.floor(F.datediff("prediction_date", "dob") / 365.25).cast("bigint")
    lags = [c for c in block.columns if "_lag" in c]
    return table.withColumn("customer_age", age).select(*KEYS, *BASE_FEATURES, *lags)


def enriched_table(r: Retail, horizon_days: int = 28) -> DataFrame:
    labels = churn_labels(r.receipts, r.grid, horizon_days)
    return featured_table(r, with_lags=True).join(labels, KEYS, "left")


def with_deltas(df: DataFrame) -> DataFrame:
    """Current window minus the window before; null where the earlier one is missing."""
    pairs = {
        "delta_visits": ("visits_30days", "visits_lag1_30days"),
        "delta_total_spend": ("total_spend_30days", "total_spend_lag1_30days"),
        "delta_unique_categories": ("unique_categories_30days", "unique_categories_lag1_30days"),
        "delta_avg_basket_value": ("avg_basket_value", "avg_basket_value_lag1_30days"),
    }
    return df.withColumns({name: F.col(a) - F.col(b) for name, (a, b) in pairs.items()})


def split_table(r: Retail, cutoffs: dict[str, dt.date], last: str = "test", horizon_days: int = 28) -> DataFrame:
    return split_by_date(with_deltas(enriched_table(r, horizon_days)), "prediction_date", cutoffs, last)


def impute(df: DataFrame, values: dict = IMPUTATION) -> DataFrame:
    """Constant defaults by column; columns absent from the frame are ignored."""
    return df.na.fill({c: v for c, v in values.items() if c in df.columns})


def joined_features(r: Retail) -> DataFrame:
    """The same table as `featured_table`, written as one left join per feature (used by tests)."""
    parts = [
        total_spend_30days(r), days_since_last_visit(r), avg_basket_value(r), visit_gap_stats(r),
        most_common_department(r), avg_items_per_visit(r), unique_categories_30days(r), customer_age(r),
        shop_weekend_pct(r), habitual_then_stopped(r),
    ]
    table = reduce(lambda a, b: a.join(b, KEYS, "left"), parts, visits_30days(r))
    return table.select(*KEYS, *BASE_FEATURES)


def customer_last_purchase(receipts: DataFrame) -> DataFrame:
    return receipts.groupBy("customer_id").agg(F.max(TS).alias("last_purchase_date"))


def purchase_history(receipts: DataFrame) -> DataFrame:
    known = receipts.filter(F.col("customer_id").isNotNull())
    return known.select("customer_id", F.to_date(TS).alias("purchase_date")).orderBy("customer_id", "purchase_date")


def split_counts(df: DataFrame, split: str = "data_split", label: str = "churned") -> DataFrame:
    return df.groupBy(split, label).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("visits_lag1_30days").isNull()).alias("null_lag1")
    )
