"""Churn feature queries; the check SQL follows the range-join form."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import functions as F

from tillmark.catalog.base import define, query
from tillmark.operators import intervals, stats
from tillmark.operators import quality as Q
from tillmark.operators.timegrid import Grid, lookback
from tillmark.plans import churn as C
from tillmark.plans.models import materialize

GRID = Grid(dt.date(1998, 1, 1), 14, 7)
CUTOFFS = {"train": dt.date(1998, 2, 20), "val": dt.date(1998, 3, 13)}


def retail(t) -> C.Retail:
    return C.Retail(t.receipts, t.lines, t.products, t.customers, GRID)


IN30 = "r.purchased_at BETWEEN g.prediction_date - INTERVAL 30 DAY AND g.prediction_date - INTERVAL 1 DAY"
D = "strftime(prediction_date, '%Y-%m-%d') AS prediction_date"

define("w0", f"SELECT g.prediction_date, r.* FROM grid g JOIN receipts r ON {IN30}", ("grid", "receipts"))
define("w0l", "SELECT w0.*, l.value, l.qty, l.product_code FROM w0 JOIN lines l ON w0.receipt_id = l.receipt_id", ("w0", "lines"))
define("w0p", "SELECT w0l.*, p.department_name, p.category_code FROM w0l JOIN products p ON w0l.product_code = p.product_code", ("w0l", "products"))
define("f_visits", "SELECT prediction_date, customer_id, count(DISTINCT receipt_id) AS visits_30days FROM w0 GROUP BY 1, 2", ("w0",))
define("f_spend", """SELECT prediction_date, customer_id, CAST(sum(value) AS DOUBLE) AS total_spend_30days,
    CAST((2 * CAST(sum(value) * 100 AS BIGINT) + count(DISTINCT receipt_id)) // (2 * count(DISTINCT receipt_id)) AS DOUBLE) / 100 AS avg_basket_value,
    CAST((200 * CAST(sum(qty) AS BIGINT) + count(DISTINCT receipt_id)) // (2 * count(DISTINCT receipt_id)) AS DOUBLE) / 100 AS avg_items_per_visit
    FROM w0l GROUP BY 1, 2""", ("w0l",))
define("f_since", """SELECT g.prediction_date, r.customer_id, min(datediff('day', r.purchased_at, g.prediction_date)) AS days_since_last_visit
    FROM grid g JOIN receipts r ON r.purchased_at < g.prediction_date GROUP BY 1, 2""", ("grid", "receipts"))
define("f_gaps", """SELECT prediction_date, customer_id, datediff('day', p, d) AS gap FROM (SELECT prediction_date, customer_id,
    CAST(purchased_at AS DATE) AS d, lag(CAST(purchased_at AS DATE)) OVER (PARTITION BY prediction_date, customer_id ORDER BY purchased_at) AS p
    FROM w0) x WHERE p IS NOT NULL""", ("w0",))
define("f_gapstats", """SELECT prediction_date, customer_id, quantile_disc(gap, 0.5) AS median_days_between_visits,
    max(gap) AS max_days_between_visits FROM f_gaps GROUP BY 1, 2""", ("f_gaps",))
define("f_dept", """SELECT prediction_date, customer_id, department_name AS most_common_department FROM (SELECT *, row_number() OVER (
    PARTITION BY prediction_date, customer_id ORDER BY total_items DESC, department_name) AS k FROM (
    SELECT prediction_date, customer_id, department_name, sum(qty) AS total_items FROM w0p GROUP BY 1, 2, 3) y) x WHERE k = 1""", ("w0p",))
define("f_cat", "SELECT prediction_date, customer_id, count(DISTINCT category_code) AS unique_categories_30days FROM w0p GROUP BY 1, 2", ("w0p",))
define("f_age", """SELECT g.prediction_date, c.customer_id, CAST(floor(datediff('day', c.dob, g.prediction_date) / 365.25) AS BIGINT) AS customer_age
    FROM grid g, customers c WHERE c.dob IS NOT NULL""", ("grid", "customers"))
define("f_weekend", """SELECT prediction_date, customer_id, CAST((20000 * count(*) FILTER (dayofweek(purchased_at) IN (0, 6)) + count(DISTINCT receipt_id))
    // (2 * count(DISTINCT receipt_id)) AS DOUBLE) / 100 AS shop_weekend_pct FROM w0 GROUP BY 1, 2""", ("w0",))
define("f_habit", f"""SELECT g.prediction_date, r.customer_id, CASE WHEN count(DISTINCT CASE WHEN r.purchased_at BETWEEN
    g.prediction_date - INTERVAL 60 DAY AND g.prediction_date - INTERVAL 31 DAY THEN r.receipt_id END) >= 3
    AND count(DISTINCT CASE WHEN {IN30} THEN r.receipt_id END) = 0 THEN 1 ELSE 0 END AS habitual_then_stopped
    FROM grid g JOIN receipts r ON r.purchased_at BETWEEN g.prediction_date - INTERVAL 60 DAY AND g.prediction_date - INTERVAL 1 DAY
    GROUP BY 1, 2""", ("grid", "receipts"))
for name, hi, lo in (("lag1", 60, 30), ("lag2", 90, 60)):
    define(f"f_{name}", f"""SELECT g.prediction_date, r.customer_id, count(DISTINCT r.receipt_id) AS visits_{name}_30days,
        CAST(sum(l.value) AS DOUBLE) AS total_spend_{name}_30days, count(DISTINCT p.category_code) AS unique_categories_{name}_30days,
        CAST(sum(l.value) AS DOUBLE) / count(DISTINCT r.receipt_id) AS avg_basket_value_{name}_30days
        FROM grid g JOIN receipts r ON r.purchased_at > g.prediction_date - INTERVAL {hi} DAY AND r.purchased_at <= g.prediction_date - INTERVAL {lo} DAY
        JOIN lines l ON r.receipt_id = l.receipt_id JOIN products p ON l.product_code = p.product_code GROUP BY 1, 2""",
        ("grid", "receipts", "lines", "products"))
define("f_label", """SELECT a.prediction_date, a.customer_id, CASE WHEN min(r.purchased_at) IS NULL THEN 1 ELSE 0 END AS churned
    FROM (SELECT DISTINCT r.customer_id, g.prediction_date FROM grid g JOIN receipts r ON r.purchased_at < g.prediction_date) a
    LEFT JOIN receipts r ON a.customer_id = r.customer_id AND r.purchased_at > a.prediction_date
    AND r.purchased_at <= a.prediction_date + INTERVAL 28 DAY GROUP BY 1, 2""", ("grid", "receipts"))
USING = " ".join(f"LEFT JOIN {f} USING (prediction_date, customer_id)" for f in
                 ("f_spend", "f_since", "f_gapstats", "f_dept", "f_cat", "f_age", "f_weekend", "f_habit"))
FEATURES = ", ".join(C.BASE_FEATURES)
define("featured", f"SELECT prediction_date, customer_id, {FEATURES} FROM f_visits {USING}",
       ("f_visits", "f_spend", "f_since", "f_gapstats", "f_dept", "f_cat", "f_age", "f_weekend", "f_habit"))
define("enriched", """SELECT * FROM featured LEFT JOIN f_lag1 USING (prediction_date, customer_id)
    LEFT JOIN f_lag2 USING (prediction_date, customer_id) LEFT JOIN f_label USING (prediction_date, customer_id)""",
       ("featured", "f_lag1", "f_lag2", "f_label"))
define("deltas", """SELECT *, visits_30days - visits_lag1_30days AS delta_visits,
    total_spend_30days - total_spend_lag1_30days AS delta_total_spend,
    unique_categories_30days - unique_categories_lag1_30days AS delta_unique_categories,
    avg_basket_value - avg_basket_value_lag1_30days AS delta_avg_basket_value FROM enriched""", ("enriched",))
define("split_data", """SELECT *, CASE WHEN prediction_date < DATE '1998-02-20' THEN 'train' WHEN prediction_date < DATE '1998-03-13' THEN 'val'
    ELSE 'test' END AS data_split FROM deltas""", ("deltas",))


def dated(table: str, cols: str = "* EXCLUDE (prediction_date)") -> str:
    return f"SELECT {D}, {cols} FROM {table}"


@query("prediction_dates", "grid receipts", f"""SELECT {D}, count(r.receipt_id) AS receipts_in_window FROM grid g
    LEFT JOIN receipts r ON {IN30} GROUP BY g.prediction_date""")
def _(t):
    from tillmark.operators.timegrid import prediction_grid

    counted = C.recent(t.receipts, GRID).groupBy("prediction_date").agg(F.count(F.lit(1)).alias("receipts_in_window"))
    return prediction_grid(t.spark, GRID).join(counted, "prediction_date", "left").na.fill({"receipts_in_window": 0})


@query("range_join_windows", "w0", f"SELECT {D}, customer_id, receipt_id FROM w0")
def _(t):
    return C.recent(t.receipts, GRID).select("prediction_date", "customer_id", "receipt_id")


@query("range_join_half_open", "grid receipts", f"""SELECT {D}, customer_id, receipt_id FROM grid g JOIN receipts r
    ON r.purchased_at > g.prediction_date - INTERVAL 60 DAY AND r.purchased_at <= g.prediction_date - INTERVAL 30 DAY""")
def _(t):
    return lookback(t.receipts, GRID, "purchased_at", 60, 30, closed="right").select("prediction_date", "customer_id", "receipt_id")


@query("visits_30days", "f_visits", dated("f_visits"))
def _(t):
    return C.visits_30days(retail(t))


@query("total_spend_30days", "f_spend", dated("f_spend", "customer_id, total_spend_30days"))
def _(t):
    return C.total_spend_30days(retail(t))


@query("days_since_last_visit", "f_since", dated("f_since"))
def _(t):
    return C.days_since_last_visit(retail(t))


@query("avg_basket_value", "f_spend", dated("f_spend", "customer_id, avg_basket_value"))
def _(t):
    return C.avg_basket_value(retail(t))


@query("visit_gaps_30d", "f_gaps", dated("f_gaps", "customer_id, gap AS days_between_visits"))
def _(t):
    return C.visit_gaps(retail(t))


@query("median_days_between_visits", "f_gapstats", dated("f_gapstats", "customer_id, median_days_between_visits"))
def _(t):
    return C.visit_gap_stats(retail(t)).drop("max_days_between_visits")


@query("max_days_between_visits", "f_gapstats", dated("f_gapstats", "customer_id, max_days_between_visits"))
def _(t):
    return C.visit_gap_stats(retail(t)).drop("median_days_between_visits")


@query("most_common_department", "f_dept", dated("f_dept"))
def _(t):
    return C.most_common_department(retail(t))


@query("avg_items_per_visit", "f_spend", dated("f_spend", "customer_id, avg_items_per_visit"))
def _(t):
    return C.avg_items_per_visit(retail(t))


@query("unique_categories_30days", "f_cat", dated("f_cat"))
def _(t):
    return C.unique_categories_30days(retail(t))


@query("customer_age_grid", "f_age", dated("f_age"))
def _(t):
    return C.customer_age(retail(t))


@query("shop_weekend_pct", "f_weekend", dated("f_weekend"))
def _(t):
    return C.shop_weekend_pct(retail(t))


@query("habitual_then_stopped", "f_habit", dated("f_habit"))
def _(t):
    return C.habitual_then_stopped(retail(t))


@query("lag1_features", "f_lag1", dated("f_lag1"))
def _(t):
    return C.lag_features(retail(t), 60, 30, "lag1")


@query("lag2_features", "f_lag2", dated("f_lag2"))
def _(t):
    return C.lag_features(retail(t), 90, 60, "lag2")


@query("active_customers_grid", "grid receipts", f"""SELECT {D}, customer_id FROM (SELECT DISTINCT r.customer_id, g.prediction_date
    FROM grid g JOIN receipts r ON r.purchased_at < g.prediction_date) x""")
def _(t):
    return C.active_grid(t.receipts, GRID)


@query("churn_labels", "f_label", dated("f_label"))
def _(t):
    return C.churn_labels(t.receipts, GRID)


@query("featured_table", "featured", dated("featured"))
def _(t):
    return C.featured_table(retail(t))


@query("enriched_featured_table", "enriched", dated("enriched"))
def _(t):
    return C.enriched_table(retail(t))


DELTAS = "customer_id, delta_visits, round(delta_total_spend, 2) AS delta_total_spend, delta_unique_categories, round(delta_avg_basket_value, 4) AS delta_avg_basket_value"


@query("delta_features", "deltas", dated("deltas", DELTAS))
def _(t):
    df = C.with_deltas(C.enriched_table(retail(t)))
    return df.select(
        *C.KEYS, "delta_visits", F.round("delta_total_spend", 2).alias("delta_total_spend"), "delta_unique_categories",
        F.round("delta_avg_basket_value", 4).alias("delta_avg_basket_value"),
    )


@query("temporal_split", "split_data", dated("split_data", "customer_id, visits_30days, churned, data_split"))
def _(t):
    return C.split_table(retail(t), CUTOFFS).select(*C.KEYS, "visits_30days", "churned", "data_split")


@query("split_counts", "split_data", """SELECT data_split, churned, count(*) AS n,
    count(*) FILTER (visits_lag1_30days IS NULL) AS null_lag1 FROM split_data GROUP BY 1, 2""")
def _(t):
    return C.split_counts(C.split_table(retail(t), CUTOFFS))


@query("impute_constants", "deltas", dated("deltas", """customer_id, COALESCE(median_days_between_visits, 30) AS median_days_between_visits,
    COALESCE(max_days_between_visits, 30) AS max_days_between_visits, COALESCE(most_common_department, 'Unknown') AS most_common_department,
    COALESCE(visits_lag1_30days, 0) AS visits_lag1_30days, COALESCE(total_spend_lag2_30days, 0.0) AS total_spend_lag2_30days,
    COALESCE(delta_visits, 0) AS delta_visits"""))
def _(t):
    df = C.impute(C.with_deltas(C.enriched_table(retail(t))))
    return df.select(
        *C.KEYS, "median_days_between_visits", "max_days_between_visits", "most_common_department",
        "visits_lag1_30days", "total_spend_lag2_30days", "delta_visits",
    )


GROUP_COLS = ["visits_30days", "total_spend_30days", "days_since_last_visit", "avg_items_per_visit", "shop_weekend_pct"]


@query("churn_group_comparison", "enriched", " UNION ALL ".join(f"""SELECT '{c}' AS feature, round(avg({c}) FILTER (churned = 1), 6) AS churned,
    round(avg({c}) FILTER (churned = 0), 6) AS retained, round(avg({c}) FILTER (churned = 1) - avg({c}) FILTER (churned = 0), 6) AS difference
    FROM enriched""" for c in GROUP_COLS))
def _(t):
    out = stats.group_difference(C.enriched_table(retail(t)), GROUP_COLS, "churned", ("retained", "churned"))
    # group_difference reads the flag column while naming its outputs after the groups
    return out.withColumns({c: F.round(c, 6) for c in ("churned", "retained", "difference")})


@query("split_drift", "split_data", " UNION ALL ".join(f"""SELECT '{c}' AS feature, round(avg({c}) FILTER (data_split = 'val'), 6) AS mean_val,
    round(avg({c}) FILTER (data_split = 'test'), 6) AS mean_test, round(stddev_samp({c}) FILTER (data_split = 'val'), 6) AS std_val,
    round(stddev_samp({c}) FILTER (data_split = 'test'), 6) AS std_test FROM split_data""" for c in GROUP_COLS))
def _(t):
    df = C.split_table(retail(t), CUTOFFS).withColumn("constant", F.lit(1))
    out = Q.split_drift(df, [*GROUP_COLS, "constant"], "data_split", ["val", "test"])
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c != "feature"})


DRIFT_SPLITS = "data_split IN ('val', 'test')"


@query("drift_histograms", "split_data", " UNION ALL ".join(f"""SELECT '{c}' AS feature, data_split,
    CAST(CASE WHEN hi > lo THEN least(floor((CAST({c} AS DOUBLE) - lo) * 10 / (hi - lo)), 9) ELSE 0 END AS BIGINT) AS bin, count(*) AS n
    FROM split_data, (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM split_data WHERE {DRIFT_SPLITS})
    WHERE {DRIFT_SPLITS} AND {c} IS NOT NULL GROUP BY 1, 2, 3""" for c in GROUP_COLS))
def _(t):
    both = materialize(C.split_table(retail(t), CUTOFFS).filter(DRIFT_SPLITS).select("data_split", *GROUP_COLS))
    parts = [stats.histogram(both, c, 10, ["data_split"]).select(F.lit(c).alias("feature"), "data_split", "bin", "n") for c in GROUP_COLS]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("customer_last_purchase", "receipts", """SELECT customer_id, strftime(max(purchased_at), '%Y-%m-%d %H:%M:%S') AS last_purchase_date
    FROM receipts GROUP BY 1""")
def _(t):
    return C.customer_last_purchase(t.receipts)


@query("purchase_history", "raw_receipts", """SELECT customer_id, strftime(purchased_at, '%Y-%m-%d') AS purchase_date FROM raw_receipts
    WHERE customer_id IS NOT NULL""")
def _(t):
    return C.purchase_history(t.raw_receipts)


# Windows of any position and length: one per supplier, and now and then a very long one.
define("offers", """SELECT s_suppkey AS offer_id, s_nationkey AS nation, DATE '1995-01-01' + CAST(s_suppkey * 37 % 2000 AS INTEGER) AS opens,
    DATE '1995-01-01' + CAST(s_suppkey * 37 % 2000 + s_suppkey % 45 + CASE WHEN s_suppkey % 13 = 0 THEN 2000 ELSE 0 END AS INTEGER) AS closes FROM supplier""")


def offers(t):
    first = F.col("s_suppkey") * 37 % 2000
    days = F.col("s_suppkey") % 45 + F.when(F.col("s_suppkey") % 13 == 0, 2000).otherwise(0)
    start = F.lit(dt.date(1995, 1, 1))
    return t.base("supplier").select(
        F.col("s_suppkey").alias("offer_id"), F.col("s_nationkey").alias("nation"),
        F.date_add(start, first.cast("int")).alias("opens"), F.date_add(start, (first + days).cast("int")).alias("closes"))


@query("interval_join_points", "offers receipts", """SELECT offer_id, strftime(opens, '%Y-%m-%d') AS opens, strftime(closes, '%Y-%m-%d') AS closes,
    count(receipt_id) AS receipts, count(DISTINCT customer_id) AS shoppers FROM offers JOIN receipts ON purchased_at >= opens AND purchased_at <= closes GROUP BY 1, 2, 3""")
def _(t):
    return intervals.counts_in_intervals(
        t.receipts, offers(t), "purchased_at", "opens", "closes", ("offer_id",), "receipt_id", "customer_id", ("receipts", "shoppers"))


@query("interval_overlap", "offers", """SELECT a.offer_id, b.offer_id AS other_id, a.nation FROM offers a JOIN offers b
    ON a.nation = b.nation AND a.opens <= b.closes AND b.opens <= a.closes WHERE a.offer_id <> b.offer_id""")
def _(t):
    other = offers(t).withColumnsRenamed({"offer_id": "other_id", "opens": "other_opens", "closes": "other_closes"})
    pairs = intervals.overlapping(offers(t), other, ("opens", "closes"), ("other_opens", "other_closes"), by=("nation",))
    return pairs.where("offer_id <> other_id").select("offer_id", "other_id", "nation")


# Every third purchase is an observation with a date of its own, instead of the common grid.
@query("irregular_churn_labels", "receipts", """SELECT a.receipt_id, a.customer_id, strftime(a.purchased_at, '%Y-%m-%d') AS observed_on,
    count(b.receipt_id) AS purchases_28d, CASE WHEN count(b.receipt_id) = 0 THEN 1 ELSE 0 END AS churned
    FROM receipts a LEFT JOIN receipts b ON a.customer_id = b.customer_id AND b.purchased_at > a.purchased_at
    AND b.purchased_at <= a.purchased_at + INTERVAL 28 DAY WHERE a.receipt_id % 3 = 0 GROUP BY 1, 2, 3""")
def _(t):
    return C.irregular_labels(t.receipts.where("receipt_id % 3 = 0"), t.receipts, 28).select(
        "receipt_id", "customer_id", F.to_date("observed_on").alias("observed_on"), "purchases_28d", "churned")
