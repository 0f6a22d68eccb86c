"""Retail KPI queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tillmark.catalog.base import define, query
from tillmark.operators import chunked
from tillmark.plans import retail as R
from tillmark.plans import sketches
from tillmark.sources import files

START, END, CUTOFF = dt.date(2000, 1, 1), dt.date(2000, 12, 31), dt.date(2000, 12, 31)
STAGES = ["view", "click", "signup", "purchase"]

define("fl", """SELECT customer_id, store_code, min(purchased_at) AS first_purchase_date,
    max(purchased_at) AS last_purchase_date, count(*) AS n FROM receipts GROUP BY 1, 2""", ("receipts",))
define("joined", """SELECT r.*, l.receipt_line_id, l.product_code, l.qty, l.value FROM receipts r
    JOIN lines l ON r.receipt_id = l.receipt_id""", ("receipts", "lines"))
define("cust_spend", """SELECT store_code, customer_id, sum(value) AS total_spent, count(*) AS n_lines,
    count(DISTINCT receipt_id) AS n_receipts FROM joined GROUP BY 1, 2""", ("joined",))
define("store_regions", """SELECT store_code, CASE WHEN store_code = 0 THEN 'Nottingham' WHEN store_code = 1 THEN 'Birmingham'
    WHEN store_code IN (2, 3) THEN 'London' END AS region FROM stores""", ("stores",))


@query("monthly_revenue", "joined", """SELECT strftime(date_trunc('month', purchased_at), '%Y-%m-%d') AS month, store_code,
    CAST(sum(value) AS DOUBLE) AS revenue FROM joined GROUP BY 1, 2""")
def _(t):
    return R.monthly_revenue(t.receipts, t.lines)


@query("valid_customers", "raw_receipts", """SELECT receipt_id, customer_id, store_code FROM raw_receipts
    WHERE customer_id IS NOT NULL AND customer_id <> -1""")
def _(t):
    return R.valid_customers(t.raw_receipts).select("receipt_id", "customer_id", "store_code")


@query("yearly_customers_by_store", "raw_receipts", """SELECT year(purchased_at) AS year, store_code,
    count(DISTINCT customer_id) AS total_customers FROM raw_receipts
    WHERE customer_id IS NOT NULL AND customer_id <> -1 GROUP BY 1, 2""")
def _(t):
    return R.yearly_customers(t.raw_receipts)


@query("distinct_products_per_store", "joined",
       "SELECT store_code, count(DISTINCT product_code) AS product_count FROM joined GROUP BY 1")
def _(t):
    return R.distinct_products(t.receipts, t.lines)


@query("department_breadth", "products", """SELECT department_name, count(DISTINCT category_code) AS n_categories,
    count(DISTINCT product_code) AS n_products FROM products GROUP BY 1""")
def _(t):
    return R.department_breadth(t.products)


@query("assortment_counts", "products", """SELECT count(DISTINCT department_name) AS n_departments,
    count(DISTINCT category_code) AS n_categories, count(DISTINCT product_code) AS n_products FROM products""")
def _(t):
    return R.assortment_counts(t.products)


@query("product_totals", "lines", """SELECT product_code, CAST(sum(qty) AS BIGINT) AS total_quantity_sold,
    CAST(sum(value) AS DOUBLE) AS total_value_spent FROM lines GROUP BY 1""")
def _(t):
    return R.product_totals(t.lines)


@query("top_products_by_value", "lines", """SELECT product_code, CAST(sum(qty) AS BIGINT) AS total_quantity_sold,
    CAST(sum(value) AS DOUBLE) AS total_value_spent FROM lines GROUP BY 1
    ORDER BY sum(value) DESC, product_code LIMIT 10""")
def _(t):
    return R.top_products(t.lines)


@query("receipts_per_customer", "receipts",
       "SELECT customer_id, count(DISTINCT receipt_id) AS unique_receipts FROM receipts GROUP BY 1")
def _(t):
    return R.receipts_per_customer(t.receipts)


@query("shoppers_per_store", "receipts",
       "SELECT store_code, count(DISTINCT customer_id) AS unique_shoppers FROM receipts GROUP BY 1")
def _(t):
    return R.shoppers_per_store(t.receipts)


@query("receipts_per_store", "receipts", "SELECT store_code, count(receipt_id) AS receipt_count FROM receipts GROUP BY 1")
def _(t):
    return R.receipts_per_store(t.receipts)


@query("dataset_span", "receipts", """SELECT strftime(min(purchased_at), '%Y-%m-%d %H:%M:%S') AS min_date,
    strftime(max(purchased_at), '%Y-%m-%d %H:%M:%S') AS max_date,
    datediff('day', min(purchased_at), max(purchased_at)) AS span_days FROM receipts""")
def _(t):
    return R.dataset_span(t.receipts)


@query("repeat_receipt_count", "raw_receipts",
       "SELECT count(customer_id) - count(DISTINCT customer_id) AS repeat_customer_count FROM raw_receipts")
def _(t):
    return R.repeat_receipt_count(t.raw_receipts)


@query("multi_store_customers", "receipts", """SELECT customer_id, count(DISTINCT store_code) AS n_stores FROM receipts
    GROUP BY 1 HAVING count(DISTINCT store_code) > 1""")
def _(t):
    return R.multi_store_customers(t.receipts)


@query("customer_spend_leaderboard", "customers joined", """SELECT c.customer_id, c."first", c."last",
    count(DISTINCT j.receipt_id) AS total_visits, CAST(sum(j.value) AS DOUBLE) AS total_value_spent
    FROM customers c JOIN joined j ON c.customer_id = j.customer_id GROUP BY 1, 2, 3""")
def _(t):
    return R.spend_leaderboard(t.customers, t.receipts, t.lines)


@query("active_customers", "receipts", """SELECT store_code, count(DISTINCT customer_id) AS active_customers FROM receipts
    WHERE purchased_at BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2000-12-31' GROUP BY 1""")
def _(t):
    return R.active_customers(t.receipts, START, END)


@query("active_repeat_customers", "receipts", """SELECT store_code, count(DISTINCT customer_id) AS active_repeat_customers
    FROM (SELECT customer_id, store_code, count(*) AS n FROM receipts
          WHERE purchased_at BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2000-12-31' GROUP BY 1, 2) s
    WHERE n > 1 GROUP BY 1""")
def _(t):
    return R.active_repeat_customers(t.receipts, START, END)


@query("repeat_customers", "receipts fl", """SELECT DISTINCT r.customer_id, r.store_code FROM receipts r JOIN fl
    ON r.customer_id = fl.customer_id AND r.store_code = fl.store_code AND r.purchased_at > fl.first_purchase_date""")
def _(t):
    return R.repeat_customers(t.receipts)


@query("retention_rate", "receipts fl", """SELECT fl.store_code,
    CAST(count(rc.customer_id) * 100 AS DOUBLE) / count(fl.customer_id) AS retention_rate
    FROM fl LEFT JOIN (SELECT DISTINCT r.customer_id, r.store_code FROM receipts r JOIN fl ON r.customer_id = fl.customer_id
        AND r.store_code = fl.store_code AND r.purchased_at > fl.first_purchase_date) rc
    ON fl.customer_id = rc.customer_id AND fl.store_code = rc.store_code GROUP BY 1""")
def _(t):
    return R.retention(t.receipts)


@query("customer_lifetime_value", "cust_spend", """SELECT store_code,
    CAST(sum(total_spent) AS DOUBLE) / count(*) AS avg_customer_lifetime_value FROM cust_spend GROUP BY 1""")
def _(t):
    return R.lifetime_value(t.receipts, t.lines)


CHURN = "CAST(count(CASE WHEN last_purchase_date < DATE '2000-12-31' THEN 1 END) * 100 AS DOUBLE) / count(*) AS churn_rate"


@query("churn_rate", "fl", f"SELECT store_code, {CHURN} FROM fl GROUP BY 1")
def _(t):
    return R.churn_rate(t.receipts, CUTOFF)


@query("single_visit_rate", "fl", """SELECT store_code,
    CAST(count(*) FILTER (n = 1) * 100 AS DOUBLE) / count(*) AS single_visit_rate FROM fl GROUP BY 1""")
def _(t):
    return R.single_visit_rate(t.receipts)


@query("churn_rate_by_month", "fl", f"""SELECT store_code, month(last_purchase_date) AS last_purchase_month, {CHURN}
    FROM fl GROUP BY 1, 2""")
def _(t):
    return R.churn_rate_by_month(t.receipts, CUTOFF)


@query("churn_rate_by_year_month", "fl", f"""SELECT store_code,
    strftime(date_trunc('month', last_purchase_date), '%Y-%m-%d') AS last_purchase_month, {CHURN} FROM fl GROUP BY 1, 2""")
def _(t):
    return R.churn_rate_by_month(t.receipts, CUTOFF, with_year=True)


@query("high_low_value_by_receipt", "receipts joined", """SELECT r.store_code,
    count(DISTINCT CASE WHEN total_spent >= 100000 THEN r.customer_id END) AS high_value_customers,
    count(DISTINCT CASE WHEN total_spent < 100000 THEN r.customer_id END) AS low_value_customers
    FROM receipts r JOIN (SELECT receipt_id, customer_id, sum(value) AS total_spent FROM joined GROUP BY 1, 2) s
    ON r.customer_id = s.customer_id GROUP BY 1""")
def _(t):
    return R.value_split_by_receipt(t.receipts, t.lines, threshold=100000)


@query("high_low_value_customers", "cust_spend", """SELECT store_code,
    count(*) FILTER (total_spent >= 400000) AS high_value_customers,
    count(*) FILTER (total_spent < 400000) AS low_value_customers FROM cust_spend GROUP BY 1""")
def _(t):
    return R.value_split(t.receipts, t.lines, threshold=400000)


@query("receipt_totals", "lines", "SELECT receipt_id, CAST(sum(value) AS DOUBLE) AS total_value FROM lines GROUP BY 1")
def _(t):
    return R.receipt_totals(t.lines)


@query("market_penetration", "receipts store_regions regions", """SELECT sr.region, count(DISTINCT r.customer_id) AS active_customers,
    p.population, CAST(count(DISTINCT r.customer_id) * 100 AS DOUBLE) / p.population AS market_penetration_percentage
    FROM store_regions sr JOIN receipts r ON sr.store_code = r.store_code JOIN regions p ON sr.region = p.region
    GROUP BY sr.region, p.population""")
def _(t):
    return R.market_penetration(t.receipts, t.stores, t.regions)


@query("spend_income_ratio", "cust_spend store_regions regions", """SELECT sr.region,
    CAST(sum(total_spent) AS DOUBLE) / count(*) AS avg_customer_spending, d.disposable_income,
    CAST(sum(total_spent) AS DOUBLE) / count(*) / d.disposable_income AS spending_vs_income_ratio
    FROM store_regions sr JOIN cust_spend c ON sr.store_code = c.store_code JOIN regions d ON sr.region = d.region
    GROUP BY sr.region, d.disposable_income""")
def _(t):
    return R.spend_income_ratio(t.receipts, t.lines, t.stores, t.regions)


@query("store_top_spenders", "cust_spend", """SELECT customer_id, CAST(total_spent AS DOUBLE) AS total_spent,
    n_receipts AS num_receipts FROM cust_spend WHERE store_code = 1 ORDER BY cust_spend.total_spent DESC, customer_id LIMIT 100""")
def _(t):
    return R.store_spenders(t.receipts, t.lines, store=1)


@query("repeat_line_value", "cust_spend", """SELECT customer_id, n_receipts AS visit_count,
    CAST(total_spent AS DOUBLE) / n_lines AS avg_line_value FROM cust_spend WHERE store_code = 1 AND n_receipts > 1
    ORDER BY avg_line_value DESC, customer_id LIMIT 100""")
def _(t):
    return R.repeat_line_value(t.receipts, t.lines, store=1)


@query("product_mix_by_store", "joined", """SELECT product_code, CAST(sum(value) AS DOUBLE) AS total_value FROM joined
    WHERE store_code = 1 GROUP BY 1 ORDER BY sum(value) DESC, product_code LIMIT 20""")
def _(t):
    return R.product_mix(t.receipts, t.lines, store=1)


@query("smoothed_monthly_customers", "raw_receipts", """SELECT strftime(month, '%Y-%m-%d') AS month, store_code, customer_count,
    CAST(sum(customer_count) OVER w AS DOUBLE) / count(*) OVER w AS smoothed_customer_count
    FROM (SELECT date_trunc('month', purchased_at) AS month, store_code, count(DISTINCT customer_id) AS customer_count
          FROM raw_receipts WHERE customer_id IS NOT NULL GROUP BY 1, 2) m
    WINDOW w AS (PARTITION BY store_code ORDER BY month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def _(t):
    return R.monthly_customers(t.raw_receipts)


@query("first_time_purchases", "receipts", """SELECT strftime(date_trunc('month', f), '%Y-%m-%d') AS period,
    count(*) AS new_customers FROM (SELECT customer_id, min(purchased_at) AS f FROM receipts GROUP BY 1) x GROUP BY 1""")
def _(t):
    return R.first_time_purchases(t.receipts)


@query("bounce_rate", "", """WITH g AS (SELECT user_id, ts, event_id, lag(ts) OVER w AS p, lead(ts) OVER w AS n FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT CAST(user_id % 4 AS BIGINT) AS segment, p IS NULL OR epoch_us(ts) - epoch_us(p) > 21600000000 AS starts,
        n IS NULL OR epoch_us(n) - epoch_us(ts) > 21600000000 AS ends FROM g)
    SELECT segment, count(*) FILTER (starts) AS sessions, count(*) FILTER (starts AND ends) AS bounces,
    CAST(count(*) FILTER (starts AND ends) AS DOUBLE) / count(*) FILTER (starts) AS bounce_rate FROM s GROUP BY 1""")
def _(t):
    events = t.base("events").select("user_id", "ts", "event_id", (F.col("user_id") % 4).alias("segment"))
    return chunked.bounce_rate(events, "user_id", "ts", 6 * 3600, by="segment", tiebreak=["event_id"])


@query("journey_funnel", "", """WITH u AS (SELECT user_id, max((event_type = 'view')::INT) AS a, max((event_type = 'click')::INT) AS b,
    max((event_type = 'signup')::INT) AS c, max((event_type = 'purchase')::INT) AS d FROM events GROUP BY 1),
    n AS (SELECT count(*) FILTER (a = 1) AS n1, count(*) FILTER (a = 1 AND b = 1) AS n2,
    count(*) FILTER (a = 1 AND b = 1 AND c = 1) AS n3, count(*) FILTER (a = 1 AND b = 1 AND c = 1 AND d = 1) AS n4 FROM u)
    SELECT 1 AS step, 'view' AS stage, n1 AS users, n1::DOUBLE / n1 AS step_rate FROM n
    UNION ALL SELECT 2, 'click', n2, n2::DOUBLE / n1 FROM n
    UNION ALL SELECT 3, 'signup', n3, n3::DOUBLE / n2 FROM n
    UNION ALL SELECT 4, 'purchase', n4, n4::DOUBLE / n3 FROM n""")
def _(t):
    return R.journey_funnel(t.base("events"), STAGES)


@query("engagement_rate", "", """SELECT CAST(user_id % 4 AS BIGINT) AS segment, count(*) AS n_events,
    CAST(count(*) FILTER (event_type IN ('click', 'signup')) AS DOUBLE) / count(*) AS engagement_rate FROM events GROUP BY 1""")
def _(t):
    events = t.base("events").withColumn("segment", F.col("user_id") % 4)
    return R.engagement_rate(events, ["click", "signup"], "segment")


# The estimates themselves have no exact twin: the query says whether they are within three standard errors of the counts.
@query("sketched_customers", "receipts", """SELECT store_code, count(*) AS receipts, count(DISTINCT customer_id) AS customers, true AS within_bound
    FROM receipts GROUP BY 1""")
def _(t):
    priced = t.receipts.join(t.lines.groupBy("receipt_id").agg(F.sum("value").alias("spend")), "receipt_id", "left")
    path = files.run_folder(t.spark, "sketches")
    sketches.add_months(path, sketches.sketches(priced, ["store_code"], "purchased_at", "customer_id", "spend"))
    rolled = sketches.rolled_up(t.spark.read.parquet(path), ["store_code"]).select("store_code", "receipts", F.col("customers").alias("estimate"))
    exact = t.receipts.groupBy("store_code").agg(F.count_distinct("customer_id").alias("customers"))
    bound = 3 * 1.04 / 2 ** (sketches.PRECISION / 2)
    return rolled.join(exact, "store_code").select(
        "store_code", "receipts", "customers", (F.abs(F.col("estimate") - F.col("customers")) <= bound * F.col("customers") + 1).alias("within_bound"))
