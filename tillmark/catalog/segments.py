"""Segmentation feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillmark.catalog.base import define, query
from tillmark.operators import quality as Q
from tillmark.plans import segments as G
from tillmark.sources.tables import CATEGORIES

GROUPS = {"fresh_foods": ["click", "view"], "processed_foods": ["signup", "purchase"], "non_food_items": ["error"]}
SPEND_SQL = ", ".join(f"COALESCE(sum(basket_spend) FILTER (category = '{c}'), 0) AS {c}" for c in CATEGORIES)
QTY_SQL = ", ".join(
    f"CAST(COALESCE(sum(basket_quantity) FILTER (category = '{c}'), 0) AS BIGINT) AS QUANTITY_{c}" for c in CATEGORIES
)
define("cat_spend", f"SELECT customer_number, {SPEND_SQL} FROM baskets GROUP BY 1", ("baskets",))
define("cat_qty", f"SELECT customer_number, {QTY_SQL} FROM baskets GROUP BY 1", ("baskets",))
define("bsum", """SELECT customer_number, CAST(sum(basket_quantity) AS BIGINT) AS SUM_basket_quantity, CAST(sum(basket_spend) AS DOUBLE) AS SUM_basket_spend,
    CAST(sum(basket_categories) AS BIGINT) AS SUM_basket_categories FROM baskets GROUP BY 1""", ("baskets",))
define("csum", """SELECT customer_number, count(*) AS baskets, CAST(sum(basket_quantity) AS BIGINT) AS total_quantity, CAST(sum(basket_spend) AS DOUBLE) AS total_spend,
    CAST(sum(basket_quantity) AS DOUBLE) / count(*) AS average_quantity, CAST(sum(basket_spend) AS DOUBLE) / count(*) AS average_spend FROM baskets GROUP BY 1""", ("baskets",))
define("g_recency", """SELECT customer_number, (epoch_us((SELECT max(purchase_time) FROM baskets)) - epoch_us(max(purchase_time))) // 86400000000 AS recency_last_purchase
    FROM baskets GROUP BY 1""", ("baskets",))
define("g_share", """SELECT customer_number, CAST(count(*) FILTER (isodow(purchase_time) >= 6) AS DOUBLE) / count(*) AS weekend_shopper,
    CAST(count(*) FILTER (hour(purchase_time) BETWEEN 6 AND 12) AS DOUBLE) / count(*) AS morning_shopper,
    CAST(sum(basket_categories) AS DOUBLE) / count(*) AS category_specialization FROM baskets GROUP BY 1""", ("baskets",))
define("g_gap", """SELECT customer_number, CAST(sum(g) AS DOUBLE) / count(g) AS churn_risk FROM (SELECT customer_number, (epoch_us(purchase_time) -
    epoch_us(lag(purchase_time) OVER (PARTITION BY customer_number ORDER BY purchase_time, basket_id))) // 86400000000 AS g FROM baskets) x GROUP BY 1""", ("baskets",))
define("g_month", """SELECT customer_number, CAST(sum(v) AS DOUBLE) / count(*) AS avg_visits_monthly FROM (SELECT customer_number,
    date_trunc('month', purchase_time) AS m, count(DISTINCT purchase_time) AS v FROM baskets GROUP BY 1, 2) x GROUP BY 1""", ("baskets",))
TOP3 = "(SELECT sum(v) FROM (SELECT unnest([" + ", ".join(CATEGORIES) + "]) AS v ORDER BY v DESC LIMIT 3))"
define("g_conc", f"""SELECT customer_number, CAST({TOP3} AS DOUBLE) / CAST({' + '.join(CATEGORIES)} AS DOUBLE) AS spend_concentration FROM cat_spend""", ("cat_spend",))
DOUBLES = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in CATEGORIES)


def spends(t):
    return G.category_spends(t.baskets)


@query("category_quantity_pivot", "cat_qty", "SELECT * FROM cat_qty")
def _(t):
    return G.category_quantities(t.baskets)


@query("basket_sums", "bsum", "SELECT * FROM bsum")
def _(t):
    return G.basket_sums(t.baskets)


@query("customer_wide_table", "bsum cat_spend cat_qty csum", f"""SELECT bsum.*, {', '.join(f'CAST(s.{c} AS DOUBLE) AS {c}' for c in CATEGORIES)},
    q.* EXCLUDE (customer_number), c.* EXCLUDE (customer_number) FROM bsum JOIN cat_spend s USING (customer_number) JOIN cat_qty q USING (customer_number)
    JOIN csum c USING (customer_number)""")
def _(t):
    return G.wide_table(
        G.basket_sums(t.baskets), spends(t), G.category_quantities(t.baskets), G.customer_summary(t.baskets)
    )


@query("category_rollup", "cat_spend", """SELECT customer_number, CAST(click + view AS DOUBLE) AS fresh_foods, CAST(signup + purchase AS DOUBLE) AS processed_foods,
    CAST(error AS DOUBLE) AS non_food_items FROM cat_spend""")
def _(t):
    return G.rollup(spends(t), GROUPS)


@query("category_averages", "cat_spend", " UNION ALL ".join(
    f"SELECT '{c}' AS category, CAST(sum({c}) AS DOUBLE) / count({c}) AS average FROM cat_spend" for c in CATEGORIES))
def _(t):
    return G.column_averages(wide := spends(t), [c for c in wide.columns if c != G.KEY])


@query("avg_visits_monthly", "g_month", "SELECT * FROM g_month")
def _(t):
    return G.monthly_visits(t.baskets)


@query("basket_ratios", "csum", """SELECT customer_number, CASE WHEN total_quantity = 0 THEN 0.0 ELSE total_spend / total_quantity END AS avg_spend_per_item,
    total_spend / baskets AS avg_basket_spend, CAST(total_quantity AS DOUBLE) / baskets AS avg_item_count FROM csum""")
def _(t):
    return G.basket_ratios(G.customer_summary(t.baskets))


@query("spend_concentration", "g_conc", "SELECT * FROM g_conc")
def _(t):
    return G.spend_concentration(t.baskets)


@query("recency_days", "g_recency", "SELECT * FROM g_recency")
def _(t):
    return G.recency(t.baskets)


@query("weekend_share", "g_share", "SELECT customer_number, weekend_shopper FROM g_share")
def _(t):
    return G.time_shares(t.baskets).drop("morning_shopper")


@query("morning_share", "g_share", "SELECT customer_number, morning_shopper FROM g_share")
def _(t):
    return G.time_shares(t.baskets).drop("weekend_shopper")


@query("category_specialization", "g_share", "SELECT customer_number, category_specialization FROM g_share")
def _(t):
    return G.category_specialization(t.baskets)


@query("visit_gaps", "baskets", """SELECT customer_number, g AS gap_days, count(*) AS n FROM (SELECT customer_number, (epoch_us(purchase_time) -
    epoch_us(lag(purchase_time) OVER (PARTITION BY customer_number ORDER BY purchase_time, basket_id))) // 86400000000 AS g FROM baskets) x
    WHERE g IS NOT NULL GROUP BY 1, 2""")
def _(t):
    from tillmark.functions import scalars as S
    from tillmark.operators import chunked

    pairs = chunked.neighbour(t.baskets, [G.KEY], G.TS, G.TS, "previous", 1.0, tiebreak=["basket_id"])
    gaps = pairs.select(G.KEY, S.elapsed_days(F.col("previous"), F.col(G.TS)).alias("gap_days"))
    return gaps.filter(F.col("gap_days").isNotNull()).groupBy(G.KEY, "gap_days").agg(F.count(F.lit(1)).alias("n"))


@query("mean_visit_gap", "g_gap", "SELECT * FROM g_gap")
def _(t):
    return G.mean_visit_gap(t.baskets)


@query("rfm_features", "csum g_recency g_share g_gap g_month g_conc", """SELECT c.customer_number, baskets AS frequency, total_spend AS monetary,
    CAST(recency_last_purchase AS DOUBLE) AS recency_last_purchase, weekend_shopper, morning_shopper, category_specialization,
    round(COALESCE(churn_risk, (SELECT quantile_cont(churn_risk, 0.5) FROM g_gap)), 9) AS churn_risk, avg_visits_monthly,
    CASE WHEN total_quantity = 0 THEN 0.0 ELSE total_spend / total_quantity END AS avg_spend_per_item, total_spend / baskets AS avg_basket_spend,
    CAST(total_quantity AS DOUBLE) / baskets AS avg_item_count, spend_concentration
    FROM csum c JOIN g_recency USING (customer_number) JOIN g_share USING (customer_number) JOIN g_gap USING (customer_number)
    JOIN g_month USING (customer_number) JOIN g_conc USING (customer_number)""")
def _(t):
    return G.rfm(t.baskets).withColumn("churn_risk", F.round("churn_risk", 9))


SCALED = ["baskets", "total_quantity", "total_spend"]


@query("log_minmax_features", "csum", "WITH l AS (SELECT customer_number, " + ", ".join(f"ln(1 + {c}) AS {c}" for c in SCALED) + " FROM csum) SELECT customer_number, "
    + ", ".join(f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}" for c in SCALED) + " FROM l")
def _(t):
    out = G.log_minmax(G.customer_summary(t.baskets), SCALED)
    return out.select(G.KEY, *[F.round(c, 6).alias(c) for c in SCALED])


@query("drop_negative_category", "cat_spend", "SELECT customer_number, CAST(error - 800 AS DOUBLE) AS lottery FROM cat_spend WHERE error - 800 >= 0")
def _(t):
    # Payouts make a category negative; the level at which that happens is planted here.
    lottery = spends(t).select(G.KEY, (F.col("error") - 800).alias("lottery"))
    return lottery.filter(F.col("lottery") >= 0)


@query("backfill_category_spend", "cat_spend baskets", """SELECT customer_number, CAST(click AS DOUBLE) AS click, CAST(view AS DOUBLE) AS view,
    CAST(COALESCE((SELECT sum(basket_spend) FROM baskets b WHERE b.customer_number = c.customer_number AND category = 'purchase' AND basket_quantity > 90), 0) AS DOUBLE) AS bakery
    FROM cat_spend c""")
def _(t):
    lines = t.baskets.filter(F.col("basket_quantity") > 90)
    return Q.backfill_from_lines(
        spends(t).select(G.KEY, "click", "view"), lines, G.KEY, "category", "purchase", "basket_spend", "bakery"
    )
