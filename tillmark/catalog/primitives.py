"""Sources, sinks, projections, filters, joins, scalars and data quality."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from tillmark.catalog.base import query
from tillmark.functions import scalars as S
from tillmark.operators import quality as Q
from tillmark.operators import ranking, reshape, stats
from tillmark.plans import retail as R
from tillmark.sources import files, updates
from tillmark.sources.tables import BASE_TABLES, MONEY, SENTINEL_PRICE

PRICE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


# ---- sources, sinks, tables ------------------------------------------------
@query("read_csv_source", "", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    path = files.write_csv(t.base("customer"), files.run_folder(t.spark, "csv-source"))
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return files.read_csv(t.spark, path, schema)


@query("write_csv_sink", "", """SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name, s_acctbal, 'run_1' AS run_id FROM supplier""")
def _(t):
    path = files.write_csv(
        t.base("supplier").select("s_suppkey", "s_name", "s_acctbal"), files.run_folder(t.spark, "csv-sink"), "run_1"
    )
    return files.read_csv(t.spark, path, "s_suppkey bigint, s_name string, s_acctbal double, run_id string")


@query("load_tables", "", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n_rows FROM {n}" for n in BASE_TABLES))
def _(t):
    counts = [t.base(n).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("name"), "n_rows") for n in BASE_TABLES]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("catalog_listing", "", f"""SELECT table_name AS name, count(*) AS n_columns FROM information_schema.columns
    WHERE table_name IN ({', '.join(repr(n) for n in BASE_TABLES)}) GROUP BY 1""")
def _(t):
    files.register_views(t.spark, t.folder)
    listing = files.listed_tables(t.spark)
    return listing.filter(F.col("name").isin(list(BASE_TABLES)))


@query("register_views", "", """SELECT n_name, count(*) AS n_customers FROM nation JOIN customer ON c_nationkey = n_nationkey
    GROUP BY 1""")
def _(t):
    files.register_views(t.spark, t.folder, ("nation", "customer"))
    return t.spark.sql(
        "SELECT n_name, count(*) AS n_customers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name"
    )


REFERENCE = """SELECT s.store_code, s.address, s2.region, p.population, p.disposable_income,
    CAST(p.grocery_spending AS DOUBLE) AS grocery_spending FROM stores s JOIN (SELECT store_code,
    CASE store_code WHEN 0 THEN 'Nottingham' WHEN 1 THEN 'Birmingham' WHEN 2 THEN 'London' WHEN 3 THEN 'London' END AS region
    FROM stores) s2 ON s.store_code = s2.store_code JOIN regions p ON p.region = s2.region"""


def store_reference(t):
    return t.stores.withColumn("region", R.region_of(F.col("store_code"))).join(t.regions, "region")


@query("region_reference", "stores regions", REFERENCE)
def _(t):
    return store_reference(t)


@query("write_reference_table", "stores regions", REFERENCE)
def _(t):
    return files.write_table(store_reference(t), f"store_reference_data_{uuid.uuid4().hex}")


@query("preview_rows", "", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def _(t):
    return t.base("orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", "o_custkey", "o_totalprice")


# ---- projections and filters -------------------------------------------------
@query("project_columns", "receipts", "SELECT receipt_id, customer_id, store_code FROM receipts")
def _(t):
    return t.receipts.select("receipt_id", "customer_id", "store_code")


@query("line_total", "lines", "SELECT receipt_id, CAST(sum(qty * value) AS DOUBLE) AS line_total, count(*) AS n FROM lines GROUP BY 1")
def _(t):
    priced = t.lines.withColumn("line_total", F.col("qty") * F.col("value"))
    return priced.groupBy("receipt_id").agg(F.sum("line_total").alias("line_total"), F.count(F.lit(1)).alias("n"))


@query("rename_prefix", "", "SELECT s_suppkey, s_name AS SUP_s_name, CAST(s_nationkey AS BIGINT) AS SUP_s_nationkey, s_acctbal AS SUP_s_acctbal FROM supplier")
def _(t):
    return reshape.add_prefix(t.base("supplier"), "SUP_", keep=["s_suppkey"])


@query("drop_columns", "", "SELECT p_partkey, p_name, p_brand, p_type FROM part")
def _(t):
    return t.base("part").drop("p_size", "p_retailprice", "no_such_column")


@query("select_by_pattern", "", "SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part")
def _(t):
    return reshape.select_by_pattern(t.base("part"), "^p_", ["int", "bigint", "double"])


@query("cast_columns", "", """SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS o_orderdate,
    CAST(o_custkey AS VARCHAR) AS o_custkey, CAST(o_totalprice AS BIGINT) AS o_totalprice FROM
    (SELECT o_orderkey, o_orderdate, o_custkey, trunc(o_totalprice) AS o_totalprice FROM orders)""")
def _(t):
    cols = t.base("orders").select("o_orderkey", "o_orderdate", "o_custkey", "o_totalprice")
    return reshape.cast_columns(cols, {"o_orderdate": "date", "o_custkey": "string", "o_totalprice": "bigint"})


@query("filter_high_value_lines", "lines", "SELECT receipt_line_id, product_code, qty, CAST(value AS DOUBLE) AS value FROM lines WHERE value > 90000")
def _(t):
    return t.lines.filter(F.col("value") > 90000).select("receipt_line_id", "product_code", "qty", "value")


@query("filter_in_list", "", """SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')""")
def _(t):
    return t.base("orders").filter(F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).select("o_orderkey", "o_orderpriority")


@query("filter_null_lines", "dirty_lines", """SELECT receipt_line_id, receipt_id, qty, CAST(value AS DOUBLE) AS value FROM dirty_lines
    WHERE qty IS NULL OR value IS NULL""")
def _(t):
    return t.dirty_lines.filter(F.col("qty").isNull() | F.col("value").isNull()).select("receipt_line_id", "receipt_id", "qty", "value")


@query("filter_date_range", "receipts", """SELECT receipt_id, strftime(purchased_at, '%Y-%m-%d %H:%M:%S') AS purchased_at FROM receipts
    WHERE purchased_at BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2000-12-31'""")
def _(t):
    return R.in_period(t.receipts, dt.date(2000, 1, 1), dt.date(2000, 12, 31)).select("receipt_id", "purchased_at")


@query("filter_mask", "", "SELECT event_id, value FROM events WHERE event_type = 'purchase' AND value >= 100")
def _(t):
    flagged = t.base("events").withColumn("flag", (F.col("event_type") == "purchase") & (F.col("value") >= 100))
    return flagged.filter("flag").select("event_id", "value")


@query("score_threshold", "scored", "SELECT row_id, score FROM scored WHERE score >= 0.5")
def _(t):
    return t.scored.filter(F.col("score") >= 0.5).select("row_id", "score")


# ---- joins, samples, unions ----------------------------------------------------
@query("join_receipt_lines", "receipts lines", """SELECT r.receipt_id, r.customer_id, r.store_code, l.product_code,
    CAST(l.value AS DOUBLE) AS line_item_value FROM receipts r JOIN lines l ON r.receipt_id = l.receipt_id""")
def _(t):
    return t.receipts.join(t.lines, "receipt_id").select(
        "receipt_id", "customer_id", "store_code", "product_code", F.col("value").alias("line_item_value")
    )


@query("map_lookup", "", """SELECT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status,
    c_mktsegment, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def _(t):
    status = F.coalesce(S.lookup(F.col("o_orderstatus"), {"F": "finished", "O": "open"}), F.col("o_orderstatus"))
    segments = t.base("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    per_customer = t.base("orders").groupBy("o_custkey", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return per_customer.join(segments, "o_custkey", "left").groupBy("status", "c_mktsegment").agg(F.sum("n").alias("n"))


@query("attach_group_stats", "", """SELECT o_orderkey, o_totalprice,
    round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER w AS DOUBLE) / count(*) OVER w, 6) AS o_totalprice_mean,
    round(stddev_samp(o_totalprice) OVER w, 4) AS o_totalprice_std FROM orders WINDOW w AS (PARTITION BY o_custkey)""")
def _(t):
    exact = t.base("orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast(MONEY).alias("o_totalprice"))
    df = reshape.attach_group_stats(exact, "o_custkey", "o_totalprice")
    return df.select(
        "o_orderkey", "o_totalprice",
        F.round("o_totalprice_mean", 6).alias("o_totalprice_mean"), F.round("o_totalprice_std", 4).alias("o_totalprice_std"),
    )


@query("hash_sample", "", "SELECT c_custkey, c_name FROM customer ORDER BY md5('7|' || CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 200")
def _(t):
    return reshape.hash_sample(t.base("customer").select("c_custkey", "c_name"), ["c_custkey"], 200, seed=7)


@query("train_val_union", "receipts", """SELECT year(purchased_at) AS year, part, count(*) AS n FROM
    (SELECT purchased_at, CASE WHEN purchased_at < TIMESTAMP '1999-01-01' THEN 'train' ELSE 'val' END AS part FROM receipts
     WHERE purchased_at < TIMESTAMP '2000-01-01') GROUP BY 1, 2""")
def _(t):
    stamped = t.receipts.select("receipt_id", "purchased_at")
    first, second = F.lit(dt.date(1999, 1, 1)), F.lit(dt.date(2000, 1, 1))
    train = stamped.filter(F.col("purchased_at") < first).withColumn("part", F.lit("train"))
    val = stamped.filter((F.col("purchased_at") >= first) & (F.col("purchased_at") < second)).withColumn("part", F.lit("val"))
    return train.unionByName(val).groupBy(F.year("purchased_at").alias("year"), "part").agg(F.count(F.lit(1)).alias("n"))


@query("average_rank", "", """SELECT c_custkey, bal, rank() OVER (ORDER BY bal DESC) + (count(*) OVER (PARTITION BY bal) - 1) / 2.0::DOUBLE AS avg_rank
    FROM (SELECT c_custkey, floor(c_acctbal / 50) AS bal FROM customer)""")
def _(t):
    df = t.base("customer").select("c_custkey", F.floor(F.col("c_acctbal") / 50).cast("double").alias("bal"))
    return ranking.average_ranks(df, "bal", descending=True).select("c_custkey", "bal", "avg_rank")


# ---- scalars --------------------------------------------------------------------
@query("date_parts", "", """SELECT year(ts) AS year, quarter(ts) AS quarter, month(ts) AS month, hour(ts) AS hour, count(*) AS n
    FROM events GROUP BY 1, 2, 3, 4""")
def _(t):
    parts = [F.year("ts").alias("year"), F.quarter("ts").alias("quarter"), F.month("ts").alias("month"), F.hour("ts").alias("hour")]
    return t.base("events").groupBy(*parts).agg(F.count(F.lit(1)).alias("n"))


@query("weekend_flag", "", """SELECT isodow(ts) >= 6 AS weekend, dayofweek(ts) + 1 AS day_number, count(*) AS n FROM events GROUP BY 1, 2""")
def _(t):
    return t.base("events").groupBy(S.is_weekend(F.col("ts")).alias("weekend"), F.dayofweek("ts").alias("day_number")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("parse_dates", "", """SELECT strftime(parsed, '%Y-%m-%d') AS parsed, count(*) AS n FROM (SELECT
    CASE WHEN o_orderkey % 41 <> 0 THEN CAST(o_orderdate AS DATE) END AS parsed FROM orders) GROUP BY 1""")
def _(t):
    text = F.when(F.col("o_orderkey") % 41 == 0, "n/a").otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    parsed = F.try_to_timestamp(text, F.lit("MM/dd/yyyy")).cast("date")
    return t.base("orders").groupBy(parsed.alias("parsed")).agg(F.count(F.lit(1)).alias("n"))


@query("quarter_end", "", """SELECT CASE WHEN o_orderkey % 43 = 0 THEN 'bad' ELSE year(o_orderdate) || 'Q' || quarter(o_orderdate) END AS label,
    CASE WHEN o_orderkey % 43 <> 0 THEN strftime(last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH), '%Y-%m-%d') END AS quarter_end,
    count(*) AS n FROM orders GROUP BY 1, 2""")
def _(t):
    label = F.when(F.col("o_orderkey") % 43 == 0, "bad").otherwise(
        F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string"))
    )
    counted = t.base("orders").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("quarter_end", S.quarter_end(F.col("label")))


@query("math_scalars", "", """SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS f, round(c_acctbal, 1) AS r, abs(c_acctbal) AS a,
    sqrt(abs(c_acctbal)) AS s, CAST(sign(c_acctbal) AS DOUBLE) AS g, round(ln(1 + abs(c_acctbal)), 9) AS l FROM customer""")
def _(t):
    bal = F.col("c_acctbal")
    return t.base("customer").select(
        "c_custkey", F.floor(bal).alias("f"), F.round(bal, 1).alias("r"), F.abs(bal).alias("a"),
        F.sqrt(F.abs(bal)).alias("s"), F.signum(bal).alias("g"), F.round(F.log1p(F.abs(bal)), 9).alias("l"),
    )


@query("store_region_map", "receipts store_regions", """SELECT r.store_code, sr.region, count(*) AS n FROM receipts r
    JOIN store_regions sr ON r.store_code = sr.store_code GROUP BY 1, 2""")
def _(t):
    counted = t.receipts.groupBy("store_code").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("region", R.region_of(F.col("store_code")))


@query("parse_currency", "baskets", """SELECT customer_number, CAST(sum(basket_spend) FILTER (basket_id % 29 <> 0) AS DOUBLE) AS spend,
    count(*) FILTER (basket_id % 29 = 0) AS unreadable FROM baskets GROUP BY 1""")
def _(t):
    text = F.when(F.col("basket_id") % 29 == 0, "n/a").otherwise(S.currency_text(F.col("basket_spend") ))
    parsed = t.baskets.withColumn("parsed", S.parse_currency(text))
    return parsed.groupBy("customer_number").agg(
        F.sum("parsed").alias("spend"), F.count_if(F.col("parsed").isNull()).alias("unreadable")
    )


@query("credit_rating_rank", "company_metadata ratings", """SELECT SP_ENTITY_ID, RD_CREDIT_RATING_GLOBAL, rating_rank AS credit_rating_rank,
    CASE WHEN RD_CREDIT_RATING_GLOBAL = 'NR' THEN 1 ELSE 0 END AS was_not_rated FROM company_metadata
    LEFT JOIN ratings ON rating = RD_CREDIT_RATING_GLOBAL""")
def _(t):
    rating = F.col("RD_CREDIT_RATING_GLOBAL")
    return t.company_metadata.select(
        "SP_ENTITY_ID", rating, S.credit_rating_rank(rating).alias("credit_rating_rank"),
        (rating == "NR").cast("int").alias("was_not_rated"),
    )


@query("sanitize_numeric", "", """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN 0.0 ELSE c_acctbal END AS cleaned FROM customer""")
def _(t):
    noisy = (
        F.when(F.col("c_custkey") % 5 == 0, float("inf"))
        .when(F.col("c_custkey") % 7 == 0, float("nan"))
        .otherwise(F.col("c_acctbal"))
    )
    return t.base("customer").select("c_custkey", S.finite_or_null(noisy).alias("cleaned")).na.fill({"cleaned": 0.0})


@query("safe_ratio", "bank", """SELECT customer_id, CASE WHEN campaign = 0 THEN 0.0 ELSE balance / campaign END AS balance_per_contact FROM bank""")
def _(t):
    return t.bank.select("customer_id", S.safe_ratio(F.col("balance"), F.col("campaign")).alias("balance_per_contact"))


# ---- statistics --------------------------------------------------------------------
@query("value_counts", "", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return stats.value_counts(t.base("events"), "event_type")


def _quantile_sql(cols, qs, table):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {q}::DOUBLE AS q, round(quantile_cont({c}, {q}), 6) AS value FROM {table}" for c in cols for q in qs
    )


@query("column_quantiles", "", _quantile_sql(PRICE_COLS, [0.25, 0.5, 0.75, 0.99], "lineitem"))
def _(t):
    from tillmark.operators.quantiles import exact_quantiles

    out = exact_quantiles(t.base("lineitem"), PRICE_COLS, [0.25, 0.5, 0.75, 0.99])
    return out.withColumn("value", F.round("value", 6))


@query("describe_columns", "", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
    min({c}) AS "min", max({c}) AS "max", round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
    round(quantile_cont({c}, 0.75), 6) AS p75 FROM lineitem""" for c in PRICE_COLS))
def _(t):
    out = stats.describe(t.base("lineitem"), PRICE_COLS)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p25", "p50", "p75")})


@query("correlation_matrix", "", " UNION ALL ".join(
    f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, round(corr({a}, {b}), 6) AS correlation FROM lineitem"
    for a in PRICE_COLS for b in PRICE_COLS))
def _(t):
    return stats.corr_long(t.base("lineitem"), PRICE_COLS).withColumn("correlation", F.round("correlation", 6))


TRIO = {"price": "l_extendedprice", "taxed": "l_extendedprice * (1 + l_tax)", "net": "l_extendedprice * (1 - l_discount)", "qty": "l_quantity"}


@query("high_corr_pairs", "", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, round(corr({TRIO[a]}, {TRIO[b]}), 6) AS correlation FROM lineitem"
    for a in TRIO for b in TRIO if a > b) + ") WHERE abs(correlation) > 0.85")
def _(t):
    df = t.base("lineitem").select(*[F.expr(e).alias(n) for n, e in TRIO.items()])
    return stats.high_corr(stats.corr_long(df, list(TRIO))).withColumn("correlation", F.round("correlation", 6))


@query("histogram", "", """SELECT CAST(least(floor((o_totalprice - lo) * 20 / (hi - lo)), 19) AS BIGINT) AS bin, count(*) AS n
    FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY 1""")
def _(t):
    return stats.histogram(t.base("orders"), "o_totalprice", 20)


@query("null_audit", "dirty_lines", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS nulls,
    CAST(count(*) FILTER ({c} IS NULL) * 100 AS DOUBLE) / count(*) AS null_pct FROM dirty_lines"""
    for c in ["receipt_id", "product_code", "qty", "value"]))
def _(t):
    return stats.null_audit(t.dirty_lines, ["receipt_id", "product_code", "qty", "value"])


@query("null_audit_by_product", "dirty_lines", """SELECT product_code, count(*) FILTER (qty IS NULL) AS nulls FROM dirty_lines
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(t):
    return stats.null_counts_by(t.dirty_lines, "product_code", ["qty", "value"])


# ---- data quality --------------------------------------------------------------------
@query("repair_sentinel_value", "dirty_lines", """SELECT d.product_code, count(*) AS n, round(sum(CASE WHEN value = 9999999 THEN m.mean
    ELSE CAST(value AS DOUBLE) END), 4) AS repaired_total, max(CASE WHEN value = 9999999 THEN round(m.mean, 6) END) AS filled
    FROM dirty_lines d LEFT JOIN (SELECT product_code, CAST(sum(value) FILTER (value <> 9999999) AS DOUBLE) /
        count(*) FILTER (value <> 9999999) AS mean FROM dirty_lines GROUP BY 1) m ON d.product_code = m.product_code GROUP BY 1""")
def _(t):
    fixed = Q.repair_sentinel(t.dirty_lines, "product_code", "value", SENTINEL_PRICE, out="repaired")
    return fixed.groupBy("product_code").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("repaired"), 4).alias("repaired_total"),
        F.max(F.when(F.col("value") == SENTINEL_PRICE, F.round("repaired", 6))).alias("filled"),
    )


@query("fill_null_quantity", "dirty_lines", """SELECT receipt_id, CAST(sum(COALESCE(qty, 1)) AS BIGINT) AS qty, count(*) AS n
    FROM dirty_lines GROUP BY 1""")
def _(t):
    filled = Q.fill_nulls(t.dirty_lines, {"qty": 1})
    return filled.groupBy("receipt_id").agg(F.sum("qty").alias("qty"), F.count(F.lit(1)).alias("n"))


@query("update_sentinel_prices", "dirty_lines", """WITH c AS (SELECT product_code, 2 * CAST(sum(value) FILTER (value <> 9999999) * 100 AS BIGINT) + count(*) FILTER (value <> 9999999) AS a,
        2 * count(*) FILTER (value <> 9999999) AS b FROM dirty_lines GROUP BY 1), m AS (SELECT product_code, CAST((a - ((a % b) + b) % b) // b AS DOUBLE) / 100 AS mean FROM c)
    SELECT d.product_code, count(*) AS n, round(sum(CASE WHEN value = 9999999 THEN m.mean ELSE CAST(value AS DOUBLE) END), 2) AS total
    FROM dirty_lines d LEFT JOIN m ON d.product_code = m.product_code GROUP BY 1""")
def _(t):
    lines = t.dirty_lines.withColumn("value", F.col("value").cast("double")).withColumn("shelf", F.col("product_code") % 32)
    path = updates.store_partitioned(lines, "lines", "shelf")
    good = t.dirty_lines.where(F.col("value") != SENTINEL_PRICE).groupBy("product_code")
    cents, n = (F.sum("value") * 100).cast("bigint"), F.count("value")
    means = good.agg((2 * cents + n).alias("a"), (2 * n).alias("b")).select(
        "product_code", (F.expr("(a - pmod(a, b)) div b").cast("double") / 100).alias("mean"))
    updates.update_where(t.spark, path, "shelf", F.col("value") == SENTINEL_PRICE, {"value": F.col("mean")}, means, "product_code")
    stored = t.spark.read.parquet(path)
    return stored.groupBy("product_code").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("update_null_quantities", "dirty_lines", """SELECT receipt_id, CAST(sum(COALESCE(qty, 1)) AS BIGINT) AS qty, count(qty) AS known, count(*) AS n
    FROM (SELECT receipt_id, COALESCE(qty, 1) AS qty FROM dirty_lines) d GROUP BY 1""")
def _(t):
    path = updates.store_partitioned(t.dirty_lines.withColumn("part", F.col("receipt_id") % 32), "lines", "part")
    updates.update_where(t.spark, path, "part", F.col("qty").isNull(), {"qty": F.lit(1)})
    stored = t.spark.read.parquet(path)
    return stored.groupBy("receipt_id").agg(F.sum("qty").alias("qty"), F.count("qty").alias("known"), F.count(F.lit(1)).alias("n"))


@query("bucketed_monthly_revenue", "receipts lines", """SELECT strftime(date_trunc('month', purchased_at), '%Y-%m-%d') AS month, store_code,
    CAST(sum(value) AS DOUBLE) AS revenue, count(DISTINCT r.receipt_id) AS receipts FROM receipts r JOIN lines l ON r.receipt_id = l.receipt_id
    WHERE purchased_at >= DATE '1997-01-01' AND purchased_at < DATE '1998-01-01' GROUP BY date_trunc('month', purchased_at), store_code""")
def _(t):
    return R.stored_monthly_revenue(*R.stored_facts(t.receipts, t.lines), dt.date(1997, 1, 1), dt.date(1997, 12, 1))


@query("suspicious_lines", "lines products", """SELECT receipt_line_id, receipt_id, l.product_code, product_details, qty, CAST(value AS DOUBLE) AS value
    FROM lines l JOIN products p ON l.product_code = p.product_code WHERE qty = 50 OR value > 100000""")
def _(t):
    return Q.suspicious_lines(t.lines, t.products, qty=50, value=100000)


@query("negative_products", "dirty_lines products", """SELECT d.product_code, product_details, CAST(sum(value) AS DOUBLE) AS total_value_spent
    FROM dirty_lines d JOIN products p ON d.product_code = p.product_code GROUP BY 1, 2 HAVING sum(value) < 0""")
def _(t):
    return Q.negative_totals(t.dirty_lines, t.products)


@query("duplicate_names", "customers", """SELECT "first", "last", count(*) AS occurrences FROM customers GROUP BY 1, 2 HAVING count(*) > 1""")
def _(t):
    return Q.duplicates(t.customers, ["first", "last"])


@query("iqr_outliers", "", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers
    FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem)""" for c in PRICE_COLS))
def _(t):
    return Q.iqr_outliers(t.base("lineitem"), PRICE_COLS)


@query("p99_outliers", "", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) FILTER ({c} > p) AS outliers
    FROM lineitem, (SELECT quantile_cont({c}, 0.99) AS p FROM lineitem)""" for c in PRICE_COLS))
def _(t):
    return Q.high_outliers(t.base("lineitem"), PRICE_COLS)


@query("winsorize_p99", "", """SELECT o_orderkey, round(least(o_totalprice, p), 6) AS o_totalprice
    FROM orders, (SELECT quantile_cont(o_totalprice, 0.99) AS p FROM orders)""")
def _(t):
    out = Q.winsorize(t.base("orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"])
    return out.withColumn("o_totalprice", F.round("o_totalprice", 6))


@query("impute_median", "", """SELECT o_orderkey, round(COALESCE(CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END, m), 6) AS amount
    FROM orders, (SELECT quantile_cont(o_totalprice, 0.5) FILTER (o_orderkey % 11 <> 0) AS m FROM orders)""")
def _(t):
    gaps = t.base("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("amount"))
    return Q.impute_median(gaps, ["amount"]).withColumn("amount", F.round("amount", 6))


@query("drop_incomplete", "raw_receipts", "SELECT receipt_id, customer_id FROM raw_receipts WHERE customer_id IS NOT NULL")
def _(t):
    return t.raw_receipts.select("receipt_id", "customer_id").na.drop()
