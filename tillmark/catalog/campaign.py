"""Campaign and social queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillmark.catalog.base import define, query
from tillmark.plans import campaign as C
from tillmark.plans import social as P
from tillmark.plans.models import materialize
from tillmark.sources.tables import literal_table

# The lexicon used against the given documents, and its negators.
LEXICON = {
    "is": 0.5, "it": -0.5, "was": -0.75, "are": 0.25, "and": 0.5, "on": 0.25, "with": 0.75,
    "by": -0.25, "as": 0.5, "this": 1.0, "be": -1.0, "from": -0.5, "for": 0.25, "at": -0.25,
}
NEGATORS = ["the", "not", "in"]

COUNTS = """count(*) FILTER (arm = 'control') AS control_responses, count(*) FILTER (arm = 'exposed') AS exposed_responses,
    count(*) FILTER (arm = 'control' AND considered = 1) AS control_considered, count(*) FILTER (arm = 'exposed' AND considered = 1) AS exposed_considered"""
define("arms", f"SELECT campaign_name, market, channel, {COUNTS} FROM lift_responses GROUP BY 1, 2, 3", ("lift_responses",))
define("arms_market", f"SELECT market, {COUNTS} FROM lift_responses GROUP BY 1", ("lift_responses",))


def test_sql(source: str) -> str:
    return f"""SELECT *, 2 * exp(-z * z / 2) / 2.5066282746310002 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) AS p_value
    FROM (SELECT *, 1.0 / (1.0 + 0.2316419 * abs(z)) AS t FROM (SELECT *, exposed_rate - control_rate AS absolute_lift, (control_rate - exposed_rate) /
        sqrt(pool * (1 - pool) * (1.0 / control_responses + 1.0 / exposed_responses)) AS z FROM (
    SELECT *, control_considered / control_responses::DOUBLE AS control_rate, exposed_considered / exposed_responses::DOUBLE AS exposed_rate,
    (control_considered + exposed_considered) / (control_responses + exposed_responses)::DOUBLE AS pool FROM {source}) a) b) c"""


define("tested", test_sql("arms"), ("arms",))
define("tested_market", test_sql("arms_market"), ("arms_market",))
KEYS = "campaign_name, market, channel"
define("lifted", f"""SELECT {KEYS}, spend, reach, conversions, absolute_lift, p_value, reach * absolute_lift AS influenced_users,
    CASE WHEN reach * absolute_lift > 0 THEN CAST(spend AS DOUBLE) / (reach * absolute_lift) END AS cost_per_lifted_user
    FROM campaign_history LEFT JOIN tested USING ({KEYS})""", ("campaign_history", "tested"))
define("market_totals", """SELECT h.market, CAST(spend AS DOUBLE) / conversions AS cpa, absolute_lift,
    CASE WHEN reach * absolute_lift > 0 THEN CAST(spend AS DOUBLE) / (reach * absolute_lift) END AS cost_per_lifted_user
    FROM (SELECT market, sum(spend) AS spend, sum(reach) AS reach, sum(conversions) AS conversions FROM campaign_history GROUP BY 1) h
    LEFT JOIN tested_market t ON t.market = h.market""", ("campaign_history", "tested_market"))


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def tests(t):
    return C.ztest(C.control_exposed_counts(t.lift_responses))


@query("control_exposed_counts", "arms", "SELECT * FROM arms")
def _(t):
    return C.control_exposed_counts(t.lift_responses)


@query("brand_lift_ztest", "tested", f"SELECT {KEYS}, round(absolute_lift, 9) AS absolute_lift, round(z, 6) AS z, round(p_value, 6) AS p_value FROM tested")
def _(t):
    df = rounded(tests(t), "z", "p_value").withColumn("absolute_lift", F.round("absolute_lift", 9))
    return df.select(*C.COMPOSITE, "absolute_lift", "z", "p_value")


@query("significant_lift", "tested", f"SELECT {KEYS}, round(z, 6) AS z FROM tested WHERE p_value < 0.05")
def _(t):
    return rounded(C.significant(tests(t)), "z").select(*C.COMPOSITE, "z")


@query("campaign_lift_join", "lifted", f"SELECT {KEYS}, CAST(spend AS DOUBLE) AS spend, reach, conversions, round(absolute_lift, 6) AS absolute_lift FROM lifted")
def _(t):
    return rounded(C.lift_join(t.campaign_history, tests(t)), "absolute_lift").drop("p_value")


@query("cost_per_lifted_user", "lifted", f"SELECT {KEYS}, round(influenced_users, 6) AS influenced_users, round(cost_per_lifted_user, 4) AS cost_per_lifted_user FROM lifted")
def _(t):
    df = C.cost_per_lifted_user(C.lift_join(t.campaign_history, tests(t)))
    df = rounded(df, "influenced_users").withColumn("cost_per_lifted_user", F.round("cost_per_lifted_user", 4))
    return df.select(*C.COMPOSITE, "influenced_users", "cost_per_lifted_user")


@query("cpa_by_channel", "campaign_history", """SELECT market, channel, CAST(sum(spend) AS DOUBLE) AS spend, CAST(sum(conversions) AS BIGINT) AS conversions,
    CAST(sum(spend) AS DOUBLE) / sum(conversions) AS cpa FROM campaign_history GROUP BY 1, 2""")
def _(t):
    return C.cpa(t.campaign_history)


@query("market_scorecard", "market_totals", """SELECT market, rank() OVER (ORDER BY cpa NULLS LAST) AS cpa_rank,
    rank() OVER (ORDER BY cost_per_lifted_user NULLS LAST) AS cplu_rank, rank() OVER (ORDER BY absolute_lift DESC NULLS LAST) AS lift_rank FROM market_totals""")
def _(t):
    return C.scorecard(C.market_totals(t.lift_responses, t.campaign_history))


@query("budget_allocation", "market_totals", """SELECT market, round(w / sum(w) OVER (), 6) AS share, round(w / sum(w) OVER () * 10000000, 2) AS budget
    FROM (SELECT market, COALESCE(1.0 / cost_per_lifted_user, 0) AS w FROM market_totals) x""")
def _(t):
    df = C.allocate_budget(C.market_totals(t.lift_responses, t.campaign_history), 10_000_000)
    return df.select("market", F.round("share", 6).alias("share"), F.round("budget", 2).alias("budget"))


RATE = "count(*) AS customers, CAST(sum(y) AS DOUBLE) / count(*) AS buy_rate, CAST(sum(y) AS DOUBLE) / count(*) / (SELECT CAST(sum(y) AS DOUBLE) / count(*) FROM bank) AS uplift"


@query("segment_buy_rate", "bank", f"SELECT job AS segment, {RATE} FROM bank GROUP BY 1")
def _(t):
    return C.segment_rates(t.bank, F.col("job"))


@query("outcome_buy_rate", "bank", f"SELECT poutcome AS segment, {RATE} FROM bank GROUP BY 1")
def _(t):
    return C.segment_rates(t.bank, F.col("poutcome"))


@query("contact_band_rate", "bank", f"""SELECT CASE WHEN pdays < 0 THEN 'never' WHEN pdays < 50 THEN 'under 50' WHEN pdays <= 200 THEN '50-200' ELSE 'over 200' END AS band,
    {RATE} FROM bank GROUP BY 1""")
def _(t):
    return C.segment_rates(t.bank, C.contact_band(F.col("pdays")), name="band")


@query("threshold_sweep", "scored", """WITH th AS (SELECT (50 - 5 * i) / 100.0::DOUBLE AS threshold, i FROM range(10) r(i)),
    c AS (SELECT threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp,
    count(*) FILTER (score < threshold AND label = 1) AS fn, count(*) FILTER (score < threshold AND label = 0) AS tn FROM th, scored GROUP BY 1)
    SELECT *, tp - COALESCE(lag(tp) OVER (ORDER BY threshold DESC), 0) AS new_tp, CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) AS accuracy,
    CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / (tp + fn) AS recall, threshold <= 0.3 AS caution FROM c""")
def _(t):
    return C.threshold_sweep(t.scored)


@query("threshold_new_positives", "scored", """SELECT row_id, max(threshold) AS found_at FROM scored, (SELECT (50 - 5 * i) / 100.0::DOUBLE AS threshold FROM range(10) r(i))
    WHERE label = 1 AND score >= threshold GROUP BY 1""")
def _(t):
    return C.new_true_positives(t.scored).select("row_id", "found_at")


# ---- posts ---------------------------------------------------------------------
define("lexicon", "SELECT * FROM (VALUES " + ", ".join(f"('{w}', {v}::DOUBLE)" for w, v in LEXICON.items()) + ") v(token, weight)")
define("toks", """SELECT post_id, unnest(w) AS token, unnest(list_concat([NULL], w[:-2])) AS before, generate_subscripts(w, 1) - 1 AS position FROM (
    SELECT post_id, list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://\\S+', ' ', 'g'), '@[\\p{L}\\p{M}\\p{N}_]+', ' ', 'g'),
    '[^\\p{L}\\p{M}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM posts) z WHERE len(w) > 0""", ("posts",))
define("pol", """SELECT p.post_id, brand, country, created_on, engagement, COALESCE(n, 0) AS n_tokens, COALESCE(h, 0) AS hits,
    CASE WHEN COALESCE(h, 0) = 0 THEN 0.0 ELSE s / h END AS polarity, CASE WHEN COALESCE(n, 0) = 0 THEN 0.0 ELSE COALESCE(h, 0)::DOUBLE / n END AS subjectivity
    FROM posts p LEFT JOIN (SELECT post_id, count(*) AS n, count(weight) AS h, sum(CASE WHEN before IN ('the', 'not', 'in') THEN -weight ELSE weight END) AS s
    FROM toks LEFT JOIN lexicon ON toks.token = lexicon.token GROUP BY 1) q ON p.post_id = q.post_id""", ("posts", "lexicon", "toks"))
define("classed", """SELECT *, CASE WHEN polarity > 0.05 THEN 'positive' WHEN polarity < -0.05 THEN 'negative' ELSE 'neutral' END AS sentiment FROM pol""", ("pol",))
MIX = """count(*) AS posts, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'negative') AS negative,
    count(*) FILTER (sentiment = 'neutral') AS neutral, round(avg(polarity), 6) AS mean_polarity"""


def lexicon(t):
    return literal_table(t.spark, list(LEXICON.items()), ["token", "weight"])


def scored_posts(t):
    return P.polarity(t.posts, lexicon(t), NEGATORS)


def classified(t):
    return P.classify(scored_posts(t))


@query("tokenize_posts", "toks", "SELECT post_id, count(*) AS n_tokens, count(DISTINCT token) AS n_distinct FROM toks GROUP BY 1")
def _(t):
    return P.tokenize(t.posts).groupBy("post_id").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.countDistinct("token").alias("n_distinct")
    )


@query("lexicon_polarity", "pol", "SELECT post_id, hits, polarity, subjectivity FROM pol")
def _(t):
    return scored_posts(t).select("post_id", "hits", "polarity", "subjectivity")


@query("sentiment_class", "classed", "SELECT sentiment, count(*) AS n FROM classed GROUP BY 1")
def _(t):
    return classified(t).groupBy("sentiment").agg(F.count(F.lit(1)).alias("n"))


@query("sentiment_by_brand", "classed", f"SELECT brand, {MIX} FROM classed GROUP BY 1")
def _(t):
    return rounded(P.sentiment_by(classified(t), "brand"), "mean_polarity")


@query("sentiment_over_time", "classed", f"SELECT brand, strftime(date_trunc('month', created_on), '%Y-%m-%d') AS period, {MIX} FROM classed GROUP BY 1, 2")
def _(t):
    return rounded(P.sentiment_by(classified(t), "brand", F.trunc("created_on", "month").alias("period")), "mean_polarity")


@query("volume_by_country", "posts", "SELECT country, brand, count(*) AS posts FROM posts GROUP BY 1, 2")
def _(t):
    return t.posts.groupBy("country", "brand").agg(F.count(F.lit(1)).alias("posts"))


@query("sentiment_engagement_corr", "pol", "SELECT round(corr(polarity, engagement), 6) AS correlation FROM pol")
def _(t):
    return rounded(P.engagement_correlation(scored_posts(t)), "correlation")


@query("sentiment_stability", "pol", "SELECT brand, round(stddev_samp(polarity), 6) AS polarity_std, count(*) AS posts FROM pol GROUP BY 1")
def _(t):
    return rounded(P.stability(scored_posts(t)), "polarity_std")


# ---- lexicon learned from labels.quality; every third post is held out ------------
define("marks", "SELECT doc_id AS post_id, max(quality) AS label FROM labels WHERE quality IS NOT NULL GROUP BY doc_id")
define("odds", """SELECT token, good, bad, ln((good + a) / (ng + 500.0 - good - a)) - ln((bad + a) / (nb + 500.0 - bad - a)) AS log_odds,
    sqrt(1 / (good + a) + 1 / (bad + a)) AS sd FROM (SELECT *, 500.0 * (good + bad) / (ng + nb) AS a FROM (SELECT *, sum(good) OVER () AS ng, sum(bad) OVER () AS nb FROM (
    SELECT token, CAST(count(*) FILTER (label = 1) AS DOUBLE) AS good, CAST(count(*) FILTER (label = 0) AS DOUBLE) AS bad
    FROM toks JOIN marks ON toks.post_id = marks.post_id WHERE marks.post_id % 3 <> 0 GROUP BY token) x) y) z""", ("toks", "marks"))
define("learned", "SELECT token, log_odds AS weight FROM odds WHERE abs(log_odds / sd) >= 1.96", ("odds",))
define("learned_pol", """SELECT p.post_id, COALESCE(h, 0) AS hits, CASE WHEN COALESCE(h, 0) = 0 THEN 0.0 ELSE s / h END AS polarity,
    CASE WHEN COALESCE(n, 0) = 0 THEN 0.0 ELSE COALESCE(h, 0)::DOUBLE / n END AS subjectivity
    FROM posts p LEFT JOIN (SELECT post_id, count(*) AS n, count(weight) AS h, sum(CASE WHEN before IN ('not', 'no', 'never') THEN -weight ELSE weight END) AS s
    FROM toks LEFT JOIN learned ON toks.token = learned.token GROUP BY 1) q ON p.post_id = q.post_id""", ("posts", "learned", "toks"))


def marks(t):
    known = t.base("labels").where("quality IS NOT NULL")
    return known.groupBy(F.col("doc_id").alias("post_id")).agg(F.max("quality").alias("label"))


def learned(t):
    return materialize(P.learned_lexicon(t.posts, marks(t).where("post_id % 3 != 0")))


@query("learned_lexicon", "learned", "SELECT token, round(weight, 6) AS weight FROM learned")
def _(t):
    return rounded(learned(t), "weight")


@query("learned_polarity", "learned_pol", "SELECT post_id, hits, round(polarity, 6) AS polarity, round(subjectivity, 9) AS subjectivity FROM learned_pol")
def _(t):
    scored = P.polarity(t.posts, learned(t), keep=())
    return rounded(scored, "polarity").select("post_id", "hits", "polarity", F.round("subjectivity", 9).alias("subjectivity"))


@query("learned_sentiment_agreement", "learned_pol marks", """SELECT count(*) AS posts, count(*) FILTER (polarity <> 0) AS told,
    count(*) FILTER (polarity <> 0 AND (polarity > 0) = (label = 1)) AS "right", count(*) FILTER (polarity <> 0 AND label = 1) AS good
    FROM learned_pol JOIN marks USING (post_id) WHERE post_id % 3 = 0""")
def _(t):
    held_out = marks(t).where("post_id % 3 = 0")
    return P.agreement(P.polarity(t.posts, learned(t), keep=()), held_out)
