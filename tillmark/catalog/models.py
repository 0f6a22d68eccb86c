"""Metric and model queries. The random search uses fewer points and rounds than the plans' defaults."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillmark.catalog import churn as churn_queries
from tillmark.catalog.base import query
from tillmark.catalog.market import RANGES
from tillmark.operators import encoding
from tillmark.operators import evaluation as E
from tillmark.operators.timegrid import split_by_range
from tillmark.plans import boosting as B
from tillmark.plans import churn as C
from tillmark.plans import forest as RF
from tillmark.plans import market as M
from tillmark.plans import models as ML
from tillmark.plans import segments as G

CHURN_FEATURES = [
    "visits_30days", "total_spend_30days", "days_since_last_visit", "avg_basket_value", "median_days_between_visits",
    "avg_items_per_visit", "unique_categories_30days", "shop_weekend_pct", "visits_lag1_30days", "total_spend_lag1_30days",
    "visits_lag2_30days", "delta_visits", "delta_total_spend",
]
MARKET_FEATURES = ["close", "volume", "return_t", "return_t_lag_1", "ma_close_5", "avg_abs_return", "spread"]
TARGETS = ["target_return_1d", "target_return_5d", "target_return_20d"]
SEGMENT_COLS = ["frequency", "monetary", "recency_last_purchase", "weekend_shopper", "morning_shopper", "category_specialization",
                "churn_risk", "avg_item_count", "spend_concentration"]
DEEP = {"maxDepth": 30}  # MLlib's largest


def churn_frame(t):
    table = C.impute(C.split_table(churn_queries.retail(t), churn_queries.CUTOFFS))
    table = table.withColumn("label", F.col("churned")).na.drop(subset=["label"])
    return ML.materialize(ML.assemble(table, CHURN_FEATURES))


def market_frame(t):
    frame = split_by_range(M.model_frame(t.bars, t.macro), "date", RANGES)
    return frame.na.drop(subset=MARKET_FEATURES)


def segment_frame(t):
    table = G.rfm(t.baskets)
    return ML.materialize(G.log_minmax(table, SEGMENT_COLS).select(G.KEY, *SEGMENT_COLS))


# ---- metrics with check SQL -------------------------------------------------------
@query("classification_metrics", "scored", """WITH c AS (SELECT count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp,
    count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label = 0) AS tn FROM scored)
    SELECT *, CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) AS accuracy, CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / (tp + fn) AS recall,
    CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) AS f1 FROM c""")
def _(t):
    return E.classification_metrics(t.scored)


@query("balanced_accuracy", "scored", """SELECT (CAST(count(*) FILTER (score >= 0.5 AND label = 1) AS DOUBLE) / count(*) FILTER (label = 1)
    + CAST(count(*) FILTER (score < 0.5 AND label = 0) AS DOUBLE) / count(*) FILTER (label = 0)) / 2 AS balanced_accuracy FROM scored""")
def _(t):
    return E.balanced_accuracy(t.scored)


@query("roc_auc", "scored", """WITH r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM scored)
    SELECT round((sum(k) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) /
    (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 9) AS auc FROM r""")
def _(t):
    return E.roc_auc(t.scored).withColumn("auc", F.round("auc", 9))


PRED = "(SELECT target_return_1d AS truth, -0.5 * daily_return AS guess FROM fwd JOIN ret USING (entity_id, date) WHERE target_return_1d IS NOT NULL AND daily_return IS NOT NULL)"


def predictions(t):
    ahead = M.with_targets(M.daily_return(t.bars), t.bars, (1,))
    return ahead.select(F.col("target_return_1d").alias("truth"), (F.col("daily_return") * -0.5).alias("guess"))


@query("regression_metrics", "fwd ret", f"""SELECT count(*) AS n, round(avg(abs(truth - guess)), 5) AS mae, round(sqrt(avg((truth - guess) * (truth - guess))), 5) AS rmse,
    round(1 - avg((truth - guess) * (truth - guess)) / var_pop(truth), 5) AS r2 FROM {PRED}""")
def _(t):
    out = E.regression_metrics(predictions(t))
    return out.withColumns({c: F.round(c, 5) for c in ("mae", "rmse", "r2")})


@query("directional_accuracy", "fwd ret", " UNION ALL ".join(f"SELECT '{name}' AS rule, CAST(count(*) FILTER ({cond}) AS DOUBLE) / count(*) AS directional_accuracy FROM {PRED}"
    for name, cond in (("sign", "sign(truth) = sign(guess)"), ("at_least_zero", "(truth >= 0) = (guess >= 0)"), ("above_zero", "(truth > 0) = (guess > 0)"))))
def _(t):
    return E.directional_accuracy(predictions(t))


@query("group_folds", "", """SELECT user_id, CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8))::BIGINT % 5 AS BIGINT) AS fold, count(*) AS n FROM events GROUP BY 1, 2""")
def _(t):
    return E.group_folds(t.base("events"), "user_id", 5).groupBy("user_id", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("label_encode", "bank", """SELECT customer_id, dense_rank() OVER (ORDER BY job) - 1 AS job_code, dense_rank() OVER (ORDER BY poutcome) - 1 AS poutcome_code FROM bank""")
def _(t):
    return ML.label_encode(t.bank, ["job", "poutcome"]).select("customer_id", "job_code", "poutcome_code")


@query("standard_scale", "bank", """SELECT customer_id, round((balance - (SELECT avg(balance) FROM bank WHERE customer_id % 5 <> 0)) /
    (SELECT stddev_pop(balance) FROM bank WHERE customer_id % 5 <> 0), 6) AS balance FROM bank""")
def _(t):
    train = t.bank.filter(F.col("customer_id") % 5 != 0)
    return ML.standard_scale(t.bank.select("customer_id", "balance"), ["balance"], train).withColumn("balance", F.round("balance", 6))


@query("minmax_scale", "bank", """SELECT customer_id, round((balance - min(balance) OVER ()) / (max(balance) OVER () - min(balance) OVER ()), 9) AS balance FROM bank""")
def _(t):
    return G.log_minmax(t.bank.select("customer_id", "balance"), ["balance"], log=False).withColumn("balance", F.round("balance", 9))


@query("silhouette_exact", "", """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    d AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.e, b.e) ** 2) AS s, count(*) AS n FROM v a, v b GROUP BY 1, 2, 3),
    m AS (SELECT vec_id, label, max(CASE WHEN other = label THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN other <> label THEN s / n END) AS b FROM d GROUP BY 1, 2)
    SELECT vec_id, CAST(label AS BIGINT) AS label, round(COALESCE((b - a) / greatest(a, b), 0), 6) AS silhouette FROM m""")
def _(t):
    out = E.silhouette(t.base("embeddings"), "embedding", "label")
    return out.select("vec_id", "label", F.round("silhouette", 6).alias("silhouette"))


@query("ordered_target_encoding", "bank", """SELECT customer_id, job, round((COALESCE(sum(y) OVER w, 0) + (SELECT avg(y) FROM bank)) / (count(y) OVER w + 1.0), 9) AS encoded FROM bank
    WINDOW w AS (PARTITION BY job ORDER BY md5(CAST(customer_id AS VARCHAR)) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(t):
    out = encoding.ordered_target_mean(t.bank, "job", "y", ["customer_id"])
    return out.select("customer_id", "job", F.round("encoded", 9).alias("encoded"))


# ---- fits -------------------------------------------------------------------------
@query("one_hot_department")
def _(t):
    table = C.impute(C.featured_table(churn_queries.retail(t)))
    return ML.one_hot(table.select(*C.KEYS, "most_common_department"), "most_common_department")


@query("train_logreg")
def _(t):
    frame = churn_frame(t)
    single = ML.assemble(frame.drop("features"), ["days_since_last_visit"])
    reports = [
        ML.split_report(ML.fit_on_train(ML.logistic(), data), data).withColumn("model", F.lit(name))
        for name, data in (("one_feature", single), ("all_features", frame))
    ]
    return reports[0].unionByName(reports[1])


@query("train_rf_classifier")
def _(t):
    frame = churn_frame(t)
    weighted = ML.materialize(ML.balance(frame.filter("data_split = 'train'")))
    return ML.split_report(RF.fit(ML.forest(weightCol="weight", **DEEP), weighted), frame)


@query("train_gbt_classifier")
def _(t):
    frame = churn_frame(t)
    return ML.split_report(ML.fit_on_train(B.Classifier(ML.boosted(**ML.TUNED_CHURN), C.KEYS, mllib=RF.LARGEST), frame), frame)


@query("train_regressors")
def _(t):
    makers = ML.regressors()
    return ML.regression_report(market_frame(t), MARKET_FEATURES, TARGETS, makers, ["train"], "val")


@query("final_refit")
def _(t):
    frame = ML.materialize(market_frame(t).select("entity_id", "date", "data_split", *MARKET_FEATURES, *TARGETS))
    boosters = B.fit(frame.filter("data_split IN ('train', 'val')"), MARKET_FEATURES, B.tuned(), ["entity_id", "date"])
    return B.report(frame.filter("data_split = 'test'"), boosters)


@query("grid_search")
def _(t):
    sampled = B.Classifier(ML.boosted(subsamplingRate=0.8, featureSubsetStrategy="0.8"), C.KEYS)
    space = {"maxDepth": [3, 5, 7, 9], "stepSize": [0.01, 0.05, 0.1], "maxIter": [100, 200, 300]}
    return ML.grid_search(sampled, space, churn_frame(t))


@query("random_search")
def _(t):
    frame = ML.materialize(ML.assemble(market_frame(t), MARKET_FEATURES))
    estimator = ML.regressors(trees=3)["boosted"]
    space = {"maxDepth": [2, 3, 4], "stepSize": [0.03, 0.05, 0.1], "subsamplingRate": [0.8, 1.0]}
    return ML.random_search(estimator, space, frame, "target_return_1d", "entity_id", n=3, folds=3)


@query("learning_curve")
def _(t):
    makers = {"default": B.Classifier(ML.boosted(), C.KEYS), "tuned": B.Classifier(ML.boosted(**ML.TUNED_CHURN), C.KEYS)}
    return ML.learning_curve(makers, churn_frame(t), C.KEYS, [i / 10 for i in range(1, 11)])


@query("permutation_importance")
def _(t):
    frame = churn_frame(t)
    model = ML.fit_on_train(ML.forest(), frame)
    held_out = frame.filter("data_split = 'val'")
    return ML.permutation_importance(model, held_out, CHURN_FEATURES, C.KEYS)


@query("tree_importance")
def _(t):
    model = ML.fit_on_train(ML.forest(), churn_frame(t))
    return ML.tree_importance(model, CHURN_FEATURES, t.spark)


def horizon_importance(t):
    """Permutation importance by mean absolute error, over the validation rows, joined across the horizons."""
    frame = ML.materialize(market_frame(t).select("entity_id", "date", "data_split", *MARKET_FEATURES, *TARGETS))
    boosters = B.fit(frame.filter("data_split = 'train'"), MARKET_FEATURES, B.tuned(), ["entity_id", "date"])
    tables = B.permutation_errors(frame.filter("data_split = 'val'"), boosters, ["entity_id", "date"])
    return ML.importance_by_horizon(tables)


@query("importance_by_horizon")
def _(t):
    return horizon_importance(t)


@query("least_important")
def _(t):
    return ML.least_important(horizon_importance(t), 15)


@query("kmeans_sweep")
def _(t):
    return ML.kmeans_sweep(ML.materialize(ML.assemble(segment_frame(t), SEGMENT_COLS)), range(2, 10))


def clustered(t, k=5):
    return ML.materialize(ML.kmeans(ML.assemble(segment_frame(t), SEGMENT_COLS), k).drop("features"))


@query("cluster_profile")
def _(t):
    return ML.cluster_profile(clustered(t), SEGMENT_COLS, 5)


@query("relative_importance")
def _(t):
    return ML.relative_importance(ML.cluster_profile(clustered(t), SEGMENT_COLS, 5), 5)


@query("segment_assignments")
def _(t):
    return ML.name_clusters(clustered(t), "monetary", ML.SEGMENT_LABELS).select(G.KEY, "cluster", "segment")


@query("pca_loadings")
def _(t):
    model, _ = ML.pca_fit(ML.materialize(ML.assemble(segment_frame(t), SEGMENT_COLS)), 7)
    return ML.pca_loadings(model, SEGMENT_COLS, t.spark)


@query("pca_cumulative_variance")
def _(t):
    model, _ = ML.pca_fit(ML.materialize(ML.assemble(segment_frame(t), SEGMENT_COLS)), len(SEGMENT_COLS))
    return ML.pca_variance(model, t.spark)


@query("nmf_factors")
def _(t):
    _, h, _ = ML.nmf(segment_frame(t), [G.KEY], SEGMENT_COLS, 5, iters=15)
    return ML.top_factor_features(h)


@query("compare_reductions")
def _(t):
    return ML.compare_reductions(segment_frame(t), [G.KEY], SEGMENT_COLS, range(2, 9), iters=5)


@query("top_churners")
def _(t):
    frame = churn_frame(t)
    model = ML.fit_on_train(ML.forest(), frame)
    scored = ML.score(model, frame.filter("data_split = 'test'"), [*C.KEYS, "label"])
    return ML.top_at_risk(scored, C.KEYS)


@query("score_saved_model")
def _(t):
    people = t.bank.withColumn("label", F.col("y").cast("double"))
    model = ML.fitted_pipeline(people.filter("customer_id % 2 = 0"), ["job", "poutcome"], ["age", "balance", "campaign", "pdays"])
    loaded = ML.save_and_load(model, t.spark)
    return ML.score(loaded, people.filter("customer_id % 2 = 1"), ["customer_id", "label"])
