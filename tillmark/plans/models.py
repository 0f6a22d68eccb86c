"""Model training, tuning, importance and clustering on MLlib."""

from __future__ import annotations

import random
from collections.abc import Sequence
from functools import reduce
from itertools import product
from math import gcd
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillmark.functions import scalars as S
from tillmark.operators import evaluation as E
from tillmark.operators.ranking import positions
from tillmark.operators.stats import unpivot_aggregates
from tillmark.session import shared_dir
from tillmark.sources.files import run_folder


# Tuned parameters of the reported models, and the names of segments, largest mean spend first.
TUNED_CHURN = {"maxDepth": 3, "stepSize": 0.05, "maxIter": 300, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
TUNED_MARKET = {
    1: {"maxDepth": 5, "stepSize": 0.08, "maxIter": 400, "subsamplingRate": 1.0, "featureSubsetStrategy": "0.8"},
    5: {"maxDepth": 9, "stepSize": 0.0438, "maxIter": 649, "subsamplingRate": 0.965, "featureSubsetStrategy": "0.569"},
    20: {"maxDepth": 9, "stepSize": 0.0438, "maxIter": 649, "subsamplingRate": 0.965, "featureSubsetStrategy": "0.569"},
}
FOREST = {"numTrees": 100, "maxDepth": 5, "seed": 42}
SEGMENT_LABELS = ["High Value", "Moderate", "Morning Mission Bulk", "Quick Morning Stop", "One Item Random Stop"]


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of a training frame in the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(df)


def label_encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace categories by their alphabetical position."""
    outs = [f"{c}_code" for c in cols]
    indexer = StringIndexer(inputCols=list(cols), outputCols=outs, stringOrderType="alphabetAsc", handleInvalid="keep")
    coded = indexer.fit(df).transform(df)
    return coded.withColumns({o: F.col(o).cast("int") for o in outs})


def one_hot(df: DataFrame, col: str) -> DataFrame:
    """Indicator columns for every category but the first in alphabetical order."""
    indexer = StringIndexer(inputCol=col, outputCol="_i", stringOrderType="alphabetDesc").fit(df)
    coded = OneHotEncoder(inputCol="_i", outputCol="_v", dropLast=True).fit(indexer.transform(df)).transform(indexer.transform(df))
    names = indexer.labels[:-1]
    wide = coded.withColumn("_a", vector_to_array("_v"))
    flags = {f"{col}_{n}": F.get("_a", F.lit(i)).cast("int") for i, n in enumerate(names)}
    return wide.withColumns(flags).drop("_i", "_v", "_a")


def standard_scale(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Zero mean, unit population deviation; statistics come from `fit_on` (the training rows)."""
    source = fit_on if fit_on is not None else df
    stats = source.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in cols])
    boxed = df.withColumn("_b", stats.select(F.struct(*cols)).scalar())
    scaled = {c: (F.col(c) - F.col("_b")[c]["m"]) / F.when(F.col("_b")[c]["s"] > 0, F.col("_b")[c]["s"]).otherwise(1.0) for c in cols}
    return boxed.withColumns(scaled).drop("_b")


def balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Weight n / (2 n_class)."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("p"))
    boxed = df.withColumn("_c", counts.select(F.struct("n", "p")).scalar())
    n, p = F.col("_c.n").cast("double"), F.col("_c.p").cast("double")
    weight = F.coalesce(F.try_divide(n, 2 * F.when(F.col(label) == 1, p).otherwise(n - p)), F.lit(1.0))
    return boxed.withColumn("weight", weight).drop("_c")


def score(model: Model, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Probability of the positive class as `score`."""
    return model.transform(df).select(*keep, F.get(vector_to_array("probability"), F.lit(1)).alias("score"))


def logistic(**params) -> LogisticRegression:
    return LogisticRegression(**{"maxIter": 1000, "regParam": 0.0001, **params})


def forest(**params) -> RandomForestClassifier:
    return RandomForestClassifier(**{**FOREST, **params})


def boosted(**params) -> GBTClassifier:
    return GBTClassifier(**{"maxDepth": 3, "maxIter": 100, "stepSize": 0.1, "seed": 42, **params})


def split_report(model: Model, frame: DataFrame, split: str = "data_split") -> DataFrame:
    """Metrics of a fitted classifier per data split."""
    scored = materialize(score(model, frame, [split, "label"]))
    return (
        E.classification_metrics(scored, by=[split])
        .join(E.balanced_accuracy(scored, by=[split]), split)
        .join(E.roc_auc(scored, by=[split]), split)
    )


def fit_on_train(estimator: Estimator, frame: DataFrame, split: str = "data_split") -> Model:
    return estimator.fit(frame.filter(F.col(split) == "train"))


# ---- regressors ---------------------------------------------------------------
def market_boosted(horizon: int, **params) -> GBTRegressor:
    return GBTRegressor(**{**TUNED_MARKET[horizon], "seed": 42, **params})


def regressors(trees: int = 100, **params) -> dict[str, Estimator]:
    """The untuned pair compared on every target; `trees` sets the size of both."""
    common = {"maxDepth": 4, "seed": 42, **params}
    return {
        "forest": RandomForestRegressor(numTrees=trees, **common),
        "boosted": GBTRegressor(maxIter=trees, stepSize=0.05, **common),
    }


def regression_report(frame: DataFrame, features: Sequence[str], targets: Sequence[str], makers: dict,
                      train: Sequence[str], held_out: str, split: str = "data_split") -> DataFrame:
    """Fit each estimator per target on the training splits and score the held-out split."""
    assembled = materialize(assemble(frame, features))
    out = None
    for target in targets:
        usable = assembled.filter(F.col(target).isNotNull())
        for name, estimator in makers.items():
            model = estimator.copy({estimator.labelCol: target}).fit(usable.filter(F.col(split).isin(list(train))))
            guess = model.transform(usable.filter(F.col(split) == held_out)).select(
                F.col(target).alias("truth"), F.col("prediction").alias("guess")
            )
            row = E.regression_metrics(guess).select(F.lit(target).alias("target"), F.lit(name).alias("model"), "*")
            direction = E.directional_accuracy(guess, rules=["sign"]).select("directional_accuracy")
            row = row.withColumn("directional_accuracy", direction.scalar())
            out = row if out is None else out.unionByName(row)
    return out


# ---- tuning -------------------------------------------------------------------
def grid(estimator: Estimator, space: dict[str, Sequence]) -> list[dict]:
    builder = ParamGridBuilder()
    for name, values in space.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    return builder.build()


def draws(estimator: Estimator, space: dict[str, Sequence], n: int, seed: int = 42) -> list[dict]:
    """n distinct random points of the grid (all of them if it has fewer)."""
    every = [dict(zip(space, values, strict=True)) for values in product(*space.values())]
    chosen = random.Random(seed).sample(every, min(n, len(every)))
    return [{estimator.getParam(k): v for k, v in point.items()} for point in chosen]


def grid_search(estimator: Estimator, space: dict[str, Sequence], frame: DataFrame, parallelism: int = 4,
                split: str = "data_split") -> DataFrame:
    """Fit every grid point on train, rank by AUC on val. One result row per point."""
    maps = grid(estimator, space)
    train, val = frame.filter(F.col(split) == "train"), frame.filter(F.col(split) == "val")

    def evaluate(fitted):
        index, model = fitted
        auc = E.roc_auc(score(model, val, ["label"])).first()["auc"]
        return {**{p.name: float(v) for p, v in maps[index].items()}, "auc": auc}

    # The iterator hands out one model per call and is safe to share between threads.
    models = estimator.fitMultiple(train, maps)
    with ThreadPool(min(parallelism, len(maps))) as pool:
        rows = pool.map(lambda _: evaluate(next(models)), range(len(maps)))
    schema = ", ".join([*[f"{name} double" for name in space], "auc double"])
    return frame.sparkSession.createDataFrame(rows, schema).orderBy(F.desc("auc"), *space)


def random_search(estimator: Estimator, space: dict[str, Sequence], frame: DataFrame, target: str, group: str,
                  n: int = 100, folds: int = 3, seed: int = 42, parallelism: int = 4, metric: str = "rmse") -> DataFrame:
    """Random points scored by grouped cross-validation."""
    folded = E.group_folds(frame.filter(F.col(target).isNotNull()), group, folds)
    maps = draws(estimator, space, n, seed)
    validator = CrossValidator(
        estimator=estimator.copy({estimator.labelCol: target}), estimatorParamMaps=maps,
        evaluator=RegressionEvaluator(labelCol=target, metricName=metric),
        numFolds=folds, foldCol="fold", parallelism=parallelism,
    )
    errors = validator.fit(folded).avgMetrics
    rows = [{**{p.name: float(v) for p, v in m.items()}, metric: float(e)} for m, e in zip(maps, errors, strict=True)]
    schema = ", ".join([*[f"{name} double" for name in space], f"{metric} double"])
    return frame.sparkSession.createDataFrame(rows, schema).orderBy(metric, *space)


def learning_curve(makers: dict[str, Estimator], frame: DataFrame, key: Sequence[str], fractions: Sequence[float],
                   split: str = "data_split", parallelism: int = 4) -> DataFrame:
    """Balanced accuracy and AUC on val for nested shares of the training rows."""
    drawn = frame.withColumn("_u", S.hash_fraction(*[F.col(k) for k in key]))
    train, val = drawn.filter(F.col(split) == "train"), drawn.filter(F.col(split) == "val")

    def evaluate(point):
        fraction, name = point
        scored = materialize(score(makers[name].fit(train.filter(F.col("_u") <= fraction)), val, ["label"]))
        return E.roc_auc(scored).select(
            F.lit(float(fraction)).alias("fraction"), F.lit(name).alias("model"), "auc",
            E.balanced_accuracy(scored).scalar().alias("balanced_accuracy"),
        )

    points = list(product(fractions, makers))
    with ThreadPool(min(parallelism, len(points))) as pool:
        return reduce(DataFrame.unionByName, pool.map(evaluate, points))


# ---- importance ---------------------------------------------------------------
def tree_importance(model: Model, features: Sequence[str], spark) -> DataFrame:
    rows = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def permutation_importance(model: Model, df: DataFrame, features: Sequence[str], key: Sequence[str], repeats: int = 10,
                           seed: int = 42) -> DataFrame:
    """Mean drop of AUC when one feature is shuffled.

    Rows get consecutive positions in hash order; row p takes the value of the
    row at (a p + b) mod n, a true permutation found by one equi join. All
    features of a repeat are rescored in one pass.
    """
    base = materialize(positions(df.select(*key, "label", *features), key, "_pos", seed))
    n = base.count()
    values = F.array(*[F.col(f).cast("double") for f in features])
    rows = base.select("_pos", "label", values.alias("own"))
    reference = E.roc_auc(score(model, rows.select("label", array_to_vector("own").alias("features")), ["label"]))
    rng = random.Random(seed)
    scored = None
    for r in range(repeats):
        a = next(x for x in iter(lambda: rng.randrange(1, max(n, 2)), None) if gcd(x, n) == 1)
        b = rng.randrange(n)
        donors = rows.select(F.pmod(F.col("_pos").cast("decimal(19,0)") * F.lit(a).cast("decimal(18,0)") + F.lit(b), F.lit(n)).cast("long").alias("_pos"), F.col("own").alias("other"))
        paired = rows.join(donors, "_pos").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))))
        mixed = F.transform("own", lambda x, i: F.when(i == F.col("j"), F.get("other", i)).otherwise(x))
        part = score(
            model, paired.select("label", "j", F.lit(r).alias("repeat"), array_to_vector(mixed).alias("features")),
            ["label", "j", "repeat"],
        )
        scored = part if scored is None else scored.unionByName(part)
    drops = E.roc_auc(scored, by=["j", "repeat"]).withColumn("drop", reference.scalar() - F.col("auc"))
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("j") + 1)
    return drops.groupBy(name.alias("feature")).agg(
        F.avg("drop").alias("importance"), F.coalesce(F.stddev_samp("drop"), F.lit(0.0)).alias("importance_std")
    )


def importance_by_horizon(tables: dict[str, DataFrame]) -> DataFrame:
    """Join importance tables on feature, with mean and average rank; one row per feature."""
    out = None
    for name, table in tables.items():
        part = table.select("feature", F.col("importance").alias(f"importance_{name}"))
        out = part if out is None else out.join(part, "feature")
    cols = [f"importance_{n}" for n in tables]
    # The table has one row per feature, so the ranking windows are small.
    for c in cols:
        rank = F.rank().over(Window.orderBy(F.desc(c)))
        ties = F.count(F.lit(1)).over(Window.partitionBy(c))
        out = out.withColumn(f"rank_{c[11:]}", rank + (ties - 1) / 2.0)
    ranks = [f"rank_{n}" for n in tables]
    return out.withColumns(
        {
            "mean_importance": S.row_sum([F.col(c) for c in cols]) / len(cols),
            "mean_rank": S.row_sum([F.col(c) for c in ranks]) / len(ranks),
        }
    )


def least_important(table: DataFrame, k: int = 15) -> DataFrame:
    return table.orderBy(F.desc("mean_rank"), "feature").limit(k)


# ---- clustering and factors -----------------------------------------------------
def kmeans_sweep(df: DataFrame, ks: Sequence[int], features: str = "features", seed: int = 42) -> DataFrame:
    """Cost and silhouette (squared Euclidean) for each k."""
    evaluator = ClusteringEvaluator(featuresCol=features)
    rows = []
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol=features).fit(df)
        rows.append((k, float(model.summary.trainingCost), float(evaluator.evaluate(model.transform(df)))))
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def kmeans(df: DataFrame, k: int, features: str = "features", seed: int = 42) -> DataFrame:
    return KMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster").fit(df).transform(df)


def cluster_profile(df: DataFrame, cols: Sequence[str], k: int, cluster: str = "cluster") -> DataFrame:
    """Mean of each feature per cluster, features with the widest spread first."""
    measures = {
        f"cluster_{i}": (lambda c, i=i: F.avg(F.when(F.col(cluster) == i, c.cast("double")))) for i in range(k)
    }
    out = unpivot_aggregates(df, cols, measures, "feature")
    means = [F.col(m) for m in measures]
    return out.withColumn("max_diff", F.greatest(*means) - F.least(*means)).orderBy(F.desc("max_diff"), "feature")


def relative_importance(profile: DataFrame, k: int) -> DataFrame:
    """Each feature's cluster means as shares of their sum."""
    cols = [F.col(f"cluster_{i}") for i in range(k)]
    total = S.row_sum([F.coalesce(c, F.lit(0.0)) for c in cols])
    return profile.select("feature", *[F.try_divide(c, total).alias(f"cluster_{i}") for i, c in enumerate(cols)])


def name_clusters(df: DataFrame, by: str, labels: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Label clusters by their mean of one column, largest first (cluster numbers are arbitrary)."""
    means = df.groupBy(cluster).agg(F.avg(by).alias("_m"))
    place = F.row_number().over(Window.orderBy(F.desc("_m"), cluster))
    named = means.select(cluster, F.get(F.array(*[F.lit(x) for x in labels]), place - 1).alias("segment"))
    return df.join(named, cluster)


def centered(df: DataFrame, features: str = "features", out: str = "centered") -> DataFrame:
    return StandardScaler(inputCol=features, outputCol=out, withMean=True, withStd=False).fit(df).transform(df)


def pca_fit(df: DataFrame, k: int, features: str = "features"):
    data = centered(df, features)
    model = PCA(k=k, inputCol="centered", outputCol="pca").fit(data)
    return model, model.transform(data)


def pca_loadings(model, features: Sequence[str], spark) -> DataFrame:
    """One row per component and feature; the largest loading of a component is made positive."""
    weights = model.pc.toArray()
    rows = []
    for j in range(weights.shape[1]):
        column = weights[:, j]
        sign = 1.0 if column[np.argmax(np.abs(column))] >= 0 else -1.0
        rows += [(j + 1, f, float(sign * w)) for f, w in zip(features, column, strict=True)]
    return spark.createDataFrame(rows, "component int, feature string, loading double")


def pca_variance(model, spark, target: float = 0.9) -> DataFrame:
    """Explained and cumulative variance; `needed` marks the components that reach the target."""
    rows = [(i + 1, float(v)) for i, v in enumerate(model.explainedVariance)]
    table = spark.createDataFrame(rows, "component int, explained double")
    w = Window.orderBy("component")
    total = table.withColumn("cumulative", F.sum("explained").over(w))
    return total.withColumn("needed", F.coalesce(F.lag("cumulative").over(w), F.lit(0.0)) < target)


def row_solver(steps: int):
    """Function giving the non-negative weights of each row for fixed components.

    Built as a closure so that it travels to the workers by value.
    """

    def solve(values, h):
        eps = 1e-10
        top, gram = values @ h.T, h @ h.T
        w = np.maximum(top / (np.trace(gram) + eps), eps)
        for _ in range(steps):
            w *= top / (w @ gram + eps)
        return w

    return solve


def nmf(df: DataFrame, key: Sequence[str], cols: Sequence[str], k: int = 5, iters: int = 200, inner: int = 40,
        seed: int = 42):
    """Non-negative factorisation V ~ W H.

    The components H (k x features) live on the driver. A row's weights depend
    only on that row and H, so each iteration is one pass that returns the two
    small products WtV and WtW; W is never stored. Returns (W frame, H frame,
    losses).
    """
    spark = df.sparkSession
    d = len(cols)
    data = materialize(df.select(*key, F.array(*[F.col(c).cast("double") for c in cols]).alias("v")))
    rng = np.random.default_rng(seed)
    solve = row_solver(inner)
    h = rng.random((k, d)) + 0.1
    losses = []
    for _ in range(iters):
        fixed = h

        def products(batches, fixed=fixed):
            wtv, wtw, loss = np.zeros((k, d)), np.zeros((k, k)), 0.0
            for batch in batches:
                if len(batch):
                    values = np.stack(batch["v"].to_numpy())
                    w = solve(values, fixed)
                    wtv += w.T @ values
                    wtw += w.T @ w
                    loss += float(((values - w @ fixed) ** 2).sum())
            yield pd.DataFrame({"p": [np.concatenate([wtv.ravel(), wtw.ravel(), [loss]])]})

        size = k * d + k * k + 1
        parts = data.select("v").mapInPandas(products, "p array<double>")
        sums = np.array(parts.agg(*[F.sum(F.get("p", F.lit(i))) for i in range(size)]).first(), dtype=float)
        wtv, wtw = sums[: k * d].reshape(k, d), sums[k * d : k * d + k * k].reshape(k, k)
        losses.append(float(sums[-1]))
        for _ in range(5):
            h = h * wtv / (wtw @ h + 1e-10)
        if len(losses) > 2 and losses[-2] - losses[-1] < 1e-6 * max(losses[0], 1e-12):
            break

    final = h

    def weights(batches):
        for batch in batches:
            if len(batch):
                w = solve(np.stack(batch["v"].to_numpy()), final)
                yield batch.drop(columns="v").assign(w=list(w))

    schema = ", ".join([*[f"{c} {dict(df.dtypes)[c]}" for c in key], "w array<double>"])
    w_frame = data.mapInPandas(weights, schema)
    rows = [(i + 1, c, float(h[i, j])) for i in range(k) for j, c in enumerate(cols)]
    return w_frame, spark.createDataFrame(rows, "component int, feature string, weight double"), losses


def top_factor_features(h: DataFrame, top: int = 3) -> DataFrame:
    w = Window.partitionBy("component").orderBy(F.desc("weight"), "feature")
    return h.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def compare_reductions(df: DataFrame, key: Sequence[str], cols: Sequence[str], ks: Sequence[int], components: int = 5,
                       iters: int = 20) -> DataFrame:
    """Silhouette of k-means on PCA scores and on NMF weights for each k."""
    _, projected = pca_fit(materialize(assemble(df, cols)), components)
    w, _, _ = nmf(df, key, cols, components, iters)
    factors = materialize(w.select(*key, array_to_vector("w").alias("factors")))
    left = kmeans_sweep(materialize(projected.select("pca")), ks, "pca").withColumn("reduction", F.lit("pca"))
    right = kmeans_sweep(factors, ks, "factors").withColumn("reduction", F.lit("nmf"))
    return left.unionByName(right)


def save_and_load(model: PipelineModel, spark) -> PipelineModel:
    path = run_folder(spark, "model")
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def fitted_pipeline(frame: DataFrame, categorical: Sequence[str], numeric: Sequence[str], **params) -> PipelineModel:
    """Encode, fill missing numbers with the median, assemble and fit the conversion forest; no row is left out."""
    codes = [f"{c}_code" for c in categorical]
    stages = [
        StringIndexer(inputCols=list(categorical), outputCols=codes, stringOrderType="alphabetAsc", handleInvalid="keep"),
        Imputer(inputCols=list(numeric), outputCols=[f"{c}_known" for c in numeric], strategy="median"),
        VectorAssembler(inputCols=[*[f"{c}_known" for c in numeric], *codes], outputCol="features", handleInvalid="error"),
        forest(**params),
    ]
    return Pipeline(stages=stages).fit(frame)


def top_at_risk(scored: DataFrame, key: Sequence[str], threshold: float = 0.5, k: int = 100) -> DataFrame:
    return scored.filter(F.col("score") >= threshold).orderBy(F.desc("score"), *key).limit(k)
