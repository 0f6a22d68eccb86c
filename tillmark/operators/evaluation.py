"""Metrics over scored rows, each one aggregation (AUC adds a ranking of distinct scores)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.functions import scalars as S
from tillmark.operators.ranking import prefix_sums
from tillmark.session import shared_dir


def confusion(scored: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    hit, actual = F.col("score") >= threshold, F.col("label") == 1
    return scored.groupBy(*by).agg(
        F.count_if(hit & actual).alias("tp"),
        F.count_if(hit & ~actual).alias("fp"),
        F.count_if(~hit & actual).alias("fn"),
        F.count_if(~hit & ~actual).alias("tn"),
    )


def classification_metrics(scored: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return confusion(scored, threshold, by).withColumns(
        {
            "accuracy": S.ratio(tp + tn, tp + fp + fn + tn),
            "precision": S.safe_ratio(tp, tp + fp),
            "recall": S.safe_ratio(tp, tp + fn),
            "f1": S.safe_ratio(2 * tp, 2 * tp + fp + fn),
        }
    )


def balanced_accuracy(scored: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the recalls of both classes."""
    table = confusion(scored, threshold, by)
    recalls = [S.ratio(F.col("tp"), F.col("tp") + F.col("fn")), S.ratio(F.col("tn"), F.col("tn") + F.col("fp"))]
    return table.select(*by, ((recalls[0] + recalls[1]) / 2).alias("balanced_accuracy"))


def roc_auc(scored: DataFrame, by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Exact area under the ROC curve, ties counted half.

    Rows shrink to one per distinct score before any ordering takes place. These rows are stored, because the ranges and
    the sums read them three times, and a model may stand behind them.
    """
    counts = scored.groupBy(*by, "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    shared_dir(counts.sparkSession)
    ranked = prefix_sums(counts.checkpoint(eager=True), "score", ["neg"], ranges, by)
    # pairs of rows outgrow a long, so they are added as decimals
    wide = "decimal(19,0)"
    won = F.sum(F.col("pos").cast(wide) * (2 * F.col("neg_before") + F.col("neg")).cast(wide))
    total = 2.0 * F.sum("pos") * F.sum("neg")
    return ranked.groupBy(*by).agg(F.try_divide(won.cast("double"), total).alias("auc"))


def regression_metrics(scored: DataFrame, truth: str = "truth", guess: str = "guess", by: Sequence[str] = ()) -> DataFrame:
    error = F.col(truth) - F.col(guess)
    kept = scored.filter(F.col(truth).isNotNull() & F.col(guess).isNotNull())
    return kept.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.try_divide(F.avg(error * error), F.var_pop(truth))).alias("r2"),
    )


SIGN_RULES = {
    "sign": lambda a, b: F.signum(a) == F.signum(b),
    "at_least_zero": lambda a, b: (a >= 0) == (b >= 0),
    "above_zero": lambda a, b: (a > 0) == (b > 0),
}


def directional_accuracy(scored: DataFrame, truth: str = "truth", guess: str = "guess",
                         rules: Sequence[str] = tuple(SIGN_RULES), by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose predicted direction is right, under each sign rule."""
    kept = scored.filter(F.col(truth).isNotNull() & F.col(guess).isNotNull())
    agree = [S.ratio(F.count_if(SIGN_RULES[r](F.col(truth), F.col(guess))), F.count(F.lit(1))).alias(r) for r in rules]
    return kept.groupBy(*by).agg(*agree).unpivot([*by], [*rules], "rule", "directional_accuracy")


def group_folds(df: DataFrame, group: str, k: int = 5, out: str = "fold") -> DataFrame:
    """Fold number by hash of the group, so all rows of a group share a fold."""
    return df.withColumn(out, S.hash_bucket(k, F.col(group)).cast("int"))


def silhouette(df: DataFrame, features: str, cluster: str) -> DataFrame:
    """Exact silhouette of each row under squared Euclidean distance.

    The mean squared distance to a cluster follows from its size, mean vector
    and mean squared norm, so clusters are summarised once (one row each, k
    rows in all) and rows are never paired with each other. The clusters' summaries
    are one array, so `cluster` must be a label with few values. Vectors of unequal
    length are refused.
    """
    sizes = df.filter(F.col(cluster).isNotNull()).agg(F.min(F.size(features)), F.max(F.size(features))).first()
    if sizes[0] != sizes[1]:
        raise ValueError(f"vectors have between {sizes[0]} and {sizes[1]} components")
    size = sizes[0] or 0
    vector = F.transform(features, lambda x: x.cast("double"))
    norm = F.aggregate("_x", F.lit(0.0), lambda acc, x: acc + x * x)
    data = df.filter(F.col(cluster).isNotNull()).withColumn("_x", vector).withColumn("_norm", norm)
    means = F.array(*[F.avg(F.get("_x", F.lit(i))) for i in range(size)])
    summary = data.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"), means.alias("mean"), F.avg("_norm").alias("mean_norm")
    )
    boxes = summary.agg(F.collect_list(F.struct(F.col(cluster).alias("c"), "n", "mean", "mean_norm"))).scalar()
    boxed = data.withColumn("_boxes", boxes)

    def distance(box: Column) -> Column:
        dot = F.aggregate(
            F.zip_with(F.col("_x"), box["mean"], lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x
        )
        mean = F.col("_norm") + box["mean_norm"] - 2 * dot
        own = box["c"] == F.col(cluster)
        n = box["n"].cast("double")
        return F.struct(own.alias("own"), n.alias("n"), F.when(own, F.try_divide(mean * n, n - 1)).otherwise(mean).alias("d"))

    measured = boxed.withColumn("_d", F.transform("_boxes", distance))
    a = F.get(F.filter("_d", lambda s: s["own"]), F.lit(0))
    b = F.array_min(F.transform(F.filter("_d", lambda s: ~s["own"]), lambda s: s["d"]))
    value = F.when(a["n"] <= 1, 0.0).otherwise(F.coalesce(F.try_divide(b - a["d"], F.greatest(a["d"], b)), F.lit(0.0)))
    return measured.withColumn("silhouette", value).drop("_x", "_norm", "_boxes", "_d")
