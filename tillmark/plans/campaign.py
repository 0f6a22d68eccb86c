"""Campaign significance, cost efficiency, allocation and conversion reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillmark.functions import scalars as S

COMPOSITE = ["campaign_name", "market", "channel"]


def control_exposed_counts(responses: DataFrame, keys: Sequence[str] = COMPOSITE) -> DataFrame:
    control, exposed = F.col("arm") == "control", F.col("arm") == "exposed"
    return responses.groupBy(*keys).agg(
        F.count_if(control).alias("control_responses"),
        F.count_if(exposed).alias("exposed_responses"),
        F.count_if(control & (F.col("considered") == 1)).alias("control_considered"),
        F.count_if(exposed & (F.col("considered") == 1)).alias("exposed_considered"),
    )


def ztest(counts: DataFrame) -> DataFrame:
    """Two-proportion z-test with pooled variance, control against exposed, two-sided p."""
    n1, n2 = F.col("control_responses").cast("double"), F.col("exposed_responses").cast("double")
    x1, x2 = F.col("control_considered").cast("double"), F.col("exposed_considered").cast("double")
    pooled = F.try_divide(x1 + x2, n1 + n2)
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    rated = counts.withColumns(
        {"control_rate": F.try_divide(x1, n1), "exposed_rate": F.try_divide(x2, n2)}
    ).withColumn("absolute_lift", F.col("exposed_rate") - F.col("control_rate"))
    rated = rated.withColumn("z", F.try_divide(F.col("control_rate") - F.col("exposed_rate"), error))
    return rated.withColumn("p_value", 2 * S.normal_tail(F.abs("z")))


def significant(tested: DataFrame, level: float = 0.05) -> DataFrame:
    return tested.filter(F.col("p_value") < level)


def lift_join(history: DataFrame, tested: DataFrame, keys: Sequence[str] = COMPOSITE) -> DataFrame:
    return history.join(tested.select(*keys, "absolute_lift", "p_value"), list(keys), "left")


def cost_per_lifted_user(joined: DataFrame) -> DataFrame:
    """Spend over reach times lift; null where nobody was lifted."""
    influenced = F.col("reach") * F.col("absolute_lift")
    return joined.withColumn("influenced_users", influenced).withColumn(
        "cost_per_lifted_user", F.when(influenced > 0, F.try_divide(F.col("spend").cast("double"), influenced))
    )


def cpa(history: DataFrame, keys: Sequence[str] = ("market", "channel")) -> DataFrame:
    return history.groupBy(*keys).agg(
        F.sum("spend").alias("spend"),
        F.sum("conversions").alias("conversions"),
        S.ratio(F.sum("spend"), F.sum("conversions")).alias("cpa"),
    )


def market_totals(responses: DataFrame, history: DataFrame, key: str = "market") -> DataFrame:
    tested = ztest(control_exposed_counts(responses, [key]))
    totals = history.groupBy(key).agg(
        F.sum("spend").alias("spend"), F.sum("reach").alias("reach"), F.sum("conversions").alias("conversions")
    )
    return cost_per_lifted_user(lift_join(totals, tested, [key])).withColumn(
        "cpa", S.ratio(F.col("spend"), F.col("conversions"))
    )


def scorecard(totals: DataFrame, key: str = "market") -> DataFrame:
    """Rank of each market on cost per acquisition, cost per lifted user and lift (1 is best).

    The table has one row per market, so the ranking windows are small.
    """

    def place(order):
        return F.rank().over(Window.orderBy(order))

    return totals.select(
        key,
        place(F.asc_nulls_last("cpa")).alias("cpa_rank"),
        place(F.asc_nulls_last("cost_per_lifted_user")).alias("cplu_rank"),
        place(F.desc_nulls_last("absolute_lift")).alias("lift_rank"),
    )


def allocate_budget(totals: DataFrame, budget: float, key: str = "market") -> DataFrame:
    """Split a budget in proportion to lifted users per unit of spend."""
    weighted = totals.withColumn(
        "weight", F.coalesce(F.try_divide(F.lit(1.0), F.col("cost_per_lifted_user")), F.lit(0.0))
    )
    total = F.sum("weight").over(Window.partitionBy())
    share = F.coalesce(F.try_divide(F.col("weight"), total), F.lit(0.0))
    return weighted.select(key, share.alias("share"), (share * budget).alias("budget"))


def segment_rates(people: DataFrame, segment, flag: str = "y", name: str = "segment") -> DataFrame:
    """Buy rate per segment and its uplift on the overall rate."""
    overall = people.agg(S.ratio(F.sum(flag), F.count(F.lit(1)))).scalar()
    rates = people.groupBy(segment.alias(name)).agg(
        F.count(F.lit(1)).alias("customers"), S.ratio(F.sum(flag), F.count(F.lit(1))).alias("buy_rate")
    )
    return rates.withColumn("uplift", F.try_divide(F.col("buy_rate"), overall))


def contact_band(days, low: int = 50, high: int = 200):
    return (
        F.when(days < 0, "never")
        .when(days < low, f"under {low}")
        .when(days <= high, f"{low}-{high}")
        .otherwise(f"over {high}")
    )


def threshold_steps(start: float = 0.5, step: float = 0.05, stop: float = 0.05) -> list[float]:
    n = round((start - stop) / step) + 1
    return [round(start - i * step, 10) for i in range(n)]


def threshold_sweep(scored: DataFrame, start: float = 0.5, step: float = 0.05, stop: float = 0.05,
                    caution_at: float = 0.3) -> DataFrame:
    """Confusion counts and metrics for a falling threshold, from one pass over the scored rows."""
    steps = threshold_steps(start, step, stop)
    hit, actual = [F.col("score") >= s for s in steps], F.col("label") == 1
    row = scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(actual).alias("p"),
        *[F.count_if(h & actual).alias(f"tp{i}") for i, h in enumerate(hit)],
        *[F.count_if(h & ~actual).alias(f"fp{i}") for i, h in enumerate(hit)],
    )
    cells = [
        F.struct(
            F.lit(s).alias("threshold"),
            F.col(f"tp{i}").alias("tp"),
            F.col(f"fp{i}").alias("fp"),
            (F.col("p") - F.col(f"tp{i}")).alias("fn"),
            (F.col("n") - F.col("p") - F.col(f"fp{i}")).alias("tn"),
            (F.col(f"tp{i}") - (F.col(f"tp{i - 1}") if i else F.lit(0))).alias("new_tp"),
        )
        for i, s in enumerate(steps)
    ]
    out = row.select(F.inline(F.array(*cells)))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.withColumns(
        {
            "accuracy": S.ratio(tp + tn, tp + fp + fn + tn),
            "precision": S.safe_ratio(tp, tp + fp),
            "recall": S.safe_ratio(tp, tp + fn),
            "caution": F.col("threshold") <= caution_at,
        }
    )


def new_true_positives(scored: DataFrame, start: float = 0.5, step: float = 0.05, stop: float = 0.05) -> DataFrame:
    """True positives with the first (largest) threshold at which each is found."""
    steps = threshold_steps(start, step, stop)
    first = F.lit(None).cast("double")
    for s in steps[::-1]:
        first = F.when(F.col("score") >= s, F.lit(s)).otherwise(first)
    found = scored.filter(F.col("label") == 1).withColumn("found_at", first)
    return found.filter(F.col("found_at").isNotNull())
