"""Market panel: assembly, features, volatility shocks and targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillmark.functions import scalars as S
from tillmark.operators import series
from tillmark.operators.asof import asof_join
from tillmark.operators.reshape import composite_join

ID, DAY = "entity_id", "date"
HORIZONS = (1, 5, 20)


def daily_bars(events: DataFrame, entity: str, ts: str, price: str, tiebreak: str) -> DataFrame:
    """Open, close and volume per entity and day; merged on the map side."""
    order = F.struct(ts, tiebreak)
    return events.groupBy(F.col(entity).alias(ID), F.to_date(ts).alias(DAY)).agg(
        F.min_by(price, order).alias("open"),
        F.max_by(price, order).alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )


def clean_metadata(metadata: DataFrame) -> DataFrame:
    rating = F.col("RD_CREDIT_RATING_GLOBAL")
    return metadata.select(
        "SP_ENTITY_ID", "SP_TICKER", F.col("SP_ENTITY_NAME").alias("entity_name"),
        S.credit_rating_rank(rating).alias("credit_rating_rank"),
        (rating == "NR").cast("int").alias("was_not_rated"),
        F.coalesce("SP_COMMON_DIV_DECLARED", F.lit(0)).alias("dividend"),
    )


def attach_metadata(bars: DataFrame, metadata: DataFrame) -> DataFrame:
    return composite_join(bars, clean_metadata(metadata), {ID: "SP_ENTITY_ID", "ticker": "SP_TICKER"})


def pivot_metrics(periodic: DataFrame, metrics: list[str]) -> DataFrame:
    """Long metric table to one column per metric; the smallest value of a cell is taken."""
    return periodic.groupBy(ID, "period_end").agg(
        *[F.min(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics]
    )


def market_panel(
    bars: DataFrame, metadata: DataFrame, periodic: DataFrame, macro: DataFrame, metrics: list[str],
    tolerance_days: float = 100, lag_days: int = 0,
) -> DataFrame:
    """Daily bars with metadata, latest known periodic metrics and the macro series."""
    panel = attach_metadata(bars, metadata)
    panel = asof_join(
        panel, pivot_metrics(periodic, metrics), on=DAY, right_on="period_end", by=[ID],
        tolerance_days=tolerance_days, chunk_days=None, lag_days=lag_days,
    )
    return panel.join(macro, DAY, "left")


def lagged_returns(bars: DataFrame) -> DataFrame:
    """Open-to-close return and its lags."""
    return series.lags(bars.withColumn("return_t", series.safe_return()), ID, DAY, ["return_t"])


def moving_averages(bars: DataFrame, windows=(1, 5, 10, 20)) -> DataFrame:
    out = bars
    for n in windows:
        out = series.rolling(out, ID, DAY, "close", n, out=f"ma_close_{n}")
    return series.rolling(out, ID, DAY, "volume", 20, out="volume_ma_20")


def market_daily(bars: DataFrame) -> DataFrame:
    """One row per day: mean absolute and mean signed open-to-close return."""
    moved = bars.withColumn("r", series.safe_return())
    return moved.groupBy(DAY).agg(F.avg(F.abs("r")).alias("avg_abs_return"), F.avg("r").alias("avg_raw_return"))


def rolling_market_vol(bars: DataFrame, windows=(5, 10, 20)) -> DataFrame:
    """Rolling deviation of the daily market series (one row per day, so one window is enough)."""
    daily = market_daily(bars)
    order = Window.orderBy(DAY)
    return daily.withColumns(
        {f"rolling_market_vol_{n}d": F.stddev_samp("avg_abs_return").over(order.rowsBetween(-(n - 1), 0)) for n in windows}
    )


def macro_delta(macro: DataFrame, n: int = 20, col: str = "spread") -> DataFrame:
    """Value n observations ago and the change since, on the macro series itself."""
    w = Window.orderBy(DAY)
    return macro.withColumn(f"{col}_lag", F.lag(col, n).over(w)).withColumn(
        f"{col}_delta", F.col(col) - F.col(f"{col}_lag")
    )


def ffill_macro(days: DataFrame, macro: DataFrame, col: str = "spread") -> DataFrame:
    """Macro series on every trading day, gaps filled from the last observation."""
    w = Window.orderBy(DAY).rowsBetween(Window.unboundedPreceding, 0)
    joined = days.select(DAY).distinct().join(macro, DAY, "left")
    return joined.withColumn(col, F.last(col, ignorenulls=True).over(w))


def daily_return(bars: DataFrame) -> DataFrame:
    return series.percent_change(bars, ID, DAY, "close", "daily_return")


def scored_returns(bars: DataFrame, expanding: bool = False) -> DataFrame:
    return series.z_scores(daily_return(bars), ID, "daily_return", expanding, DAY)


def shocks(bars: DataFrame, z: float = 2.0, expanding: bool = False) -> DataFrame:
    return scored_returns(bars, expanding).filter(F.abs("return_z_score") > z)


def distinct_shocks(bars: DataFrame, z: float = 2.0, max_gap_days: int = 1) -> DataFrame:
    """Shocks with consecutive days collapsed to the last one."""
    return series.last_of_streak(shocks(bars, z), ID, DAY, max_gap_days).withColumn(
        "shock_polarity",
        F.when(F.col("daily_return") > 0, "positive").when(F.col("daily_return") < 0, "negative").otherwise("neutral"),
    )


def shock_summary(bars: DataFrame, z: float = 2.0) -> DataFrame:
    """Total shocks, shocks after collapsing streaks, entities concerned."""
    tagged = series.streaks(shocks(bars, z), ID, DAY)
    return tagged.agg(
        F.count(F.lit(1)).alias("total_shocks"),
        F.count_if("new_streak").alias("non_redundant_shocks"),
        F.countDistinct(ID).alias("entities"),
    )


def shocks_per_entity(bars: DataFrame, metadata: DataFrame, z: float = 2.0, k: int = 25) -> DataFrame:
    counted = distinct_shocks(bars, z).groupBy(ID).agg(F.count(F.lit(1)).alias("shock_count"))
    names = metadata.select(F.col("SP_ENTITY_ID").alias(ID), F.col("SP_ENTITY_NAME").alias("entity_name"))
    return counted.join(names, ID, "left").orderBy(F.desc("shock_count"), ID).limit(k)


def shocks_per_day(bars: DataFrame, z: float = 2.0) -> DataFrame:
    return distinct_shocks(bars, z).groupBy(DAY).agg(F.count(F.lit(1)).alias("num_shocks"))


def shocks_per_month(bars: DataFrame, z: float = 2.0) -> DataFrame:
    months = [F.quarter(DAY).alias("quarter"), F.trunc(DAY, "month").alias("month")]
    return distinct_shocks(bars, z).groupBy(*months).agg(F.count(F.lit(1)).alias("num_shocks"))


def shocks_rolling(bars: DataFrame, z: float = 2.0, n: int = 7) -> DataFrame:
    """Shocks per day with an n-day mean, null until n days exist."""
    w = Window.orderBy(DAY).rowsBetween(-(n - 1), 0)
    mean = S.ratio(F.sum("num_shocks").over(w), F.count(F.lit(1)).over(w))
    return shocks_per_day(bars, z).withColumn("rolling_avg", F.when(F.count(F.lit(1)).over(w) >= n, mean))


def daily_polarity(bars: DataFrame, z: float = 2.0) -> DataFrame:
    daily = distinct_shocks(bars, z).groupBy(DAY).agg(
        F.count_if(F.col("shock_polarity") == "positive").alias("num_pos_shocks"),
        F.count_if(F.col("shock_polarity") == "negative").alias("num_neg_shocks"),
    )
    return daily.withColumn("total", F.col("num_pos_shocks") + F.col("num_neg_shocks")).withColumn(
        "net_shock_score", F.col("num_pos_shocks") - F.col("num_neg_shocks")
    )


def top_shock_days(bars: DataFrame, z: float = 2.0, k: int = 5) -> DataFrame:
    """The k days with most positive and the k days with most negative shocks."""
    daily = daily_polarity(bars, z)
    parts = []
    for name, col in (("positive", "num_pos_shocks"), ("negative", "num_neg_shocks")):
        best = daily.orderBy(F.desc(col), DAY).limit(k)
        parts.append(best.select(F.lit(name).alias("side"), DAY, F.col(col).alias("num_shocks")))
    return parts[0].unionByName(parts[1])


def top_movers(bars: DataFrame, k: int = 20) -> DataFrame:
    moved = daily_return(bars).withColumn("abs_return", F.abs("daily_return")).withColumn(
        "pct_move", series.safe_return() * 100
    )
    return (
        moved.filter(F.col("abs_return").isNotNull())
        .orderBy(F.desc("abs_return"), ID, DAY)
        .select(ID, DAY, "open", "close", "daily_return", "abs_return", "pct_move")
        .limit(k)
    )


def with_targets(events: DataFrame, bars: DataFrame, horizons=HORIZONS, relative: bool = True) -> DataFrame:
    """Forward returns (or price differences) attached to the selected entity-days."""
    prefix = "target_return" if relative else "target_delta"
    ahead = series.forward_change(bars, ID, DAY, "close", horizons, relative, prefix)
    targets = ahead.select(ID, DAY, *[f"{prefix}_{h}d" for h in horizons])
    return events.join(targets, [ID, DAY], "left")


def model_frame(bars: DataFrame, macro: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Feature table per entity-day with forward-return targets."""
    frame = series.lags(bars.withColumn("return_t", series.safe_return()), ID, DAY, ["return_t", "close"], (1, 5))
    frame = series.rolling(frame, ID, DAY, "close", 5, out="ma_close_5")
    frame = series.rsi(frame, ID, DAY, "close", 14, out="rsi_14")
    frame = frame.join(market_daily(bars), DAY, "left")
    frame = frame.join(ffill_macro(bars, macro), DAY, "left")
    frame = series.z_scores(daily_return(frame), ID, "daily_return", False, DAY)
    return series.forward_change(frame, ID, DAY, "close", horizons)


def mean_baseline(df: DataFrame, targets: list[str], split: str, train: str = "train", held_out: str = "val") -> DataFrame:
    """Predict the training mean of each target; score the held-out split."""
    is_train, is_out = F.col(split) == train, F.col(split) == held_out
    means = df.agg(F.struct(*[F.avg(F.when(is_train, F.col(t))).alias(t) for t in targets])).scalar()
    boxed = df.filter(is_out).withColumn("_mean", means)
    row = boxed.agg(
        *[
            F.struct(
                F.first(F.col("_mean")[t]).alias("mean_prediction"),
                F.avg(F.abs(F.col(t) - F.col("_mean")[t])).alias("mae"),
                F.sqrt(F.avg(F.pow(F.col(t) - F.col("_mean")[t], 2))).alias("rmse"),
                (
                    1 - F.try_divide(F.avg(F.pow(F.col(t) - F.col("_mean")[t], 2)), F.var_pop(F.col(t)))
                ).alias("r2"),
            ).alias(t)
            for t in targets
        ]
    )
    fields = ("mean_prediction", "mae", "rmse", "r2")
    cells = [F.struct(F.lit(t).alias("target"), *[F.col(t)[f].alias(f) for f in fields]) for t in targets]
    return row.select(F.inline(F.array(*cells)))


def top_features_by_horizon(df: DataFrame, features: list[str], targets: list[str], k: int = 3) -> DataFrame:
    """Features ranked by absolute correlation with each target; k kept per target."""
    row = df.agg(*[F.abs(F.corr(f, t)).alias(f"{i}_{j}") for i, f in enumerate(features) for j, t in enumerate(targets)])
    cells = [
        F.struct(F.lit(t).alias("target"), F.lit(f).alias("feature"), F.col(f"{i}_{j}").alias("strength"))
        for i, f in enumerate(features)
        for j, t in enumerate(targets)
    ]
    long = row.select(F.inline(F.array(*cells)))
    w = Window.partitionBy("target").orderBy(F.desc_nulls_last("strength"), "feature")
    return long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def presence(ranked: DataFrame, targets: list[str]) -> DataFrame:
    """Which lists each feature appears in, and in how many."""
    flags = [F.max((F.col("target") == t).cast("int")).alias(f"in_{t}") for t in targets]
    return ranked.groupBy("feature").agg(*flags, F.countDistinct("target").alias("n_lists"))
