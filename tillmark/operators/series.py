"""Window operators over a panel with one row per entity and date.

Bring raw events to that shape first (`plans.market.daily_bars`): an entity then
holds at most one row per calendar day, which bounds every window below. For
row-level facts use `operators.chunked`, which also splits the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tillmark.functions import scalars as S


def entity_window(by: Sequence[str] | str, order: str) -> WindowSpec:
    keys = [by] if isinstance(by, str) else list(by)
    return Window.partitionBy(*keys).orderBy(order)


def lags(df: DataFrame, by, order: str, cols: Sequence[str], offsets: Sequence[int] = (1, 5, 10, 20)) -> DataFrame:
    w = entity_window(by, order)
    return df.withColumns({f"{c}_lag_{k}": F.lag(c, k).over(w) for c in cols for k in offsets})


def forward_change(
    df: DataFrame, by, order: str, col: str, horizons: Sequence[int] = (1, 5, 20), relative: bool = True,
    prefix: str = "target_return",
) -> DataFrame:
    """Change of `col` h rows ahead, as a share of today's value or as a difference."""
    w = entity_window(by, order)

    def change(h: int) -> Column:
        delta = F.lead(col, h).over(w) - F.col(col)
        return F.try_divide(delta, F.col(col)) if relative else delta

    return df.withColumns({f"{prefix}_{h}d": change(h) for h in horizons})


def rolling(
    df: DataFrame, by, order: str, col: str, n: int, fn: str = "avg", out: str | None = None,
    min_periods: int = 1, center: bool = False,
) -> DataFrame:
    """Rolling aggregate over n rows; null where fewer than `min_periods` values are present."""
    start, end = (-(n // 2), n // 2) if center else (-(n - 1), 0)
    w = entity_window(by, order).rowsBetween(start, end)
    value = getattr(F, fn)(col).over(w)
    if min_periods > 1:
        value = F.when(F.count(col).over(w) >= min_periods, value)
    return df.withColumn(out or f"{col}_{fn}_{n}", value)


def ffill(df: DataFrame, by, order: str, cols: Sequence[str]) -> DataFrame:
    w = entity_window(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def percent_change(df: DataFrame, by, order: str, col: str, out: str) -> DataFrame:
    w = entity_window(by, order)
    return df.withColumn(out, F.try_divide(F.col(col), F.lag(col).over(w)) - 1)


def z_scores(df: DataFrame, by: str, col: str, expanding: bool = False, order: str = "date") -> DataFrame:
    """Mean, sample deviation and z-score of `col` per entity.

    The whole sample is used by default; `expanding` restricts it to rows up to
    each date.
    """
    if expanding:
        w = entity_window(by, order).rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumns({"avg_return": F.avg(col).over(w), "return_std": F.stddev_samp(col).over(w)})
    else:
        stats = df.groupBy(by).agg(F.avg(col).alias("avg_return"), F.stddev_samp(col).alias("return_std"))
        df = df.join(stats, by, "left")
    return df.withColumn(
        "return_z_score", F.try_divide(F.col(col) - F.col("avg_return"), F.col("return_std"))
    )


def streaks(df: DataFrame, by: str, date: str, max_gap_days: int = 1) -> DataFrame:
    """Number runs of rows no further than `max_gap_days` apart."""
    w = entity_window(by, date)
    gap = F.datediff(date, F.lag(date).over(w))
    starts = gap.isNull() | (gap > max_gap_days)
    flagged = df.withColumn("day_diff", gap).withColumn("new_streak", starts)
    return flagged.withColumn("streak_id", F.sum(F.col("new_streak").cast("int")).over(w))


def last_of_streak(df: DataFrame, by: str, date: str, max_gap_days: int = 1) -> DataFrame:
    """Keep the last row of every run: the one no row follows within the gap."""
    w = entity_window(by, date)
    following = F.datediff(F.lead(date).over(w), date)
    tagged = df.withColumn("_next", following)
    return tagged.filter(F.col("_next").isNull() | (F.col("_next") > max_gap_days)).drop("_next")


def rsi(df: DataFrame, by: str, order: str, col: str, n: int = 14, out: str = "rsi", block: int | None = None) -> DataFrame:
    """Relative strength index with exponential smoothing (weight 1/n), null for the first n-1 rows.

    The recursion y = (1-a) y' + a x is a weighted running sum. Weights are
    taken relative to the start of a block of rows and each block's final value
    is carried into the next, so they stay within double range for any length.
    A block spans at least 64 n rows; what lies two blocks back weighs less than
    the rounding of a double.
    """
    block = block or max(1024, 64 * n)
    decay = 1.0 - 1.0 / n
    w = entity_window(by, order)
    change = F.col(col) - F.lag(col).over(w)
    step = df.withColumns(
        {
            "_up": F.when(change > 0, change).otherwise(0.0),
            "_down": F.when(change < 0, -change).otherwise(0.0),
            "_i": F.row_number().over(w) - 1,
        }
    )
    step = step.withColumn("_block", F.floor(F.col("_i") / block)).withColumn("_j", F.col("_i") % block)
    in_block = Window.partitionBy(by, "_block").orderBy("_i")
    upto = in_block.rowsBetween(Window.unboundedPreceding, 0)
    scale = F.pow(F.lit(decay), -F.col("_j"))
    step = step.withColumns({c: F.sum(F.col(c) * scale).over(upto) / scale for c in ("_up", "_down")})
    # What reaches this block from the last row of the block before it.
    ends = step.groupBy(by, "_block").agg(*[F.max_by(c, "_i").alias(f"{c}_end") for c in ("_up", "_down")])
    ends = ends.withColumn("_block", F.col("_block") + 1)
    step = step.join(ends, [by, "_block"], "left")
    fade = F.pow(F.lit(decay), F.col("_j") + 1)
    up = F.col("_up") + F.coalesce(F.col("_up_end") * fade, F.lit(0.0))
    down = F.col("_down") + F.coalesce(F.col("_down_end") * fade, F.lit(0.0))
    value = F.when(down == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + F.try_divide(up, down)))
    step = step.withColumn(out, F.when(F.col("_i") >= n - 1, value))
    return step.drop("_up", "_down", "_i", "_j", "_block", "_up_end", "_down_end")


def history_array(df: DataFrame, by: str, order: str, cols: Sequence[str], n: int = 60, out: str = "feature_window",
                  pad: bool = True) -> DataFrame:
    """The n rows before each row, oldest first, with nulls in front where history is short."""
    w = entity_window(by, order).rowsBetween(-n, -1)
    past = F.collect_list(F.struct(*cols)).over(w)
    if pad:
        empty = F.struct(*[F.lit(None).cast(dict(df.dtypes)[c]).alias(c) for c in cols])
        past = F.concat(F.array_repeat(empty, n - F.size(past)), past)
    return df.withColumn(out, past)


def technical_indicators(df: DataFrame, by: str, order: str, col: str, n: int = 10) -> DataFrame:
    """Simple moving average, Bollinger bands (two deviations) and momentum."""
    w = entity_window(by, order)
    back = w.rowsBetween(-(n - 1), 0)
    full = F.count(col).over(back) >= n
    mean, spread = F.avg(col).over(back), F.stddev_samp(col).over(back)
    return df.withColumns(
        {
            f"sma_{n}": F.when(full, mean),
            f"bollinger_upper_{n}": F.when(full, mean + 2 * spread),
            f"bollinger_lower_{n}": F.when(full, mean - 2 * spread),
            f"momentum_{n}d": F.col(col) - F.lag(col, n).over(w),
        }
    )


def safe_return(close: str = "close", open_: str = "open") -> Column:
    return S.ratio(F.col(close) - F.col(open_), F.col(open_))
