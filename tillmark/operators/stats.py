"""Column statistics computed in a single aggregation, returned in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.functions import scalars as S
from tillmark.operators.quantiles import exact_quantiles



def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    return [c for c, t in df.dtypes if t.split("(")[0] in kinds and c not in exclude]


def corr_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every ordered pair, pairwise complete."""
    data = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[:i]]
    row = data.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("feature_1"), F.lit(a).alias("feature_2"), F.lit(1.0).alias("correlation")) for a in cols]
    for i, (a, b) in enumerate(pairs):
        for x, y in ((a, b), (b, a)):
            cells.append(F.struct(F.lit(x).alias("feature_1"), F.lit(y).alias("feature_2"), F.col(f"{i}").alias("correlation")))
    return row.select(F.inline(F.array(*cells)))


def high_corr(corr: DataFrame, threshold: float = 0.85) -> DataFrame:
    """One row per pair above the threshold, strongest first."""
    strong = corr.filter((F.col("feature_1") > F.col("feature_2")) & (F.abs("correlation") > threshold))
    return strong.orderBy(F.desc(F.abs("correlation")), "feature_1", "feature_2")


def skew_sample(value: Column) -> Column:
    """Bias-corrected skewness."""
    n = F.count(value).cast("double")
    return F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(value))


def kurtosis_sample(value: Column) -> Column:
    """Bias-corrected excess kurtosis."""
    n = F.count(value).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value) + 6))


def unpivot_aggregates(df: DataFrame, cols: Sequence[str], measures: dict, name: str = "column") -> DataFrame:
    """One aggregation over all columns, one output row per column."""
    row = df.agg(
        *[F.struct(*[fn(F.col(c)).alias(m) for m, fn in measures.items()]).alias(f"s{i}") for i, c in enumerate(cols)]
    )
    cells = [
        F.struct(F.lit(c).alias(name), *[F.col(f"s{i}")[m].alias(m) for m in measures]) for i, c in enumerate(cols)
    ]
    return row.select(F.inline(F.array(*cells)))


def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return unpivot_aggregates(
        df,
        cols,
        {
            "n": F.count,
            "mean": F.avg,
            "std": F.stddev_samp,
            "min_value": F.min,
            "max_value": F.max,
            "skew": skew_sample,
            "kurtosis": kurtosis_sample,
        },
        "target",
    )


def sign_shares(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return unpivot_aggregates(
        df,
        cols,
        {
            "share_positive": lambda c: S.ratio(F.count_if(c > 0), F.count(c)),
            "share_negative": lambda c: S.ratio(F.count_if(c < 0), F.count(c)),
        },
        "target",
    )


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max of each column."""
    data = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    base = unpivot_aggregates(
        data, cols, {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    )
    quartiles = exact_quantiles(data, cols, [0.25, 0.5, 0.75])
    wide = quartiles.groupBy("column").agg(
        *[F.max(F.when(F.col("q") == q, F.col("value"))).alias(f"p{round(q * 100)}") for q in (0.25, 0.5, 0.75)]
    )
    return base.join(wide, "column")


def null_audit(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or df.columns)
    return unpivot_aggregates(
        df,
        cols,
        {
            "nulls": lambda c: F.count_if(c.isNull()),
            "null_pct": lambda c: S.ratio(F.count_if(c.isNull()) * 100, F.count(F.lit(1))),
        },
    )


def null_counts_by(df: DataFrame, by: str, cols: Sequence[str], k: int = 10) -> DataFrame:
    """The k keys with most nulls."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in cols[1:]), F.count_if(F.col(cols[0]).isNull()))
    return df.groupBy(by).agg(nulls.alias("nulls")).orderBy(F.desc("nulls"), by).limit(k)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, col: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width counts between the overall minimum and maximum."""
    span = df.agg(F.struct(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))).scalar()
    value = F.col(col).cast("double")
    slot = F.when(
        span["hi"] > span["lo"],
        F.least(F.floor((value - span["lo"]) * bins / (span["hi"] - span["lo"])), F.lit(bins - 1)),
    ).otherwise(F.lit(0))
    return df.filter(value.isNotNull()).groupBy(*by, slot.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def group_difference(df: DataFrame, cols: Sequence[str], flag: str, names: tuple[str, str]) -> DataFrame:
    """Mean of each column in both groups, largest absolute difference first."""
    off, on = names
    out = unpivot_aggregates(
        df,
        cols,
        {
            on: lambda c: F.avg(F.when(F.col(flag) == 1, c.cast("double"))),
            off: lambda c: F.avg(F.when(F.col(flag) == 0, c.cast("double"))),
        },
        "feature",
    )
    return out.withColumn("difference", F.col(on) - F.col(off)).orderBy(F.desc(F.abs("difference")), "feature")
