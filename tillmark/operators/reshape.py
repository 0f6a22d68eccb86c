"""Column selection, pivots, samples and small relational steps with column names as parameters."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def add_prefix(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keep})


def select_by_pattern(df: DataFrame, pattern: str | None = None, kinds: Sequence[str] | None = None,
                      exclude: Sequence[str] = ()) -> DataFrame:
    """Columns by name pattern and / or type prefix, minus exclusions."""
    chosen = [
        c for c, kind in df.dtypes
        if c not in exclude
        and (pattern is None or re.search(pattern, c))
        and (kinds is None or any(kind.startswith(k) for k in kinds))
    ]
    return df.select(*chosen)


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def pivot_sum(df: DataFrame, keys: Sequence[str], column: str, values: Sequence, amount: str, prefix: str = "",
              fill=0) -> DataFrame:
    """Wide sums with declared pivot values; one aggregation, no extra job to discover them."""
    sums = [F.sum(F.when(F.col(column) == v, F.col(amount))) for v in values]
    return df.groupBy(*keys).agg(
        *[F.coalesce(s, F.lit(fill)).alias(f"{prefix}{v}") for s, v in zip(sums, values, strict=True)]
    )


def pivot_first(df: DataFrame, keys: Sequence[str], column: str, values: Sequence, value: str) -> DataFrame:
    """Wide form taking one value per cell; the smallest wins when a cell has several."""
    return df.groupBy(*keys).agg(*[F.min(F.when(F.col(column) == v, F.col(value))).alias(str(v)) for v in values])


def hash_sample(df: DataFrame, key: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """Repeatable random sample of n rows."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))
    return df.orderBy(order, *key).limit(n)


def attach_group_stats(df: DataFrame, by: str, col: str) -> DataFrame:
    """Mean and sample deviation of the row's group.

    Aggregated on the map side and joined back, so a dominant group is never
    buffered in one task as a window over the group would.
    """
    mean = F.try_divide(F.sum(col).cast("double"), F.count(col).cast("double"))
    stats = df.groupBy(by).agg(mean.alias(f"{col}_mean"), F.stddev_samp(col).alias(f"{col}_std"))
    return df.join(stats, by)


def composite_join(left: DataFrame, right: DataFrame, pairs: dict[str, str], how: str = "left") -> DataFrame:
    """Join on keys named differently on both sides (`left name -> right name`)."""
    renamed = right.withColumnsRenamed({r: l for l, r in pairs.items()})
    return left.join(renamed, list(pairs), how)
