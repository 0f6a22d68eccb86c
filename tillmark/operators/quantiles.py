"""Exact interpolated quantiles without sorting a column in one task.

An approximate sketch brackets the wanted rank; only the values inside the
bracket (a few ten-thousandths of the rows) are counted by value and ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 20_000


def exact_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """Long frame `(column, q, value)` of interpolated quantiles, nulls ignored."""
    data = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    margin = 3.0 / ACCURACY
    edges = [min(max(q + side * margin, 0.0), 1.0) for q in qs for side in (-1, 1)]
    bounds = data.agg(*[F.percentile_approx(c, edges, ACCURACY).alias(c) for c in cols])
    # One reference to the subquery; the expressions below read the attached column.
    data = data.withColumn("_box", bounds.select(F.struct(*cols).alias("b")).scalar())
    # SQL text keeps the number of driver calls small where columns and quantiles multiply.
    slots = [
        (c, f"s_{c}_{i}", repr(float(q)) + "D", f"_box.`{c}`[{2 * i}]", f"_box.`{c}`[{2 * i + 1}]")
        for c in cols
        for i, q in enumerate(qs)
    ]
    counts = data.agg(
        *[F.count(c).alias(f"n_{c}") for c in cols],
        *[
            F.expr(
                f"struct(count_if(`{c}` < {lo}) AS below, max(if(`{c}` < {lo}, `{c}`, NULL)) AS before, "
                f"min(if(`{c}` > {hi}, `{c}`, NULL)) AS after)"
            ).alias(name)
            for c, name, _, lo, hi in slots
        ],
    )
    rows = ", ".join(
        f"struct('{c}' AS column, {q} AS q, `n_{c}` AS n, `{name}`.below AS below, `{name}`.before AS before, "
        f"`{name}`.after AS after)"
        for c, name, q, _, _ in slots
    )
    targets = counts.selectExpr(f"inline(array({rows}))")
    # Few rows fall into any bracket; the rest go before anything is exploded.
    hits = [f"`{c}` BETWEEN {lo} AND {hi}" for c, _, _, lo, hi in slots]
    inside = ", ".join(
        f"if({hit}, struct('{c}' AS column, {q} AS q, `{c}` AS value), NULL)"
        for hit, (c, _, q, _, _) in zip(hits, slots, strict=True)
    )
    counted = (
        data.filter(" OR ".join(hits))
        .selectExpr(f"explode(array({inside})) AS s")
        .filter("s IS NOT NULL")
        .select("s.*")
        .groupBy("column", "q", "value")
        .agg(F.count(F.lit(1)).alias("n_value"))
    )
    upto = Window.partitionBy("column", "q").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("cum", F.sum("n_value").over(upto))
    joined = targets.join(ranked, ["column", "q"], "left")
    position = F.col("q") * (F.col("n") - 1)
    end = F.col("below") + F.col("cum")
    picked = joined.groupBy("column", "q", "n", "below", "before", "after").agg(
        F.min(F.when(end > F.floor(position), F.col("value"))).alias("v0"),
        F.min(F.when(end > F.ceil(position), F.col("value"))).alias("v1"),
    )
    lower = F.when(F.floor(position) < F.col("below"), F.col("before")).otherwise(F.coalesce("v0", "after"))
    upper = F.when(F.ceil(position) < F.col("below"), F.col("before")).otherwise(F.coalesce("v1", "after"))
    part = position - F.floor(position)
    return picked.select("column", "q", (lower + (upper - lower) * part).alias("value"))


def with_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float], out: str = "_q") -> DataFrame:
    """Attach the same quantiles to every row as a struct: `out[column][i]`."""
    long = exact_quantiles(df, cols, qs)
    row = long.agg(
        *[
            F.array(
                *[F.max(F.when((F.col("column") == c) & (F.col("q") == float(q)), F.col("value"))) for q in qs]
            ).alias(c)
            for c in cols
        ]
    )
    return df.withColumn(out, row.select(F.struct(*cols).alias("b")).scalar())
