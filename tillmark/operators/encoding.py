"""Category encodings that do not leak a row's own target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 100_000


def hash_order(key: Sequence[str]) -> Column:
    """Order of the rows: md5 of the key's text, its parts joined by a bar."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key]))


def ordered_target_mean(df: DataFrame, category: str, target: str, key: Sequence[str], weight: float = 1.0,
                        prior: float | None = None, out: str = "encoded", digits: int | None = None) -> DataFrame:
    """All columns of `df` and, for each row, the mean target of the rows of its category that come before it.

    Rows come in the order of a hash of `key`, which must be unique. `weight` rows of the prior (by default the mean of
    all targets) are added, so the first row of a category gets the prior. A null category is one of its own; rows
    without a target are encoded and do not count for later ones.

    A category is cut by the first `digits` of the hash (by default as many as keep 100,000 rows in a part): a window
    runs inside each part and a small table of part sums supplies the rest, so that one category may hold any share of
    the rows.
    """
    value = F.col(target).cast("double")
    facts = df.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).first()
    prior = float(facts["mean"] or 0.0) if prior is None else prior
    if digits is None:
        digits = next(d for d in range(1, 8) if 16**d * ROWS_PER_BUCKET >= facts["n"])
    parts = ["_null", "_category", "_part"]
    tagged = df.withColumns({
        "_order": hash_order(key), "_null": F.col(category).isNull(),
        "_category": F.coalesce(F.col(category).cast("string"), F.lit("")), "_value": value})
    tagged = tagged.withColumn("_part", F.substring("_order", 1, digits))
    sums = tagged.groupBy(*parts).agg(F.sum("_value").alias("_s"), F.count("_value").alias("_n"))
    ahead = Window.partitionBy("_null", "_category").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*parts, F.coalesce(F.sum("_s").over(ahead), F.lit(0.0)).alias("_s0"),
                          F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n0"))
    inside = Window.partitionBy(*parts).orderBy("_order", *key).rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.withColumns({"_s1": F.coalesce(F.sum("_value").over(inside), F.lit(0.0)),
                                "_n1": F.count("_value").over(inside)})
    total = F.col("_s0") + F.col("_s1") + F.lit(prior * weight)
    return local.join(offsets, parts).select(*df.columns, (total / (F.col("_n0") + F.col("_n1") + F.lit(weight))).alias(out))
