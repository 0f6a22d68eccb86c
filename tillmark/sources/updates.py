"""Updates of stored tables by copy-on-write, and facts laid out for joins without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillmark.sources.files import run_folder


def store_partitioned(df: DataFrame, label: str, by: str) -> str:
    """Parquet files below a fresh shared folder, one subfolder for each value of `by`; returns the folder."""
    path = run_folder(df.sparkSession, label)
    df.repartition(by).write.partitionBy(by).parquet(path)
    return path


def update_where(spark: SparkSession, path: str, by: str, where: Column, values: dict[str, Column],
                 lookup: DataFrame | None = None, on: str | None = None) -> int:
    """Set columns of the rows that meet `where`, in a table stored by `store_partitioned`; returns how many partitions changed.

    `values` may use columns of `lookup`, which is joined on `on` (one row each, at most) and may itself be read from the
    table; a row it does not know gets nulls from it. Only partitions that hold such a row are read for the change and
    written anew; the files of all others stay as they are. New files are staged and take the place of the old ones when
    the job commits, so a lost executor or a failed job leaves the table as it was. The names of partitions that change
    reach the driver, as the table's listing does anyway.
    """
    table = spark.read.parquet(path)
    touched = [row[0] for row in table.where(where).select(by).distinct().collect()]
    if not touched:
        return 0
    kept = F.col(by).isin([x for x in touched if x is not None])
    part = table.where(kept | F.col(by).isNull() if None in touched else kept)
    hit = F.coalesce(where, F.lit(False))
    if lookup is not None:
        flagged = part.withColumn("_hit", hit)
        part = flagged.join(lookup, on, "left")
        hit = F.col("_hit")
    kinds = dict(table.dtypes)
    changed = part.select(*[
        F.when(hit, values[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])
    changed.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    spark.catalog.refreshByPath(path)
    return len(touched)


def store_bucketed(df: DataFrame, label: str, key: str, buckets: int, month: str | None = None) -> str:
    """A catalogue table of its own name, bucketed and sorted by `key`, partitioned by calendar month of `month` if given."""
    name = f"{label}_{uuid.uuid4().hex}"
    if month:
        df = df.withColumn("month", F.trunc(month, "MM"))
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", run_folder(df.sparkSession, label))
    (writer.partitionBy("month") if month else writer).saveAsTable(name)
    return name


def bucket_count(rows: int, rows_per_bucket: int = 2_000_000, least: int = 8) -> int:
    """A power of two, so that tables of different sizes can still meet bucket by bucket."""
    return max(least, 1 << max(0, -(-rows // rows_per_bucket) - 1).bit_length())
