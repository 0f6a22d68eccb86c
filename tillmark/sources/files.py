"""CSV source and sink, managed tables, views."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillmark.session import shared_dir
from tillmark.sources.tables import BASE_TABLES


def run_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one; earlier runs are never overwritten."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Headed CSV with a declared schema; a value that does not fit becomes null."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def write_csv(df: DataFrame, path: str, run_id: str | None = None) -> str:
    """Headed CSV, optionally below a `run_id=` partition folder."""
    if run_id is not None:
        df = df.withColumn("run_id", F.lit(run_id))
        df.write.mode("append").partitionBy("run_id").option("header", True).csv(path)
    else:
        df.write.mode("errorifexists").option("header", True).csv(path)
    return path


def write_table(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Create or replace a catalog table and return it. Runs that share a warehouse give `name` a part of their own."""
    spark = df.sparkSession
    writer = df.write.mode("overwrite").option("path", run_folder(spark, name))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)
    return spark.table(name)


def register_views(spark: SparkSession, folder: str, names=BASE_TABLES, prefix: str = "") -> list[str]:
    """Temporary views over the parquet tables of a folder."""
    views = []
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(f"{prefix}{name}")
        views.append(f"{prefix}{name}")
    return views


def listed_tables(spark: SparkSession) -> DataFrame:
    """Catalog entries with their column counts."""
    rows = [(t.name, len(spark.table(t.name).columns)) for t in spark.catalog.listTables() if t.isTemporary]
    return spark.createDataFrame(rows, "name string, n_columns int")
