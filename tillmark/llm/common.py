"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillmark.session import apply_defaults, shared_dir
from tillmark.sources.files import run_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The frame written to the shared checkpoint folder and read from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """The frame written as Parquet below the shared folder and read back; survives lost executors."""
    path = run_folder(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def labelled_side(column: str = "doc_id"):
    """True for rows that may teach a model: crc32 of the id's text, modulo 3, is not 1."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3 != 1


#: Python batches: rows hold whole texts, so their bytes are bounded too.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


SENT: list[Broadcast] = []


def send(spark: SparkSession, value) -> Broadcast:
    """A broadcast whose copies on the executors go when the next query or stage is prepared."""
    SENT.append(spark.sparkContext.broadcast(value))
    return SENT[-1]


def prepare(spark: SparkSession) -> SparkSession:
    """Settings of this package; frees the executors of earlier broadcasts, which are sent again if they are still used."""
    apply_defaults(spark)
    while SENT:
        SENT.pop().unpersist()
    for key, value in ARROW.items():
        spark.conf.set(key, value)
    return spark


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` rows, the first by a hash of the key; a share of the hashes is cut off before they are ordered."""
    share = min(1.0, 2 * rows / max(df.count(), 1))
    some = df.where(F.pmod(F.xxhash64(F.lit(3), key), F.lit(1 << 30)) <= int(share * (1 << 30)))
    return some.orderBy(F.xxhash64(key), key).limit(rows)


def join_small(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", most: int = 1_000_000) -> DataFrame:
    """Join that leaves `big` in place while `small` has at most `most` rows, and shuffles both beyond that."""
    return big.join(F.broadcast(small) if small.limit(most + 1).count() <= most else small, on, how)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
