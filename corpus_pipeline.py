"""From raw documents to encoded training text: filter, filter, deduplicate, mix, encode.

Every stage reads what its predecessor wrote; all but the last return the columns of documents. Null and empty texts count
as empty in every stage and stay in. Rows without doc_id are judged by their text; no stage learns from them or links them.
Repeated rows are judged alike. Further columns are carried along. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillmark.llm import toxicity
from tillmark.llm.common import prepare, stored, table, tokenizer_path
from tillmark.llm.jaccard import one_of_each
from tillmark.llm.mixing import mix
from tillmark.llm.perplexity import quality
from tillmark.llm.pieces import encode_pieces

TOXIC = 0.7
#: half the rows and bytes of a batch: what Python workers hold adds up over the stages of a run
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "256", "spark.sql.execution.arrow.maxBytesPerBatch": "2m"}


def begin(spark: SparkSession) -> None:
    prepare(spark)
    for key, value in BATCHES.items():
        spark.conf.set(key, value)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's limit; empty ones have the average perplexity and stay."""
    prepare(spark)  # sums of costs are rounded by batch, so batches stay as they are in op9_quality
    return quality(docs, table(spark, sf_dir, "labels")).where("lm_keep").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the limit of toxicity; empty ones have the score of a text without hits."""
    begin(spark)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(f"toxicity < {TOXIC}").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 over five-word shingles connect; empty texts link with nothing.

    Of rows that repeat id and text one stays.
    """
    begin(spark)
    return one_of_each(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix, smaller sources repeated as far as their weights ask for it; a null source is one
    of its own."""
    begin(spark)
    mixed = mix(docs)
    return mixed.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their pieces."""
    begin(spark)
    return encode_pieces(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL can't express the trained models; the stages are tested against brute force and planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + "-".join(name.split()))
    return STAGES[-1][1](spark, docs, sf_dir)
