"""From raw documents to encoded training data: five stages, each of one operator.

A stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.llm import minhash, mixing, pii, quality_rules, sentencepiece_fst
from lithoframe.llm.common import stage
from lithoframe.llm.queries import piece_model

#: Most rows of the Arrow batches in which whole texts go to Python. A batch lies in the executor's JVM, once as vectors and once as bytes to send, and again in its Python worker.
BATCH_ROWS = 2_000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """The session's Arrow batches have BATCH_ROWS rows at most from now on; a smaller setting stays. Rows and results are the same for any size of batch."""
    if not 0 < int(spark.conf.get(_ROWS)) <= BATCH_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the isolation forest reject go."""
    small_batches(spark)
    return quality_rules.drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id."""
    small_batches(spark)
    return minhash.deduplicate(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind in brackets; n_chars follows."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is repeated as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_pieces, ids and whether decoding gives the text back."""
    small_batches(spark)
    coded = sentencepiece_fst.encode_checked(docs.select("doc_id", "lang", "source", "n_chars", "text"), piece_model())
    return coded.withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [("quality rules", quality), ("near duplicates", deduplicate), ("personal data", redact), ("mixing", mix), ("encoding", encode)]

#: The forest and the transducer are not SQL: tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rows = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(_ROWS)
    try:
        for name, step in STAGES:
            docs = stage(step(spark, docs, sf_dir), name.replace(" ", "_"))
    finally:
        spark.conf.set(_ROWS, rows)
    return docs
