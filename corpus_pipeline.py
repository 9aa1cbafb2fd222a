"""A corpus pipeline of five stages; each works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm import decontaminate, exact_dedup, near_dedup, packing, toxicity
from loomspark.llm._common import documents, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows of an Arrow batch: neither side of a task holds many texts at once, however long they are.
BATCH_ROWS = 500
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _columns(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of documents. The session's Arrow batches are kept small, as a stage's result is written by its caller; run() puts them back as they were."""
    spark.conf.set(ARROW_ROWS, BATCH_ROWS)
    return docs.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the classifier learns from the labels of this stage's own documents."""
    rows = _columns(spark, docs)
    return toxicity.drop_toxic(rows, toxicity.train(rows, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.drop_copies(_columns(spark, docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.drop_near_copies(_columns(spark, docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.drop_contaminated(_columns(spark, docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences."""
    return packing.pack(_columns(spark, docs))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies), ("decontaminate", drop_contaminated), ("pack", pack)]

#: The toxicity stage is a trained model, which SQL cannot express; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rows = documents(spark, sf_dir), spark.conf.get(ARROW_ROWS)
    try:
        for name, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    finally:
        spark.conf.set(ARROW_ROWS, rows)
    return docs
