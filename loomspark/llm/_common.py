"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than 1/HOT_SHARE of all rows is hot; there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where there are no other machines."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "/tmp/checkpoints/loomspark"
        os.makedirs(found, exist_ok=True)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{label}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch, so that neither side of a task holds many texts or sets at once.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage with a Parquet table in the shared folder, which survives lost executors."""
    path, conf = scratch(df.sparkSession, label), df.sparkSession.conf
    rows = int(conf.get(_BATCH))
    conf.set(_BATCH, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        conf.set(_BATCH, str(rows))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def safe_text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def attach_by_key(rows: DataFrame, stats: DataFrame, key: str, count: str, n_rows: int) -> DataFrame:
    """Inner join of rows with per-key stats that holds up when one key has a third of all rows.

    Keys with over 1/HOT_SHARE of the rows (under HOT_SHARE keys, so the size is bounded) are
    broadcast; the others meet in a shuffle, where no key is large any more.
    Both inputs should be read from storage, as they are read twice.
    """
    limit = max(50, n_rows // HOT_SHARE)
    hot = F.broadcast(stats.where(F.col(count) > limit))
    cold = stats.where(F.col(count) <= limit)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold.hint("shuffle_hash"), key))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
