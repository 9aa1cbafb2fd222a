"""Tables between stages, in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where there are no other machines."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "/tmp/checkpoints/loomspark"
        Path(folder).mkdir(parents=True, exist_ok=True)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written once and read back: later stages don't repeat what made them, and lost executors cost nothing."""
    path, spark = new_path(df.sparkSession, label), df.sparkSession
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
