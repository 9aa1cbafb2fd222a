"""Results to files: rows as JSON or CSV, and a log of jobs (workbooks: see excel.py). All are written by the tasks that hold the rows."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.text import visible_list

JOB_FIELDS = "job_id string, updated_at timestamp, field string, value string"


def as_json(df: DataFrame) -> DataFrame:
    """One column, each row as a JSON object; nulls are kept as fields."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_results(comments: DataFrame, issues: DataFrame | None, folder: str) -> None:
    """Rows of JSON under `comments` and, where there are issues, under `issues_metrics`; existing ones are replaced."""
    as_json(comments).write.mode("overwrite").text(f"{folder}/comments")
    if issues is not None:
        as_json(issues).write.mode("overwrite").text(f"{folder}/issues_metrics")


def visible(df: DataFrame) -> DataFrame:
    """Lists of strings as lines of a cell, other nested columns as JSON, so that a flat format can hold them."""
    kinds = dict(df.dtypes)
    flat = lambda c: visible_list(F.col(c)) if kinds[c] == "array<string>" else F.to_json(c) if kinds[c].startswith(("array", "map", "struct")) else F.col(c)
    return df.select(*(flat(c).alias(c) for c in df.columns))


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; texts with line breaks and quotes are read back as they were."""
    visible(df).write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").csv(path)


def verify(spark: SparkSession, path: str, kind: str = "parquet", rows: int | None = None) -> int:
    """Reads back what was written; raises unless it is there, has rows and, if told, that many. Gives the number of rows."""
    options = {"header": True, "multiLine": True, "escape": '"'} if kind == "csv" else {}
    found = spark.read.format(kind).options(**options).load(path).count()
    if not found or rows is not None and found != rows:
        raise ValueError(f"{found} rows at {path}" + (f", not {rows}" if rows is not None else ""))
    return found


def update_job(spark: SparkSession, folder: str, job_id: str, **values: object) -> None:
    """Adds fields of a job to the log. Nothing is rewritten, so writers at once lose nothing."""
    now = datetime.datetime.now(datetime.timezone.utc)
    rows = [(job_id, now, k, None if v is None else str(v)) for k, v in values.items()]
    spark.createDataFrame(rows, JOB_FIELDS).coalesce(1).write.mode("append").parquet(folder)


def merged_jobs(log: DataFrame) -> DataFrame:
    """job_id, updated_at, fields (a map): each field as it was last set; the larger value of two set at the same time."""
    last = log.groupBy("job_id", "field").agg(F.max(F.struct("updated_at", "value")).alias("m"))
    return last.groupBy("job_id").agg(F.max("m.updated_at").alias("updated_at"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "m.value")))).alias("fields"))


def job(spark: SparkSession, folder: str, job_id: str) -> DataFrame:
    """The state of one job; no row if it is unknown."""
    return merged_jobs(spark.read.schema(JOB_FIELDS).parquet(folder).where(F.col("job_id") == job_id))
