"""Queries of studies: exports that are read back, quantiles by group, embedders compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.more_queries import SQL_OVER_SAID, said_noise
from loomspark.operators import embedders, noise, quantiles
from loomspark.plans.lineage import new_path
from loomspark.queries import _quoted
from loomspark.sinks.excel import write_xlsx
from loomspark.sources.excel import read_xlsx


def exported_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as formatted workbooks, read back by their types."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    path = new_path(spark, "orders-xlsx")
    write_xlsx(orders, path, "mapped")
    return read_xlsx(spark, path, schema=orders.schema)


def grouped_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of two columns by flag and status, of all lines."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    found = quantiles.exact_quantiles(li, ["l_extendedprice", "l_quantity"], (0.0, 0.05, 0.33, 0.5, 0.66, 0.95, 1.0), ["l_returnflag", "l_linestatus"])
    return found.withColumn("value", F.round("value", 6))


def embedder_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four embedders by how well a document's quality is learned from its whole text."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").join(labels, "doc_id")
    every = [embedders.HashedWords(), embedders.HashedWords(256, "hashed words, wide"), embedders.HashedGrams(), embedders.fit_lsa(docs, "text")]
    return embedders.compare(docs, "text", "quality", "doc_id", every)


def noise_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level and reason of every turn and document."""
    levels = said_noise(spark, sf_dir)
    return levels.select("comment_id", "noise_level", noise.noise_reason(F.col("noise_level")).alias("noise_reason"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (exported_orders, grouped_quantiles, embedder_comparison, noise_reasons)}

_REASONS = ", ".join(f"({_quoted(level)}, {_quoted(reason)})" for level, reason in noise.REASONS.items())

SQL: dict[str, str] = {
    "noise_reasons": f"SELECT n.*, r.reason AS noise_reason FROM ({SQL_OVER_SAID['said_noise']}) n JOIN (VALUES {_REASONS}) r(level, reason) ON level = noise_level",
    "exported_orders": "SELECT * FROM orders",
    "grouped_quantiles": """
WITH v AS (
  SELECT l_returnflag, l_linestatus, unnest(['l_extendedprice', 'l_quantity']) AS column_name, unnest([l_extendedprice::DOUBLE, l_quantity::DOUBLE]) AS x FROM lineitem),
q AS (
  SELECT l_returnflag, l_linestatus, column_name, quantile_cont(x, [0.0, 0.05, 0.33, 0.5, 0.66, 0.95, 1.0]) AS found
  FROM v GROUP BY l_returnflag, l_linestatus, column_name),
each AS (
  SELECT l_returnflag, l_linestatus, column_name, unnest([0.0, 0.05, 0.33, 0.5, 0.66, 0.95, 1.0]::DOUBLE[]) AS share, unnest(found) AS value FROM q)
SELECT l_returnflag, l_linestatus, column_name, share, round(value, 6) AS value FROM each
""",
}
