"""Exact deduplication: two passes over a Bloom filter, DataFrame functions only.

Pass 1 counts the cells of a Bloom filter that the texts' 64-bit hashes hit (map-side combined,
16 bytes a cell travel) and keeps the cells hit at least twice as bitmaps. Pass 2 probes these, a broadcast range of hashes at a time:
a text with any cell hit once is unique and passes straight through; only the possibly
repeated ones are shuffled, by SHA-256, and grouped exactly. So false positives cost time, never results.

Nulls count as the empty text. A null id ranks below every other id. Rows that repeat both id and
text count in group_size and share one decision in exact_groups(); drop_copies() keeps one of them. An empty table gives an empty result.
Other columns of the input are neither read nor in the way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm._common import attach_by_key, materialize, safe_text
from loomspark.llm.bloom import bitmaps, keep_decided, probed


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", max_bytes: int | None = None) -> DataFrame:
    """A row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    text = safe_text(F.col(text_col))
    # no text goes further; hashes are sorted within their files, which prunes what a range of them reads
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"), F.xxhash64(text).alias("h")).sortWithinPartitions("h"), "hashes")
    n = rows.count()
    marked = materialize(probed(rows, F.col("h"), bitmaps(rows, n, 2, max_bytes), "maybe_repeated").drop("h"), "probed")
    rest = marked.where("maybe_repeated").select("doc_id", "sha")
    best = F.max("doc_id") if keep == "max" else F.min("doc_id")
    stats = materialize(rest.groupBy("sha").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    hex_sha = F.lower(F.hex("sha")).alias("text_sha256")
    single = marked.where("not maybe_repeated").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), hex_sha)
    groups = attach_by_key(rest, stats, "sha", "group_size", n).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), hex_sha)
    return single.unionByName(groups)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row of each text, with all its columns as they were."""
    judged = exact_groups(docs, id_col, text_col, keep).select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex("text_sha256").alias("sha"), (~F.col("kept")).alias("gone"))
    return keep_decided(docs, materialize(judged, "judged"), id_col, text_col)
