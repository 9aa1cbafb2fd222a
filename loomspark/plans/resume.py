"""Stages that resume: a stage's rows are dealt to ranges of keys, and a manifest tells which ranges are done.

The input is written once, by range. Each range is then made from its own files alone and written to its own folder; only after that a manifest entry for it appears, so what a stopped run
left half done isn't counted, and a rerun makes the ranges that have no entry. A key is in one range only, so no key comes twice. Names of ranges
depend on the key, never on partitions: the same table comes out however often a run was stopped.

The manifest also holds what the run was told (ranges, key, columns); a rerun that is told otherwise is refused.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

RANGE = "__range"


class Manifest:
    """Small files in a folder, made through Spark's file systems; an entry appears whole or not at all (it is written aside and renamed)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def put(self, name: str, value: dict) -> None:
        aside = self._path(f"{self.folder}/_aside-{name}")
        out = self._files.create(aside, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        self._files.delete(self._path(f"{self.folder}/{name}"), False)
        if not self._files.rename(aside, self._path(f"{self.folder}/{name}")):
            raise OSError(f"no entry {name} could be made in {self.folder}")

    def get(self, name: str) -> dict | None:
        path = self._path(f"{self.folder}/{name}")
        if not self._files.exists(path):
            return None
        found = self._files.open(path)
        try:
            return json.loads(bytes(found.readAllBytes()))
        finally:
            found.close()

    def times(self) -> dict[str, float]:
        """Names and when they were touched last."""
        folder = self._path(self.folder)
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in self._files.listStatus(folder)} if self._files.exists(folder) else {}

    def names(self) -> set[str]:
        return set(self.times())

    def create(self, name: str) -> bool:
        """Whether this call made the (empty) file: of several at once one does."""
        path = self._path(f"{self.folder}/{name}")
        try:
            self._files.create(path, False).close()
        except Py4JJavaError:
            if self._files.exists(path):
                return False
            raise
        return True

    def touch(self, name: str) -> None:
        self._files.setTimes(self._path(f"{self.folder}/{name}"), int(time.time() * 1000), -1)

    def remove(self, path: str) -> None:
        self._files.delete(self._path(path), True)


def by_ranges(rows: DataFrame, key: str, folder: str, make: Callable[[DataFrame], DataFrame], ranges: int = 32, done: Callable[[int, int], None] | None = None) -> DataFrame:
    """make() of the rows, range by range, as a table under folder. make must work key by key (a key's rows are in one range, null keys together);
    done: told the number of finished ranges and of all. What was finished before is not made again."""
    spark = rows.sparkSession
    log = Manifest(spark, f"{folder.rstrip('/')}/manifest")
    plan = {"ranges": ranges, "key": key, "columns": sorted(rows.columns)}
    told = log.get("plan")
    if told is not None and told != plan:
        raise ValueError(f"{folder} holds a run with {told}, not {plan}")
    log.put("plan", plan)
    have = log.names()
    left = [r for r in range(ranges) if f"range-{r}" not in have]
    source = f"{folder.rstrip('/')}/input"
    if left and log.get("input") is None:
        dealt = rows.withColumn(RANGE, F.pmod(F.xxhash64(F.col(key)), F.lit(ranges)).cast("int"))
        dealt.write.mode("overwrite").partitionBy(RANGE).parquet(source)
        log.put("input", {"path": source})
    for n, r in enumerate(left, ranges - len(left) + 1):
        read = spark.read.schema(StructType([*rows.schema.fields, StructField(RANGE, IntegerType())])).parquet(source)
        made = make(read.where(F.col(RANGE) == r).drop(RANGE))
        made.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/table/{RANGE}={r}")
        log.put(f"range-{r}", {"schema": made.schema.json()})
        if done:
            done(n, ranges)
    log.remove(source)
    return finished_table(spark, folder)


def finished_table(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all ranges that are done; others don't show, whatever is left of them."""
    log = Manifest(spark, f"{folder.rstrip('/')}/manifest")
    parts = sorted(n for n in log.names() if n.startswith("range-"))
    if not parts:
        raise ValueError(f"nothing is finished at {folder}")
    schema = StructType.fromJson(json.loads(log.get(parts[0])["schema"]))
    paths = [f"{folder.rstrip('/')}/table/{RANGE}={n.removeprefix('range-')}" for n in parts]
    return spark.read.schema(schema).parquet(*paths)
