"""The index of issues over a stream: each issue's counters are keyed state, and only the issues that a trigger changed are written.

A processor for each issue keeps its counters (kind and name to a sum and a first position) in the state store and gives the leading names of the issue when
some of them changed. The index needs the extremes and quantiles of all issues, which no increment can give, so it is computed at each trigger from a
row of features an issue: those of the trigger are written beside the earlier ones, and the last of each issue counts. Every FULL triggers one table of all issues takes their
place. Tables are named by the batch, so a batch that is run again gives the same ones; what no later trigger reads is removed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from loomspark.operators import index

#: Triggers after which all issues' features are written as one table.
FULL = 10
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Counters(StatefulProcessor):
    """Rows kind, name, v, p (position as a sortable text) of one issue to its leading names: issue_number, kind, r, name, value, total."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getMapState("sums", "kind string, name string", "v double, p string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        new: dict[tuple, list] = {}
        for r in rows:
            own = new.setdefault((r.kind, r.name), [0.0, r.p])
            own[0] += r.v
            own[1] = min(own[1], r.p)
        for at, (v, p) in new.items():
            if self.sums.containsKey(at):
                before = self.sums.getValue(at)
                v, p = before[0] + v, min(before[1], p)
            self.sums.updateValue(at, (v, p))
        kinds: dict[str, list] = {}
        for (kind, name), (v, p) in self.sums.iterator():
            kinds.setdefault(kind, []).append((-v, p, name))
        for kind, own in kinds.items():
            total = -sum(v for v, _, _ in own)
            for r, (v, _, name) in enumerate(sorted(own)[: index.MOST], 1):
                yield Row(issue_number=key[0], kind=kind, r=r, name=name, value=-v, total=total)

    def close(self) -> None:
        pass


def changed_issues(comments: DataFrame) -> DataFrame:
    """The leading names of each issue that a trigger changes; comments: a stream of issue_number, row_ord, code, microcauses. row_ord: a number or numbers in
    a struct, not negative."""
    own = index.counted_items(comments)
    place = lambda c: F.lpad(c.cast("string"), 20, "0")
    kind = own.schema["row_ord"].dataType
    parts = [F.col(f"row_ord.{f}") for f in kind.names] if kind.typeName() == "struct" else [F.col("row_ord")]
    rows = own.select("issue_number", "x.kind", "x.name", "x.v", F.concat_ws("-", *map(place, [*parts, F.col("x.i"), F.col("x.j")])).alias("p"))
    out = f"issue_number {own.schema['issue_number'].dataType.simpleString()}, kind string, r int, name string, value double, total double"
    return rows.groupBy("issue_number").transformWithState(statefulProcessor=_Counters(), outputStructType=out, outputMode="Update", timeMode="None")


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def index_of_each_batch(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over changed_issues(): features of what changed under features-<batch> (of all issues under full-<batch>), the index of all issues under index-<batch>."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ranked = batch.select("issue_number", "kind", F.struct("r", "name", "value").alias("x"), "total")
        index.features_of_ranked(ranked).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/features-{batch_id}")
        base = batch_id // FULL * FULL  # the last full table is that of the batch before it
        paths = [f"{folder}/full-{base - 1}"] * (base > 0) + [f"{folder}/features-{b}" for b in range(base, batch_id + 1)]
        every = spark.read.parquet(*paths)
        last = every.groupBy("issue_number").agg(F.max_by(F.struct(*every.columns), "batch").alias("x")).select("x.*")
        full = batch_id % FULL == FULL - 1
        if full:
            last.write.mode("overwrite").parquet(f"{folder}/full-{batch_id}")
            last = spark.read.parquet(f"{folder}/full-{batch_id}")
        index.with_index(last.drop("batch")).write.mode("overwrite").parquet(f"{folder}/index-{batch_id}")
        # the batch before is committed, so only this one or later ones can be run again
        if batch_id == base > 0:
            for b in range(base - FULL, base):
                _remove(spark, f"{folder}/features-{b}")
            _remove(spark, f"{folder}/full-{base - 1 - FULL}")
        if batch_id > 1:
            _remove(spark, f"{folder}/index-{batch_id - 2}")

    return run


def start_index(comments: DataFrame, folder: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Starts the query; trigger: as for writeStream.trigger. The state store of keyed state is set for this query only."""
    spark = comments.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        writer = changed_issues(comments).writeStream.outputMode("update").foreachBatch(index_of_each_batch(folder))
        return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
