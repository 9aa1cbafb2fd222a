"""Sums of numpy arrays over all rows of a table: each task sums its own rows, and only sums travel."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Numbers of one row of a sum, and bytes of all tasks' sums that may meet in the driver at once.
CHUNK, MOST_BYTES = 1 << 15, 64 << 20


def summed(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int) -> np.ndarray:
    """The sum of kernel's arrays (of `size` doubles, one for each task). Where the tasks' arrays together are large, they are summed in chunks by
    tasks first; the driver then gets one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.asarray(kernel(batches), np.float64).ravel()
        for at in range(0, size, CHUNK):
            part = own[at : at + CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([at // CHUNK], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["chunk", "part"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[chunk] = found[chunk] + np.frombuffer(part) if chunk in found else np.frombuffer(part)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["chunk", "part"])

    rows = df.mapInArrow(run, "chunk int, part binary")
    if rows.rdd.getNumPartitions() * size * 8 > MOST_BYTES:
        rows = rows.repartition("chunk").mapInArrow(meet, "chunk int, part binary")
    total = np.zeros(size)
    for chunk, part in rows.collect():
        own = np.frombuffer(part)
        total[chunk * CHUNK : chunk * CHUNK + len(own)] += own
    return total
