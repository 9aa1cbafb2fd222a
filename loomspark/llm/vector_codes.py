"""Product quantization of vectors with integer codebooks and partial-distance search.

Each component becomes floor(1024 x); a vector is cut into PARTS equal parts, and each part position has a codebook of at most ENTRIES entries, first the parts of the
rows with the smallest ids. A round assigns every part to its nearest entry and replaces each entry by its parts' mean, floored. Distances are exact integers.

Search: dimensions go in descending variance of the codebook. After every STEP of them the entry that is nearest so far is completed; the least such distance
is the current best, and a mask drops the entries whose sum strictly exceeds it. Sums only grow and the best only falls, so what is dropped stays dropped. Once one of FEW
is left or less, the rest are kept as flat arrays of rows and entries, to which each dimension adds and of which the mask takes away. What ties is never
dropped, so ties go to the lower index.

A round is one pass over the vectors; a task gives at most PARTS * ENTRIES rows of sums, so a hot entry is no hot task, and the driver holds no more than the codebooks.

Rows whose vector is null, or has a null, NaN or infinite component, are dropped. Of vectors with different lengths those of the most common length are kept (ties: the
longer); a length that PARTS doesn't divide is filled with zeros. A scaled component is held within +-2^24 (x within 16,384), so that
no sum leaves 64 bits. Rows with equal ids start codebooks in the order of their components; a null id comes last. An empty table, or one without a good vector, gives
an empty result. Labels of any type count; nulls are equal to each other. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm._common import attach_by_key, materialize

PARTS, ENTRIES, ROUNDS = 4, 256, 4
SCALE, BOUND = 1024, 1 << 24
#: Dimensions between two completions, the share of entries from which flat arrays are quicker, and rows searched at once.
STEP, FEW, ROWS = 4, 16, 256


class Codes(NamedTuple):
    """vec_id, label, code, error by row, and the codebooks: PARTS arrays of entries."""

    rows: DataFrame
    codebooks: list[np.ndarray]


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry (ties: the lowest) and the squared distance, by partial-distance search."""
    n, d = rows.shape
    if not n or not d:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    centred = book - book.mean(0)
    order = np.argsort(-(centred * centred).mean(0), kind="stable")
    x, c = rows[:, order], book[:, order]
    complete = lambda row, entry: ((x[row] - c[entry]) ** 2).sum(1)
    every, columns = np.arange(n), np.ascontiguousarray(c.T)
    total, gap = np.zeros((n, len(c)), np.int64), np.empty((n, len(c)), np.int64)
    best, j = np.full(n, np.iinfo(np.int64).max), 0
    while True:
        for j in range(j, min(j + STEP, d)):
            np.subtract(x[:, j, None], columns[j], out=gap)
            np.multiply(gap, gap, out=gap)
            total += gap
        j += 1
        best = np.minimum(best, complete(every, total.argmin(1)))
        left = total <= best[:, None]
        if j == d or np.count_nonzero(left) * FEW <= left.size:
            break
    row, entry = np.nonzero(left)
    total = total[row, entry]
    for j in range(j, d):
        total = total + (x[row, j] - c[entry, j]) ** 2
        keep = total <= best[row]
        row, entry, total = row[keep], entry[keep], total[keep]
    at = _least(row, total)
    return entry[at], total[at]


def _least(row: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The place of each row's least total, the first of equal ones; row is sorted and has every row."""
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    hit = np.flatnonzero(total == np.repeat(np.minimum.reduceat(total, starts), np.diff(np.r_[starts, len(row)])))
    return hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]


def integers(rows: DataFrame, vector_col: str, id_col: str, label_col: str) -> DataFrame:
    """vec_id, label, parts (PARTS arrays of integers, one after the other) of the good rows."""
    vector = F.col(vector_col).cast("array<double>")
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), vector.alias("v")).where(F.col("v").isNotNull() & good)
    common = some.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    d = common["d"] if common else 0
    whole = lambda x: F.least(F.greatest(F.floor(x * F.lit(SCALE)), F.lit(-BOUND)), F.lit(BOUND)).cast("int")
    filled = F.concat(F.transform("v", whole), F.array_repeat(F.lit(0), -d % PARTS))
    return some.where(F.size("v") == d).select("vec_id", "label", filled.alias("parts"))


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """Rows, parts, positions."""
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), PARTS, -1)


def _sums(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """part, entry, n, total (componentwise) over all parts that are nearest to an entry."""
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((PARTS, len(books[0])), np.int64)
        total = np.zeros((*n.shape, width), np.int64)
        for big in batches:
            for batch in (big.slice(i, ROWS) for i in range(0, big.num_rows, ROWS)):
                x = _matrix(batch, "parts")
                for part, book in enumerate(books):
                    entry = nearest(x[:, part], book)[0]
                    np.add.at(n[part], entry, 1)
                    np.add.at(total[part], entry, x[:, part])
        part, entry = np.nonzero(n)
        flat = pa.array(total[part, entry].ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * width), flat)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), lists], names=["part", "entry", "n", "total"])

    found = rows.select("parts").mapInArrow(run, "part int, entry int, n long, total array<long>")
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(width))).alias("total"))


def train(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks from rows (vec_id, parts), read from storage; at most `entries` rows, and the sums for each entry, come to the driver."""
    first = rows.select("vec_id", "parts").orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(entries).collect()
    if not first:
        return [np.zeros((0, 0), np.int64)] * PARTS
    start = np.array([r["parts"] for r in first], np.int64).reshape(len(first), PARTS, -1)
    books = [np.ascontiguousarray(start[:, part]) for part in range(PARTS)]
    for _ in range(rounds):
        for part, entry, n, total in _sums(rows, books).collect():
            books[part][entry] = np.array(total, np.int64) // n
    return books


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code, error of rows (vec_id, label, parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in (big.slice(i, ROWS) for i in range(0, big.num_rows, ROWS)):
                x = _matrix(batch, "parts")
                found = [nearest(x[:, part], book) for part, book in enumerate(books)]
                code = np.stack([entry for entry, _ in found], 1).tolist()
                error = np.sum([e for _, e in found], axis=0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(["".join(f"{e:02x}" for e in c) for c in code], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long")


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, vector_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label") -> Codes:
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte for each part")
    rows = materialize(integers(vectors, vector_col, id_col, label_col), "vector-parts")
    books = train(rows, entries, rounds)
    return Codes(materialize(encode(rows, books), "codes"), books)


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and position, as decimals joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Adds label_error: the error summed over equal labels; a label with a third of all rows is met by a broadcast."""
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    keyed = codes.withColumn("__key", key)
    sums = materialize(keyed.groupBy("__key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("__n")), "label-errors")
    return attach_by_key(keyed, sums, "__key", "__n", codes.count()).drop("__key", "__n")
