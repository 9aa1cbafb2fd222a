"""Importance resampling towards a target distribution: hashed word runs score documents, Gumbel noise makes the draw, an exact histogram ranks it.

1. Features are all runs of 1 to RUNS consecutive words, as the CRC-32 of their bytes modulo `buckets`. Each task sums its own counts in one
   array and gives at most `buckets` rows; the log ratios of target and corpus (gains) are an array of `buckets` integers that goes to the tasks.
2. A document's weight is the floored mean of its features' gains, gathered from that array. Its score adds the noise of its id, an integer as well.
3. Scores are counted exactly. A gain is within 1000 * ln(2^63) either way and the noise between -3,133 and 22,873, so there are at most
   114,000 scores, whatever the input. Suffix sums over them, in blocks of BLOCK scores and then over under 500 blocks, give each score's place and
   the cutoff. Only rows at or above the cutoff are shuffled. Row numbers by doc_id within a score finish the ranks; a score's ids are cut into at most SLICES
   ranges, each counted too, so no window holds more than a part of one score's rows.

A null or empty text has no words and no features: weight 0, the score is the noise alone, and it is not drawn as it is short. A null doc_id counts as
the empty string in the noise and comes last among equal scores. Rows that repeat an id are drawn one by one; of these, equal scores go by features and weight. An
empty table gives an empty result; with an empty target all gains follow from the corpus alone. Other columns are not read by draw().
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm._common import materialize

RUNS, BUCKETS = 2, 10_000
#: A draw takes this share of the documents with at least LEAST_WORDS words.
PERCENT, LEAST_WORDS = 25, 20
SEED = 7
#: Scores whose suffix sums are made together.
BLOCK = 256
#: Ranges of ids that one score's rows are cut into.
SLICES = 64
#: Features counted at once, and rows of text held at once, in a task.
HELD, ROWS = 1 << 20, 500
#: Words are digits, letters without A-Z and everything beyond ASCII.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


class _Codes(dict):
    """CRC-32 of each word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        code = self[word] = crc32(word)
        return code


def features(text: bytes | None, of: _Codes, runs: int = RUNS, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words, and the buckets of all runs of words, repeats included."""
    own = (text or b"").translate(_WORDS).split()
    codes = list(map(of.__getitem__, own))
    out = [np.array(codes, np.uint32)]
    for length in range(2, runs + 1):
        codes = [crc32(word, crc32(b" ", code)) for word, code in zip(own[length - 1 :], codes)]
        out.append(np.array(codes, np.uint32))
    return len(own), (np.concatenate(out) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, runs: int = RUNS, buckets: int = BUCKETS, text_col: str = "text") -> np.ndarray:
    """How many features of all texts each bucket has; at most `buckets` rows come from a task, and as many to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total, held, n = _Codes(), np.zeros(buckets, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(features(text.as_py(), of, runs, buckets)[1])
                n += len(held[-1])
                if n > HELD:
                    total += np.bincount(np.concatenate(held), minlength=buckets)
                    held, n = [], 0
        total += np.bincount(np.concatenate([np.zeros(0, np.int64), *held]), minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["bucket", "n"])

    own = docs.select(F.col(text_col).cast("string").cast("binary")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in own.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + b) / ((s + 1)(T + b)))) of each of the b buckets."""
    s, t, b = corpus.astype(np.float64), target.astype(np.float64), float(len(corpus))
    return np.floor(1000 * np.log((t + 1) * (float(corpus.sum()) + b) / ((s + 1) * (float(target.sum()) + b)))).astype(np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(float(2**32))))).cast("long")


def scored(docs: DataFrame, gain: np.ndarray, runs: int = RUNS, seed: int = SEED, whole: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each row and, on demand, the whole row as a struct."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Codes()
        for big in batches:
            for batch in (big.slice(i, ROWS) for i in range(0, big.num_rows, ROWS)):
                found = [features(t.as_py(), of, runs, buckets) for t in batch.column(1)]
                weight = [int(gain[f].sum()) // len(f) if len(f) else 0 for _, f in found]
                facts = [pa.array(x, pa.int64()) for x in ([n for n, _ in found], [len(f) for _, f in found], weight)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *facts, *batch.columns[2:]], names=["doc_id", "n_words", "n_features", "weight", *batch.schema.names[2:]])

    doc_id = F.col(id_col).cast("long").alias("doc_id")
    row = [F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")] if whole else []
    rows = docs.select(doc_id, F.col(text_col).cast("string").cast("binary").alias("text"), *row)
    schema = "doc_id long, n_words long, n_features long, weight long" + (f", row {rows.schema['row'].dataType.simpleString()}" if whole else "")
    return rows.mapInArrow(run, schema).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


class Places(NamedTuple):
    """What a histogram of the scores says: n documents to draw, the least score drawn, and the place before each score's ranges of ids."""

    n: int
    cutoff: int
    above: int
    part: Column
    starts: DataFrame


def places(eligible: DataFrame, percent: int = PERCENT) -> Places | None:
    """The histogram's answer for rows (doc_id, score), read from storage; None if nothing is to be drawn."""
    seen = eligible.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    n = percent * seen["n"] // 100
    if not n:
        return None
    lo, hi, shift = seen["lo"] or 0, seen["hi"] or 0, 0
    while (hi >> shift) - (lo >> shift) >= SLICES:
        shift += 1
    part = F.coalesce(F.shiftright("doc_id", shift) - F.lit(lo >> shift), F.lit(SLICES)).cast("int")
    counts = materialize(eligible.groupBy("score", part.alias("part")).agg(F.count(F.lit(1)).alias("n")), "score-counts")
    one = counts.groupBy("score").agg(F.sum("n").alias("n")).withColumn("block", F.floor(F.col("score") / BLOCK))
    down = lambda w, by: w.orderBy(F.col(by).desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = one.groupBy("block").agg(F.sum("n").alias("n"))  # under 500 rows
    above_block = blocks.select("block", F.coalesce(F.sum("n").over(down(Window.partitionBy(F.lit(0)), "block")), F.lit(0)).alias("above_block"))
    within = one.withColumn("within", F.coalesce(F.sum("n").over(down(Window.partitionBy("block"), "score")), F.lit(0)))
    ranked = materialize(within.join(F.broadcast(above_block), "block").select("score", (F.col("within") + F.col("above_block")).alias("above")), "score-places")
    last = ranked.where(F.col("above") < n).agg(F.min(F.struct("score", "above")).alias("m")).first()["m"]
    order = Window.partitionBy("score").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.join(ranked.where(F.col("above") < n), "score").select("score", "part", (F.col("above") + F.coalesce(F.sum("n").over(order), F.lit(0))).alias("start"))
    return Places(n, last["score"], last["above"], part, starts)


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank (from 1; null if not drawn) of each row of docs; target: any rows with a text."""
    gain = gains(bucket_counts(docs, runs, buckets, text_col), bucket_counts(target, runs, buckets, text_col))
    rows = materialize(scored(docs, gain, runs, seed, id_col=id_col, text_col=text_col), "scored")
    out = ["doc_id", "n_features", "weight", "score"]
    eligible = rows.where(F.col("n_words") >= least_words)
    found = places(eligible, percent)
    none = F.lit(None).cast("long").alias("rank")
    if found is None:
        return rows.select(*out, none)
    fits = (F.col("n_words") >= least_words) & (F.col("score") >= found.cutoff)
    number = F.row_number().over(Window.partitionBy("score", "part").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight"))
    some = rows.where(fits).withColumn("part", found.part).join(found.starts.hint("shuffle_hash"), ["score", "part"])
    rank = (F.col("start") + number).cast("long")
    return rows.where(~fits).select(*out, none).unionByName(some.select(*out, F.when(rank <= found.n, rank).alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The drawn rows with all their columns as they were. Rows above the cutoff pass straight through; only those at the cutoff, a score of many, are numbered."""
    gain = gains(bucket_counts(docs, runs, buckets, text_col), bucket_counts(target, runs, buckets, text_col))
    rows = scored(docs, gain, runs, seed, True, id_col, text_col).where(F.col("n_words") >= least_words)
    found = places(materialize(rows.select("doc_id", "score"), "scores"), percent)
    if found is None:
        return docs.limit(0)
    number = F.row_number().over(Window.orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight"))
    tied = rows.where(F.col("score") == found.cutoff).withColumn("number", number).where(F.col("number") <= found.n - found.above).drop("number")
    chosen = rows.where(F.col("score") > found.cutoff).unionByName(tied)
    return chosen.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    """The noise of one id, for checks."""
    from hashlib import sha256

    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
