"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of WINDOW consecutive words (an item with fewer words is one window). A window's
tokens are its shingles of SHINGLE words. One pass over the documents counts how often each of these shingles occurs, so
that they can be ordered by rarity; as a window must be contained whole, its necessary prefix is its single rarest
shingle, and a window with a shingle that no document has is dropped. The second pass joins document shingles with these prefix
tokens; the shingle's place in the window gives the only possible start, which must leave room for the whole window
(positional and length bounds), and the words there are compared one by one over the window's length.

The benchmark is taken in blocks of about MAX_BLOCK_BYTES of text: only one block's index is ever in a
worker's memory, and each block is a further written pass over the documents, so a benchmark of any size works. Documents are never shuffled.

Null texts have no words. Items without words have no windows; items with equal windows all count; an item without id counts as ''.
Repeated rows get the same result; empty tables give empty results or no hits. Other columns are not read by decontaminate().
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm._common import materialize, safe_text

WINDOW = 10
SHINGLE = 3
MAX_BLOCK_BYTES = 8 << 20
#: Words of documents that are looked up together.
MAX_WORDS = 200_000
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32) for c in range(256))


def words(text: str | None) -> list[bytes]:
    """ASCII letters lower-cased; runs of letters, digits and non-ASCII bytes."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass
class Index:
    """Windows of one block of the benchmark, by the word ids of this block (from 1)."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    windows: dict[tuple[int, ...], set[str]] = field(default_factory=dict)
    #: by shingle length: sorted keys, and of each key the (offset, window) pairs that have it as prefix token
    prefix: dict[int, tuple[np.ndarray, list[list[tuple[int, tuple[int, ...]]]]]] = field(default_factory=dict)

    @staticmethod
    def of(items: list[tuple[object, str | None]], window: int) -> Index:
        out = Index()
        for item, text in items:
            ids = [out.vocabulary.setdefault(w, len(out.vocabulary) + 1) for w in words(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                out.windows.setdefault(tuple(ids[i : i + window]), set()).add("" if item is None else str(item))
        return out

    def lengths(self) -> list[int]:
        return sorted({min(SHINGLE, len(w)) for w in self.windows})

    def key(self, ids) -> int:
        """Modulo 2^64, as _shingles() has it: from two million words on keys are hashes. Windows with equal keys are listed together, and words are compared."""
        key = 0
        for i in ids:
            key = key * (len(self.vocabulary) + 1) + int(i)
        return (key + 2**63) % 2**64 - 2**63

    def tokens(self, k: int) -> np.ndarray:
        """Sorted keys of all shingles of k words in windows that use this length."""
        own = {self.key(w[i : i + k]) for w in self.windows if min(SHINGLE, len(w)) == k for i in range(len(w) - k + 1)}
        return np.array(sorted(own), np.int64)

    def choose(self, counts: dict[tuple[int, int], int]) -> None:
        """counts: by (k, key). Picks each window's rarest shingle; windows that cannot occur are left out."""
        by: dict[int, dict[int, list]] = {}
        for w in self.windows:
            k = min(SHINGLE, len(w))
            ranked = [(counts.get((k, key), 0), i, key) for i in range(len(w) - k + 1) for key in [self.key(w[i : i + k])]]
            n, at, key = min(ranked)
            if n:
                by.setdefault(k, {}).setdefault(key, []).append((at, w))
        self.prefix = {k: (np.array(sorted(d), np.int64), [d[x] for x in sorted(d)]) for k, d in by.items()}


def _shingles(ids: np.ndarray, ends: np.ndarray, k: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and keys of the shingles of k known words that don't cross a document's end."""
    if len(ids) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(ids) - k + 1
    good = np.ones(n, bool)
    for j in range(k):
        good &= ids[j : j + n] > 0
    for j in range(k - 1):  # starts in the last k-1 words of a document
        cut = ends - 1 - j
        good[cut[(cut >= 0) & (cut < n)]] = False
    at = np.flatnonzero(good)
    key = np.zeros(len(at), np.int64)
    for j in range(k):
        key = key * base + ids[at + j]
    return at, key


def _chunks(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    chunk, n = [], 0
    for t in texts:
        chunk.append(words(t))
        n += len(chunk[-1])
        if n >= MAX_WORDS:
            yield chunk
            chunk, n = [], 0
    if chunk:
        yield chunk


def _ids(chunk: list[list[bytes]], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([len(c) for c in chunk])
    return np.fromiter(map(vocabulary.get, itertools.chain.from_iterable(chunk), itertools.repeat(0)), np.int64, int(ends[-1])), ends


def _find(keys: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """Place of each probe among the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(probes), -1)
    at = np.minimum(np.searchsorted(keys, probes), len(keys) - 1)
    return np.where(keys[at] == probes, at, -1)


def _count(texts: DataFrame, shared) -> dict[tuple[int, int], int]:
    """How often each benchmark shingle occurs in all documents: at most one row for each of the block's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        tokens = {k: index.tokens(k) for k in index.lengths()}
        totals = {k: np.zeros(len(t), np.int64) for k, t in tokens.items()}
        for batch in batches:
            for chunk in _chunks(batch.column(0).to_pylist()):
                ids, ends = _ids(chunk, index.vocabulary)
                for k in tokens:
                    at = _find(tokens[k], _shingles(ids, ends, k, len(index.vocabulary) + 1)[1])
                    totals[k] += np.bincount(at[at >= 0], minlength=len(tokens[k]))
        for k, n in totals.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(tokens[k][some]), pa.array(n[some])], names=["k", "key", "n"])

    found = texts.mapInArrow(run, "k int, key long, n long").groupBy("k", "key").agg(F.sum("n").alias("n")).collect()
    return {(r.k, r.key): r.n for r in found}


def _matches(chunk: list[list[bytes]], index: Index) -> Iterator[tuple[np.ndarray, set[str]]]:
    """Of each document: which words are hit, and the items."""
    ids, ends = _ids(chunk, index.vocabulary)
    hit, items = np.zeros(len(ids), bool), {}
    starts = ends - [len(c) for c in chunk]
    for k, (keys, owners) in index.prefix.items():
        at, key = _shingles(ids, ends, k, len(index.vocabulary) + 1)
        place = _find(keys, key)
        for i in np.flatnonzero(place >= 0):
            doc = int(np.searchsorted(ends, at[i], "right"))
            for offset, w in owners[place[i]]:
                s = int(at[i]) - offset
                if s >= starts[doc] and s + len(w) <= ends[doc] and tuple(ids[s : s + len(w)].tolist()) == w:
                    hit[s : s + len(w)] = True
                    items.setdefault(doc, set()).update(index.windows[w])
    for d in range(len(chunk)):
        yield hit[starts[d] : ends[d]], items.get(d, set())


def _names(docs: DataFrame) -> tuple[str, str]:
    """Names of the two more columns, which no column of the input has."""
    taken = {c.lower() for c in docs.columns}
    return tuple(next(n for i in itertools.count() if (n := f"__{word}{i or ''}") not in taken) for word in ("hit", "items"))


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_block: int = MAX_BLOCK_BYTES) -> DataFrame:
    """The documents with two more columns at the end: __hit, a byte for each word (1: hit), and __items, the ids of the items that occur, sorted as strings.
    (Where the input has columns of these names, a number follows.) Rows between the blocks of a large benchmark are written, so a worker holds one index."""
    spark = docs.sparkSession
    hit_col, items_col = _names(docs)
    items = benchmark.select(F.col("item_id").alias("item_id"), safe_text(F.col("text")).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // max_block) or 1
    out, at = docs, docs.columns.index("text")
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        index = Index.of([(r.item_id, r.text) for r in part.collect()], window)  # one block: about max_block bytes
        if index.windows:
            bare = spark.sparkContext.broadcast(index)
            index.choose(_count(docs.select(F.col("text").cast("string")), bare))
        shared = spark.sparkContext.broadcast(index)
        first = b == 0

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=first) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                found = [(h.astype(np.uint8), i) for chunk in _chunks(batch.column(at).to_pylist()) for h, i in _matches(chunk, index)]
                if not first:
                    found = [(h | np.frombuffer(o, np.uint8), i | set(j)) for (h, i), o, j in zip(found, batch.column(hit_col).to_pylist(), batch.column(items_col).to_pylist(), strict=True)]
                own = batch.columns if first else batch.columns[:-2]
                more = [pa.array([h.tobytes() for h, _ in found], pa.binary()), pa.array([sorted(i) for _, i in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*own, *more], names=[*(batch.schema.names if first else batch.schema.names[:-2]), hit_col, items_col])

        out = out.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{hit_col}` binary, `{items_col}` array<string>"]))
        if b < blocks - 1:
            out = materialize(out, "marked")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_block: int = MAX_BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [np.frombuffer(h, np.uint8) for h in batch.column("__hit").to_pylist()]
            items = batch.column("__items").to_pylist()
            n_hit = [int(h.sum()) for h in hits]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(h) for h in hits], pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_())],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mark(rows, benchmark, window, max_block).select("doc_id", "__hit", "__items").mapInArrow(digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The input's rows in which no window occurs, with all their columns as they were."""
    return mark(docs, benchmark, window).where(F.size(F.col(f"`{_names(docs)[1]}`")) == 0).select(*docs.columns)
