"""Best-fit packing of documents into sequences of a fixed number of tokens.

1. Documents become pieces of at most `capacity` tokens. A piece's rank among all pieces of its length is found from counts
   per partition and prefix sums, without a sort.
2. The driver plans on the histogram of lengths alone (at most `capacity` numbers, however many pieces there are). Linear grouping:
   lengths over `capacity / SMALL` are dealt, longest first, into GROUPS groups of equal cardinality and rounded up to their group's
   longest; the few rounded sizes are combined into configurations by column generation on the linear programme; the rounded-down
   number of each configuration is filled with actual lengths, and what is left over goes by best fit, as do then all small
   lengths, longest first, into the gaps.
3. The plan is a table of runs (length, ranks -> sequences, offset), a few for each length, which is broadcast; every piece finds its
   place by binary search. No piece is moved, sorted or gathered.

A null text is empty: a piece of one token, the end-of-document id. Ids may be null or repeat; each row is packed on its own. An empty
table gives an empty result. Other columns are not read. The tokenizer file is a parameter.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm._common import materialize, scratch

CAPACITY = 4096
GROUPS = 40
SMALL = 8
END_ID = 1
#: Words whose ids a worker remembers, and characters tokenized together.
CACHE_WORDS, CHUNK_CHARS = 250_000, 1_000_000
#: Words of each worker whose ids are compared with the tokenizer's own.
CHECK_ONE_IN = 500
CHECK_WORDS = 2000


# -- tokens


class WordCache:
    """Ids of texts, word by word: the tokenizer's pieces never span white space, and words repeat."""

    odd = re.compile(r"[\x1c-\x1f]")  # white space to Python, but not to the tokenizer

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.merge, self.checked = self._merger(), 0

    def _fresh(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merger(self):
        """The tokenizer's merges run by tiktoken, which takes a third of the time for one word: byte 255, which UTF-8 never has, stands for the end of a word."""
        import tiktoken

        model = json.loads(self.tokenizer.to_str())["model"]
        suffix = model.get("end_of_word_suffix") or ""
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of = {chr(c): c for c in visible} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in visible)}
        ranks = {}
        for token, i in model["vocab"].items():
            core = token.removesuffix(suffix) if suffix else token
            if set(core) <= of.keys() and (core != chr(255) or core != token):
                ranks[bytes(map(of.__getitem__, core)) + b"\xff" * (core != token)] = i
        ranks[b"\xff"] = max(ranks.values()) + 1
        return tiktoken.Encoding("words", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words: Latin letters, with or without common marks after them, through the merger, others through the tokenizer."""
        out, rest, merge = {}, [], self.merge
        for w in words:
            core = w.rstrip(".,|;:!?")
            if core.isalpha() and max(core) < "\u0250" and (low := unicodedata.normalize("NFC", core).lower()).isalpha():
                ids = merge(low.encode() + b"\xff")
                if len(core) < len(w):
                    ids = ids + merge(w[len(core) :].encode() + b"\xff")
                out[w] = array("I", ids).tobytes()
            else:
                rest.append(w)
        # both must agree: on all of a worker's first words, then on a share of the new ones, drawn by hash
        own = list(out)[:CHECK_WORDS] if self.checked < CHECK_WORDS else [w for w in out if not zlib.crc32(w.encode()) % CHECK_ONE_IN]
        if own:
            self.checked += len(own)
            if [out[w] for w in own] != self._fresh(own):
                raise ValueError("the merger and the tokenizer differ")
        for i in range(0, len(rest), 2000):
            out |= zip(rest[i : i + 2000], self._fresh(rest[i : i + 2000]))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [[] if self.odd.search(t) else t.split() for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = list(set().union(*split).difference(self.known))
        self.known.update(self._words(new))
        out = [b"".join(map(self.known.__getitem__, s)) for s in split]
        for w in new:
            if len(w) > 200:
                del self.known[w]
        for i, t in enumerate(texts):
            if t and self.odd.search(t):
                out[i] = self._fresh([t])[0]
        return out


@functools.lru_cache(1)
def _cache(path: str) -> WordCache:
    return WordCache(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, on demand, ids of each piece; part and local number pieces of a length within a partition."""
    path, end = tokenizer or default_tokenizer(), np.array([END_ID], np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, cache = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64).tolist(), _cache(path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            i = 0
            while i < len(ids):
                j, n = i, 0
                while j < len(ids) and n < CHUNK_CHARS:
                    n += len(texts[j])
                    j += 1
                cols: list[list] = [[] for _ in range(8)]
                for doc, raw in zip(ids[i:j], cache.encode(texts[i:j])):
                    raw += end
                    for p, at in enumerate(range(0, len(raw), 4 * capacity)):
                        own = raw[at : at + 4 * capacity]
                        length = len(own) // 4
                        for c, v in zip(cols, (doc, p, at // 4, length, zlib.crc32(own), part, seen[length], own)):
                            c.append(v)
                        seen[length] += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()][: 7 + with_ids]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names[: 7 + with_ids])
                i = j

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _PIECE + ", ids binary" * with_ids)


# -- the plan, on the histogram


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """Most valuable multiset of sizes within the capacity."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        fits = sizes <= c
        got = np.where(fits, best[np.maximum(c - sizes, 0)] + values, -np.inf)
        g = int(got.argmax())
        best[c], last[c] = (got[g], g) if got[g] > best[c - 1] else (best[c - 1], -1)
    out, c = np.zeros(len(sizes), int), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            out[last[c]] += 1
            c -= int(sizes[last[c]])
    return out, float(best[capacity])


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 300) -> list[tuple[np.ndarray, int]]:
    """(how many of each size, how many bins) of a basic solution of the configuration programme, rounded down."""
    if not len(sizes):
        return []
    basis = np.diag(capacity // sizes).astype(float)
    x = demand / np.diag(basis)
    for _ in range(rounds):
        config, value = _knapsack(sizes, np.linalg.solve(basis.T, np.ones(len(sizes))), capacity)
        if value <= 1 + 1e-7:
            break
        move = np.linalg.solve(basis, config)
        ratio = np.where(move > 1e-9, x / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = np.maximum(x - ratio[out] * move, 0)
        x[out] = ratio[out]
        basis[:, out] = config
    return [(basis[:, i].round().astype(int), int(x[i] + 1e-7)) for i in range(len(sizes)) if int(x[i] + 1e-7)]


class _Bins:
    """Classes of equally filled bins: [number, [(length, first rank, pieces a bin), ...]] by gap."""

    def __init__(self, capacity: int):
        self.by_gap: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.open = np.zeros(capacity + 1, bool)
        self.capacity = capacity

    def put(self, gap: int, count: int, parts: list[tuple[int, int, int]]) -> None:
        if count:
            self.by_gap[gap].append([count, parts])
            self.open[gap] = True

    def take(self, least: int) -> tuple[int, int, list]:
        """A class with the smallest sufficient gap; a count of 0 if there is none."""
        where = np.flatnonzero(self.open[least:])
        if not len(where):
            return self.capacity, 0, []
        gap = least + int(where[0])
        count, parts = self.by_gap[gap].pop()
        self.open[gap] = bool(self.by_gap[gap])
        return gap, count, parts

    @staticmethod
    def skip(parts: list, bins: int) -> list:
        return [(length, first + bins * t, t) for length, first, t in parts]

    def best_fit(self, length: int, first: int, count: int) -> None:
        """Places pieces of one length, ranks from first on."""
        while count:
            gap, bins, parts = self.take(length)
            t = gap // length
            if not bins:
                bins = -(-count // t)
            full = min(bins, count // t)
            self.put(gap - t * length, full, [*parts, (length, first, t)])
            first, count = first + full * t, count - full * t
            parts, bins = self.skip(parts, full), bins - full
            if bins and 0 < count < t:
                self.put(gap - count * length, 1, [*parts, (length, first, count)])
                parts, bins, count = self.skip(parts, 1), bins - 1, 0
            self.put(gap, bins, parts)


def plan(histogram: np.ndarray, groups: int = GROUPS, small: int = SMALL) -> np.ndarray:
    """Runs (length, first rank, pieces a bin, bins, first sequence, offset), by length and rank."""
    capacity = len(histogram) - 1
    bins = _Bins(capacity)
    bins.put(0, int(histogram[capacity]), [(capacity, 0, 1)])
    large = [(s, int(histogram[s])) for s in range(capacity - 1, capacity // small, -1) if histogram[s]]
    per = -(-sum(n for _, n in large) // groups) if large else 1
    dealt: list[list[list[int]]] = []  # groups of [length, first rank, count]
    room = 0
    for s, n in large:
        first = 0
        while n:
            if not room:
                dealt.append([])
                room = per
            k = min(n, room)
            dealt[-1].append([s, first, k])
            first, n, room = first + k, n - k, room - k
    sizes, demand = np.array([g[0][0] for g in dealt], int), np.array([sum(r[2] for r in g) for g in dealt], float)
    for config, count in configurations(sizes, demand, capacity):
        while count:
            parts, step = [], count
            for g in np.flatnonzero(config):
                run = dealt[g][0]
                step = min(step, run[2] // config[g]) if run[2] >= config[g] else 0
            step = step or 1
            for g in np.flatnonzero(config):
                need = int(config[g])
                while need:
                    run = dealt[g][0]
                    t = min(need, run[2])
                    parts.append((run[0], run[1], t))
                    run[1], run[2], need = run[1] + step * t, run[2] - step * t, need - t
                    if not run[2]:
                        dealt[g].pop(0)
            bins.put(capacity - sum(s * t for s, _, t in parts), step, parts)
            count -= step
    for s, first, n in sorted((r for g in dealt for r in g), reverse=True):
        bins.best_fit(s, first, n)
    for s in range(capacity // small, 0, -1):
        if histogram[s]:
            bins.best_fit(s, 0, int(histogram[s]))
    runs, sequence = [], 0
    for own in bins.by_gap:
        for count, parts in own:
            offset = 0
            for s, first, t in parts:
                runs.append((s, first, t, count, sequence, offset))
                offset += s * t
            sequence += count
    return np.array(sorted(runs), np.int64).reshape(-1, 6)


# -- all together

#: Partitions whose counts lie in one file.
PARTS_A_FILE = 64


def _pieces_ahead(per_part: DataFrame) -> str:
    """Writes how many pieces of each length earlier partitions have, in a file for PARTS_A_FILE partitions; a task reads those of its own partitions only."""
    before = per_part.select("part", "length", (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("before"))
    path = scratch(per_part.sparkSession, "pieces-ahead")
    before.withColumn("bucket", F.floor(F.col("part") / PARTS_A_FILE).cast("int")).repartition("bucket").sortWithinPartitions("bucket", "part").write.partitionBy("bucket").parquet(path)
    return path


class _Ahead:
    """Those counts, read as they are needed; a task meets few partitions, one after another."""

    def __init__(self, path: str, capacity: int):
        self.path, self.capacity, self.known = path, capacity, {}

    def of(self, parts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = np.zeros(len(parts), np.int64)
        for part in np.unique(parts).tolist():
            if part not in self.known:
                fs, root = pafs.FileSystem.from_uri(self.path)
                rows = pq.read_table(f"{root}/bucket={part // PARTS_A_FILE}", filesystem=fs, columns=["length", "before"], filters=[("part", "=", part)], partitioning=None)
                own = np.zeros(self.capacity + 1, np.int64)
                own[rows.column("length").to_numpy()] = rows.column("before").to_numpy()
                if len(self.known) > 8:
                    self.known.clear()
                self.known[part] = own
            some = parts == part
            out[some] = self.known[part][lengths[some]]
        return out


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of each piece."""
    pieces = materialize(cut_pieces(docs, capacity, tokenizer, with_ids), "pieces")
    per_part = materialize(pieces.groupBy("part", "length").count(), "piece-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in per_part.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most `capacity` rows
        histogram[r.length] = r.n
    runs = docs.sparkSession.sparkContext.broadcast(plan(histogram))  # a few rows for each length
    ahead = _pieces_ahead(per_part)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, before = runs.value, _Ahead(ahead, capacity)
        keys = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("local").to_numpy() + before.of(batch.column("part").to_numpy(), length)
            run = table[np.searchsorted(keys, length << 48 | rank, "right") - 1] if len(length) else np.zeros((0, 6), np.int64)
            at = rank - run[:, 1]
            t = np.maximum(run[:, 2], 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(run[:, 4] + at // t), pa.array(run[:, 5] + at % t * length)], names=[*names, "sequence_id", "offset"])

    return pieces.select(*names, "part", "local").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids binary, " * with_ids + "sequence_id long, offset long")
