"""URL filter over a sorted digest array.

The rules' keys (host + path) are hashed with 64-bit xxhash, sorted, and written as an array file that
each executor gets as a Spark file and memory-maps. A probe hashes the candidates that a URL could match
(its host's suffixes times the path lengths that rules use), finds them by a vectorised binary search and
confirms the stored full string, so that a collision never decides. The list is cut into blocks of at
most MAX_BLOCK rules: each block is a file and a pass of its own, so no executor holds more than
one block, however long the list is.

A null URL, or one without `://`, has empty host and path and fits no rule. Repeated rows are judged alike.
Of rules with the same host and path the first counts. The longest fitting rule (host, then path) wins.
Only the id and the URL are read, so other columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm._common import materialize, scratch

#: Rules a block: 8 bytes of digest each, and the strings.
MAX_BLOCK = 4_000_000
_UPPER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (ASCII letters lower-cased) and path; empty without `://`."""
    at = url.find("://") if url is not None else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [i for i in map(rest.find, "?#") if i >= 0]
    rest = rest[: min(ends)] if ends else rest
    slash = rest.find("/")
    return (rest, "")[0].translate(_UPPER) if slash < 0 else rest[:slash].translate(_UPPER), "" if slash < 0 else rest[slash:]


class DigestArray:
    """One block of the list, in a file: sorted digests, order, string ends, then the strings."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            n, lengths = np.fromfile(f, np.int64, 2)
            self.lengths = np.fromfile(f, np.int64, int(lengths))
            start = f.tell()
        n = int(n)
        self.digests = np.memmap(path, np.uint64, "r", start, n) if n else np.zeros(0, np.uint64)
        self.ends = np.memmap(path, np.int64, "r", start + 8 * n, n + 1)
        self.verdicts = np.memmap(path, np.uint8, "r", start + 16 * n + 8, n) if n else np.zeros(0, np.uint8)
        self.text = np.memmap(path, np.uint8, "r", start + 17 * n + 8) if n else np.zeros(0, np.uint8)

    @staticmethod
    def packed(rules: Iterable[tuple[str, str, str]]) -> bytes:
        """A block's file; rules: (verdict, host, path)."""
        by: dict[str, tuple[bool, int]] = {}
        for verdict, host, tail in rules:
            by.setdefault(f"{host.translate(_UPPER)}{tail}", (verdict == "block", len(tail)))
        keys = sorted(by, key=xxhash.xxh64_intdigest)
        lengths = np.array(sorted({x for _, x in by.values()}), np.int64)
        raw = [k.encode() for k in keys]
        parts = [
            np.array([len(keys), len(lengths)], np.int64), lengths, np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64), np.cumsum([0, *map(len, raw)], dtype=np.int64), np.array([by[k][0] for k in keys], np.uint8),
        ]
        return b"".join([*(x.tobytes() for x in parts), *raw])

    def find(self, keys: Sequence[str]) -> np.ndarray:
        """Place of each key, or -1."""
        out = np.full(len(keys), -1)
        if not len(self.digests) or not len(keys):
            return out
        digests = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, digests)
        for i in np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, len(self.digests) - 1)] == digests)):
            raw, j = keys[i].encode(), int(at[i])
            while j < len(self.digests) and self.digests[j] == digests[i]:  # equal digests: compare what is stored
                if self.text[self.ends[j] : self.ends[j + 1]].tobytes() == raw:
                    out[i] = j
                j += 1
        return out


@functools.lru_cache(4)
def _opened(path: str) -> DigestArray:
    return DigestArray(path)


def _candidates(host: str, path: str, lengths: Sequence[int]) -> list[str]:
    """Longest host suffix first, then longest path first."""
    labels = host.split(".")
    return [f"{suffix}{path[:n]}" for i in range(len(labels)) if (suffix := ".".join(labels[i:])) for n in lengths[::-1] if n <= len(path)]


_OUT = "page_id long, host string, path string, rule string, verdict string"


def _put(folder: str, raw: bytes) -> str:
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    name = f"urls-{uuid.uuid4().hex}.bin"
    with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
        f.write(raw)
    return name


def write_blocks(spark: SparkSession, rules: Sequence[tuple[str, str, str]] | DataFrame, max_block: int = MAX_BLOCK) -> tuple[str, list[str]]:
    """Folder and names of the list's block files, in the shared folder. A table of rules (verdict, host, path) is written by tasks, a block each; of rows
    with the same host and path the first by verdict counts there."""
    folder = scratch(spark, "urls")
    if not isinstance(rules, DataFrame):
        return folder, [_put(folder, DigestArray.packed(rules[i : i + max_block])) for i in range(0, max(1, len(rules)), max_block)]
    own = rules.select("verdict", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    blocks = max(1, -(-own.count() // max_block))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))]
        if every:
            yield pa.RecordBatch.from_arrays([pa.array([_put(folder, DigestArray.packed(sorted(every)))])], names=["name"])

    dealt = own.repartition(blocks, F.xxhash64("host", "path")).mapInArrow(put, "name string")
    return folder, [r.name for r in materialize(dealt, "url-blocks").collect()] or [_put(folder, DigestArray.packed([]))]  # one name a block


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", max_block: int = MAX_BLOCK) -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict: the longest rule's, else default."""
    context = pages.sparkSession.sparkContext
    folder, names = write_blocks(pages.sparkSession, rules, max_block)
    for name in names:
        context.addFile(f"{folder}/{name}")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [SparkFiles.get(x) for x in names]
        for batch in batches:
            ids, urls = batch.column(0), batch.column(1).to_pylist()
            split = [split_url(u) for u in urls]
            best: list[tuple[int, int, str, int] | None] = [None] * len(urls)
            for path in blocks:
                block = _opened(path)
                keys: list[str] = []
                owner: list[int] = []
                for i, (host, tail) in enumerate(split):
                    own = _candidates(host, tail, block.lengths.tolist())
                    keys += own
                    owner += [i] * len(own)
                for j in np.flatnonzero((places := block.find(keys)) >= 0):
                    i, k = owner[j], keys[j]
                    n = len(k.split("/", 1)[0]), len(k)
                    if best[i] is None or (*n,) > best[i][:2]:
                        best[i] = (*n, k, int(block.verdicts[places[j]]))
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array([h for h, _ in split], pa.string()), pa.array([t for _, t in split], pa.string()), pa.array([b and b[2] for b in best], pa.string()), pa.array([("block" if b[3] else "allow") if b else default for b in best], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).mapInArrow(judge, _OUT)
