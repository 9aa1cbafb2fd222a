"""SimHash near-deduplication by covering locality-sensitive hashing.

A fingerprint has 64 bits: a bit is set if it is in over half of the XXH64 hashes of a text's shingles, repeats included. Fingerprints that differ in
at most RADIUS bits are linked.

Covering masks: bit i of the fingerprint is given one of the 2^(RADIUS + 1) - 1 nonzero vectors of RADIUS + 1 bits, in turn. Table v, for each nonzero v, keeps the bits
whose vector has an odd product with v. The RADIUS vectors of two fingerprints' differing bits are RADIUS equations in RADIUS + 1 unknowns, so
some table v has none of these bits: every pair within the radius agrees in some table, with no chance involved. Seven tables keep 36 or 37 of 64 bits.

Equal fingerprints are one node, so copies cost a row. The nodes meet in 7 tables of 17-byte rows. A bucket of at most LARGE nodes is searched at once: each node
is held against those that aren't reached yet, so a bucket gives at most a link less than it has nodes, never its pairs. The nodes of a larger bucket are
covered once more, by masks over the bits that the bucket leaves open (28 at most): each of its 7 tables keeps 16 of these, so a second bucket has at most
2^12 nodes, as all are different. No bucket is capped, and no task holds more than 4,096 nodes.

A null text, or one without words, has fingerprint zero and is linked like any other. Rows with a null doc_id take part; a component of such rows only
has a null id. Rows that repeat an id are linked by their own texts. An empty table gives an empty result. Other columns are not read by near_duplicates().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm._common import attach_by_key, materialize
from loomspark.llm.near_dedup import components

WORDS, SEED, RADIUS = 3, 42, 2
#: Nodes of a bucket beyond which it is covered once more.
LARGE = 1024
#: Rows of text held at once in a task, and shingles whose bits are counted at once.
ROWS, HELD = 500, 1 << 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The bits of each value of a byte, the lowest first.
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def fingerprint(text: bytes | None, words: int = WORDS, seed: int = SEED) -> int:
    """64 bits of a whole text, as an unsigned number."""
    own = (text or b"").translate(_LOWER).split()
    if not own:
        return 0
    k = min(words, len(own))
    flat, n = b" ".join(own), len(own) - k + 1
    starts = np.cumsum([0, *(len(w) + 1 for w in own[:-1])])
    ends = starts + [len(w) for w in own]
    digest, total = xxhash.xxh64_intdigest, np.zeros((8, 8), np.int64)
    for i in range(0, n, HELD):
        spans = zip(starts[i : min(n, i + HELD)].tolist(), ends[i + k - 1 : i + k - 1 + HELD].tolist())
        h = np.array([digest(flat[a:b], seed) for a, b in spans], "<u8").view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            total[byte] += np.bincount(h[:, byte], minlength=256) @ _BITS
    return sum(1 << i for i, c in enumerate(total.ravel().tolist()) if 2 * c > n)


def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the given bits: any `radius` of the bits are outside one of them."""
    many = 2 ** (radius + 1) - 1
    return [sum(1 << bit for i, bit in enumerate(bits) if ((i % many + 1) & v).bit_count() % 2) for v in range(1, many + 1)]


#: Tables over all bits, and for each of these the tables over the bits that it leaves open.
TABLES = covering_masks(list(range(64)))
INNER = [covering_masks([i for i in range(64) if not mask >> i & 1]) for mask in TABLES]


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def sketch(docs: DataFrame, words: int = WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in (big.slice(i, ROWS) for i in range(0, big.num_rows, ROWS)):
                own = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column(1)], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.view(np.int64))], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").cast("binary")).mapInArrow(run, "doc_id long, fingerprint long")


def spanning_links(nodes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within the radius of each other, directly or over others: one less than there are nodes in each group."""
    left, found = nodes.view(np.uint64), []
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            at = reached.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                new = left[near]
                found.append(np.stack([np.full(len(new), at), new]))
                reached.extend(new)
                left = left[~near]
    both = np.concatenate([np.zeros((2, 0), np.uint64), *found], axis=1).view(np.int64)
    return both[0], both[1]


def _search(dealt: DataFrame, large: int) -> DataFrame:
    """Rows (table, key, node), the nodes of a bucket all different, to links (a, b) within buckets. A bucket of more than `large` nodes isn't held: it
    streams through as rows of table and node (a), with b null."""

    def rows(a: np.ndarray, b: np.ndarray | None = None, table: int | None = None) -> pa.RecordBatch:
        second = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)
        return pa.RecordBatch.from_arrays([pa.array([table] * len(a), pa.int32()), pa.array(a), second], names=["table", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, n, found = None, [], 0, []

        def done() -> Iterator[pa.RecordBatch]:
            if n > large:
                yield from (rows(part, None, place[0]) for part in held)
            elif n > 1:
                found.append(spanning_links(np.concatenate(held)))

        def linked() -> Iterator[pa.RecordBatch]:
            if found:
                yield rows(*(np.concatenate(x) for x in zip(*found)))
                found.clear()

        for batch in batches:
            table, key, node = (batch.column(i).to_numpy() for i in range(3))
            cuts = (np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1])) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(node)]):
                own = (int(table[lo]), int(key[lo]))
                if own != place:
                    yield from done()
                    place, held, n = own, [], 0
                held.append(node[lo:hi])
                n += hi - lo
                if n > large:
                    yield from done()
                    held = []
            yield from linked()
        yield from done()
        yield from linked()

    return materialize(dealt.repartition("table", "key").sortWithinPartitions("table", "key").mapInArrow(run, "table int, a long, b long"), "simhash-links")


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that join all fingerprints (node, all different) within RADIUS: fewer than 7 for each node or, where buckets are large, 49."""
    node, many = F.col("node"), len(TABLES)
    kept = lambda masks: [node.bitwiseAND(F.lit(signed(m))) for m in masks]
    first = _search(nodes.select(F.posexplode(F.array(*kept(TABLES))).alias("table", "key"), "node"), LARGE)
    found, large = first.where("b is not null").select("a", "b"), first.where("b is null").select("table", F.col("a").alias("node"))
    if large.isEmpty():
        return found
    # a second bucket is known by both tables and all bits that either keeps
    again = F.array(*(F.array(*kept([m | outer for m in masks])) for outer, masks in zip(TABLES, INNER)))[F.col("table")]
    dealt = large.select("table", "node", F.posexplode(again).alias("inner", "key")).select((F.col("table") * many + F.col("inner")).alias("table"), "key", "node")
    return found.unionByName(_search(dealt, 1 << 12).select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable over links) for each row."""
    rows = materialize(sketch(docs, id_col=id_col, text_col=text_col), "fingerprints")
    nodes = materialize(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("members")), "nodes")
    trees = components(links(nodes.select(F.col("fingerprint").alias("node"))))
    labelled = nodes.join(trees, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", "members", F.coalesce("label", "fingerprint").alias("label"))
    labelled = materialize(labelled, "labelled")
    ids = materialize(labelled.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "component-ids")
    named = materialize(attach_by_key(labelled.select("fingerprint", "members", "label"), ids, "label", "n", nodes.count()).select("fingerprint", "members", "component_id"), "named")
    return attach_by_key(rows, named, "fingerprint", "members", rows.count()).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
