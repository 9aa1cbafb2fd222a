"""MinHash near-deduplication with circulant permutations and exact verification.

Signature: a first permutation (sigma) spreads a document's shingles over 2^32 places; a second one (pi), circularly shifted by k,
gives coordinate k as the least value over the set. BANDS * ROWS coordinates need no more than these two permutations. Documents that agree
in a band are candidates: at a similarity of 0.75 a pair is missed with probability (1 - 0.75^3)^24, about 2 in a million.

1. Documents with equal sets form a class; only its smallest doc_id goes on.
2. A band's pivot is its class with most neighbours over all bands, which lies amid its variants. Each class is compared with the pivot
   that it shares most bands with, then, where several trees of links still meet in a band, with two pivots drawn by hash. The
   trees of verified links already join most copies: a few comparisons for each class, never one for each two.
3. Only in bands that still hold several trees are classes of different trees compared. Shingles that no other class in such bands has are in
   no intersection; a class with over a quarter of them has no link at all. Bands with the same
   classes are compared once, and two classes in the least band that they share. A band's
   classes are dealt to blocks of about BLOCK classes or BLOCK_BYTES of shingles; the largest tree has blocks of its own, which are never held
   against each other. Blocks meet in cells, first by FINE coordinates, which drop classes without a likely partner (a pair at 0.75 is lost with a probability
   below 1 in a million), then by their shingles, all sizes of intersections at once; full sets decide, and a cell gives one link
   for each two trees that it joins: fewer links than it has classes. In bands with over MANY cells a first pass over cells on the diagonal joins
   what it can before the rest is dealt.
So every pair that shares a band is either joined already or verified; no bucket is capped, no pairs are written, and no task gets more than two blocks at once.

A null text has an empty set, as have texts without words; these are linked with nothing. Rows with a null doc_id take part under a 64-bit hash
of their text (which is an id of another row with a probability of rows / 2^64); a component of such rows only has a null id, and one text of it is kept. Any 64-bit id is
an id. Rows that repeat an id with other texts share a component, which the least of their sets (as bytes) decides. An empty table gives an empty result. Other columns are not read by near_duplicates().
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm._common import HOT_SHARE, attach_by_key, materialize, safe_text
from loomspark.llm.bloom import bitmaps, keep_decided, probed

WORDS = 5
PERCENT = 75
BANDS, ROWS = 24, 3
#: A block's classes and bytes of shingles, about.
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: Cells of a band from which a pass over the diagonal comes first.
MANY = 16
#: Rows of one pivot that are compared with one copy of its set.
SALT = 1024
#: Coordinates (of 8 bits) that estimate a similarity, and how many must agree: 4.8 standard deviations below 0.75.
FINE, LEAST_EQUAL = 256, 159
#: Shingles whose bits are counted at once in a cell; a multiple of 64.
COLUMNS = 8192
#: Rows of a band that meet one copy of what is known of the band.
BAND_ROWS = 4096
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
#: Shingles hashed at once, so that all steps stay in the processor's cache.
CHUNK = 1 << 15


class _Hashes(dict):
    """64-bit hash of each word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[0]
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, of: _Hashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    own = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    h = np.fromiter(map(of.__getitem__, own), np.uint64, len(own))
    if not len(h):
        return h
    k = min(words, len(h))
    n = len(h) - k + 1
    total = np.full(n, k, np.uint64)
    for j in range(k):
        total = mixed(total + h[j : j + n] * _MIX[j % 5])
    return np.unique(total)


def signatures(sets: list[np.ndarray], coordinates: int = BANDS * ROWS) -> np.ndarray:
    """A row of 32-bit coordinates for each set that isn't empty."""
    out = np.zeros((len(sets), coordinates), np.uint32)
    filled = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(filled):
        end, n = at, 0
        while end < len(filled) and (end == at or n + len(sets[filled[end]]) <= CHUNK):
            n += len(sets[filled[end]])
            end += 1
        own = filled[at:end]
        starts = np.cumsum([0, *(len(sets[i]) for i in own[:-1])])
        every = np.concatenate([sets[i] for i in own])
        sigma = ((every * _MIX[3]) >> np.uint64(32)).astype(np.uint32)
        for k in range(coordinates):
            x = sigma + np.uint32(k)  # the circular shift
            x ^= x >> np.uint32(16)
            x *= np.uint32(0x85EBCA6B)
            x ^= x >> np.uint32(13)
            x *= np.uint32(0xC2B2AE35)
            out[own, k] = np.minimum.reduceat(x, starts)
        at = end
    return out


def _numbered(docs: DataFrame) -> list[Column]:
    """doc_id, node (the id, or a 64-bit hash of the text) and text."""
    text = docs["text"].cast("string")
    own = F.col("doc_id").cast("long")
    return [own.alias("doc_id"), F.coalesce(own, F.xxhash64(safe_text(text))).alias("node"), text.alias("text")]


def sketch(docs: DataFrame, identity: bool = False) -> DataFrame:
    """doc_id, node, n_shingles, key (of the set), bands and, on demand, the text's SHA-256 of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Hashes()
        for big in batches:
            for i in range(0, big.num_rows, 500):
                batch = big.slice(i, 500)
                sets = [shingle_set(t, of) for t in batch.column(2).to_pylist()]
                sig = signatures(sets)
                bands = np.zeros((len(sets), BANDS), np.uint64)
                for b in range(BANDS):
                    for r in range(ROWS):
                        bands[:, b] = mixed(bands[:, b] + sig[:, b * ROWS + r].astype(np.uint64) + np.uint64((b + 1) * int(_MIX[1]) % 2**64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()))
                keys = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), keys, lists, *batch.columns[3:]], names=["doc_id", "node", "n_shingles", "key", "bands", *batch.schema.names[3:]]
                )

    sha = [F.unhex(F.sha2(safe_text(F.col("text")), 256)).alias("sha")] if identity else []
    return docs.select(*_numbered(docs), *sha).mapInArrow(run, "doc_id long, node long, n_shingles long, key binary, bands array<long>" + ", sha binary" * identity)


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node reachable, for each node of edges (a, b). Least labels spread over links, and labels of labels are followed. The rows are
    16 bytes; a node or label that many have is split by Spark's adaptive skew join."""
    both = materialize(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct(), "links")
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        spread = materialize(labels.join(near, F.col("node") == F.col("u")).select("node", F.least("label", "near").alias("label"), F.col("label").alias("old")), "labels")
        follow = spread.select(F.col("node").alias("at"), F.col("label").alias("next"))
        labels = materialize(spread.join(follow, F.col("label") == F.col("at"), "left").select("node", F.coalesce("next", "label").alias("label"), "old"), "labels")
        if labels.where("label != old").isEmpty():
            return labels.select("node", "label")
        labels = labels.drop("old")


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, shingles (sorted 64-bit hashes) of at least the documents wanted: a Bloom filter of these lets them through, so no text is shuffled."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Hashes()
        for big in batches:
            for i in range(0, big.num_rows, 500):
                batch = big.slice(i, 500)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, of).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["node", "shingles"])

    own = wanted.select(F.xxhash64("node").alias("h"))
    texts = probed(docs.select(*_numbered(docs)[1:]), F.xxhash64("node"), bitmaps(own, own.count(), distinct=True), "__some").where("__some").select("node", "text")
    full = materialize(texts.mapInArrow(sets, "node long, shingles binary"), "shingles")
    repeats = full.groupBy("node").count().where("count > 1")
    return full if repeats.isEmpty() else materialize(full.groupBy("node").agg(F.min("shingles").alias("shingles")), "shingles")


def _linked(full: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough; an a with very many pairs is met by several copies of its set."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (big.slice(i, 500) for big in batches for i in range(0, big.num_rows, 500)):
            good = []
            last, x = None, None
            for a, raw, other in zip(batch.column("a").to_pylist(), batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
                if a != last:
                    last, x = a, np.frombuffer(raw, np.uint64)
                y = np.frombuffer(other, np.uint64)
                both = int(np.intersect1d(x, y, assume_unique=True).size)
                good.append(100 * both >= PERCENT * (x.size + y.size - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    n = pairs.count()
    hot = F.broadcast(pairs.groupBy("a").count().where(F.col("count") > max(SALT, n // HOT_SHARE)).select("a", F.ceil(F.col("count") / SALT).alias("copies")))  # fewer than HOT_SHARE rows
    copies = F.coalesce("copies", F.lit(1).cast("long"))
    dealt = pairs.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), copies).alias("copy"))
    # Bloom filters of the pairs' ends: no other set is moved
    having = lambda end: probed(full, F.xxhash64("node"), bitmaps(pairs.select(F.xxhash64(end).alias("h")), n, distinct=end == "b"), "__some").where("__some")  # noqa: E731  a b has two pairs at most
    sets = having("a").select(F.col("node").alias("a"), F.col("shingles").alias("set_a")).join(hot, "a", "left").select("a", "set_a", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy"))
    one = dealt.join(having("b").select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
    return materialize(one.join(sets, ["a", "copy"]).select("a", "b", "set_a", "set_b").mapInArrow(check, "a long, b long").distinct(), "linked")


def _having(full: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sets of at least these nodes: they pass a Bloom filter, and none is moved."""
    own = materialize(nodes.select(F.xxhash64("node").alias("h")).distinct(), "nodes")
    return probed(full, F.xxhash64("node"), bitmaps(own, own.count(), distinct=True), "__some").where("__some").drop("__some")


def _fine_signatures(full: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, n_shingles, sig (FINE coordinates of the whole set) of the wanted documents (and of a few others) that share enough shingles with others to have a link. Only
    shingles travel, each with its node; no set does."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, 200):
                batch = big.slice(i, 200)
                sets = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
                ids = batch.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *sets])), pa.array(np.repeat(ids, [len(x) for x in sets]))], names=["shingle", "node"])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            sig = signatures(sets, FINE).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sig], pa.binary())], names=["node", "n_shingles", "sig"])

    some = _having(full, wanted)
    rows = some.select("node", "shingles").mapInArrow(spread, "shingle long, node long")
    alone = rows.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    sizes = some.select("node", (F.octet_length("shingles") / 8).cast("long").alias("n"))
    enough = 100 * (F.col("n") - F.coalesce("alone", F.lit(0))) >= PERCENT * F.col("n")
    kept = materialize(sizes.join(alone, "node", "left").where(enough).select("node"), "sharing")
    return materialize(_having(full, kept).join(kept, "node", "left_semi").select("node", "shingles").mapInArrow(signed, "node long, n_shingles long, sig binary"), "fine")


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a's with b's sets: bits for the shingles that both sides have, COLUMNS at a time."""
    flat = [np.concatenate([np.zeros(0, np.uint64), *x]) for x in (a, b)]
    known = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    total = np.zeros((len(a), len(b)), np.int64)
    if not len(known):
        return total
    entries = []
    for sets, every in zip((a, b), flat):
        row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        at = np.searchsorted(known, every)
        hit = known[np.minimum(at, len(known) - 1)] == every
        row, at = row[hit], at[hit]
        order = np.argsort(at, kind="stable")
        entries.append((row[order], at[order]))
    for k in range(0, len(known), COLUMNS):
        bits = []
        for sets, (row, at) in zip((a, b), entries):
            lo, hi = np.searchsorted(at, (k, k + COLUMNS))
            m = np.zeros((len(sets), COLUMNS), bool)
            m[row[lo:hi], at[lo:hi] - k] = True
            bits.append(np.packbits(m, axis=1).view(np.uint64))
        for i, own in enumerate(bits[0]):
            total[i] += np.bitwise_count(bits[1] & own).sum(1, dtype=np.int64)
    return total


def joining_links(sides: list[list[tuple[int, int, np.ndarray]]]) -> list[tuple[int, int]]:
    """Links that join the trees of one cell's two sides of (label, n_shingles, shingles): at most one less than there are trees."""
    (la, na, sa), (lb, nb, sb) = [(np.array([m[0] for m in s], np.int64), np.array([m[1] for m in s]), [m[2] for m in s]) for s in sides]
    both = intersections(sa, sb)
    good = (la[:, None] != lb) & (100 * both >= PERCENT * (na[:, None] + nb - both))
    x, y = np.nonzero(good)
    above: dict[int, int] = {}

    def root(v: int) -> int:
        while above.get(v, v) != v:
            v = above[v]
        return v

    out = []
    for a, b in np.unique(np.sort(np.stack([la[x], lb[y]], 1), axis=1), axis=0).tolist():
        p, q = root(a), root(b)
        if p != q:
            above[max(p, q)] = min(p, q)
            out.append((a, b))
    return out


def _blocks(rows: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes of each band (band, n, node, label) with their sizes, and each band's numbers of blocks; sizes: node, size in bytes."""
    sized = materialize(rows.join(sizes, "node"), "block-rows")
    trees = sized.groupBy("band", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("s"), F.max("n").alias("n")).groupBy("band")
    stats = trees.agg(F.max(F.struct("c", "label", "s")).alias("m"), F.sum("c").alias("members"), F.sum("s").alias("s"), F.max("n").alias("n"))
    blocks = lambda c, s: F.greatest(F.ceil(c / BLOCK), F.ceil(s / BLOCK_BYTES)).cast("int")
    others = blocks(F.col("members") - F.col("m.c"), F.col("s") - F.col("m.s")).alias("others")
    return sized, materialize(stats.select("band", "n", F.col("m.label").alias("largest"), blocks(F.col("m.c"), F.col("m.s")).alias("k"), others), "blocks")


def _cells(sized: DataFrame, plan: DataFrame, diagonal: bool = False) -> DataFrame | None:
    """band, lo, hi, own, label, node: the classes dealt to blocks, and the cells in which blocks meet. None if only large bands were asked for and there are none."""
    cells = F.col("others") * (F.col("others") + 1) / 2 + F.col("others") * F.col("k")
    plan = plan.where(cells > MANY if diagonal else F.col("others") > 0)
    if diagonal and plan.isEmpty():
        return None
    # blocks of the other trees have the numbers 0 to others - 1, those of the largest tree come behind them
    number = F.xxhash64("node", F.lit(int(diagonal)))
    large = F.col("label") == F.col("largest")
    own = F.when(large, F.col("others") + F.pmod(number, F.col("k").cast("long"))).otherwise(F.pmod(number, F.greatest("others", F.lit(1)).cast("long"))).cast("int")
    low = F.sequence(F.lit(0), F.col("others") - 1)
    if diagonal:
        meets = F.when(large, F.filter(low, lambda j: j % F.col("k") == F.col("own") - F.col("others"))).otherwise(F.array(F.col("own"), F.col("others") + F.col("own") % F.col("k")))
    else:
        meets = F.when(large, low).otherwise(F.sequence(F.lit(0), F.col("others") + F.col("k") - 1))
    dealt = _meet(sized, plan).withColumn("own", own).withColumn("other", F.explode(meets))
    return dealt.select("band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "label", "node")


def _by_cell(cells: DataFrame, facts: DataFrame, judge: Callable[[int, list, list], Iterable[tuple[int, int]]], out: str) -> DataFrame:
    """Rows of two numbers that judge(band, side, side) finds in each cell; a side has (node, label, facts) of each class. facts: node, and what is known of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: list = [None, [], []]

        def found() -> pa.RecordBatch:
            sides = [cell[1], cell[2] if cell[0][1] != cell[0][2] else cell[1]]
            rows = list(judge(cell[0][0], *sides)) if all(sides) else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.int64()) for k in (0, 1)], names=["x", "y"])

        for batch in batches:
            *place, own = (c.to_pylist() for c in batch.columns[:4])
            for where, o, *member in zip(zip(*place), own, *(c.to_pylist() for c in batch.columns[4:])):
                if where != cell[0]:
                    if cell[0]:
                        yield found()
                    cell = [where, [], []]
                cell[1 if o == where[1] else 2].append(member)
        if cell[0]:
            yield found()

    wide = cells.join(facts, "node").select("band", "lo", "hi", "own", "node", "label", *facts.columns[1:])
    rows = wide.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi").mapInArrow(run, "x long, y long").distinct()
    return materialize(rows.toDF(*out.split()), "by-cell")


def _bits(rows: list[list[int]], width: int) -> np.ndarray:
    """A row of bits for each list of places."""
    out = np.zeros((len(rows), -(-width // 8)), np.uint8)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    places = np.array([p for r in rows for p in r], np.int64)
    np.bitwise_or.at(out, (at, places >> 3), (1 << (places & 7)).astype(np.uint8))
    return out


def _likely(band: int, one: list, two: list) -> Iterator[tuple[int, int]]:
    """Those of a cell's classes that some class of another tree may be similar to, by size and by the finer signature; two classes that share several bands
    are told in the least of them only, so that their sets meet once. A member: node, label, n_shingles, sig, its bands."""
    sides = [(np.array([m[1] for m in s], np.int64), np.array([m[2] for m in s]), np.frombuffer(b"".join(m[3] for m in s), np.uint8).reshape(len(s), -1)) for s in (one, two)]
    (la, na, sa), (lb, nb, sb) = sides
    before = {b: i for i, b in enumerate({b for s in (one, two) for m in s for b in m[4] if b < band})}
    earlier = [_bits([[before[b] for b in m[4] if b < band] for m in s], len(before)) for s in (one, two)]
    x, y = np.nonzero((la[:, None] != lb) & (100 * np.minimum(na[:, None], nb) >= PERCENT * np.maximum(na[:, None], nb)))
    for k in range(0, len(x), 20_000):
        i, j = x[k : k + 20_000], y[k : k + 20_000]
        good = (sa[i] == sb[j]).sum(1) >= LEAST_EQUAL
        i, j = i[good], j[good]
        good = ~(earlier[0][i] & earlier[1][j]).any(1)
        yield from ((band, one[p][0]) for p in np.unique(i[good]).tolist())
        yield from ((band, two[p][0]) for p in np.unique(j[good]).tolist())


def _across(sets: DataFrame, blocks: tuple[DataFrame, DataFrame], diagonal: bool = False) -> DataFrame | None:
    """Links (a, b) between labels whose classes share a band and are similar. None if only large bands were asked for and there are none."""
    cells = _cells(*blocks, diagonal)
    if cells is None:
        return None
    unpacked = lambda side: [(label, n, np.frombuffer(raw, np.uint64)) for _, label, n, raw in side]
    return _by_cell(cells, sets.select("node", (F.octet_length("shingles") / 8).cast("long").alias("n_shingles"), "shingles"), lambda band, one, two: joining_links([unpacked(one), unpacked(two)]), "a b")


def _meet(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (band, n, node) with what is known of each band (band, n); a band of n rows meets a copy of it for each BAND_ROWS rows."""
    copies = F.greatest(F.ceil(F.col("n") / BAND_ROWS), F.lit(1)).cast("long")
    each = known.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("n")
    return rows.withColumn("__copy", F.pmod(F.xxhash64("node"), copies)).join(each, ["band", "__copy"]).drop("__copy")


def _to_pivots(rows: DataFrame, most: int) -> DataFrame:
    """Pairs (a: pivot, b: node): for each document those pivots that it shares most bands with; rows: node, pivot."""
    counted = rows.where("pivot != node").groupBy("node", "pivot").count().groupBy("node")
    best = counted.agg(F.max(F.struct("count", "pivot")).alias("m")).select("node", F.array("m").alias("m")) if most == 1 else counted.agg(F.slice(F.sort_array(F.collect_list(F.struct("count", "pivot")), False), 1, most).alias("m"))  # at most a pivot for each band
    return materialize(best.select(F.col("node").alias("b"), F.explode("m").alias("m")).select(F.col("m.pivot").alias("a"), "b"), "pairs")


def _open(shared: DataFrame, trees: DataFrame) -> DataFrame:
    """Of the rows band, n, node those in bands where several trees meet, with each document's label."""
    labelled = materialize(shared.join(trees, "node", "left").select("band", "n", "node", F.coalesce("label", "node").alias("label")), "labelled")
    several = labelled.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max("n").alias("n")).where("x != y").select("band", "n")
    return materialize(_meet(labelled, several).select("band", "n", "node", "label"), "open-rows")


def _renamed(trees: DataFrame, between: DataFrame) -> DataFrame:
    """node, label after links (a, b) between labels; a tree of one node may not be in trees yet."""
    joined = materialize(components(between).select(F.col("node").alias("tree"), F.col("label").alias("joined")), "joined")
    lone = joined.join(trees, F.col("tree") == F.col("node"), "left_anti").select(F.col("tree").alias("node"), F.col("tree").alias("label"))
    every = trees.unionByName(lone)
    return materialize(every.join(joined, F.col("label") == F.col("tree"), "left").select("node", F.coalesce("joined", "label").alias("label")), "components")


def _trees(docs: DataFrame, reps: DataFrame) -> DataFrame | None:
    """node, label of the classes that have a link; reps: node, bands. None if no two share a band."""
    banded = reps.select("node", F.explode("bands").alias("band"))
    buckets = materialize(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    shared = materialize(banded.join(buckets, "band").select("band", "n", "node"), "shared-bands")  # narrow rows; a hot band is split by the adaptive skew join
    if shared.isEmpty():
        return None
    degree = materialize(shared.groupBy("node").agg(F.sum("n").alias("degree")), "degrees")
    middle = shared.join(degree, "node").groupBy("band").agg(F.max(F.struct("degree", F.bitwise_not("node").alias("below"))).alias("m"), F.max("n").alias("n"))
    central = middle.select("band", F.bitwise_not("m.below").alias("pivot"), "n")
    full = _full_sets(docs, degree.select("node"))
    links = _linked(full, _to_pivots(_meet(shared, central), 1))
    trees = components(links)
    rest = _open(shared, trees)
    if rest.isEmpty():
        return trees
    drawn = F.struct(F.xxhash64("node", F.lit(11)), "node", "label")
    pivots = rest.groupBy("band").agg(F.max(drawn).alias("m"), F.max("n").alias("n")).select("band", F.col("m.node").alias("pivot"), F.col("m.label").alias("pivot_label"), "n")
    more = _linked(full, _to_pivots(_meet(rest, pivots).where("label != pivot_label"), 2))
    trees = components(links.unionByName(more))
    rest = _open(rest.drop("label"), trees)
    if rest.isEmpty():
        return trees
    fine = _fine_signatures(full, rest.select("node"))
    rest = _open(rest.join(fine.select("node"), "node", "left_semi").drop("label"), trees)
    if rest.isEmpty():
        return trees
    # bands with the same classes are compared once; then classes without a likely partner go, before any set is moved
    same = materialize(rest.groupBy("band").agg(F.count(F.lit(1)).alias("c"), *(F.sum(F.xxhash64("node", F.lit(i)) % 2**40).alias(f"s{i}") for i in (0, 1))), "band-members")
    once = same.groupBy("c", "s0", "s1").agg(F.min("band").alias("band")).select("band")
    rest = materialize(rest.join(once, "band", "left_semi"), "distinct-bands")
    own = rest.groupBy("node").agg(F.collect_list("band").alias("bands"))  # at most BANDS
    likely = _by_cell(_cells(*_blocks(rest, fine.select("node", F.lit(FINE).cast("long").alias("size")))), fine.join(own, "node"), _likely, "band node")
    rest = _open(rest.join(likely, ["band", "node"], "left_semi").drop("label"), trees)
    sets = blocks = None
    for diagonal in (True, False):
        if blocks is None:
            if rest.isEmpty():
                break
            sets = _having(full, rest.select("node"))
            blocks = _blocks(rest, sets.select("node", F.octet_length("shingles").alias("size")))
        between = _across(sets, blocks, diagonal)
        if between is not None and not between.isEmpty():
            trees = _renamed(trees, between)
            if diagonal:
                rest, blocks = _open(rest.drop("label"), trees), None
    return trees


def _judged(docs: DataFrame, identity: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (and sha) of each row."""
    rows = materialize(sketch(docs, identity), "sketches")
    n = rows.count()
    filled = rows.where("n_shingles > 0")
    least = F.min(F.struct("node", "n_shingles", "bands")).alias("m")
    classes = materialize(filled.groupBy("key").agg(least, F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("members")).select("key", "m.*", "least_id", "members"), "classes")
    trees = _trees(docs, classes.select("node", "bands"))
    named = classes.select("key", F.col("node").alias("label"), F.col("least_id").alias("component_id"), "members")
    if trees is not None:
        # classes without a link are their own component; a tree's id is the least one of its classes
        own = classes.select("key", "node", "least_id", "members")
        linked = materialize(own.join(trees, "node").select("key", "least_id", "members", "label"), "linked-classes")
        ids = materialize(linked.groupBy("label").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "component-ids")
        some = attach_by_key(linked.drop("least_id"), ids, "label", "n", linked.count()).select("key", "label", "component_id", "members")
        lone = own.join(trees, "node", "left_anti").select("key", F.col("node").alias("label"), F.col("least_id").alias("component_id"), "members")
        named = materialize(some.unionByName(lone), "named")
    out = ["doc_id", "n_shingles", "component_id", "kept", *["sha"] * identity]
    kept = F.when(F.col("component_id").isNull(), F.col("node") == F.col("label")).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    some = attach_by_key(filled.drop("bands"), named, "key", "members", n).withColumn("kept", kept).select(*out)
    return some.unionByName(rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")).withColumn("kept", F.lit(True)).select(*out))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row."""
    return _judged(docs)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row for each component, with all its columns as they were: that with the component's id, or, of rows that repeat it, any one."""
    judged = materialize(_judged(docs, True).select("doc_id", "sha", (~F.col("kept")).alias("gone")), "judged")
    return keep_decided(docs, judged)
