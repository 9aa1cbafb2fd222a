"""Bloom filters as bitmaps in a table, DataFrame functions only.

Each of two hash functions sets a cell for a 64-bit hash, both in one bucket of cells, so that a probe is a single join with a broadcast table. Hashes are cut into ranges, so that
the bitmaps of one range stay below MAX_BROADCAST_BYTES; a range is broadcast and probed at a time, and rows pass through without a shuffle at any size. A large filter costs a pass over the rows for each range.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm._common import materialize, safe_text

#: Cells a hash; two hash functions leave under 2 % false positives.
CELLS_PER_HASH = 16
#: Cells of a bucket: bits of one bitmap.
BUCKET = 1 << 15
#: Bitmaps of one range, which are broadcast.
MAX_BROADCAST_BYTES = 32 << 20


class Bitmaps(NamedTuple):
    """part, bucket, bits by rows; buckets in a range; ranges, both powers of two."""

    maps: DataFrame
    buckets: int
    ranges: int

    def part(self, h: Column) -> Column:
        return F.lit(0) if self.ranges == 1 else (F.shiftright(h, 65 - self.ranges.bit_length()) + self.ranges // 2).cast("int")

    def within(self, h: Column, part: int) -> Column:
        """Whether a hash is in the range, as bounds that a sorted table is pruned by."""
        width = 2**64 // self.ranges
        return h.between(-(2**63) + part * width, -(2**63) + (part + 1) * width - 1)

    def bucket(self, h: Column) -> Column:
        return F.pmod(h, F.lit(self.buckets))

    def at(self, h: Column, fn: int) -> Column:
        """The cell's place in the bucket."""
        return F.pmod(F.shiftright(F.xxhash64(h, F.lit(1)), 20 * fn), F.lit(BUCKET))


def bitmaps(hashes: DataFrame, n: int, least: int = 1, max_bytes: int | None = None, least_ranges: int = 1, distinct: bool = False) -> Bitmaps:
    """Cells that at least `least` of the n hashes (column h) hit; counts are combined before they travel, so a hot hash is no hot task. Of hashes told to be
    distinct (or nearly so) none is hot: with least = 1 they travel once, uncounted. least_ranges, a power of two: filters with equal ranges are probed together."""
    cells = max(BUCKET, 1 << (CELLS_PER_HASH * n - 1).bit_length())
    ranges = max(least_ranges, cells // 8 // (max_bytes or MAX_BROADCAST_BYTES))
    form = Bitmaps(hashes, max(1, cells // ranges // BUCKET), ranges)
    h = F.col("h")
    known = hashes.where("h is not null").select(form.part(h).alias("part"), form.bucket(h).alias("bucket"), F.array(*[form.at(h, fn) for fn in (0, 1)]).alias("cells"))
    hit = known.select("part", "bucket", F.explode("cells").alias("cell"))
    if least > 1 or not distinct:
        hit = hit.groupBy("part", "bucket", "cell").count().where(F.col("count") >= least)
    placed = hit.repartition("part", "bucket").groupBy("part", "bucket")
    return form._replace(maps=materialize(placed.agg(F.bitmap_construct_agg("cell").alias("bits")), "bloom"))


def _bit(bitmap: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, (at % 8).cast("int")), F.lit(0)) % 2 == 1


def probed(rows: DataFrame, h: Column, known: Bitmaps, name: str) -> DataFrame:
    """Adds a boolean column: false only where the hash is not in the filter."""
    return probed_all(rows, h, {name: known})


def probed_all(rows: DataFrame, h: Column, filters: dict[str, Bitmaps]) -> DataFrame:
    """Adds a boolean column for each filter; all have as many ranges, and the rows are read once a range, however many filters there are."""
    ranges = {known.ranges for known in filters.values()}
    if len(ranges) > 1:
        raise ValueError(f"filters with {sorted(ranges)} ranges can't be probed together")

    def one(part: int) -> DataFrame:
        first = next(iter(filters.values()))
        out = rows.where(first.within(h, part)) if first.ranges > 1 else rows
        for k, (name, known) in enumerate(filters.items()):
            side = known.maps.where(F.col("part") == part).select(F.col("bucket").alias(f"__bucket{k}"), F.col("bits").alias(f"__bits{k}"))
            # at most MAX_BROADCAST_BYTES a filter
            out = out.join(F.broadcast(side), known.bucket(h) == F.col(f"__bucket{k}"), "left")
            both = [_bit(F.col(f"__bits{k}"), known.at(h, fn)) for fn in (0, 1)]
            out = out.withColumn(name, both[0] & both[1]).drop(f"__bucket{k}", f"__bits{k}")
        return out

    return reduce(DataFrame.unionByName, map(one, range(ranges.pop())))


def keep_decided(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bytes: int | None = None) -> DataFrame:
    """The input's rows that are not gone, with all their columns as they were; of rows that repeat id and text any one.

    decided (read from storage): doc_id, sha (of the text), gone. A first filter holds the rows gone or repeated, a second one the kept rows
    that the first lets through. A row outside the first stays, one inside it alone is gone; only the few in both are shuffled and looked up exactly.
    """
    ident = lambda i, sha: F.xxhash64(i.cast("long"), sha)
    n = decided.count()
    hashed = decided.select(ident(F.col("doc_id"), F.col("sha")).alias("h"), "gone")
    marked = materialize(probed(hashed, F.col("h"), bitmaps(hashed, n, 2), "repeated"), "marked")
    special = marked.where("gone or repeated").select("h")
    first = bitmaps(special, special.count(), max_bytes=max_bytes)
    # both filters are as large, so that one pass over the texts a range probes both
    passed = materialize(probed(marked.where("not gone").select("h"), F.col("h"), first, "hit").where("hit").select("h"), "passed")
    second = bitmaps(passed, passed.count(), max_bytes=max_bytes, least_ranges=first.ranges)  # no more hashes than in the first
    rows = docs.withColumn("__sha", F.unhex(F.sha2(safe_text(F.col(text_col)), 256))).withColumn("__h", ident(F.col(id_col), F.col("__sha")))
    tested = probed_all(rows, F.col("__h"), {"__gone": first, "__open": second})
    extra = ["__sha", "__h", "__gone", "__open"]
    sure = tested.where("not __gone").drop(*extra)
    gone = decided.where("gone").select(F.col("doc_id").alias("__id"), F.col("sha").alias("__its")).distinct()
    some = tested.where("__gone and __open").dropDuplicates([id_col, "__sha"])
    return sure.unionByName(some.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__its")), "left_anti").drop(*extra))
