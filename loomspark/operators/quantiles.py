"""Exact quantiles of any doubles, of all columns and groups at once, by radix selection: nothing is sorted, and no task or driver holds a column.

A double's 64 bits, turned so that their order as a whole number is the doubles' order, are looked at 16 at a time. A pass counts, for the values that agree with what is known of
the wanted ones so far, how often each of at most 65,536 next digits occurs; counts are combined before they travel, so a hot value or group is no hot task. The
running count tells the digit in which each wanted rank lies. Four passes find all 64 bits, whatever the values.

Nulls and NaN are left out; -0.0 is 0.0; infinities are the ends. Ranks between two values are met linearly; between opposite infinities there is none (NaN).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.plans.lineage import written

DIGIT = 16


def _turned(bits: np.ndarray) -> np.ndarray:
    """From a double's bits to a number of the same order, and back."""
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def ordered_bits(x: Column) -> Column:
    """Null for null and NaN."""

    @F.arrow_udf("long")
    def bits(values: pa.Array) -> pa.Array:
        own = values.fill_null(float("nan")).to_numpy(zero_copy_only=False) + 0.0
        return pa.array(_turned(own.view(np.int64)), mask=np.isnan(own))

    return bits(x.cast("double"))


def from_bits(bits: Column) -> Column:
    @F.arrow_udf("double")
    def double(values: pa.Array) -> pa.Array:
        own = values.fill_null(0).to_numpy(zero_copy_only=False)
        return pa.array(_turned(own).view(np.float64), mask=values.is_null().to_numpy(zero_copy_only=False))

    return double(bits)


def _met(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the left ones stay."""
    other = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    condition = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return left.join(other, condition, how).drop(*(f"__{k}" for k in keys))


def exact_quantiles(df: DataFrame, columns: list[str], shares: tuple[float, ...], groups: list[str] | None = None) -> DataFrame:
    """The groups' columns, column_name, share, value: a row for each group, column with a value, and share."""
    own = list(groups or [])
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), ordered_bits(F.col(c)).alias("bits")) for c in columns))).alias("x")
    rows = written(df.select(*own, each).select(*own, "x.*").where("bits is not null"), "bits")
    keys = [*own, "column_name"]
    place = (F.col("n") - 1) * F.col("share")
    wanted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("part", place - F.floor(place))
    state = wanted.select(*keys, "share", "part", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("rank")).withColumn("left", F.col("rank")).withColumn("known", F.lit(0).cast("long"))
    for k in range(1, 64 // DIGIT + 1):
        state = written(state, "ranks")
        some = rows.withColumn("known", F.shiftright("bits", 64 - DIGIT * (k - 1))) if k > 1 else rows.withColumn("known", F.lit(0).cast("long"))
        some = _met(some, state.select(*keys, "known").distinct(), [*keys, "known"]) if k > 1 else some
        counted = some.groupBy(*keys, "known", F.shiftright("bits", 64 - DIGIT * k).alias("next")).agg(F.count(F.lit(1)).alias("c"))
        up = Window.partitionBy(*keys, "known").orderBy("next").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most 65,536 rows
        summed = counted.withColumn("upto", F.sum("c").over(up))
        found = _met(state, summed, [*keys, "known"]).where("left < upto and left >= upto - c")
        state = found.select(*keys, "share", "part", "rank", (F.col("left") - (F.col("upto") - F.col("c"))).alias("left"), F.col("next").alias("known"))
    value = from_bits(F.col("known"))
    ends = state.select(*keys, "share", "part", value.alias("v")).groupBy(*keys, "share").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("part").alias("part"))
    between = (1 - F.col("part")) * F.col("lo") + F.col("part") * F.col("hi")
    return ends.select(*keys, "share", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(between).alias("value"))
