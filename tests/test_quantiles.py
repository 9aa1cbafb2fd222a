"""Radix quantiles against numpy, with infinities, NaN, ties, nulls and groups."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import index, quantiles, tables

INF = float("inf")
SHARES = (0.0, 0.25, 0.33, 0.5, 0.999, 1.0)


def plain(values, share):
    own = sorted(v for v in values if v is not None and not math.isnan(v))
    at = (len(own) - 1) * share
    lo, hi, part = own[math.floor(at)], own[math.ceil(at)], at - math.floor(at)
    return lo if lo == hi else (1 - part) * lo + part * hi


def test_bits_keep_the_order(spark):
    values = [-INF, -1.7e308, -1.0, -5e-324, 0.0, 5e-324, 1e-300, 1.0, math.nextafter(1.0, 2), 1.7e308, INF]
    rows = spark.createDataFrame([(v,) for v in [*values, -0.0, None, float("nan")]], "x double").select("x", quantiles.ordered_bits(F.col("x")).alias("b"))
    got = rows.select("x", "b", quantiles.from_bits(F.col("b")).alias("back")).collect()
    by = {r.x: r.b for r in got[:-3]}
    assert [by[v] for v in values] == sorted(by.values()) and len(set(by.values())) == len(values)
    assert got[-3].b == by[0.0] and got[-2].b is None and got[-1].b is None and all(r.back == r.x for r in got[:-2])


def test_quantiles(spark):
    r = random.Random(3)
    pool = [None, float("nan"), INF, -INF, 0.0, -0.0, 1e-310, 7.0, 7.0]
    rows = [(r.choice([None, "a", "b", "c"]), r.choice([1, 2]), r.choice(pool) if r.random() < 0.2 else r.gauss(0, 10.0 ** r.randrange(-3, 4)), r.randrange(5)) for _ in range(3000)]
    rows += [("lone", 1, 2.5, 3), ("none", 1, None, None), ("ends", 1, INF, 1), ("ends", 1, -INF, 2), ("hot", 1, 1.5, 1)] + [("hot", 1, 1.5, 1)] * 2000
    df = spark.createDataFrame(rows, "g string, h int, x double, k int").repartition(5)
    got = {(q.g, q.h, q.column_name, q.share): q.value for q in quantiles.exact_quantiles(df, ["x", "k"], SHARES, ["g", "h"]).collect()}
    want = {}
    for g, h in {(a, b) for a, b, *_ in rows}:
        for c, at in (("x", 2), ("k", 3)):
            own = [row[at] for row in rows if row[:2] == (g, h)]
            if any(v is not None and not math.isnan(v) for v in own):
                want |= {(g, h, c, s): plain(own, s) for s in SHARES}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-12, nan_ok=True), k
    assert math.isnan(got["ends", 1, "x", 0.5]) and got["ends", 1, "x", 1.0] == INF


def test_one_column_and_summary(spark):
    x = np.random.default_rng(2).lognormal(0, 3, 5001)
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate(x)], "x double, y long")
    assert index.quantiles(df, "x", (0.33, 0.66)) == pytest.approx(list(np.quantile(x, [0.33, 0.66])), rel=1e-12)
    assert index.quantiles(df.limit(0), "x", (0.33,)) == [None]
    rows = {r.column_name: r for r in tables.summary(df.unionByName(spark.createDataFrame([(float("nan"), None)], df.schema)), ["x", "y"]).collect()}
    assert (rows["x"]["count"], rows["y"]["p50"]) == (5001, 2500) and rows["x"]["p75"] == pytest.approx(np.quantile(x, 0.75), rel=1e-12)
    assert [r["count"] for r in tables.summary(df.limit(0), ["x"]).collect()] == []


def test_shares_of_values(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "v string")
    assert sorted(map(tuple, tables.value_counts(df, "v").collect()), key=repr) == [("a", 2, 66.67), (None, 1, 33.33)]
    assert tables.value_counts(df, "v", False).collect()[0].percentage == 100.0 and tables.value_counts(df.limit(0), "v").count() == 0
