"""Cleaning, noise and rules as stateless stages; they run alike on tables and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import discourse
from loomspark.operators import causes, noise


def annotate(comments: DataFrame, body: str = "text", clean: Callable[[Column], Column] = discourse.cleaned) -> DataFrame:
    """Adds clean, noise_level, cause, confidence and rule. clean: the whole cleaning, as in plans.classify, or one's own."""
    own = comments.columns
    out = comments.withColumn("clean", clean(F.col(body)))
    out = out.withColumn("noise_level", noise.noise_level(F.col("clean")))
    out = causes.with_rules(out, "clean", F.lit("H"), F.lit(0.5), "__rule")
    useful = F.col("noise_level") == "useful"
    pick = lambda f, other: F.when(useful, F.col(f"__rule.{f}")).otherwise(other)
    return out.select(*own, "clean", "noise_level", pick("code", F.lit("H")).alias("cause"), pick("confidence", F.lit(1.0)).alias("confidence"), pick("rule", F.lit("none")).alias("rule"))
