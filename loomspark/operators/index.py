"""Per-issue index: top-five counters, features, min-max scaling, mean and levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.quantiles import exact_quantiles

FEATURES = ("comment_count", "macro_diversity", "top_macro_frequency", "top_micro_score", "top_smell_frequency", "top_risk_frequency")


def most_common(rows: DataFrame, keys: list[str], name: str, value: str, position: str, n: int, out: str) -> DataFrame:
    """For each key the n names with the largest sums; ties by first position. Pre-aggregated, so a large issue costs no more."""
    sums = rows.groupBy(*keys, name).agg(F.sum(value).alias("__v"), F.min(position).alias("__p"))
    ranked = sums.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__v"), "__p", name))).where(F.col("__r") <= n)
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("__r", F.col(name).alias("name"), F.col("__v").cast("double").alias("value")))), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))
    return ranked.groupBy(*keys).agg(pairs.alias(out))


#: Kinds of names that an issue counts.
COUNTED = ("macrocauses", "microcauses", "community_smells", "risks")
MOST = 5


def counted_items(comments: DataFrame) -> DataFrame:
    """issue_number, row_ord and x (kind, name, v and the places i, j within the comment) for all that a comment counts.

    comments: issue_number, row_ord, code, microcauses array<struct<cause_name, similarity, community_smells, risks>>. Null issues are left out.
    A null code counts as H; a null similarity counts as 0; null lists are empty. Counters of parts of the comments can be summed up again."""
    item = lambda kind, name, v, i, j: F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("name"), v.cast("double").alias("v"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    none = F.lit(0)
    listed = lambda c: F.flatten(F.transform("microcauses", lambda m, i: F.transform(m[c], lambda s, j: item(c, s, F.lit(1), i, j))))
    empty = F.array().cast("array<struct<kind:string,name:string,v:double,i:int,j:int>>")
    own = F.array(item("macrocauses", F.coalesce("code", F.lit("H")), F.lit(1), none, none))
    micro = F.transform("microcauses", lambda m, i: item("microcauses", m["cause_name"], F.coalesce(m["similarity"], F.lit(0.0)), i, none))
    all_items = F.concat(own, *(F.coalesce(F.filter(x, lambda y: y.isNotNull()), empty) for x in (micro, listed("community_smells"), listed("risks"))))
    return comments.where("issue_number is not null").select("issue_number", "row_ord", F.explode(all_items).alias("x"))


def counters(comments: DataFrame) -> DataFrame:
    """issue_number, kind, name, v (sum), p (first position): the four counters of all issues in one pass, combined before they travel."""
    return counted_items(comments).groupBy("issue_number", "x.kind", "x.name").agg(F.sum("x.v").alias("v"), F.min(F.struct("row_ord", "x.i", "x.j")).alias("p"))


def features_of(counted: DataFrame) -> DataFrame:
    """The features of each issue from its counters: the MOST leading names of each kind, how many these are, and the first one's value."""
    own = Window.partitionBy("issue_number", "kind")
    ranked = counted.select("issue_number", "kind", F.struct(F.row_number().over(own.orderBy(F.desc("v"), "p", "name")).alias("r"), "name", F.col("v").alias("value")).alias("x"), F.sum("v").over(own).alias("total"))
    return features_of_ranked(ranked.where(F.col("x.r") <= MOST))


def features_of_ranked(kept: DataFrame) -> DataFrame:
    """Features from issue_number, kind, x (r, name, value) and total: the leading names of each kind."""
    of = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("x")))), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"))).alias(f"dominant_{k}")
    out = kept.groupBy("issue_number").agg(F.max(F.when(F.col("kind") == "macrocauses", F.col("total"))).cast("long").alias("comment_count"), *map(of, COUNTED))
    head = lambda c: F.coalesce(F.get(F.col(f"dominant_{c}"), F.lit(0))["value"], F.lit(0.0))
    size = lambda c: F.size(f"dominant_{c}")
    return out.select(
        "*", size("macrocauses").alias("macro_diversity"), size("microcauses").alias("micro_diversity"), size("community_smells").alias("smell_diversity"), size("risks").alias("risk_diversity"),
        head("macrocauses").alias("top_macro_frequency"), head("microcauses").alias("top_micro_score"), head("community_smells").alias("top_smell_frequency"), head("risks").alias("top_risk_frequency"),
    )


def issue_features(comments: DataFrame) -> DataFrame:
    """A row an issue; with_index() reads it several times, so write it first."""
    return features_of(counters(comments))


def issue_texts(comments: DataFrame, text: str, order: str) -> DataFrame:
    """issue_number, text: all texts of an issue in their order, a blank line between them; null texts are left out. The whole text is one value."""
    said = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(F.col(order).alias("o"), F.col(text).alias("t")))))
    return comments.where("issue_number is not null").groupBy("issue_number").agg(F.array_join(F.transform(said, lambda x: x["t"]), "\n\n").alias("text"))


def global_counts(indexed: DataFrame, kind: str) -> DataFrame:
    """name, value: sums over the issues' leading names of a kind (not over raw rows)."""
    each = indexed.select(F.explode(f"dominant_{kind}").alias("x")).select("x.*")
    return each.groupBy("name").agg(F.sum("value").alias("value"))


def scaled(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Adds <column>_norm in [0, 1]; a constant column gives 0. The extremes are one row, so it is broadcast."""
    ends = df.agg(*(f(c).cast("double").alias(f"__{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))))
    norm = lambda c: F.coalesce((F.col(c) - F.col(f"__lo_{c}")) / F.nullif(F.col(f"__hi_{c}") - F.col(f"__lo_{c}"), F.lit(0.0)), F.lit(0.0)).alias(f"{c}_norm")
    return df.crossJoin(F.broadcast(ends)).select(*df.columns, *map(norm, columns))


def level(score: Column, q1: Column, q2: Column) -> Column:
    return F.when(score.isNull(), "Unknown").when(score <= q1, "Low Social Debt").when(score <= q2, "Medium Social Debt").otherwise("High Social Debt")


def quantiles(df: DataFrame, column: str, shares: tuple[float, ...]) -> list[float | None]:
    """Exact quantiles, with linear interpolation; None of no rows."""
    found = {r["share"]: r["value"] for r in exact_quantiles(df, [column], shares).collect()}
    return [found.get(s) for s in shares]


def with_index(features: DataFrame) -> DataFrame:
    """Adds the index (rounded to 9 places, so that levels don't hang on the order of sums) and its level by the 0.33 and 0.66 quantiles. Reads features (best from storage) several times."""
    out = scaled(features, FEATURES)
    mean = sum((F.col(f"{c}_norm") for c in FEATURES), F.lit(0.0)) / len(FEATURES)
    out = out.withColumn("social_debt_index", F.round(mean, 9))
    q1, q2 = (F.round(F.lit(q).cast("double"), 9) for q in quantiles(out, "social_debt_index", (0.33, 0.66)))
    return out.withColumn("social_debt_level", level(F.col("social_debt_index"), q1, q2))
