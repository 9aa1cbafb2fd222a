"""From raw comments to causes and indexes, in two profiles.

offline: rules may override the model's answer, and only useful comments with a cause count in the index.
online: the answer stands as it is, and every comment counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import discourse
from loomspark.functions.embedding import first_words, hashed_vector
from loomspark.operators import causes, index, noise, ontology, ranking
from loomspark.plans.lineage import written

PROFILES = ("offline", "online")


def classify(comments: DataFrame, text: str, answer: Column | None = None, profile: str = "offline") -> DataFrame:
    """Adds clean, noise_level, code, confidence, rule and status. answer: a model's raw words for each row; without one, H at 0.5."""
    if profile not in PROFILES:
        raise ValueError(f"no profile {profile!r}")
    own = comments.columns
    out = comments.withColumn("clean", discourse.cleaned(F.col(text))).withColumn("noise_level", noise.noise_level(F.col("clean"), "useful" if profile == "offline" else "none"))
    raw = answer if answer is not None else F.lit("H|0.50")
    useful = F.col("noise_level").isin("useful", "none")
    out = out.withColumn("__answer", F.when(useful, causes.answer_code(raw)).otherwise("H")).withColumn("__sure", F.when(useful, causes.answer_confidence(raw)).otherwise(1.0))
    if profile == "offline":
        out = causes.with_rules(out, "clean", F.col("__answer"), F.col("__sure"), "__rule")
        pick = lambda f, other: F.when(useful, F.col("__rule")[f]).otherwise(other)
        out = out.select(*own, "clean", "noise_level", pick("code", F.col("__answer")).alias("code"), pick("confidence", F.col("__sure")).alias("confidence"), pick("rule", F.lit("none")).alias("rule"))
    else:
        out = out.select(*own, "clean", "noise_level", F.col("__answer").alias("code"), F.col("__sure").alias("confidence"), F.lit("none").alias("rule"))
    return out.withColumn("status", causes.status(F.col("clean"), F.col("confidence"), F.col("rule")))


def classify_text(spark: SparkSession, text: str | None, answer: str | None = None, profile: str = "online") -> DataFrame:
    """One comment."""
    rows = spark.createDataFrame([(text, answer)], "text string, answer string")
    return classify(rows, "text", F.coalesce("answer", F.lit("H|0.50")), profile).drop("answer")


def classify_batch(comments: DataFrame, text: str, issue: str, order: str, answer: Column | None = None, profile: str = "offline", graph: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The comments with their causes and what the ontology tells of them, and the index of each issue.

    microcauses: the three nearest causes, in both profiles. top_causes: those that are enriched and count in the index; offline the best by the
    blended score, enriched from graph (triples; without any, the invented ones), and a comment counts each smell and risk once; online the three
    nearest, and the lists of the ontology stay empty."""
    spark = comments.sparkSession
    done = classify(comments.where(F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0), text, answer, profile)
    done = written(done.withColumn("__row", F.monotonically_increasing_id()), "classified")  # rows that repeat stay apart
    near = ranking.nearest_causes(done, ranking.candidate_vectors(spark), hashed_vector(first_words(F.col("clean"), 60)))
    if profile == "offline":
        top = written(ranking.blended_causes(done.select(F.col("__row").alias("comment_id"), "code", F.col("clean").alias("text")), spark), "top")
        ids = top.select(F.col("comment_id").alias("__row"), F.transform("top", lambda x: x["cause_id"]).alias("ids"))
        told = ontology.enrich(ids, "ids", ontology.enrichment(graph if graph is not None else ontology.triples(spark)), "__row")
        found = top.select(F.col("comment_id").alias("__row"), F.transform("top", lambda x: F.struct(x["cause_id"].alias("cause_name"), x["score"].alias("similarity"))).alias("top_causes"))
        done = near.join(found, "__row").join(told, "__row")
    else:
        done = near.select("*", F.col("microcauses").alias("top_causes"), *(F.array().cast("array<string>").alias(r) for r in ontology.LISTS))
    done = written(done.drop("__row"), "ranked")
    once = lambda c, i: F.when(i == 0, F.col(c)).otherwise(F.array().cast("array<string>")).alias(c)
    micro = F.transform("top_causes", lambda m, i: F.struct(m["cause_name"].alias("cause_name"), m["similarity"].alias("similarity"), once("community_smells", i), once("risks", i)))
    counted = done.where("noise_level = 'useful' and code != 'H'") if profile == "offline" else done
    rows = counted.select(F.col(issue).alias("issue_number"), F.col(order).alias("row_ord"), "code", micro.alias("microcauses"))
    return done, index.with_index(written(index.issue_features(rows), "features"))
