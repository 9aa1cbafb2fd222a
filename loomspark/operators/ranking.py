"""Finer causes: candidates of a cause, scored by vectors and words, the best few kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark import constants as C
from loomspark.functions.embedding import embedding_text, hashed_vector
from loomspark.functions.regex import once, squeeze
from loomspark.functions.text import plain_words

# Weights and limits of the adaptive score.
MACRO_WEIGHT, COMMENT_WEIGHT, LEXICAL_WEIGHT = 0.10, 0.90, 0.20
LEAST_SCORE, WIDEST_GAP, MOST, LANGUAGE_PENALTY = 0.28, 0.18, 3, 0.10
BASELINE_LEAST = 0.50


def candidates(spark: SparkSession) -> DataFrame:
    """code, pos, cause_id, signals, penalty: 39 rows, a fixed size."""
    letters = {label: code for code, label in C.CAUSES.items()}
    rows = [(letters[label], i, cause, C.LEXICAL_SIGNALS.get(cause, []), float(C.GENERIC_CAUSE_PENALTY.get(cause, 0.0))) for label, ids in C.MACRO_TO_CANDIDATE_INDIVIDUALS.items() for i, cause in enumerate(sorted(ids))]
    return spark.createDataFrame(rows, "code string, pos int, cause_id string, signals array<string>, penalty double")


def match_text(text: Column) -> Column:
    return plain_words(text)


def lexical_score(text: Column, signals: Column) -> Column:
    """A third for each signal that the text contains as a substring, 1 at most."""
    return F.least(F.lit(1.0), F.size(F.filter(signals, lambda s: F.contains(text, s))) / F.lit(3.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if a vector has no length."""
    return F.coalesce(dot(a, b) / F.nullif(length(a) * length(b), F.lit(0.0)), F.lit(0.0))


def _cosine_to(vector: Column, size: Column, x: Column) -> Column:
    """Cosine of a vector, whose length is known, with a candidate's."""
    return F.coalesce(dot(vector, x["vector"]) / F.nullif(size * x["length"], F.lit(0.0)), F.lit(0.0))


def _lists(known: DataFrame) -> DataFrame:
    """code, known: a row for each of at most eight causes with the array of its candidates (39 in all), so a comment finds them in a broadcast and stays in its row."""
    own = [c for c in known.columns if c not in ("code", "pos")]
    return F.broadcast(known.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("pos", *own))).alias("__known")))


def _best(scores: Column) -> Column:
    """Structs (k: negated score, pos, cause_id, score) in order; ties by catalog order; empty without candidates."""
    return F.coalesce(F.array_sort(scores), F.array().cast("array<struct<k:double,pos:int,cause_id:string,score:double>>"))


def _scored(x: Column, score: Column) -> Column:
    return F.struct((-score).alias("k"), x["pos"].alias("pos"), x["cause_id"].alias("cause_id"), score.alias("score"))


def _listed(comments: DataFrame, known: DataFrame, score: Column) -> DataFrame:
    """Adds __all, the candidates in order; score: an array of structs made from the column __known."""
    return comments.join(_lists(known), "code", "left").select(*(comments[c] for c in comments.columns), _best(score).alias("__all"))


def top_causes(comments: DataFrame, spark: SparkSession, macro_similarity: Callable[[Column], Column] | None = None, comment_similarity: Callable[[Column], Column] | None = None, known: DataFrame | None = None) -> DataFrame:
    """comments: comment_id, code, text and what the similarities read. Adds top: array<struct<cause_id, score>> and status, row by row: nothing is
    shuffled or regrouped, and rows that repeat stay apart.

    known: code, pos, cause_id and what the similarities read of a candidate x."""
    every = candidates(spark) if known is None else candidates(spark).join(F.broadcast(known), ["code", "pos", "cause_id"], "left")
    none = lambda x: F.lit(0.0)
    macro, own = macro_similarity or none, comment_similarity or none

    def score(text: Column, language: Column, x: Column) -> Column:
        base = MACRO_WEIGHT * macro(x) + COMMENT_WEIGHT * own(x)
        penalty = x["penalty"] + F.when(x["cause_id"].startswith("CO-001") & ~language, LANGUAGE_PENALTY).otherwise(0.0)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + LEXICAL_WEIGHT * lexical_score(text, x["signals"]) - penalty))

    speaks = lambda t: F.exists(F.array(*map(F.lit, C.LANGUAGE_TERMS)), lambda term: F.contains(t, term))
    scores = once(match_text(F.col("text")), lambda t: once(speaks(t), lambda language: F.transform("__known", lambda x: once(score(t, language, x), lambda s: _scored(x, s)))))
    listed = _listed(comments, every, scores)
    good = F.filter("__all", lambda x: x["score"] >= LEAST_SCORE)
    near = F.filter(good, lambda x: good[0]["score"] - x["score"] <= WIDEST_GAP)
    kept = F.when(F.size("__all") == 0, F.slice("__all", 1, 0)).when(F.size(good) == 0, F.slice("__all", 1, 1)).otherwise(F.slice(near, 1, MOST))
    status = F.when(F.size("__all") == 0, "no_candidates").when(F.size(good) == 0, "mapped_low_confidence").otherwise("mapped")
    return listed.select(*comments.columns, F.transform(kept, lambda x: F.struct(x["cause_id"].alias("cause_id"), F.round(x["score"], 6).alias("score"))).alias("top"), status.alias("status"))


def candidate_vectors(spark: SparkSession) -> DataFrame:
    """code, pos, cause_id and the vector of its keywords: 39 rows."""
    words = spark.createDataFrame(list(C.CAUSE_KEYWORDS.items()), "cause_id string, words string")
    return candidates(spark).select("code", "pos", "cause_id").join(F.broadcast(words), "cause_id").select("code", "pos", "cause_id", hashed_vector(F.concat_ws(" ", F.regexp_replace("cause_id", "[_-]", " "), "words")).alias("vector"))


def blended_causes(comments: DataFrame, spark: SparkSession) -> DataFrame:
    """The offline profile: comment_id, code, text to top_causes by the hashed vectors of the text and of its cause's description; a text without words to embed counts as that description."""
    macro = spark.createDataFrame(list(C.MACRO_DESCRIPTIONS.items()), "code string, words string").select("code", hashed_vector(F.col("words")).alias("macro"))
    known = candidate_vectors(spark).join(F.broadcast(macro), "code").select("code", "pos", "cause_id", "vector", length(F.col("vector")).alias("length"), cosine(F.col("macro"), F.col("vector")).alias("to_macro"))
    own = comments.select("comment_id", "code", "text", once(embedding_text(F.col("text")), lambda t: F.when(t != "", hashed_vector(t))).alias("__v"))
    own = own.select("*", length(F.col("__v")).alias("__n"))
    similarity = lambda x: F.when(F.col("__v").isNull(), x["to_macro"]).otherwise(_cosine_to(F.col("__v"), F.col("__n"), x))
    return top_causes(own, spark, lambda x: x["to_macro"], similarity, known).drop("__v", "__n")


def nearest_causes(comments: DataFrame, known: DataFrame, vector: Column, k: int = 3) -> DataFrame:
    """The online profile: the k nearest candidates by cosine (9 places), without a threshold; ties by catalog order. A comment without candidates gets none."""
    every = known.select("code", "pos", "cause_id", "vector", length(F.col("vector")).alias("length"))
    near = lambda v, n: F.transform("__known", lambda x: once(F.round(_cosine_to(v, n, x), 9), lambda s: _scored(x, s)))
    listed = _listed(comments, every, once(vector, lambda v: once(length(v), lambda n: near(v, n))))
    return listed.select(*comments.columns, F.transform(F.slice("__all", 1, k), lambda x: F.struct(x["cause_id"].alias("cause_name"), x["score"].alias("similarity"))).alias("microcauses"))


def argmax_baseline(comments: DataFrame, known: DataFrame, vector: Column, least: float = BASELINE_LEAST) -> DataFrame:
    """Adds best_cause, best_similarity, second_similarity, gap and status: the single nearest candidate, the earlier one on ties, and how far the second is behind."""
    near = nearest_causes(comments, known, vector, 2)
    at = lambda i, f: F.get("microcauses", F.lit(i))[f]
    status = F.when(F.size("microcauses") == 0, "no_candidates").when(at(0, "similarity") < least, "mapped_low_confidence").otherwise("mapped")
    return near.select(
        *comments.columns, at(0, "cause_name").alias("best_cause"), at(0, "similarity").alias("best_similarity"), at(1, "similarity").alias("second_similarity"),
        F.round(at(0, "similarity") - at(1, "similarity"), 9).alias("gap"), status.alias("status"),
    )


def legacy_causes(comments: DataFrame, known: DataFrame, vector: Column, k: int = 3) -> DataFrame:
    """The k nearest candidates by cosine (9 places); of ties the later one in the catalog comes first. A code without candidates of its own meets all of them; a blank text has none."""
    every = known.select("code", (-F.col("pos")).alias("pos"), "cause_id", "vector", length(F.col("vector")).alias("length"))
    whole = every.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("code", (-F.col("pos")).alias("p"), "cause_id", "vector", "length"))), lambda x, i: F.struct((-i).alias("pos"), x["cause_id"].alias("cause_id"), x["vector"].alias("vector"), x["length"].alias("length"))).alias("__known"))
    lists = _lists(every).select("code", "__known").unionByName(whole.select(F.lit("*").alias("code"), "__known"))
    own = comments.withColumn("__c", F.when(F.col("code").isin(*(c for c in C.CAUSES if c != "H")), F.col("code")).otherwise("*"))
    near = lambda v, n: F.transform("__known", lambda x: once(F.round(_cosine_to(v, n, x), 9), lambda s: _scored(x, s)))
    scores = F.when(F.length(squeeze(F.coalesce("text", F.lit("")))) > 0, once(vector, lambda v: once(length(v), lambda n: near(v, n))))
    wide = own.join(F.broadcast(lists.withColumnRenamed("code", "__c")), "__c").withColumn("__all", _best(scores))
    return wide.select(*comments.columns, F.transform(F.slice("__all", 1, k), lambda x: F.struct(x["cause_id"].alias("cause_name"), x["score"].alias("similarity"))).alias("microcauses"))


def compared(baseline: DataFrame, ranked: DataFrame, key: str) -> DataFrame:
    """One row for each comment with the baseline's cause and score beside the first of the ranked list, and whether they are the same; met by key, never by position."""
    own = ranked.select(key, F.get("top", F.lit(0))["cause_id"].alias("topk_cause"), F.get("top", F.lit(0))["score"].alias("topk_score"), F.size("top").alias("topk_size"))
    both = baseline.select(key, F.col("best_cause").alias("baseline_cause"), F.col("best_similarity").alias("baseline_score")).join(own, key)
    return both.withColumn("same_cause", F.col("baseline_cause").eqNullSafe(F.col("topk_cause")))


def similarity_matrix(known: DataFrame) -> DataFrame:
    """cause_id and a column for each candidate with their similarity: as many rows and columns as the catalog has causes (39)."""
    ids = [r[0] for r in known.select("cause_id").distinct().orderBy("cause_id").collect()]  # the catalog
    one = known.dropDuplicates(["cause_id"]).select("cause_id", "vector")
    listed = one.groupBy().agg(F.collect_list(F.struct("cause_id", "vector")).alias("__all"))
    pairs = one.join(F.broadcast(listed)).select("cause_id", F.map_from_entries(F.transform("__all", lambda x: F.struct(x["cause_id"], F.round(cosine(F.col("vector"), x["vector"]), 6)))).alias("m"))
    return pairs.select("cause_id", *(F.col("m")[i].alias(i) for i in ids))


def cause_pairs(known: DataFrame) -> DataFrame:
    """Pairs of candidates of the same cause, each once, with their similarity; at most eight candidates meet."""
    a, b = known.alias("a"), known.alias("b")
    pairs = a.join(b, (F.col("a.code") == F.col("b.code")) & (F.col("a.cause_id") < F.col("b.cause_id")))
    return pairs.select("a.code", F.col("a.cause_id").alias("cause_1"), F.col("b.cause_id").alias("cause_2"), F.round(cosine(F.col("a.vector"), F.col("b.vector")), 6).alias("similarity"))
