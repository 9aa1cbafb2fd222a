"""Counts, cross tables, agreement and checks over labelled tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.regex import strip
from loomspark.operators.quantiles import exact_quantiles


def value_counts(df: DataFrame, column: str, keep_null: bool = True) -> DataFrame:
    """value, n, percentage (2 places)."""
    rows = df if keep_null else df.where(F.col(column).isNotNull())
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("__all"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("value", "n", F.round(100 * F.col("n") / F.col("__all"), 2).alias("percentage"))


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of pairs, 0 where there is none."""
    return df.groupBy(row).pivot(column, values).count().fillna(0)


def pivot_mean(df: DataFrame, row: str, column: str, values: list, measure: str) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.avg(measure)).fillna(0.0)


def class_report(df: DataFrame, truth: str, predicted: str, labels: list) -> DataFrame:
    """label, precision, recall, f1, support; 0 where undefined."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    spread = pairs.select(F.explode(F.array(*map(F.lit, labels))).alias("label"), "t", "p", "c")
    n = spread.groupBy("label").agg(*(F.coalesce(F.sum(F.when(c, F.col("c"))), F.lit(0)).alias(k) for k, c in (("tp", (F.col("t") == F.col("label")) & (F.col("p") == F.col("label"))), ("fp", (F.col("t") != F.col("label")) & (F.col("p") == F.col("label"))), ("fn", (F.col("t") == F.col("label")) & (F.col("p") != F.col("label"))))))
    over = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return n.select("label", over(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), over(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), over(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def loss(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows of each key before and after, what was lost, in percent too."""
    a, b = before.groupBy(key).agg(F.count(F.lit(1)).alias("n_before")), after.groupBy(key).agg(F.count(F.lit(1)).alias("n_after"))
    out = a.join(b, key, "left").withColumn("n_after", F.coalesce("n_after", F.lit(0)))
    return out.withColumn("n_lost", F.col("n_before") - F.col("n_after")).withColumn("percent_lost", F.bround(100 * F.col("n_lost") / F.col("n_before"), 2))


def duplicate_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows repeat an earlier key; nulls equal each other."""
    return df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def bins(x: Column) -> Column:
    """Right-closed similarity bins; null outside."""
    return F.when((x > -0.001) & (x <= 0.3), "Muy baja").when((x > 0.3) & (x <= 0.5), "Baja").when((x > 0.5) & (x <= 0.7), "Media").when((x > 0.7) & (x <= 1.0), "Alta")


def top_rows(df: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(n)


def stratified(df: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each group, always the same, by a hash of key and seed. Spark cuts each task's rows to n a group before they travel."""
    w = Window.partitionBy(group).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, count, mean, std, min, quartiles, max; quartiles are exact. Nulls and NaN are left out."""
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    each = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), number(c).alias("x")) for c in columns))).alias("e")).select("e.column_name", "e.x")
    moments = each.groupBy("column_name").agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    shares = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    found = exact_quantiles(df, columns, tuple(shares.values()))
    quartiles = found.groupBy("column_name").agg(*(F.max(F.when(F.col("share") == s, F.col("value"))).alias(n) for n, s in shares.items()))
    return moments.join(F.broadcast(quartiles), "column_name", "left").select("column_name", "count", "mean", "std", "min", *shares, "max")  # a row a column


def null_counts(df: DataFrame) -> DataFrame:
    """column_name, nulls; all columns in one pass."""
    one = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in df.columns))).alias("e")).select("e.*")


def agreement(a: DataFrame, b: DataFrame, key: str, label: str, number: str, order: str | None = None) -> DataFrame:
    """One row: rows in both, percent with equal labels, mean and largest absolute difference. Of rows that repeat a key the last by order counts; without one, the largest."""
    one = lambda df, end: df.groupBy(key).agg((F.max_by(F.struct(label, number), order) if order else F.max(F.struct(label, number))).alias(end))
    both = one(a, "x").join(one(b, "y"), key)
    gap = F.abs(F.col(f"x.{number}") - F.col(f"y.{number}"))
    same = F.col(f"x.{label}").eqNullSafe(F.col(f"y.{label}"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg(same.cast("int")), 2).alias("percent_equal"), F.avg(gap).alias("mean_gap"), F.max(gap).alias("largest_gap"))


#: Bits of a hash that cut a label's rows into parts which are ranked apart.
PART_BITS = 10


def spread_rank(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """Adds __rank (from 1, by a hash of key and seed) and __n, both within the label. Each label is ranked in 2^PART_BITS parts behind which the counts
    of earlier parts are added, so a label with a third of all rows is no single task."""
    hashed = df.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed))).withColumn("__part", F.shiftright("__h", 64 - PART_BITS))
    counts = hashed.groupBy(F.col(label).alias("__label"), F.col("__part").alias("__p")).agg(F.count(F.lit(1)).alias("__c"))
    own = Window.partitionBy("__label")
    before = counts.select("__label", "__p", (F.sum("__c").over(own.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))).alias("__before"), F.sum("__c").over(own).alias("__n"))
    ranked = hashed.withColumn("__r", F.row_number().over(Window.partitionBy(label, "__part").orderBy("__h", key)))
    placed = ranked.join(F.broadcast(before), F.col(label).eqNullSafe(F.col("__label")) & (F.col("__part") == F.col("__p")))  # a row for each label and part
    return placed.withColumn("__rank", F.col("__r") + F.coalesce("__before", F.lit(0))).select(*df.columns, "__rank", "__n")


def stratified_split(df: DataFrame, label: str, key: str, test_share: float = 0.3, seed: int = 42) -> DataFrame:
    """Adds is_test: of each label's rows that share, always the same ones."""
    return spread_rank(df, label, key, seed).select(*df.columns, (F.col("__rank") <= F.round(F.col("__n") * test_share)).alias("is_test"))


def folds(df: DataFrame, label: str, key: str, n: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold, 0 to n - 1, spread evenly over each label."""
    return spread_rank(df, label, key, seed).select(*df.columns, (F.col("__rank") % n).cast("int").alias("fold"))


def differences(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys that are in one table only, and in which."""
    lost, new = before.select(key).subtract(after.select(key)), after.select(key).subtract(before.select(key))
    return lost.withColumn("only_in", F.lit("before")).unionByName(new.withColumn("only_in", F.lit("after")))


def confusion(df: DataFrame, truth: str, predicted: str, labels: list) -> DataFrame:
    """A row for each true label, a column for each predicted one, 0 where there is none."""
    spread = df.where(F.col(truth).isin(*labels)).groupBy(F.col(truth).alias("truth")).pivot(predicted, labels).count().fillna(0)
    every = df.sparkSession.createDataFrame([(x,) for x in labels], spread.select("truth").schema)
    return every.join(F.broadcast(spread), "truth", "left").fillna(0)


def overall(report: DataFrame) -> DataFrame:
    """One row from a class report: accuracy, macro_f1, weighted_f1."""
    rows = F.nullif(F.sum("support"), F.lit(0))
    return report.agg((F.sum(F.col("recall") * F.col("support")) / rows).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / rows).alias("weighted_f1"))


def mean_and_deviation(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """<column>_mean and <column>_std (of the sample; null for one row) for each group."""
    return df.groupBy(group).agg(*(f(c).alias(f"{c}_{end}") for c in columns for f, end in ((F.avg, "mean"), (F.stddev_samp, "std"))))


def distinct_counts(df: DataFrame, columns: list[str], group: str | None = None) -> DataFrame:
    """How many different values each column has (a list counts as one value; nulls don't count), in all or for each group."""
    one = lambda c: F.to_json(c) if dict(df.dtypes)[c].startswith(("array", "map", "struct")) else F.col(c)
    return (df.groupBy(group) if group else df.groupBy()).agg(*(F.count_distinct(one(c)).alias(c) for c in columns))


def first_of_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by the order; nulls are a key like others. Combined before rows travel, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("__m"))
    return first.select(*((F.col(c) if c in keys else F.col(f"__m.{c}").alias(c)) for c in df.columns))


def random_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, always the same, by the MD5 of seed and key, which any engine has."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def most_frequent(df: DataFrame, column: str, n: int = 1) -> DataFrame:
    """The n values with most rows, and these; smaller values first on ties; nulls are left out."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(n)


def rows_of_most_frequent(df: DataFrame, column: str, n: int = 1) -> DataFrame:
    return df.join(F.broadcast(most_frequent(df, column, n).select(column)), column, "left_semi")


def missing_keys(known: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """key, problem: known ones that are not used, and used ones that are not known."""
    one = lambda a, b, word: a.select(key).where(F.col(key).isNotNull()).distinct().join(b.select(key).distinct(), key, "left_anti").withColumn("problem", F.lit(word))
    return one(known, used, "unused").unionByName(one(used, known, "unknown"))


def values_of_map(df: DataFrame, column: str, out: str) -> DataFrame:
    """Distinct members of all lists in a map's values."""
    return df.select(F.explode(F.flatten(F.map_values(column))).alias(out)).distinct()


def merged_lists(*columns: Column) -> Column:
    """Sorted distinct members of several lists, stripped, without blank ones; null lists are empty."""
    every = F.flatten(F.array(*(F.coalesce(c.cast("array<string>"), F.array().cast("array<string>")) for c in columns)))
    return F.array_sort(F.array_distinct(F.filter(F.transform(every, strip), lambda x: x != "")))


def heat_map(df: DataFrame, row: str, column: str, values: list, measure: str) -> DataFrame:
    """Means by row and column, 0 where there is none, the row with the largest mean first."""
    return pivot_mean(df, row, column, values, measure).orderBy(F.greatest(*(F.col(f"`{v}`") for v in values)).desc(), row)


def with_text(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose text has the pattern in any case; a null has none."""
    return df.where(F.coalesce(F.col(column).rlike(f"(?iUd){pattern}"), F.lit(False)))


def with_anywhere(df: DataFrame, words: str, columns: list[str] | None = None) -> DataFrame:
    """Rows that have the words in any of the columns, in any case; lists are searched as JSON."""
    kinds = dict(df.dtypes)
    said = lambda c: F.to_json(c) if kinds[c].startswith(("array", "map", "struct")) else F.col(c).cast("string")
    return df.where(reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(said(c)), F.lit(words.lower())), F.lit(False)) for c in columns or df.columns)))
