"""Models that learn an issue's level from its text or its features.

All classes weigh the same. Splits and folds go by a hash of the key, so a run can be repeated. Word weights are
tf * (ln((1 + n) / (1 + df)) + 1), unit length.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators import embedders, linear, tables
from loomspark.operators.index import FEATURES
from loomspark.plans.lineage import written

MAX_TERMS, MIN_TEXTS, TREES, DEEPEST = 5000, 2, 300, 30
Fit = Callable[[DataFrame, str], Model]


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Adds weight: rows / (labels * rows of the label)."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    total = n.agg(F.sum("__n").alias("__rows"), F.count(F.lit(1)).alias("__labels"))
    weights = n.join(F.broadcast(total)).select(F.col(label).alias("__label"), (F.col("__rows") / (F.col("__labels") * F.col("__n"))).alias("weight"))
    return df.join(F.broadcast(weights), F.col(label) == F.col("__label")).drop("__label")


def text_features(train: DataFrame, text: str = "text") -> PipelineModel:
    """One vocabulary of words and pairs of words."""
    words = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="words", pattern=r"(?U)\b\w\w+\b", gaps=False),
        NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__"),
        CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=MAX_TERMS, minDF=MIN_TEXTS),
    ]).fit(train)
    idf = IDF(inputCol="tf", outputCol="tfidf").fit(words.transform(train)).idf
    scale = ElementwiseProduct(scalingVec=[float(x) + 1.0 for x in idf], inputCol="tf", outputCol="weighted")
    return PipelineModel([*words.stages, scale, Normalizer(p=2.0, inputCol="weighted", outputCol="features")])


def _fit(train: DataFrame, label: str, features: PipelineModel, classifier) -> PipelineModel:
    index = StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep").fit(train)
    ready = features.transform(index.transform(balanced(train, label)))
    return PipelineModel([index, features, classifier.fit(ready)])


def text_logistic(train: DataFrame, label: str) -> PipelineModel:
    return _fit(train, label, text_features(train), LogisticRegression(labelCol="y", weightCol="weight", maxIter=1000, regParam=1.0 / max(1, train.count()), family="multinomial"))


def text_svm(train: DataFrame, label: str) -> PipelineModel:
    return _fit(train, label, text_features(train), OneVsRest(classifier=LinearSVC(maxIter=100, regParam=1.0 / max(1, train.count())), labelCol="y", weightCol="weight"))


def feature_forest(train: DataFrame, label: str, columns: tuple[str, ...] = FEATURES) -> PipelineModel:
    """Spark grows trees no deeper than DEEPEST."""
    features = PipelineModel([VectorAssembler(inputCols=list(columns), outputCol="features")])
    return _fit(train, label, features, RandomForestClassifier(labelCol="y", weightCol="weight", numTrees=TREES, maxDepth=DEEPEST, seed=42))


def vector_logistic(train: DataFrame, label: str, vector: str = "vector") -> PipelineModel:
    """Over an embedder's array column, standardised."""
    wide = train.withColumn("raw", array_to_vector(vector))
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(wide)
    features = PipelineModel([SQLTransformer(statement="SELECT * FROM __THIS__"), scaler])
    return _fit(wide, label, features, LogisticRegression(labelCol="y", weightCol="weight", maxIter=1000, regParam=1.0 / max(1, train.count()), family="multinomial"))


class Linear(NamedTuple):
    """A linear model over an embedder's vectors or, without one, over weighted words; all such models and folds are trained in one go."""

    loss: str = "logistic"
    embedder: embedders.Embedder | None = None


MODELS: dict[str, Fit | Linear] = {"TF-IDF + Logistic Regression": Linear(), "TF-IDF + Linear SVM": Linear("hinge"), "Random Forest + Adaptive Features": feature_forest}


def compact(df: DataFrame) -> DataFrame:
    """Issues kept in memory for the rounds of training, in few partitions where they are few."""
    return df.repartition(1 + df.count() // 20_000).cache()


def predict(model: PipelineModel, rows: DataFrame, vector: str | None = None) -> DataFrame:
    """Adds predicted, a label."""
    names = F.array(*map(F.lit, model.stages[0].labels))
    wide = rows.withColumn("raw", array_to_vector(vector)) if vector else rows
    return model.transform(wide).withColumn("predicted", F.get(names, F.col("prediction").cast("int"))).select(*rows.columns, "predicted")


def scores(predicted: DataFrame, label: str, labels: list[str]) -> DataFrame:
    """One row: accuracy, macro_f1, weighted_f1, over labels that occur in truth or predictions."""
    report = tables.class_report(predicted, label, "predicted", labels)
    seen = report.where("support > 0 or precision > 0 or f1 > 0")
    rows = F.nullif(F.sum("support"), F.lit(0))
    return seen.agg((F.sum(F.col("recall") * F.col("support")) / rows).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / rows).alias("weighted_f1"))


def importance(model: PipelineModel, columns: tuple[str, ...] = FEATURES) -> list[tuple[str, float]]:
    """Features of a forest, the most important first."""
    return sorted(zip(columns, map(float, model.stages[-1].featureImportances.toArray())), key=lambda x: (-x[1], x[0]))


def importance_by_fold(issues: DataFrame, label: str, key: str, columns: tuple[str, ...] = FEATURES, n: int = 5, fit: Fit | None = None) -> DataFrame:
    """feature, mean and sample deviation of a forest's importance over n folds."""
    split = compact(tables.folds(issues, label, key, n))
    forest = fit or (lambda train, y: feature_forest(train, y, columns))
    rows = [(f, x) for k in range(n) for f, x in importance(forest(split.where(F.col("fold") != k), label), columns)]  # a row a feature and fold
    made = issues.sparkSession.createDataFrame(rows, "feature string, x double")
    return made.groupBy("feature").agg(F.round(F.avg("x"), 4).alias("mean"), F.round(F.stddev_samp("x"), 4).alias("std"))


def together(rows: DataFrame, models: dict[str, Linear], folds: list[int], classes: int, text: str = "text", counts: DataFrame | None = None) -> dict[str, np.ndarray]:
    """Confusion by fold, true and predicted class of each model; rows: fold, y and the text or, with counts (embedders.term_counts of the key named text), the key."""
    some = {name: f"v{i}" for i, (name, m) in enumerate(models.items()) if m.embedder}
    columns = [embedders.embedded(F.col(text), models[name].embedder).alias(c) for name, c in some.items()]
    if counts is not None and some:
        raise ValueError("embedders read texts, not counts of terms")
    known = None if len(some) == len(models) else embedders.vocabulary(rows, text, folds) if counts is None else embedders.vocabulary_of_counts(rows, counts, text, folds)
    if known and counts is not None:
        none = F.struct(F.array().cast("array<int>").alias("i"), F.array().cast("array<int>").alias("n"))
        rows = rows.join(embedders.known_counts(counts, text, known), text, "left").withColumn("terms", F.coalesce("terms", none))
        columns.append(F.col("terms"))
    elif known:
        columns.append(embedders.counted_terms(F.col(text), known).alias("terms"))
    ready = written(rows.select("fold", "y", *columns), "model-rows")
    problems = [linear.Problem(name, some.get(name, "terms"), m.loss, idf=None if m.embedder else known.idf) for name, m in models.items()]
    return dict(zip(models, linear.confusion(ready, linear.fit(ready, problems, folds, classes))))


def _judged(split: DataFrame, label: str, models: dict[str, Fit | Linear], folds: list[int], text: str, counts: DataFrame | None = None) -> dict[str, np.ndarray]:
    """Confusion of every model on each fold, learned from the other rows; split: the issues and their fold. With counts, text is the key of both."""
    labels = [r[0] for r in split.where(F.col(label).isNotNull()).select(label).distinct().orderBy(label).limit(1000).collect()]  # levels: three
    y = (F.array_position(F.array(*map(F.lit, labels)), F.col(label)) - 1).cast("int")
    named = split.where(F.col(label).isNotNull()).withColumn("__y", y)
    own = {name: m for name, m in models.items() if isinstance(m, Linear)}
    out = together(named.select("fold", F.col("__y").alias("y"), text), own, folds, max(2, len(labels)), text, counts) if own else {}
    for name, fit in models.items():
        if name not in own:
            out[name] = np.zeros((len(folds), len(labels), len(labels)))
            for k, f in enumerate(folds):
                model = fit(split.where(F.col("fold") != f), label)
                guess = (F.array_position(F.array(*map(F.lit, labels)), F.col("predicted")) - 1).cast("int").alias("guess")
                for true, said, n in predict(model, named.where(F.col("fold") == f)).groupBy("__y", guess).count().collect():
                    out[name][k, true, said] += n
    return {name: out[name] for name in models}


def holdout(issues: DataFrame, label: str, key: str, models: dict[str, Fit | Linear] = MODELS, test_share: float = 0.3, text: str = "text", counts: DataFrame | None = None) -> DataFrame:
    """model, accuracy, macro_f1, weighted_f1 on the part held out of each label. Where an issue's text would be one large value, counts (embedders.term_counts
    by key, read several times) stand for it."""
    split = compact(tables.stratified_split(issues, label, key, test_share).withColumn("fold", F.when(F.col("is_test"), 0).otherwise(1)).drop("is_test"))
    rows = [(name, *(round(x, 4) for x in linear.scores(found[0]))) for name, found in _judged(split, label, models, [0], text if counts is None else key, counts).items()]
    return issues.sparkSession.createDataFrame(rows, "model string, accuracy double, macro_f1 double, weighted_f1 double")


def cross_validation(issues: DataFrame, label: str, key: str, models: dict[str, Fit | Linear] = MODELS, n: int = 5, text: str = "text") -> DataFrame:
    """model, mean and population deviation of the three scores over n folds."""
    found = _judged(compact(tables.folds(issues, label, key, n)), label, models, list(range(n)), text)
    return issues.sparkSession.createDataFrame(embedders.score_table(list(found), list(found.values())), f"model string, {embedders.SCORES}")


def final_comparison(issues: DataFrame, label: str, key: str, own: list[embedders.Embedder], models: dict[str, Fit | Linear] = MODELS, n: int = 5, text: str = "text") -> DataFrame:
    """model, input_type and mean scores over n folds of all models and of the best embedder by macro F1, the best first."""
    every = models | {f"Best embedder ({e.name})": Linear(embedder=e) for e in own}
    found = cross_validation(issues, label, key, every, n, text).collect()
    best = max((r for r in found if r["model"] not in models), key=lambda r: r["macro_f1_mean"], default=None)
    kind = lambda name: "Adaptive structured features" if not isinstance(every[name], Linear) else "Issue text embeddings" if every[name].embedder else "Issue text"
    rows = [(r["model"], kind(r["model"]), r["accuracy_mean"], r["macro_f1_mean"], r["weighted_f1_mean"]) for r in found if r["model"] in models or r is best]
    made = issues.sparkSession.createDataFrame(rows, "model string, input_type string, accuracy_mean double, macro_f1_mean double, weighted_f1_mean double")
    return made.orderBy(F.desc("macro_f1_mean"), "model")
