"""Embedders, singular vectors and the one-go trainer against dense and separate versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.functions.embedding import hashed_vector
from loomspark.operators import embedders, linear, models
from loomspark.operators.sums import summed


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(4)
    rows = []
    for k in range(240):
        label = ("low", "mid", "high")[k % 3]
        own = [r.choice(f"{label}a {label}b {label}c".split() if r.random() < 0.35 else "common words that all texts share here".split()) for _ in range(r.randrange(4, 30))]
        rows.append((k, " ".join(own), label))
    rows += [(240, None, "low"), (241, "", "mid"), (242, "!", "high"), (243, "a b", None)]
    return spark.createDataFrame(rows, "key long, text string, label string").repartition(3).cache()


def test_sums_meet_in_chunks(spark, monkeypatch):
    from loomspark.operators import sums

    def kernel(batches):
        out = np.zeros(100_001)
        for b in batches:
            np.add.at(out, b.column(0).to_numpy(), 1.0)
        return out

    rows = spark.range(0, 200_000, 2, 6).select((F.col("id") % 100_001).alias("id"))
    want = np.bincount(np.arange(0, 200_000, 2) % 100_001, minlength=100_001)
    assert (summed(rows, kernel, 100_001) == want).all()
    monkeypatch.setattr(sums, "MOST_BYTES", 1)
    assert (summed(rows, kernel, 100_001) == want).all()
    assert not summed(rows.where("id < 0"), kernel, 100_001).any()


def test_embedders(spark, texts):
    words = embedders.HashedWords()
    got = texts.select("key", "text", embedders.embedded(F.col("text"), words).alias("v"), hashed_vector(F.col("text")).alias("native")).collect()
    for r in got:
        own = np.array(r.native)
        assert np.allclose(r.v, own / (np.linalg.norm(own) or 1))
    grams = embedders.HashedGrams(64).encode(["", "ab", "The  same\nTEXT", "the same text", "other"])
    assert (grams[2] == grams[3]).all() and (grams[3] != grams[4]).any() and np.abs(grams[1]).sum() <= 3 and np.abs(grams[0]).sum() == 0

    class Length:
        def encode(self, own):
            return [[len(t), 1.0] for t in own]

    plugged = embedders.Plugged("length", 2, Length)
    long = spark.createDataFrame([("x" * 100_000,), (None,)], "text string").select(embedders.embedded(F.col("text"), plugged).alias("v")).collect()
    assert np.allclose(long[0].v, [1, 1e-5]) and np.allclose(long[1].v, [0, 1])


def dense_terms(rows, known):
    m = np.zeros((len(rows), len(known.terms)))
    for i, text in enumerate(rows):
        for t in embedders.terms(text or ""):
            if t in known.terms:
                m[i, known.terms[t]] += known.idf[0][known.terms[t]]
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length > 0, length, 1)


def test_svd_is_the_dense_one(spark, texts):
    rows = [r.text for r in texts.collect()]
    lsa = embedders.fit_lsa(texts, "text", 6)
    known = embedders.vocabulary(texts, "text")
    df = {t: sum(t in embedders.terms(x or "") for x in rows) for t in known.terms}
    assert min(df.values()) >= 2 and all(math.isclose(known.idf[0][i], math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, i in known.terms.items())
    m = dense_terms(rows, known)
    _, values, right = np.linalg.svd(m, full_matrices=False)
    assert np.allclose(lsa.values, values[:6], rtol=1e-3)
    turned = np.abs((lsa.vectors * right[:6].T).sum(0))  # up to the sign
    assert (turned[:3] > 0.999).all() and np.allclose(lsa.vectors.T @ lsa.vectors, np.eye(6), atol=1e-8)
    assert np.allclose(lsa.encode([t or "" for t in rows]), m @ lsa.vectors)
    few = embedders.fit_lsa(spark.createDataFrame([("one two",), ("one two",)], "text string"), "text", 64)
    assert few.dimensions == 3 and embedders.fit_lsa(texts.limit(0), "text", 8).dimensions == 0


def test_vocabulary_by_fold(spark, texts):
    split = texts.withColumn("fold", (F.col("key") % 3).cast("int"))
    both = embedders.vocabulary(split, "text", [0, 1, 2], 12)
    for f in range(3):
        alone = embedders.vocabulary(texts.where(F.col("key") % 3 != f), "text", None, 12)
        assert {t: both.idf[f][i] for t, i in both.terms.items() if both.idf[f][i]} == pytest.approx({t: alone.idf[0][i] for t, i in alone.terms.items()})


def problems(texts, n=4):
    ready, labels = embedders.split(texts, "label", "key", n, F.col("text"), embedders.embedded(F.col("text"), embedders.HashedWords(16)).alias("v"))
    folded = ready.cache()
    known = embedders.vocabulary(folded, "text", list(range(n)))
    rows = folded.withColumn("terms", embedders.counted_terms(F.col("text"), known)).drop("text").cache()
    own = [linear.Problem("dense", "v"), linear.Problem("words", "terms", idf=known.idf), linear.Problem("svm", "terms", "hinge", idf=known.idf)]
    return rows, own, labels


def test_all_at_once_is_each_alone(spark, texts):
    rows, own, labels = problems(texts)
    assert labels == ["high", "low", "mid"] and rows.count() == 243
    fitted = linear.fit(rows, own, [0, 1, 2, 3], 3)
    counts = linear.confusion(rows, fitted)
    assert counts.sum() == 3 * 243
    for p, problem in enumerate(own):
        for f in (0, 3):
            alone = problem if problem.idf is None else problem._replace(idf=problem.idf[f : f + 1])
            one = linear.fit(rows, [alone], [f], 3)
            assert np.abs(one.coefficients[0][0] - fitted.coefficients[p][f]).max() < 1e-2
            assert linear.scores(linear.confusion(rows, one)[0, 0]) == pytest.approx(linear.scores(counts[p, f]), abs=1e-6)
    assert min(linear.scores(counts[p].sum(0))[0] for p in range(3)) > 0.8


@pytest.mark.parametrize("classes", [2, 3])
def test_logistic_is_the_optimum(spark, texts, classes):
    """Against a dense descent on the same loss."""
    own = texts.where(F.col("label") != "mid") if classes == 2 else texts
    rows, some, _ = problems(own, 3)
    fitted = linear.fit(rows, some[:1], [1], classes)
    local = rows.where("fold != 1").collect()
    x, y = np.array([r.v for r in local]), np.array([r.y for r in local])
    scale = x.std(0)
    x = (x - x.mean(0)) / np.where(scale > 1e-12, scale, 1)
    weight = (len(y) / (classes * np.bincount(y, minlength=classes)))[y]

    def slope(w):
        z = x @ w[:-1] + w[-1]
        if classes == 2:
            r = (1 / (1 + np.exp(-z)) - y[:, None]) * weight[:, None]
        else:
            e = np.exp(z - z.max(1, keepdims=True))
            r = (e / e.sum(1, keepdims=True) - np.eye(classes)[y]) * weight[:, None]
        return np.concatenate([x.T @ r + w[:-1], r.sum(0, keepdims=True)])

    w = fitted.coefficients[0][0]
    assert np.abs(slope(w)).max() < 1e-2
    best = w.copy()
    for _ in range(20_000):
        best -= 0.002 * slope(best)
    assert np.abs(slope(best)).max() < 1e-4 and np.abs(best[:-1] - w[:-1]).max() < 1e-2


def test_comparison(spark, texts):
    got = embedders.compare(texts, "text", "label", "key", [embedders.HashedWords(), embedders.HashedGrams(32), embedders.fit_lsa(texts, "text", 8)], 3)
    assert got.columns == ["embedding_model", "accuracy_mean", "accuracy_std", "macro_f1_mean", "macro_f1_std", "weighted_f1_mean", "weighted_f1_std", "embedding_dim"]
    rows = got.collect()
    assert {r.embedding_dim for r in rows} == {64, 32, 8} and [r.macro_f1_mean for r in rows] == sorted((r.macro_f1_mean for r in rows), reverse=True)
    assert rows[0].macro_f1_mean > 0.9


def test_scores():
    assert linear.scores(np.array([[3, 1, 0], [0, 2, 0], [0, 0, 0]])) == pytest.approx((5 / 6, (6 / 7 + 4 / 5) / 2, (4 * 6 / 7 + 2 * 4 / 5) / 6))
    assert linear.scores(np.zeros((2, 2))) == (0, 0, 0)


def test_final_comparison(spark, texts):
    """All linear models in one go beside a model of its own fits; the best embedder alone is named."""
    issues = texts.where("label is not null").withColumn("f", F.when(F.col("label") == "low", 1.0).when(F.col("label") == "mid", 2.0).otherwise(3.0))

    def forest(train, label):
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.feature import VectorAssembler

        features = models.PipelineModel([VectorAssembler(inputCols=["f"], outputCol="features")])
        return models._fit(train, label, features, RandomForestClassifier(labelCol="y", weightCol="weight", numTrees=3, maxDepth=3, seed=1))

    own = {"words": models.Linear(), "svm": models.Linear("hinge"), "forest": forest}
    got = models.final_comparison(issues, "label", "key", [embedders.HashedWords(16), embedders.HashedGrams(16)], own, 2).collect()
    assert [r.macro_f1_mean for r in got] == sorted((r.macro_f1_mean for r in got), reverse=True)
    named = {r.model: r.input_type for r in got}
    assert len(named) == 4 and named["forest"] == "Adaptive structured features" and named["words"] == "Issue text"
    assert [v for k, v in named.items() if k.startswith("Best embedder")] == ["Issue text embeddings"]
    alone = models.cross_validation(issues, "label", "key", {"words": models.Linear()}, 2).first()
    assert alone.macro_f1_mean == pytest.approx(next(r.macro_f1_mean for r in got if r.model == "words"), abs=1e-4)
    held = {r.model: r.accuracy for r in models.holdout(issues, "label", "key", own).collect()}
    assert set(held) == set(own) and held["forest"] == 1.0 and held["words"] > 0.8


def test_dense_vectors_need_few_passes(spark, monkeypatch):
    """Separable classes, for which L-BFGS needs many rounds: each is a pass over all rows."""
    r = np.random.default_rng(5)
    y = r.integers(0, 2, 400)
    x = r.normal(size=(400, 20)) * np.logspace(0, 3, 20) + np.outer(y, np.full(20, 2.0))
    rows = spark.createDataFrame([(i % 3, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x))], "fold int, y int, v array<double>")
    passes, real = [], linear.summed
    monkeypatch.setattr(linear, "summed", lambda *a: (passes.append(1), real(*a))[1])
    fitted = linear.fit(rows, [linear.Problem("a", "v")], [0, 1, 2], 2)
    assert len(passes) <= 14
    monkeypatch.setattr(linear, "WIDEST", 0)
    slow = linear.fit(rows, [linear.Problem("a", "v")], [0, 1, 2], 2)
    assert np.allclose(fitted.coefficients[0], slow.coefficients[0], atol=0.02)
