"""Toxicity scores from a counterfactually regularised classifier.

A logistic model over which words a text has, and which short word beginnings; features whose association with the label may be chance are left
out, so that few labels suffice. For each labelled text that names a group, copies with the group's name swapped for another's and for a neutral word
are made, and the squared change of the score between the two is penalised; so a neutral mention of a group doesn't carry a score.

Training reads at most MAX_TRAIN labelled texts, chosen by a hash of the id (a documented bound on the driver's memory); scoring reads every
whole text, counts each distinct word once, and needs nothing but the weights (at most MAX_FEATURES).
Null and empty texts get the score of a text without words. A null id gets held_out = false and no part in training; a
null label isn't used; repeated rows get the same score. An empty documents table gives an empty result; without
usable labels all scores are 0.5 or less, and nothing is predicted toxic. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm._common import safe_text

MAX_TRAIN = 8000
MAX_FEATURES = 6000
MIN_TEXTS = 3
LEAST_FEATURES = 20
#: Share of chosen features that may be chance finds.
FALSE_DISCOVERIES = 0.01
#: Weight of the counterfactual penalty.
SWAP_PENALTY = 2.0
THRESHOLD = 0.7
#: Rows that a worker holds as Python objects at once.
STEP = 500
PREFIXES = (4, 5, 6)
NEUTRAL = "people"
IDENTITY_TERMS = (
    "women", "men", "muslims", "christians", "jews", "hindus", "immigrants", "refugees", "gay", "lesbian", "transgender", "black", "white", "asian", "disabled", "deaf", "blind",
    "femmes", "hommes", "musulmans", "juifs", "frauen", "männer", "muslime", "juden", "mujeres", "hombres", "musulmanes", "judíos",
)
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32) for c in range(256))


def words(text: str | None) -> list[bytes]:
    """ASCII letters lower-cased; runs of letters and non-ASCII bytes."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _features(word: bytes) -> tuple[int, ...]:
    """32-bit hashes of the word and of its beginnings."""
    text = word.decode("utf-8", "replace")
    return (xxhash.xxh32_intdigest(word), *(xxhash.xxh32_intdigest(text[:n].encode(), seed=n) for n in PREFIXES if len(text) > n))


class Model:
    """Weights by feature; scores texts."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias

    def scorer(self):
        known: dict[bytes, tuple[int, ...]] = {}
        weights = self.weights

        def score(text: str | None) -> float:
            active: set[int] = set()
            for w in set(words(text)):
                own = known.get(w)
                if own is None:
                    if len(known) > 150_000:
                        known.clear()
                    own = known[w] = tuple(f for f in _features(w) if f in weights)
                active.update(own)
            z = self.bias + sum(map(weights.__getitem__, sorted(active)))
            return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))

        return score


def association(in1: np.ndarray, in0: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Signed root of the likelihood ratio of each feature and the label; about normal where there is no association, also for few texts."""

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    total, n = in1 + in0, n1 + n0
    ratio = part(in1, total * n1 / n) + part(in0, total * n0 / n) + part(n1 - in1, (n - total) * n1 / n) + part(n0 - in0, (n - total) * n0 / n)
    return np.sign(in1 / n1 - in0 / n0) * np.sqrt(np.maximum(2 * ratio, 0))


def chosen_features(z: np.ndarray) -> np.ndarray:
    """Places of the features whose association is no chance find: a false discovery rate of FALSE_DISCOVERIES, at least LEAST_FEATURES and at most MAX_FEATURES."""
    p = np.array([math.erfc(abs(x) / math.sqrt(2)) for x in z.tolist()])
    order = np.argsort(p, kind="stable")
    good = np.flatnonzero(p[order] <= FALSE_DISCOVERIES * np.arange(1, len(order) + 1) / max(1, len(order)))
    return order[: min(MAX_FEATURES, max(LEAST_FEATURES, good[-1] + 1 if len(good) else 0))]


def fit(
    texts: Iterable[list[bytes]], labels: np.ndarray, seed: int = 7, rounds: int = 400, l2: float = 1e-4, penalty: float = SWAP_PENALTY, terms: tuple[str, ...] = IDENTITY_TERMS, neutral: str = NEUTRAL
) -> Model:
    """texts: distinct words of each labelled text. terms: the groups' names that are swapped for each other and for the neutral word."""
    if not len(labels) or labels.min() == labels.max():
        return Model({}, -1.0 if not len(labels) or labels.max() == 0 else 0.0)
    known: dict[bytes, tuple[int, ...]] = {}

    def of(word: bytes) -> tuple[int, ...]:
        got = known.get(word)
        if got is None:
            if len(known) > 150_000:
                known.clear()
            got = known[word] = _features(word)
        return got

    groups = {t.encode() for t in terms}
    sets, named = [], []
    for t in texts:
        sets.append(np.unique(np.fromiter((f for w in t for f in of(w)), np.uint32)))
        if groups & set(t):
            named.append(t)
    return _fitted(sets, named, labels, seed, rounds, l2, penalty, terms, neutral)


def _fitted(
    sets: list[np.ndarray], named: list[list[bytes]], labels: np.ndarray, seed: int = 7, rounds: int = 400, l2: float = 1e-4, penalty: float = SWAP_PENALTY, terms: tuple[str, ...] = IDENTITY_TERMS, neutral: str = NEUTRAL
) -> Model:
    """sets: the features of each labelled text; named: the words of those that name a group, in the same order."""
    if not len(labels) or labels.min() == labels.max():
        return Model({}, -1.0 if not len(labels) or labels.max() == 0 else 0.0)
    of = _features
    groups, draw = [t.encode() for t in terms], np.random.default_rng(seed)
    swaps = []  # features that only the swapped text has, and those it lost
    for t in named:
        have = set(t)
        for term in sorted(have & set(groups)):
            others = [g for g in groups if g != term]
            rest = {f for w in have - {term} for f in of(w)}
            before = rest | set(of(term))
            for other in ([others[int(draw.integers(len(others)))]] if others else []) + [neutral.encode()]:
                after = rest | set(of(other))
                swaps.append((after - before, before - after))
    n, n1 = len(labels), float(labels.sum())
    n0 = n - n1
    every, in_all = np.unique(np.concatenate(sets), return_counts=True)
    in1 = np.zeros(len(every))
    of_toxic, counts = np.unique(np.concatenate([s for s, y in zip(sets, labels) if y > 0]), return_counts=True)
    in1[np.searchsorted(every, of_toxic)] = counts
    usable = np.flatnonzero(in_all >= MIN_TEXTS)
    chosen = np.sort(usable[chosen_features(association(in1[usable], in_all[usable] - in1[usable], n1, n0))])
    features = every[chosen]
    rows, column = [], []
    for i, s in enumerate(sets):
        hit = np.flatnonzero(np.isin(features, s, assume_unique=True))
        rows.append(np.full(len(hit), i, np.int32)), column.append(hit)
    rows, column = np.concatenate(rows), np.concatenate(column)
    index = {int(f): i for i, f in enumerate(features)}
    changes = [(pair, index[f], sign) for pair, both in enumerate(swaps) for sign, own in ((1.0, both[0]), (-1.0, both[1])) for f in own if f in index]
    cf_row, cf_col, cf_val = (np.array([c[k] for c in changes], kind) for k, kind in ((0, int), (1, int), (2, float)))
    k, pairs = len(chosen), len(swaps)
    w, b, g2, gb2 = np.zeros(k), 0.0, np.full(k, 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(rows, w[column], n), -30, 30)))
        e = (p - labels) * np.where(labels > 0, n0 / n1, 1.0) / n  # both labels weigh the same
        g = np.bincount(column, e[rows], k) + l2 * w
        if len(changes) and penalty:
            change = np.bincount(cf_row, w[cf_col] * cf_val, pairs)
            g += 2 * penalty / pairs * np.bincount(cf_col, change[cf_row] * cf_val, k)
        g2 += g * g
        gb2 += e.sum() ** 2
        w -= 0.5 * g / np.sqrt(g2)
        b -= 0.5 * e.sum() / np.sqrt(gb2)
    return Model({int(f): float(w[i]) for i, f in enumerate(features) if w[i]}, float(b))


def is_held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, **options) -> Model:
    """Fits on labelled rows that are not held out; of rows that repeat an id one counts. options: those of fit()."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (big.slice(i, STEP) for big in batches for i in range(0, big.num_rows, STEP)):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b" ".join(sorted(set(words(t)))) for t in batch.column(2).to_pylist()], pa.binary())], names=["doc_id", "toxic", "words"])

    found = docs.select(F.col("doc_id"), safe_text(F.col("text")).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")
    each = found.mapInArrow(distinct_words, "doc_id long, toxic int, words binary")
    groups = {t.encode() for t in options.get("terms", IDENTITY_TERMS)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, ...]] = {}
        for batch in (big.slice(i, STEP) for big in batches for i in range(0, big.num_rows, STEP)):
            sets, named = [], []
            for raw in batch.column(2).to_pylist():
                own = raw.split()
                if len(known) > 150_000:
                    known.clear()
                for w in own:
                    if w not in known:
                        known[w] = _features(w)
                sets.append(np.unique(np.fromiter((f for w in own for f in known[w]), np.uint32)).tobytes())
                named.append(raw if groups.intersection(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary()), pa.array(named, pa.binary())], names=["doc_id", "toxic", "features", "named"])

    one = each.groupBy("doc_id").agg(F.max(F.struct("toxic", "words")).alias("m")).select("doc_id", "m.*")
    # at most max_train rows; the driver gets 32-bit features, and words of texts that name a group only
    rows = one.mapInArrow(features, "doc_id long, toxic int, features binary, named binary").toArrow()
    model = _fitted(*_in_order(rows), **options)
    del rows
    pa.default_memory_pool().release_unused()  # else the driver keeps it to its end
    return model


def _in_order(rows: pa.Table) -> tuple[list[np.ndarray], list[list[bytes]], np.ndarray]:
    """Features and named words of each text, and the labels, by doc_id; the features are views of the table, not copies."""
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    sets = []
    for chunk in rows.column("features").chunks:
        _, places, data = chunk.buffers()
        at = np.frombuffer(places, np.int64 if pa.types.is_large_binary(chunk.type) else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1] // 4 if len(chunk) else [0]
        sets += np.split(np.frombuffer(data or b"", np.uint32, at[-1]), at[:-1])[1:]
    named = rows.column("named").take(pa.array(order)).drop_null().to_pylist()
    return [sets[i] for i in order.tolist()], [x.split() for x in named], rows.column("toxic").to_numpy()[order].astype(float)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for batch in (big.slice(i, STEP) for big in batches for i in range(0, big.num_rows, STEP)):
            s = [of(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The input's rows that score below the threshold, with all their columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for batch in (big.slice(i, STEP) for big in batches for i in range(0, big.num_rows, STEP)):
            yield batch.filter(pa.array([of(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
