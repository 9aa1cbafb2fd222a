"""Embedders of texts, and their comparison by how well a classifier learns from them.

An embedder has a name, its dimensions and encode(texts), which gives a row of numbers for each text; it works on Arrow batches inside tasks. Any model fits:
Plugged makes one from a function that loads it, once in each worker. Vectors are brought to unit length; a null or blank text has a vector of zeros.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.embedding import DIMENSIONS
from loomspark.operators import linear, tables
from loomspark.operators.sums import summed
from loomspark.plans.lineage import written

#: Texts encoded at once in a task.
ROWS = 128
MOST_TERMS, LEAST_TEXTS = 5000, 2
#: Terms that a task counts before it passes them on.
MOST_HELD = 100_000
_WORD, _PLAIN, _SPACE = re.compile(r"\b\w\w+\b"), re.compile("[^a-z0-9]+"), re.compile(r"\s+")


class Embedder(Protocol):
    name: str
    dimensions: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class _Cells(dict):
    """The first four hex digits of each word's MD5."""

    def __missing__(self, word: str) -> int:
        cell = self[word] = int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:4], 16)
        return cell


class HashedWords(NamedTuple):
    """How many words fall into each cell; as functions.embedding.hashed_vector."""

    dimensions: int = DIMENSIONS
    name: str = "hashed words"

    def encode(self, texts: list[str]) -> np.ndarray:
        cells, out = _Cells(), np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts):
            own = [cells[w] % self.dimensions for w in _PLAIN.split(text.lower()) if w]
            row += np.bincount(np.array(own, np.int64), minlength=self.dimensions)
        return out


class HashedGrams(NamedTuple):
    """Character n-grams of the text in lower case, words set apart by a blank; a hash gives the cell and the sign."""

    dimensions: int = 256
    sizes: tuple[int, ...] = (3, 4, 5)
    name: str = "hashed character n-grams"

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in enumerate(texts):
            codes = np.frombuffer(f" {_SPACE.sub(' ', text.lower()).strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            for size in self.sizes:
                if len(codes) >= size:
                    h = np.full(len(codes) - size + 1, size, np.uint64)
                    for j in range(size):
                        h = (h ^ codes[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
                        h ^= h >> np.uint64(29)
                    out[row] += np.bincount((h % np.uint64(self.dimensions)).astype(np.int64), np.where(h >> np.uint64(63), -1.0, 1.0), self.dimensions)
        return out


class Plugged:
    """A model of one's own: load() gives an object with encode(texts), called once in each worker."""

    def __init__(self, name: str, dimensions: int, load: Callable[[], Embedder]):
        self.name, self.dimensions, self.load, self._model = name, dimensions, load, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_model": None}

    def encode(self, texts: list[str]) -> np.ndarray:
        self._model = self._model or self.load()
        return np.asarray(self._model.encode(texts), np.float64)


def terms(text: str) -> list[str]:
    """Words of two letters or more in lower case, and pairs of neighbours."""
    own = _WORD.findall(text.lower())
    return own + [f"{a} {b}" for a, b in zip(own, own[1:])]


def term_counts(rows: DataFrame, key: str, order: list[str], text: str) -> DataFrame:
    """key, term, n: the terms of each key's texts in their order, as of one text made of them with blanks between; no such text is made. Rows are sorted over
    all tasks, wherever a key's rows begin and end; a task tells the first and last word that it has of a key, whose pairs across tasks are added."""
    parts = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.struct(*order).alias("__place"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    kind = parts.schema["__key"].dataType.simpleString()
    own = parts.repartitionByRange("__key", "__place", "__text").sortWithinPartitions("__key", "__place", "__text").select("__key", "__text", F.spark_partition_id().alias("__task"))
    names = ["__key", "term", "n", "task", "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, task, first, last, found = None, 0, None, None, Counter()

        def told(edges: bool) -> pa.RecordBatch:
            each = [*((key, t, n, None, None, None) for t, n in found.items()), *[(key, None, 0, task, first, last)] * (edges and first is not None)]
            types = [keys, pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in each], t) for i, t in enumerate(types)], names=names)

        keys = pa.null()
        for batch in batches:
            keys = batch.column(0).type
            for own, raw, task_of in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if own != key:
                    if key is not None:
                        yield told(True)
                    key, first, last, found = own, None, None, Counter()
                task = task_of
                words = _WORD.findall(raw.lower())
                if words:
                    found.update(words)
                    found.update(f"{a} {b}" for a, b in zip(words if last is None else [last, *words], words[last is None :]))
                    first, last = words[0] if first is None else first, words[-1]
                if len(found) >= MOST_HELD:
                    yield told(False)
                    found = Counter()
        if key is not None:
            yield told(True)

    each = written(own.mapInArrow(run, f"__key {kind}, term string, n long, task int, first string, last string"), "term-parts")
    ends = each.where("task is not null")  # at most a row for each task and key
    before = F.lag("last").over(Window.partitionBy("__key").orderBy("task"))
    across = ends.select("__key", F.concat_ws(" ", before, "first").alias("term"), F.lit(1).cast("long").alias("n"), before.isNotNull().alias("__met")).where("__met").drop("__met")
    every = each.where("term is not null").select("__key", "term", "n").unionByName(across)
    return every.groupBy("__key", "term").agg(F.sum("n").alias("n")).withColumnRenamed("__key", key)


class Vocabulary(NamedTuple):
    """The number of each term, and its weight ln((1 + n) / (1 + df)) + 1 for each fold."""

    terms: dict[str, int]
    idf: np.ndarray


def vocabulary(rows: DataFrame, text: str, folds: list[int] | None = None, most: int = MOST_TERMS, least: int = LEAST_TEXTS) -> Vocabulary:
    """The `most` terms with the largest counts that at least so many texts have; with folds (a column fold) for each of them, over the other rows.
    Counts are combined before they travel; at most `most` rows for each fold come to the driver."""
    wanted = folds or [-1]
    own = rows if folds else rows.withColumn("fold", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (big.slice(i, ROWS) for big in batches for i in range(0, big.num_rows, ROWS)):
            found: dict[tuple, list[int]] = {}
            for text, fold in zip(batch.column(0), batch.column(1).to_pylist()):
                for term, n in Counter(terms(text.as_py() or "")).items():
                    both = found.setdefault((term, fold), [0, 0])
                    both[0] += n
                    both[1] += 1
            names, counts = list(found), list(found.values())
            columns = [pa.array([t for t, _ in names], pa.string()), pa.array([f for _, f in names], pa.int32()), *(pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "fold", "n", "df"])

    return _leading(own, own.select(F.col(text).cast("string"), F.col("fold").cast("int")).mapInArrow(run, "term string, fold int, n long, df long"), wanted, most, least)


def vocabulary_of_counts(rows: DataFrame, counts: DataFrame, key: str, folds: list[int]) -> Vocabulary:
    """As vocabulary(), from term_counts() of the rows' keys (key, fold)."""
    each = counts.join(rows.select(key, F.col("fold").cast("int")), key).select("term", "fold", "n", F.lit(1).cast("long").alias("df"))
    return _leading(rows, each, folds, MOST_TERMS, LEAST_TEXTS)


def known_counts(counts: DataFrame, key: str, known: Vocabulary) -> DataFrame:
    """key and terms, as of counted_terms(): a key has at most as many as the vocabulary."""
    places = counts.sparkSession.createDataFrame(list(known.terms.items()), "term string, i int")
    found = counts.join(F.broadcast(places), "term").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", F.col("n").cast("int").alias("n")))).alias("__all"))
    return found.select(key, F.struct(F.transform("__all", lambda x: x["i"]).alias("i"), F.transform("__all", lambda x: x["n"]).alias("n")).alias("terms"))


def _leading(own: DataFrame, each: DataFrame, wanted: list[int], most: int, least: int) -> Vocabulary:
    """From counts each (term, fold, n, df) of the texts own (fold)."""
    outside = lambda f, x: F.sum(F.when(F.col("fold") != f, F.col(x)).otherwise(0))
    counted = written(each.groupBy("term").agg(*(outside(f, x).alias(f"{x}{i}") for i, f in enumerate(wanted) for x in ("n", "df"))), "terms")
    sizes = own.agg(*(F.count_if(F.col("fold") != f).alias(f"f{i}") for i, f in enumerate(wanted))).first()
    leading = [counted.where(F.col(f"df{i}") >= least).orderBy(F.desc(f"n{i}"), "term").limit(most).select("term", F.col(f"df{i}")).collect() for i in range(len(wanted))]
    places = {t: i for i, t in enumerate(sorted({t for found in leading for t, _ in found}))}
    idf = np.zeros((len(wanted), len(places)))
    for i, found in enumerate(leading):
        for term, df in found:
            idf[i, places[term]] = np.log((1 + sizes[i]) / (1 + df)) + 1
    return Vocabulary(places, idf)


def counted_terms(text: Column, known: Vocabulary) -> Column:
    """struct<i, n>: numbers and counts of a text's known terms."""
    places = known.terms

    @F.arrow_udf("struct<i: array<int>, n: array<int>>")
    def count(texts: pa.Array) -> pa.Array:
        ends, at, n = [0], [], []
        for t in texts:
            found: dict[int, int] = {}
            for term in terms(t.as_py() or ""):
                if (i := places.get(term)) is not None:
                    found[i] = found.get(i, 0) + 1
            at.extend(found)
            n.extend(found.values())
            ends.append(len(at))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (at, n)]
        return pa.StructArray.from_arrays(lists, ["i", "n"])

    return count(text)


class Lsa(NamedTuple):
    """Weighted terms projected on the leading right singular vectors."""

    places: dict[str, int]
    idf: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    name: str = "latent semantic analysis"

    @property
    def dimensions(self) -> int:
        return self.vectors.shape[1]

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in enumerate(texts):
            own = [i for i in map(self.places.get, terms(text)) if i is not None]
            if own:
                at, n = np.unique(own, return_counts=True)
                value = n * self.idf[at]
                out[row] = value / np.sqrt(value @ value) @ self.vectors[at]
        return out


def svd(rows: DataFrame, column: str, idf: np.ndarray, dimensions: int, more: int = 10, power: int = 4, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors (in columns) and values of the matrix with a row of weighted terms, of unit length, for each text.

    Randomised: a random start of a few columns more than wanted is multiplied by A'A `power` times, each one pass whose tasks sum terms times
    columns; between passes the driver makes the columns orthonormal. A last pass gives the small matrix whose eigenvectors turn them into singular vectors."""
    words, width = linear._Words(idf[None]), len(idf)
    columns = min(width, dimensions + more)
    if not columns:
        return np.zeros((width, 0)), np.zeros(0)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, columns)))[0]
    context = rows.sparkSession.sparkContext

    def passed(basis: np.ndarray, small: bool) -> np.ndarray:
        shared = context.broadcast(basis)

        def kernel(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros((columns if small else width, columns))
            for big in batches:
                for i in range(0, big.num_rows, linear.ROWS):
                    batch = big.slice(i, linear.ROWS)
                    x = words.fold(words.open(batch.column(0)), 0)
                    z = words.times(x, shared.value, batch.num_rows)
                    out += z.T @ z if small else words.back(x, z)
            return out

        total = summed(rows.select(column), kernel, (columns if small else width) * columns).reshape(-1, columns)
        shared.destroy()
        return total

    for _ in range(power):
        basis = np.linalg.qr(passed(basis, False))[0]
    values, turn = np.linalg.eigh(passed(basis, True))
    order = np.argsort(-values)[:dimensions]
    vectors = basis @ turn[:, order]
    vectors *= np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(order))] < 0, -1.0, 1.0)  # a sign is free
    return vectors, np.sqrt(np.maximum(values[order], 0))


def fit_lsa(texts: DataFrame, text: str, dimensions: int = 64, most: int = MOST_TERMS, least: int = LEAST_TEXTS) -> Lsa:
    known = vocabulary(texts, text, None, most, least)
    counted = written(texts.select(counted_terms(F.col(text), known).alias("terms")), "term-counts")
    vectors, values = svd(counted, "terms", known.idf[0], dimensions)
    return Lsa(known.terms, known.idf[0], vectors, values)


def embedded(text: Column, embedder: Embedder) -> Column:
    """array<double> of unit length."""

    @F.arrow_udf("array<double>")
    def encode(texts: pa.Array) -> pa.Array:
        flat = [np.zeros(0)]
        for i in range(0, len(texts), ROWS):
            own = np.asarray(embedder.encode([t or "" for t in texts.slice(i, ROWS).to_pylist()]), np.float64)
            length = np.sqrt((own * own).sum(1, keepdims=True))
            flat.append((own / np.where(length > 0, length, 1)).ravel())
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * embedder.dimensions), pa.array(np.concatenate(flat)))

    return encode(text)


def split(rows: DataFrame, label: str, key: str, n: int, *columns: Column) -> tuple[DataFrame, list]:
    """fold, y (number of the label in order) and columns of each row, and the labels."""
    labels = [r[0] for r in rows.where(F.col(label).isNotNull()).select(label).distinct().orderBy(label).limit(1001).collect()]
    if len(labels) > 1000:
        raise ValueError(f"{label} has over 1,000 values: no classes")
    y = F.array_position(F.array(*map(F.lit, labels)), F.col(label)).cast("int") - 1
    return tables.folds(rows.where(F.col(label).isNotNull()), label, key, n).select("fold", y.alias("y"), *columns), labels


def score_table(names: list[str], counts: np.ndarray) -> list[tuple]:
    """name, and mean and population deviation over folds of accuracy, macro and weighted F1; 4 places."""
    out = []
    for name, folds in zip(names, counts):
        own = np.array([linear.scores(c) for c in folds])
        out.append((name, *(round(float(f(own[:, k])), 4) for k in range(3) for f in (np.mean, np.std))))
    return out


SCORES = ", ".join(f"{s}_{e} double" for s in ("accuracy", "macro_f1", "weighted_f1") for e in ("mean", "std"))


def compare(rows: DataFrame, text: str, label: str, key: str, embedders: list[Embedder], n: int = 5) -> DataFrame:
    """embedding_model, scores of logistic regression over n folds, embedding_dim; the best macro F1 first. All embedders and folds are trained at once."""
    ready, labels = split(rows, label, key, n, *(embedded(F.col(text), e).alias(f"v{i}") for i, e in enumerate(embedders)))
    ready = written(ready, "embedded")
    fitted = linear.fit(ready, [linear.Problem(e.name, f"v{i}") for i, e in enumerate(embedders)], list(range(n)), max(2, len(labels)))
    found = score_table([e.name for e in embedders], linear.confusion(ready, fitted))
    made = [(*r, e.dimensions) for r, e in zip(found, embedders)]
    return rows.sparkSession.createDataFrame(made, f"embedding_model string, {SCORES}, embedding_dim int").orderBy(F.desc("macro_f1_mean"), "embedding_model")
