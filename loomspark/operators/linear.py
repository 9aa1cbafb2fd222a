"""Linear classifiers of all models and folds at once: a round is one pass over the rows, which sums the losses and gradients of every one of them.

A problem is a column of features with a loss. Each problem is solved once for each fold, on the rows of the other folds; L-BFGS runs on the driver for
all of them in step, with the parameters alone in its hands (they depend on terms and dimensions, never on rows). With the gradients of dense vectors of up to WIDEST
numbers a round sums the curvature of each fold, too: with one column of coefficients its steps are Newton's, with more L-BFGS starts from it. So there are a tenth of the
rounds, each of them a pass over the rows. What depends on the training rows is
found for each fold as well: the standardisation of dense vectors, the vocabulary and weights of words, the weights of classes.

Losses, over rows weighted by n / (classes * n of the class): `logistic`, the multinomial (with two classes binomial) loss with a free intercept; `hinge`,
the squared hinge loss of each class against the rest, whose intercept counts in the penalty. The penalty is half the squared length of the coefficients.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators.sums import summed

ROUNDS, TOLERANCE, MEMORY = 200, 1e-5, 12
#: Numbers of a dense vector up to which its curvature is summed, and the second derivative (as a share of the largest) from which a row counts in it.
WIDEST, LEAST_BEND = 512, 1e-7
#: Rows that a task works on at once.
ROWS = 512


class Problem(NamedTuple):
    """vector: an array<double> column (dense), or a struct<i: array<int>, n: array<int>> column of term numbers and counts, with idf for each fold (0: not in
    the fold's vocabulary)."""

    name: str
    vector: str
    loss: str = "logistic"
    strength: float = 1.0
    idf: np.ndarray | None = None


class _Dense(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray

    @property
    def width(self) -> int:
        return self.mean.shape[1]

    def open(self, column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def fold(self, x: np.ndarray, f: int) -> np.ndarray:
        return (x - self.mean[f]) / self.scale[f]

    def opened(self, w: np.ndarray, at: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients (folds at, features and the intercept, columns) as those of vectors that aren't standardised: features, folds by columns; and intercepts."""
        own = w[at, :-1] / self.scale[at, :, None]
        return own.transpose(1, 0, 2).reshape(self.width, -1), (w[at, -1] - np.einsum("fd,fdc->fc", self.mean[at], own)).ravel()

    def slopes(self, raw: np.ndarray, total: np.ndarray, at: list[int]) -> np.ndarray:
        """The gradient of the standardised vectors' coefficients, from that of the others (features, folds by columns) and the sums of slopes."""
        own = raw.reshape(self.width, len(at), -1).transpose(1, 0, 2)
        total = total.reshape(len(at), 1, -1)
        return np.concatenate([(own - self.mean[at, :, None] * total) / self.scale[at, :, None], total], 1)

    def inverse(self, products: np.ndarray, f: int, held: np.ndarray) -> np.ndarray:
        """Of the curvature of a fold's standardised vectors; products: those of the others, 1 behind them, by weight."""
        turn = np.diag(np.append(1 / self.scale[f], 1.0))
        turn[:-1, -1] = -self.mean[f] / self.scale[f]
        own = turn @ products @ turn.T + np.diag(held)
        own[-1, -1] = max(own[-1, -1], 1e-9)
        return np.linalg.inv(own)

    def times(self, x: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
        return x @ w

    def back(self, x: np.ndarray, r: np.ndarray) -> np.ndarray:
        return x.T @ r


class _Words(NamedTuple):
    idf: np.ndarray

    @property
    def width(self) -> int:
        return self.idf.shape[1]

    def open(self, column: pa.Array) -> tuple:
        terms = column.field(0)
        row = np.repeat(np.arange(len(column)), terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        return len(column), row, terms.flatten().to_numpy(zero_copy_only=False), column.field(1).flatten().to_numpy(zero_copy_only=False)

    def fold(self, x: tuple, f: int) -> tuple:
        n, row, term, count = x
        value = count * self.idf[f][term]
        length = np.sqrt(np.bincount(row, value * value, n))
        return row, term, value / np.where(length > 0, length, 1)[row]

    def times(self, x: tuple, w: np.ndarray, n: int) -> np.ndarray:
        row, term, value = x
        return np.stack([np.bincount(row, value * w[term, k], n) for k in range(w.shape[1])], 1)

    def back(self, x: tuple, r: np.ndarray) -> np.ndarray:
        row, term, value = x
        return np.stack([np.bincount(term, value * r[row, k], self.width) for k in range(r.shape[1])], 1)


class _Lbfgs:
    """Asks for values at `trial`; tell() gives them. Backtracks until the loss falls enough."""

    def __init__(self, x: np.ndarray):
        self.inverse: np.ndarray | None = None  # of the curvature, for each column of the parameters
        self.exact = False  # whether that is all of it
        self.x, self.trial, self.f, self.g, self.step, self.direction = x, x, None, None, 1.0, None
        self.past: list[tuple[np.ndarray, np.ndarray]] = []
        self.done, self.rounds, self.tries = False, 0, 0

    def tell(self, f: float, g: np.ndarray) -> None:
        if self.f is not None and not f <= self.f + 1e-4 * self.step * float(self.g @ self.direction):
            self.step, self.tries = self.step / 2, self.tries + 1
            if self.tries > 30:
                self.done = True
            self.trial = self.x + self.step * self.direction
            return
        if self.f is not None and not self.exact:
            s, y = self.trial - self.x, g - self.g
            if s @ y > 1e-12 * (y @ y):
                self.past = [*self.past, (s, y)][-MEMORY:]
        self.x, self.f, self.g = self.trial, f, g
        self.rounds += 1
        if np.abs(g).max(initial=0) <= TOLERANCE * max(1.0, abs(f)) or self.rounds > ROUNDS:
            self.done = True
            return
        self.direction = self._direction(g)
        self.step, self.tries = (1.0 if self.past or self.inverse is not None else 1.0 / max(1.0, float(np.sqrt(g @ g)))), 0
        self.trial = self.x + self.step * self.direction

    def _direction(self, g: np.ndarray) -> np.ndarray:
        q, used = g.copy(), []
        for s, y in reversed(self.past):
            a = (s @ q) / (s @ y)
            q -= a * y
            used.append((a, s, y))
        start = (lambda v: v) if self.inverse is None else lambda v: (self.inverse @ v.reshape(len(self.inverse), -1)).ravel()
        q = start(q)
        if self.past:
            s, y = self.past[-1]
            q = q * ((s @ y) / (y @ start(y))) if self.inverse is None else q
        for a, s, y in reversed(used):
            q += s * (a - (y @ q) / (s @ y))
        return -q


def _bend(loss: str, slope: np.ndarray) -> np.ndarray:
    """The loss's second derivative of each row, on average over columns."""
    if loss == "hinge":
        return 2.0 * (slope != 0).mean(1)
    p = np.abs(slope)  # of one column: how far from the truth; of several: each class's share, but for the true one's, which is short of 1 by it
    return (p * (1 - p)).mean(1)


def _logistic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each row and its slope."""
    if z.shape[1] == 1:
        own = np.where(y[:, None] == 1, z, -z)
        return np.logaddexp(0, -own)[:, 0], np.where(y[:, None] == 1, -1, 1) * np.exp(-np.logaddexp(0, own))
    top = z - z.max(1, keepdims=True)
    total = np.log(np.exp(top).sum(1))
    slope = np.exp(top - total[:, None])
    at = np.arange(len(y))
    loss = total - top[at, y]
    slope[at, y] -= 1
    return loss, slope


def _hinge(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    side = np.where((y[:, None] == 1) if z.shape[1] == 1 else (y[:, None] == np.arange(z.shape[1])), 1.0, -1.0)
    short = np.maximum(0, 1 - side * z)
    return (short * short).sum(1), -2 * side * short


_LOSSES = {"logistic": _logistic, "hinge": _hinge}


class Fitted(NamedTuple):
    """coefficients by problem: folds, features and the intercept, columns (one where there are two classes)."""

    problems: list[Problem]
    features: list
    folds: list[int]
    classes: int
    coefficients: list[np.ndarray]


def _opened(problem: Problem, feature, batch: pa.RecordBatch):
    return feature.open(batch.column(problem.vector))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for big in batches:
        for i in range(0, big.num_rows, ROWS):
            batch = big.slice(i, ROWS)
            yield batch, batch.column("fold").to_numpy(), batch.column("y").to_numpy()


def _moments(rows: DataFrame, problems: list[Problem], folds: list[int]) -> dict[str, _Dense]:
    """Mean and population deviation of each dense column over the rows outside each fold."""
    dense = [p.vector for p in problems if p.idf is None]
    if not dense:
        return {}
    first = rows.select(*(F.size(c).alias(c) for c in dense)).first()
    widths = [first[c] if first else 0 for c in dense]
    size = len(folds) * (1 + 2 * sum(widths))

    def kernel(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((len(folds), 1 + 2 * sum(widths)))
        for batch, fold, _ in _batches(batches):
            x = np.concatenate([batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in dense], 1)
            wide = np.concatenate([np.ones((len(x), 1)), x, x * x], 1)
            for at, f in enumerate(folds):
                total[at] += wide[fold != f].sum(0)
        return total

    total = summed(rows.select("fold", "y", *dense), kernel, size).reshape(len(folds), -1)
    n = np.maximum(total[:, :1], 1)
    mean, square = np.split(total[:, 1:] / n, 2, axis=1)
    scale = np.sqrt(np.maximum(square - mean * mean, 0))
    scale[scale <= 1e-12 * np.maximum(1, np.abs(mean))] = 1
    cuts = np.cumsum(widths)[:-1]
    return {c: _Dense(m, s) for c, m, s in zip(dense, np.split(mean, cuts, axis=1), np.split(scale, cuts, axis=1))}


def fit(rows: DataFrame, problems: list[Problem], folds: list[int], classes: int) -> Fitted:
    """rows: fold, y (from 0) and the problems' columns; read once a round, so best cached or read from storage."""
    counts = np.zeros((len(folds), classes))
    for fold, y, n in rows.groupBy("fold", "y").count().collect():
        counts[[f != fold for f in folds], y] += n
    weight = counts.sum(1, keepdims=True) / (np.maximum((counts > 0).sum(1, keepdims=True), 1) * np.maximum(counts, 1))
    dense = _moments(rows, problems, folds)
    features = [dense[p.vector] if p.idf is None else _Words(p.idf) for p in problems]
    columns = 1 if classes == 2 else classes
    shapes = [(len(folds), f.width + 1, columns) for f in features]
    ends = np.cumsum([int(np.prod(s)) for s in shapes])
    size = len(folds) * len(problems)
    bent = [f.width + 1 if p.idf is None and f.width <= WIDEST else 0 for p, f in zip(problems, features)]
    from_bent = size + int(ends[-1])
    bent_ends = from_bent + np.cumsum([len(folds) * w * w for w in bent])
    solvers = [[_Lbfgs(np.zeros(s[1] * s[2])) for _ in folds] for s in shapes]
    needed = rows.select("fold", "y", *dict.fromkeys(p.vector for p in problems))
    context = rows.sparkSession.sparkContext
    while not all(s.done for own in solvers for s in own):
        at = np.concatenate([s.trial for own in solvers for s in own])
        going = [[not s.done for s in own] for own in solvers]
        shared = context.broadcast(at)

        def kernel(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros(bent_ends[-1])
            loss = out[:size].reshape(len(problems), len(folds))
            parts = list(zip(np.split(shared.value, ends[:-1]), np.split(out[size:from_bent], ends[:-1])))
            products = [part.reshape(-1, w, w) if w else part for w, part in zip(bent, np.split(out[from_bent:], bent_ends[:-1] - from_bent))]
            for batch, fold, y in _batches(batches):
                for p, problem in enumerate(problems):
                    w, g = (x.reshape(shapes[p]) for x in parts[p])
                    if problem.idf is None:  # all folds at once
                        at = [k for k in range(len(folds)) if going[p][k]]
                        if not at:
                            continue
                        x, (opened, free) = _opened(problem, features[p], batch), features[p].opened(w, at)
                        z = (x @ opened + free).reshape(len(y), len(at), -1)
                        whole = np.concatenate([x, np.ones((len(y), 1))], 1) if bent[p] else None
                        for j, k in enumerate(at):
                            own = (fold != folds[k]) * weight[k][y]
                            each, slope = _LOSSES[problem.loss](z[:, j], y)
                            loss[p, k] += each @ own
                            if bent[p]:
                                bend = _bend(problem.loss, slope) * own
                                some = bend > LEAST_BEND * own.max()
                                few = whole[some]
                                products[p][k] += (few * bend[some, None]).T @ few
                            z[:, j] = slope * own[:, None]
                        slopes = z.reshape(len(y), -1)
                        g[at] += features[p].slopes(x.T @ slopes, slopes.sum(0), at)
                        continue
                    x = None
                    for k, f in enumerate(folds):
                        own = (fold != f) * weight[k][y]
                        if not going[p][k] or not own.any():
                            continue
                        x = _opened(problem, features[p], batch) if x is None else x
                        xf = features[p].fold(x, k)
                        z = features[p].times(xf, w[k, :-1], len(y)) + w[k, -1]
                        each, slope = _LOSSES[problem.loss](z, y)
                        slope *= own[:, None]
                        loss[p, k] += each @ own
                        g[k, :-1] += features[p].back(xf, slope)
                        g[k, -1] += slope.sum(0)
            return out

        total = summed(needed, kernel, int(bent_ends[-1]))
        shared.destroy()
        for p, problem in enumerate(problems):
            g = np.split(total[size:from_bent], ends[:-1])[p].reshape(len(folds), -1)
            products = problem.strength * total[bent_ends[p] - len(folds) * bent[p] ** 2 : bent_ends[p]].reshape(len(folds), bent[p], bent[p])
            for k, solver in enumerate(solvers[p]):
                if not solver.done:
                    held = np.ones(shapes[p][1:])
                    held[-1] = problem.loss == "hinge"
                    own = solver.trial * held.ravel()
                    if bent[p]:
                        solver.inverse, solver.exact = features[p].inverse(products[k], k, held[:, 0]), columns == 1
                    solver.tell(problem.strength * total[p * len(folds) + k] + own @ own / 2, problem.strength * g[k] + own)
    return Fitted(problems, features, folds, classes, [np.stack([s.x for s in own]).reshape(shape) for own, shape in zip(solvers, shapes)])


def predicted(fitted: Fitted, batch: pa.RecordBatch, p: int, fold: np.ndarray) -> np.ndarray:
    """Class of each row by the model of the row's own fold."""
    x, out = _opened(fitted.problems[p], fitted.features[p], batch), np.zeros(batch.num_rows, np.int64)
    for k, f in enumerate(fitted.folds):
        w = fitted.coefficients[p][k]
        z = fitted.features[p].times(fitted.features[p].fold(x, k), w[:-1], len(out)) + w[-1]
        mine = fold == f
        out[mine] = (z[mine, 0] > 0) if fitted.classes == 2 else z[mine].argmax(1)
    return out


def confusion(rows: DataFrame, fitted: Fitted) -> np.ndarray:
    """Counts by problem, fold, true and predicted class, over the rows of each fold; one pass."""
    shape = (len(fitted.problems), len(fitted.folds), fitted.classes, fitted.classes)

    def kernel(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(shape)
        for batch, fold, y in _batches(batches):
            for p in range(shape[0]):
                own = predicted(fitted, batch, p, fold)
                for k, f in enumerate(fitted.folds):
                    np.add.at(out[p, k], (y[fold == f], own[fold == f]), 1)
        return out

    return summed(rows.select("fold", "y", *dict.fromkeys(p.vector for p in fitted.problems)), kernel, math.prod(shape)).reshape(shape)


def scores(counts: np.ndarray) -> tuple[float, float, float]:
    """Accuracy, macro and weighted F1 of one confusion matrix, over classes that occur in truth or predictions."""
    true, said, hit = counts.sum(1), counts.sum(0), np.diag(counts)
    seen = true + said > 0
    if not seen.any():
        return 0.0, 0.0, 0.0
    f1 = 2 * hit[seen] / (true + said)[seen]
    return float(hit.sum() / max(true.sum(), 1)), float(f1.mean()), float((f1 * true[seen]).sum() / max(true.sum(), 1))
