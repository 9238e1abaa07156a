"""Logistic models fitted by sums over partitions: a fixed number of gradient steps, or Newton steps, for many folds at once.

Rows are stored once as blocks of numbers, scaled by the moments of the whole table. A scan sends points (weights of folds) to the
tasks; each adds up its blocks' gradients at all points, and second derivatives at some; Spark adds the tasks' sums, and a row of
features + 1 numbers a point reaches the driver. So scans do not depend on the number of folds, and nothing but weights and
moments is ever held in one place.

A descent of 400 steps need not be 400 scans. Its steps are equations w[t+1] = w[t] - rate * g(w[t]), solved for all t together:
one scan takes the gradients along the whole path guessed so far, and the path is stepped anew with those gradients, corrected by
the second derivatives for where it has moved. This is Newton's method on the path. It ends when no step of the path differs from the
plain step any more, so the result is the plain descent's to rounding, after a handful of scans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import written

CLIP = 30.0  # logits beyond are cut, as in scoring


@dataclass(frozen=True)
class Moments:
    """Rows, means and sums of squared deviations of a segment's features, and its least and greatest label."""

    n: int
    mean: np.ndarray
    spread: np.ndarray
    low: float
    high: float

    def joined(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return other if not self.n else self
        n, gap = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n), self.spread + other.spread + gap**2 * (self.n * other.n / n),
                       min(self.low, other.low), max(self.high, other.high))

    def scale(self) -> np.ndarray:
        """Population deviations; 1 for a constant feature."""
        deviation = np.sqrt(self.spread / self.n)
        return np.where(deviation == 0, 1.0, deviation)


def segment_moments(data: DataFrame, features: Sequence[str], label: str, segment: str) -> dict[int, Moments]:
    """Moments of every segment: one row a segment comes to the driver."""
    rows = data.groupBy(segment).agg(
        F.count(F.lit(1)).alias("n"), F.min(label).alias("low"), F.max(label).alias("high"),
        F.array(*[F.avg(c) for c in features]).alias("mean"), F.array(*[F.var_pop(c) for c in features]).alias("variance")).collect()
    return {r[segment]: Moments(r["n"], np.array(r["mean"], float), np.array(r["variance"], float) * r["n"], float(r["low"]), float(r["high"])) for r in rows}


def _packed(features: Sequence[str], label: str, segment: str, mean: np.ndarray, scale: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = (np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in features], axis=1) - mean) / scale
            y = batch.column(label).to_numpy(zero_copy_only=False)
            at = batch.column(segment).to_numpy(zero_copy_only=False)
            found = np.unique(at)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([x[at == s].tobytes() for s in found], pa.binary()),
                                              pa.array([y[at == s].tobytes() for s in found], pa.binary())], ["segment", "x", "y"])

    return pack


@dataclass(frozen=True)
class _Folds:
    """What a step needs to know of the folds: the segments below `needs` are fold k's; its rows, and its scaling against the blocks'."""

    needs: np.ndarray
    count: np.ndarray
    shift: np.ndarray
    ratio: np.ndarray
    penalty: np.ndarray

    def on_blocks(self, weights: np.ndarray) -> np.ndarray:
        """Weights (intercept first) for rows as they are stored."""
        slopes = weights[:, 1:] / self.ratio
        return np.concatenate((weights[:, :1] - (slopes * self.shift).sum(axis=1, keepdims=True), slopes), axis=1)

    def gradient(self, slope: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Gradient of the mean loss with its penalty, from sums over stored rows."""
        scaled = (slope[:, 1:] - self.shift * slope[:, :1]) / self.ratio
        return np.concatenate((slope[:, :1], scaled), axis=1) / self.count + self.penalty * weights

    def curvature(self, curve: np.ndarray) -> np.ndarray:
        change = np.zeros_like(curve)  # (1, z) = (1, x) change
        change[:, 0, 0] = 1.0
        for j in range(self.ratio.shape[1]):
            change[:, j + 1, j + 1] = 1.0 / self.ratio[:, j]
            change[:, 0, j + 1] = -self.shift[:, j] / self.ratio[:, j]
        return np.einsum("kai,kab,kbj->kij", change, curve, change) / self.count[:, :, None] + np.diag(self.penalty)


def _sums(points: np.ndarray, needs: np.ndarray, curved: np.ndarray, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task the sums of (p - y) (1, x) at every point, then those of p (1 - p) (1, x)(1, x)' at the `curved` ones, row by row."""
    width = points.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slope, curve = np.zeros(points.shape), np.zeros((len(curved), width, width))
        for batch in batches:
            for segment, x, y in zip(*(batch.column(i) for i in range(3))):
                of = np.flatnonzero(needs > segment.as_py())
                bent = [(k, int(np.searchsorted(of, i))) for k, i in enumerate(curved) if needs[i] > segment.as_py()]
                y = np.frombuffer(y.as_py(), float)
                design = np.concatenate((np.ones((len(y), 1)), np.frombuffer(x.as_py(), float).reshape(len(y), width - 1)), axis=1)
                for a in range(0, len(y), rows):
                    some = design[a : a + rows]
                    p = 1.0 / (1.0 + np.exp(-np.clip(some @ points[of].T, -CLIP, CLIP)))
                    slope[of] += (p - y[a : a + rows, None]).T @ some
                    for k, i in bent:
                        curve[k] += some.T @ (some * (p[:, i] * (1 - p[:, i]))[:, None])
        flat = np.concatenate((slope, curve.reshape(-1, width)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), *[pa.array(c) for c in flat.T.copy()]], ["key", *[f"v{i}" for i in range(width)]])

    return add


def _totals(blocks: DataFrame, points: np.ndarray, needs: np.ndarray, curved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all rows: point k reads the segments below needs[k]. One scan."""
    width = points.shape[1]
    names = [f"v{i}" for i in range(width)]
    parts = blocks.mapInArrow(_sums(points, needs, curved, 1024), "key long, " + ", ".join(f"{c} double" for c in names))
    total = np.zeros((len(points) + len(curved) * width, width))
    for row in parts.groupBy("key").agg(*[F.sum(c) for c in names]).collect():
        total[row[0]] = row[1:]
    return total[: len(points)], total[len(points) :].reshape(-1, width, width)


@dataclass(frozen=True)
class Fit:
    """Weights on the standardized features of a fold's training rows (intercept first), and their moments."""

    moments: Moments
    weights: np.ndarray


def fit_folds(data: DataFrame, features: Sequence[str], label: str, segment: str, folds: Sequence[int], solver: str = "descent",
              learning_rate: float = 0.05, steps: int | None = None, l2: float = 0.01, tolerance: float = 1e-10, both_labels: bool = True) -> dict[int, Fit]:
    """A model for every fold, trained on the segments below it; folds without rows there get none, nor those without both labels
    unless `both_labels` is off.

    `descent` gives the weights after exactly `steps` (400) steps from zero. `newton` makes at most `steps` (25), until no gradient
    exceeds `tolerance`; a step that goes too far is halved. Features and labels must not be null.
    """
    if solver not in ("descent", "newton"):
        raise ValueError("solver must be descent or newton")
    each = segment_moments(data, features, label, segment)
    moments: dict[int, Moments] = {}
    for fold in folds:
        known = Moments(0, np.zeros(0), np.zeros(0), 0.0, 0.0)
        for s in sorted(s for s in each if s < fold):
            known = known.joined(each[s])
        if known.n and not (both_labels and known.low == known.high):
            moments[fold] = known
    if not moments:
        return {}
    widest = moments[max(moments)]
    mean, scale = widest.mean, widest.scale()
    columns = data.where(F.col(segment) < max(moments)).select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias(label), segment)
    blocks = written(columns.mapInArrow(_packed(features, label, segment, mean, scale), "segment int, x binary, y binary"))
    penalty = np.full(len(features) + 1, l2)
    penalty[0] = 0.0
    of = _Folds(np.array(list(moments)), np.array([m.n for m in moments.values()], float)[:, None],
                np.array([(m.mean - mean) / scale for m in moments.values()]), np.array([m.scale() / scale for m in moments.values()]), penalty)
    solve = _newton if solver == "newton" else _descent
    weights = solve(blocks, of, (400 if solver == "descent" else 25) if steps is None else steps, learning_rate, tolerance)
    return {fold: Fit(m, w) for (fold, m), w in zip(moments.items(), weights)}


def _along(blocks: DataFrame, of: _Folds, path: np.ndarray, knots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients at all points path[t, fold], and second derivatives at the knots of t: one scan."""
    steps, folds, width = path.shape
    points = np.concatenate([of.on_blocks(w) for w in path])
    curved = (knots[:, None] * folds + np.arange(folds)).ravel()
    slope, curve = _totals(blocks, points, np.tile(of.needs, steps), curved)
    slope, curve = slope.reshape(path.shape), curve.reshape(len(knots), folds, width, width)
    return np.stack([of.gradient(s, w) for s, w in zip(slope, path)]), np.stack([of.curvature(c) for c in curve])


def _descent(blocks: DataFrame, of: _Folds, steps: int, rate: float, _: float, exact: float = 4e-15, scans: int = 60) -> np.ndarray:
    start = np.zeros((1, len(of.needs), len(of.penalty)))
    if not steps:
        return start[0]
    gradient, curve = _along(blocks, of, start, np.zeros(1, int))
    path, gradient = np.repeat(start, steps, axis=0), np.repeat(gradient, steps, axis=0)
    knots, curve = np.array([0, steps]), np.repeat(curve, 2, axis=0)
    for _ in range(scans):
        fresh = [start[0]]
        for t in range(steps):
            k = min(int(np.searchsorted(knots, t, "right")), len(knots) - 1)
            part = (t - knots[k - 1]) / (knots[k] - knots[k - 1]) if k else 0.0
            bend = curve[k - 1] * (1 - part) + curve[k] * part if k else curve[0]
            fresh.append(fresh[t] - rate * (gradient[t] + np.einsum("kij,kj->ki", bend, fresh[t] - path[t])))
        path, end = np.stack(fresh[:-1]), fresh[-1]
        knots = np.unique(np.linspace(0, steps - 1, 17).round().astype(int))
        gradient, curve = _along(blocks, of, path, knots)
        plain = path - rate * gradient  # where the plain steps lead from every point of the path
        if np.abs(plain - np.concatenate((path[1:], end[None]))).max() <= exact * max(1.0, np.abs(path).max()):
            return plain[-1]
    raise ArithmeticError("the path of the descent does not settle; use a smaller learning rate")


def _newton(blocks: DataFrame, of: _Folds, steps: int, _: float, tolerance: float) -> np.ndarray:
    def derivatives(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gradient, curve = _along(blocks, of, w[None], np.zeros(1, int))
        return gradient[0], curve[0]

    weights = np.zeros((len(of.needs), len(of.penalty)))
    gradient, curve = derivatives(weights)
    for _ in range(steps):
        if np.abs(gradient).max() <= tolerance:
            break
        move = np.stack([np.linalg.lstsq(c, g, rcond=None)[0] for c, g in zip(curve, gradient)])
        part = np.ones((len(weights), 1))
        while True:
            tried = weights - part * move
            after, bent = derivatives(tried)
            # On a convex loss a step is short enough while the slope along it has not turned back by more than half.
            late = (-(after * move).sum(axis=1) > 0.5 * (gradient * move).sum(axis=1)) & (part[:, 0] > 1e-4)
            if not late.any():
                break
            part[late] /= 2
        weights, gradient, curve = tried, after, bent
    return weights
