"""Quality classifier: random Fourier features of document statistics, ridge regression from summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, slices, span_hashes, stored, utf8, words

STATISTICS = (
    "bytes", "words", "lines", "word_length", "word_length_spread", "upper", "digits", "symbols", "marks", "sentence_ends", "other_bytes",
    "distinct_words", "top_word", "repeated_next", "symbol_ends", "capital_words", "distinct_lines", "line_words", "short_words", "long_words",
)
_CLASS = np.zeros((6, 256), bool)
_CLASS[0, 65:91] = True
_CLASS[1, 48:58] = True
_CLASS[2, list(b"#$%&*@^~|<>{}[]=_+\\")] = True
_CLASS[3, list(b"!?")] = True
_CLASS[4, list(b".")] = True
_CLASS[5, 128:] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return np.diff(total[offsets]).astype(float)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text; all zero for a text without words."""
    starts, ends, first = words(data, offsets)
    n = np.diff(first)
    length = (ends - starts).astype(float)
    hashes = span_hashes(data, starts, ends)
    size, many = np.maximum(np.diff(offsets), 1).astype(float), np.maximum(n, 1).astype(float)
    own = np.repeat(np.arange(len(n)), n)
    again = np.concatenate((hashes[1:] == hashes[:-1], [False])) if len(hashes) else np.zeros(0, bool)
    if len(again):
        again[:-1] &= own[1:] == own[:-1]
    mean = _sums(length, first) / many
    spread = np.sqrt(np.maximum(_sums(length**2, first) / many - mean**2, 0))
    newline = data == 10
    lines = _sums(newline, offsets) + 1
    distinct, top, lines_kept = np.zeros(len(n)), np.zeros(len(n)), np.ones(len(n))
    for d in np.flatnonzero(n):
        counts = np.unique(hashes[first[d] : first[d + 1]], return_counts=True)[1]
        distinct[d], top[d] = len(counts), counts.max()
    breaks = np.flatnonzero(newline)
    line_at = np.searchsorted(breaks, offsets)
    for d in np.flatnonzero(lines > 1):
        cut = breaks[line_at[d] : line_at[d + 1]]
        a, b = np.concatenate(([offsets[d]], cut + 1)), np.concatenate((cut, [offsets[d + 1]]))
        lines_kept[d] = len(np.unique(span_hashes(data, a, b))) / len(a)
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    head = data[starts] if len(starts) else np.zeros(0, np.uint8)
    share = [_sums(_CLASS[c][data], offsets) / size for c in range(6)]
    out = np.stack([
        np.log1p(size), np.log1p(n), np.log1p(lines), np.log1p(mean), np.log1p(spread), *share, distinct / many, top / many,
        _sums(again, first) / many, _sums((_CLASS[2] | _CLASS[3])[last], first) / many, _sums(_CLASS[0][head], first) / many, lines_kept,
        np.log1p(n / lines), _sums(length <= 3, first) / many, _sums(length >= 12, first) / many], axis=1)
    out[n == 0] = 0
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        values = statistics(*utf8(batch.column("text")))
        lists = pa.ListArray.from_arrays(np.arange(0, values.size + 1, len(STATISTICS), dtype=np.int32), values.ravel())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


@dataclass
class FourierRidge:
    """A fitted scorer: standardization, random frequencies and phases, ridge weights, and the calibration's steps."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        wave = np.cos(z @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([wave, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.steps), 0, 1)


def isotonic(at: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in ascending order: the centres of the pooled bins and their means."""
    blocks: list[list[float]] = []
    for x, y, w in zip(at, label, weight):
        blocks.append([x * w, y * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _normal_equations(model: FourierRidge) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(model.phases) + 2
        total = np.zeros((width, width))
        for batch in batches:
            z = np.hstack([model.features(_matrix(batch.column("x"))), batch.column("y").to_numpy(zero_copy_only=False)[:, None]])
            total += z.T @ z
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    return sums


def fit_quality(described: DataFrame, waves: int = 192, bandwidth: float = 4.0, ridge: float = 1e-3, bins: int = 1000, seed: int = 7) -> FourierRidge | None:
    """Fit on rows (doc_id, x, y) with y 0 or 1; None without rows.

    The frequencies are normal with deviation 1 / bandwidth, so the cosines approximate a Gaussian kernel of that width over
    standardized statistics. Every partition sums its normal equations and Spark adds them up entry by entry; the driver
    gets (waves + 2)^2 / 2 numbers. A quarter of the rows, by hash of the id, is left out of the regression; their scores,
    summed in `bins` bins, fit the calibration.
    """
    width = len(STATISTICS)
    element = [F.col("x")[k] for k in range(width)]
    row = described.agg(F.count(F.lit(1)), *[F.avg(e) for e in element], *[F.stddev_pop(e) for e in element]).first()
    if not row[0]:
        return None
    draw = np.random.default_rng(seed)
    scale = np.array(row[1 + width :], float)
    model = FourierRidge(np.array(row[1 : 1 + width], float), np.where(scale > 1e-9, scale, 1.0), draw.normal(size=(width, waves)) / bandwidth,
                         draw.uniform(0, 2 * np.pi, waves), np.zeros(waves + 1), (np.array([0.0]), np.array([0.5])))
    calibrating = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    described = described.withColumn("calibrating", F.coalesce(calibrating, F.lit(False)))
    entries = described.where("not calibrating").select("x", "y").mapInArrow(_normal_equations(model), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((waves + 2, waves + 2))
    for i, j, v in entries:
        total[i, j] = total[j, i] = v
    count = max(total[waves, waves], 1.0)
    penalty = ridge * count * np.eye(waves + 1)
    penalty[waves, waves] = 1e-9 * count
    model.weights = np.linalg.solve(total[: waves + 1, : waves + 1] + penalty, total[: waves + 1, waves + 1])

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.clip(model.raw(_matrix(batch.column("x"))), -1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.round((raw + 1) / 3 * bins).astype(np.int32)), batch.column("y")], ["bin", "y"])

    binned = described.where("calibrating").select("x", "y").mapInArrow(bucket, "bin int, y double").groupBy("bin").agg(F.avg("y"), F.count(F.lit(1))).orderBy("bin").collect()
    if binned:
        at, label, weight = (np.array(c, float) for c in zip(*binned))
        model.steps = isotonic(at / bins * 3 - 1, label, weight)
    else:
        model.steps = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def _fitted(texts: DataFrame, labels: DataFrame, id_col: str, label: str, **fit: float) -> tuple[DataFrame, FourierRidge | None]:
    """Statistics of all texts (doc_id, x, held_out), stored, and the model learned from the labelled ones not held out."""
    described = stored(texts.mapInArrow(_describe, "doc_id long, x array<double>").withColumn("held_out", crc_mod("doc_id", 3) == 1))
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("y in (0, 1)")
    return described, fit_quality(stored(described.where("not held_out").join(marked, "doc_id").select("doc_id", "x", "y")), **fit)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", **fit: float) -> DataFrame:
    """(doc_id, held_out, score, predicted): the probability that `label` is 1, from the text alone.

    Labels of documents whose crc32(doc_id as text) mod 3 is 1 are held out and never read. Statistics are taken from whole
    texts; texts without words (null, empty, blank) have all statistics 0 and the score that the model gives there. Label
    rows other than 0 or 1 and null ids are ignored; a document labelled twice counts twice; without any usable label all
    scores are 0.5. A null doc_id is scored, is not held out and never learned from. Rows that repeat an id are scored each.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    described, model = _fitted(texts, labels, id_col, label, **fit)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = model.score(_matrix(batch.column("x"))) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(values)], ["doc_id", "held_out", "score"])

    scored = described.select("doc_id", "held_out", "x").mapInArrow(score, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def quality_kept(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text: str = "text", label: str = "quality", **fit: float) -> DataFrame:
    """The rows of `docs`, with all their columns, whose score is `threshold` or more; scores as in `quality_scores`.

    The fitted model is applied where the rows are read, so texts are not shuffled.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    _, model = _fitted(texts, labels, id_col, label, **fit)
    if model is None:
        return docs

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            yield batch.filter(pa.array(model.score(statistics(*utf8(batch.column(text)))) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
