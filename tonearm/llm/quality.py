"""Quality classifier: a linear support vector machine over n-gram indicators scaled by class log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .labels import held_out, sample
from .shingles import Hasher

FOLDS, HELD_FOLD, THRESHOLD = 4, 2, 0.7
#: Bound of the labelled sample that is learned from, and the number of hashed n-grams.
SAMPLE_ROWS, DIMENSIONS = 6_000, 1 << 20
SMOOTHING, COST, EPOCHS = 1.0, 1.0, 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Byte classes: 0 white space, 1 mark, 2 word (letters, digits, underscore, anything beyond ASCII).
_CLASS = np.ones(256, np.int8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = _CLASS[95] = _CLASS[128:] = 2
_CAPITAL = np.zeros(256, np.int32)
_CAPITAL[65:91] = 1
_DIGIT = np.zeros(256, np.int32)
_DIGIT[48:58] = 1


class Indicators:
    """Distinct hashed n-grams of a whole text: words and marks, pairs of them, pairs of shapes, and threefold repeats.

    A token is a run of word bytes or of marks.  Its shape is its case pattern,
    length class and kind; marks stand for themselves.
    """

    def __init__(self):
        self.hasher = Hasher()

    def __call__(self, text: str) -> np.ndarray:
        data = text.encode("utf-8", "replace")
        # Long texts are cut at spaces; a pair across a cut is not formed.
        found = [self._part(data[lo:hi]) for lo, hi in self.hasher.cuts(data)]
        return found[0] if len(found) == 1 else np.unique(np.concatenate([np.zeros(0, np.int32), *found]))

    def _part(self, data: bytes) -> np.ndarray:
        raw = np.frombuffer(data, np.uint8)
        kind = np.zeros(len(raw) + 2, np.int8)
        kind[1:-1] = _CLASS[raw]
        turn = np.flatnonzero(kind[1:] != kind[:-1])
        start, end = turn[:-1], turn[1:]
        keep = kind[start + 1] > 0
        start, end = start[keep], end[keep]
        if not len(start):
            return np.zeros(1, np.int32)
        word = self.hasher.runs(_LOWER[raw], start, end)
        count = lambda table: np.diff(np.concatenate(([0], np.cumsum(table[raw])))[np.stack((start, end))], axis=0)[0]
        capitals, digits, size = count(_CAPITAL), count(_DIGIT), end - start
        form = (capitals > 0) * 1 + (capitals == size) * 2 + (_CAPITAL[raw[start]] > 0) * 4 + (digits == size) * 8 + (size > 12) * 16
        form = np.where(kind[start + 1] == 1, word >> np.uint64(40), form.astype(np.uint64))
        mix = np.uint64(0x9E3779B97F4A7C15)
        grams = [word * mix, (word[:-1] * np.uint64(3) + word[1:]) * mix + np.uint64(1), ((form[:-1] << np.uint64(25)) + form[1:] + np.uint64(1 << 60)) * mix]
        again = word[1:] == word[:-1]
        if (again[1:] & again[:-1]).any():
            grams.append(np.array([7], np.uint64) * mix)
        grams = np.sort((np.concatenate(grams) >> np.uint64(44)).astype(np.int32))
        return grams[np.concatenate(([True], grams[1:] != grams[:-1]))]


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make = Indicators()
    for batch in batches:
        grams = pa.array([make(t) for t in batch.column(0).to_pylist()], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), grams], ["y", "part", "grams"])


@dataclass
class Model:
    #: Weight and squared scale by n-gram; bias; slope and offset of the calibration.
    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, grams: np.ndarray) -> float:
        norm = float(self.squares[grams].sum(dtype=np.float64)) ** 0.5
        return float(self.weights[grams].sum(dtype=np.float64)) / (norm or 1.0) + self.bias

    def probability(self, grams: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(grams) + self.offset, -30, 30))))


def train(grams: list[np.ndarray], y: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights x ratios, squared ratios, bias) by dual coordinate descent on the hinge loss.

    Indicators are scaled by log-count ratios and each text to unit length, so
    that long texts don't outweigh short ones; the bias is one more constant
    indicator.
    """
    counts = [np.full(DIMENSIONS, SMOOTHING), np.full(DIMENSIONS, SMOOTHING)]
    for g, label in zip(grams, y):
        counts[label][g] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    seen = (counts[0] + counts[1]) > 2 * SMOOTHING
    ratio = np.where(seen, ratio, 0.0)
    x = []
    for g in grams:
        v = ratio[g]
        norm = float(np.sqrt((v * v).sum()))
        x.append(v / (norm or 1.0))
    sign = np.where(np.asarray(y) == 1, 1.0, -1.0)
    # The rarer class weighs as much as the other.
    share = np.array([max(1, (sign < 0).sum()), max(1, (sign > 0).sum())]) / max(1, len(sign))
    top = cost * 0.5 / share[(sign > 0).astype(int)]
    w, bias, alpha = np.zeros(DIMENSIONS), 0.0, np.zeros(len(grams))
    q = np.array([float((v * v).sum()) + 1.0 for v in x])
    draw = np.random.default_rng(11)
    for _ in range(epochs):
        worst = 0.0
        for i in draw.permutation(len(grams)):
            slope = sign[i] * (float(w[grams[i]] @ x[i]) + bias) - 1.0
            new = min(max(alpha[i] - slope / q[i], 0.0), top[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[grams[i]] += step * x[i]
                bias += step
                worst = max(worst, abs(new - alpha[i]))
                alpha[i] = new
        if worst < 1e-3:
            break
    return (w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), bias


def calibrate(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (margin, label), by Newton steps on smoothed targets."""
    up, down = int((y == 1).sum()), int((y == 0).sum())
    goal = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, float(np.log((up + 1) / (down + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        d, h = p - goal, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(d * margins).sum() + 1e-3 * (a - 1), d.sum()])
        hess = np.array([[(h * margins * margins).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model | float:
    """Model learned from three quarters of the sample and calibrated on the last; without both labels, their share.

    The sample (at most ``rows`` labelled ids) is turned into n-grams on the
    executors; the driver gets its hashed n-grams only.
    """
    table = sample(documents, labels, "quality", FOLDS, HELD_FOLD, rows).mapInArrow(_featurize, "y int, part int, grams array<int>").toArrow()
    y, part = (np.array(table.column(c).to_pylist(), np.int64) for c in ("y", "part"))
    grams = [np.asarray(g.values, np.int32) for g in table.column("grams")]
    fitted, rest = np.flatnonzero(part > 0), np.flatnonzero(part == 0)
    if len(set(y[fitted])) < 2 or len(set(y[rest])) < 2:
        return float(y.mean()) if len(y) else 0.0
    order = fitted[np.lexsort(([xxhash.xxh64_intdigest(grams[i].tobytes()) for i in fitted],))]  # the same whatever order tasks end in
    model = Model(*train([grams[i] for i in order], y[order]), 1.0, 0.0)
    model.slope, model.offset = calibrate(np.array([model.margin(grams[i]) for i in rest]), y[rest])
    return model


def score(text: Column | str, model: Model | float, spark) -> Column:
    if not isinstance(model, Model):
        return F.lit(model)
    shared = spark.sparkContext.broadcast(model)  # two vectors of DIMENSIONS floats, 8 MB

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        make, known = Indicators(), shared.value
        for batch in texts:
            yield pd.Series([known.probability(make(t)) for t in batch], dtype="float64")

    return of(F.coalesce(text, F.lit("")))


def scan(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from 0.7).

    Only the text enters a score.  Null and empty texts are scored as a text
    without n-grams.  Repeated rows and null ids are kept (nothing is joined by
    id when scoring; a null id isn't held out), further columns are ignored, an
    empty table gives an empty result.
    """
    model = fit(documents, labels, rows)
    scored = documents.select("doc_id", held_out("doc_id", FOLDS, HELD_FOLD).alias("held_out"), score("text", model, documents.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
