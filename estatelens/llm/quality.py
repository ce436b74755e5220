"""Quality classifier: naive Bayes support vectors.

A text has indicators of word n-grams and of n-grams of token shapes, hashed to ``WIDTH``
places. Each is scaled by the log-count ratio of its place between the labelled classes; a
linear hinge-loss model over the scaled indicators is fitted by dual coordinate descent, in one
task, on a bounded sample of labelled rows. Its weights are drawn towards their mean size, as
is usual with this model, and margins become probabilities by a logistic curve that is fitted
on labelled rows that the descent left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .labels import MOST_ROWS, training_rows

WIDTH = 1 << 17
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
SMOOTHING = 1.0
#: Cost of a text's hinge loss against half the squared weights, before classes are balanced.
COST = 1.0
#: Rounds of the descent, at most, and the share of the primal value by which it may still be off.
EPOCHS, GAP = 60, 0.01
#: Bytes of text that the one task which fits may hold, about; documents with the smallest hashes are taken.
MOST_BYTES = 64 << 20
#: Share of the weights kept as fitted; the rest is their mean size in their direction.
INTERPOLATION = 0.5
#: Every so many training rows one is kept for the logistic curve.
HELD_FOR_CURVE = 5
REMEMBERED = 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_known: dict[str, int] = {}


def _shape(token: str, before: str) -> int:
    if token == before:
        return 1
    if not token[0].isalpha():
        return 2 if token[0].isdigit() else 10 + ord(token[0]) % 50
    if token.isupper():
        return 3 if len(token) > 1 else 4
    return 5 if token[0].isupper() else 6


def indicators(text: str | None) -> np.ndarray:
    """Places of the n-grams that a text has, each once, ascending."""
    tokens = TOKEN.findall(text or "")
    if not tokens:
        return np.empty(0, np.int64)
    if len(_known) > REMEMBERED:
        _known.clear()
    for t in set(tokens).difference(_known):
        _known[t] = xxh3_64_intdigest(t.lower().encode("utf-8", "surrogatepass"))
    words = np.fromiter(map(_known.__getitem__, tokens), np.uint64, len(tokens))
    shapes = np.fromiter(map(_shape, tokens, ["", *tokens[:-1]]), np.uint64, len(tokens))
    with np.errstate(over="ignore"):
        pair = words[:-1] * _MIX + words[1:]
        two = (shapes[:-1] + np.uint64(101)) * _MIX + shapes[1:]
        three = (two[:-1] ^ np.uint64(77)) * _MIX + shapes[2:]
        grams = np.concatenate([words, pair, np.unique(two) * _MIX, np.unique(three) * _MIX, np.unique(shapes + np.uint64(1000)) * _MIX])
        places = (grams ^ (grams >> np.uint64(29))) * _MIX >> np.uint64(64 - 17)
    return np.unique(places).astype(np.int64)


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    counts = [np.full(WIDTH, SMOOTHING), np.full(WIDTH, SMOOTHING)]
    for own, y in zip(rows, labels, strict=True):
        counts[int(y)][own] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, epochs: int = EPOCHS, cost: float = COST, gap: float = GAP) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model over unit-length scaled indicators.

    The bias is one more feature of every text. Both classes weigh the same in all. The descent
    ends when primal and dual value are within ``gap`` of the primal one, or after ``epochs``.
    """
    rng = np.random.default_rng(7)
    y = labels * 2.0 - 1.0
    values = [ratio[r] / (np.linalg.norm(ratio[r]) or 1.0) for r in rows]
    square = np.array([float(v @ v) for v in values]) + 1.0
    balance = cost * labels.size / 2 / np.maximum(1, np.array([(labels == 0).sum(), (labels == 1).sum()]))
    most = balance[labels.astype(int)]
    w, b, alpha = np.zeros(WIDTH), 0.0, np.zeros(labels.size)
    for _ in range(epochs):
        for i in rng.permutation(labels.size):
            own, v = rows[i], values[i]
            gradient = y[i] * (w[own] @ v + b) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), most[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[own] += step * v
                b += step
                alpha[i] = new
        margins = np.array([w[own] @ v for own, v in zip(rows, values, strict=True)]) + b
        half = (w @ w + b * b) / 2
        primal = half + float(most @ np.maximum(0.0, 1.0 - y * margins))
        if primal - (alpha.sum() - half) <= gap * primal:
            break
    return w, b


class Model:
    """Weights of the indicators, scaled as the texts are, and the logistic curve of the margins."""

    def __init__(self, ratio: np.ndarray, weights: np.ndarray, bias: float, curve: tuple[float, float]):
        self.ratio, self.weights, self.bias, self.curve = ratio.astype(np.float32), weights.astype(np.float32), bias, curve

    def margin(self, own: np.ndarray) -> float:
        r = self.ratio[own].astype(np.float64)
        return float(r @ self.weights[own] / (np.linalg.norm(r) or 1.0)) + self.bias

    def score(self, text: str | None) -> float:
        z = self.curve[0] * self.margin(indicators(text)) + self.curve[1]
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def fit(texts: list[str], labels: np.ndarray) -> Model:
    rows = [indicators(t) for t in texts]
    if labels.size == 0 or labels.min() == labels.max():
        share = float(labels.mean()) if labels.size else 0.5
        return Model(np.zeros(WIDTH), np.zeros(WIDTH), 0.0, (1.0, math.log((share + 0.01) / (1.01 - share))))
    for_curve = np.arange(labels.size) % HELD_FOR_CURVE == HELD_FOR_CURVE - 1
    if not for_curve.any() or labels[for_curve].min() == labels[for_curve].max() or labels[~for_curve].min() == labels[~for_curve].max():
        for_curve = np.zeros(labels.size, bool)
    fitted = [r for r, c in zip(rows, for_curve, strict=True) if not c]
    ratio = log_count_ratios(fitted, labels[~for_curve])
    w, b = dual_descent(fitted, labels[~for_curve], ratio)
    mean = np.abs(w[w != 0]).mean() if w.any() else 0.0
    w = INTERPOLATION * w + (1 - INTERPOLATION) * mean * np.sign(w)
    model = Model(ratio, w, b, (1.0, 0.0))
    shown = for_curve if for_curve.any() else ~for_curve
    margins = np.array([model.margin(r) for r, c in zip(rows, shown, strict=True) if c])
    model.curve = logistic_curve(margins, labels[shown])
    return model


def logistic_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, with targets drawn in as Platt does."""
    yes, no = labels.sum(), labels.size - labels.sum()
    aim = np.where(labels == 1, (yes + 1) / (yes + 2), 1 / (no + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + c, -40, 40)))
        g = np.array([((p - aim) * margins).sum(), (p - aim).sum()]) + 1e-3 * np.array([a, 0])
        s = p * (1 - p)
        h = np.array([[(s * margins**2).sum() + 1e-3, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, c = a - float(step[0]), c - float(step[1])
        if np.abs(step).max() < 1e-8:
            break
    return (a, c) if a > 0 and math.isfinite(a + c) else (1.0, 0.0)


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, labels, order = [], [], []
    for batch in batches:
        texts += batch.column("text").to_pylist()
        labels += batch.column("label").to_pylist()
        order += batch.column("place").to_pylist()
    by = sorted(range(len(texts)), key=order.__getitem__)
    m = fit([texts[k] for k in by], np.array([labels[k] for k in by], np.int64))
    yield pa.RecordBatch.from_arrays(
        [pa.array([x], pa.binary()) for x in (m.ratio.tobytes(), m.weights.tobytes(), np.array([m.bias, *m.curve]).tobytes())], ["ratio", "weights", "rest"]
    )


def train(docs: DataFrame, labels: DataFrame, in_training: Column, most: int = MOST_ROWS) -> Model:
    """Fit on about ``most`` labelled rows of each class and ``MOST_BYTES`` of text, the bounds of what the one task holds.

    Null labels and ids are left out, a null text is an empty one; repeated rows count each, in the
    order of their text's hash, so the result does not depend on how rows lie. Rows of one class
    only, or none (an empty table included), give the same score to every text. Other columns are
    not read.
    """
    rows = training_rows(docs, labels, "quality", in_training, most).withColumn("place", F.xxhash64("text", "label"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MOST_BYTES:  # an even share of the sample
        rows = rows.where(F.pmod(F.xxhash64("place", F.lit("bytes")), F.lit(1 << 20)) < int(MOST_BYTES / size * (1 << 20)))
    r = rows.repartition(1).mapInArrow(_fit_task, "ratio binary, weights binary, rest binary").first()
    if r is None:  # no labelled row at all
        return fit([], np.empty(0, np.int64))
    bias, slope, offset = np.frombuffer(r["rest"])
    return Model(np.frombuffer(r["ratio"], np.float32), np.frombuffer(r["weights"], np.float32), float(bias), (float(slope), float(offset)))


def scores(model: Model):
    """A column function: the score of a text, read whole, null as empty. Repeated rows score alike; an empty table gives no rows."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in text], dtype="float64")

    return score
