"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features serves all grades; ordered thresholds t_0 < t_1 < ... cut its
score: P(grade > k) = sigmoid(score - t_k). The order is kept by training log-gaps. The expected grade and the
tail probability P(grade >= pass_grade) come from the same model, and a document is kept when its tail probability
is at least ``keep_at``.

Training uses at most ``train_rows`` (documented bound, default 6000) labelled documents with the smallest id hashes;
scoring covers every whole text, map-side, with one broadcast of 2^17 weights.

Defined results: a null or empty text, or one without words, has a score of 0 before the thresholds; a
missing or one-grade label table gives the constant grade (all kept if that is the pass grade or none is known);
repeated rows are scored each; extra columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns, trim
from .textmodel import BITS, Rows, adam, labelled, means, score_texts, sigmoid, word_features

TRAIN_ROWS = 6000
STEPS = 120


class OrdinalModel:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, grades: np.ndarray):
        self.weights, self.thresholds, self.grades = weights, thresholds, grades

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k, as columns."""
        return sigmoid(score[:, None] - self.thresholds[None, :])

    def expected(self, score: np.ndarray) -> np.ndarray:
        return self.grades[0] + self.tails(score) @ np.diff(self.grades)


def fit_rows(rows: Rows, grade: np.ndarray, l2: float = 1e-4) -> OrdinalModel:
    """Maximum penalised likelihood; classes are weighted to equal total weight."""
    grades = np.unique(grade)
    k = len(grades) - 1
    size = 1 << BITS
    if k < 1:
        return OrdinalModel(np.zeros(size, np.float32), np.empty(0), grades if len(grades) else np.array([1.0]))
    y = np.searchsorted(grades, grade)
    count = np.bincount(y, minlength=k + 1)
    weight = (len(y) / ((k + 1) * count))[y]
    weight /= weight.sum()
    gap = np.cumsum(np.concatenate([[0.0], np.ones(k - 1)])) - (k - 1) / 2

    def unpack(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = p[size:]
        return p[:size], t[0] + np.concatenate([[0.0], np.cumsum(np.exp(t[1:]))])

    def grad(p: np.ndarray) -> np.ndarray:
        w, t = unpack(p)
        s = rows.dot(w)
        up = sigmoid(s[:, None] - t[None, :])  # P(y > k)
        edge = np.concatenate([np.ones((len(y), 1)), up, np.zeros((len(y), 1))], axis=1)
        at = np.arange(len(y))
        a, b = edge[at, y], edge[at, y + 1]
        prob = np.maximum(a - b, 1e-9)
        da, db = a * (1 - a) / prob * weight, b * (1 - b) / prob * weight
        gt = np.zeros(k)
        np.add.at(gt, y[y > 0] - 1, da[y > 0])
        np.add.at(gt, y[y < k], -db[y < k])
        g = np.empty_like(p)
        g[:size] = rows.back(-(da - db), size) + l2 * w / 100
        g[size] = gt.sum()
        tail = np.cumsum(gt[::-1])[::-1]
        g[size + 1 :] = tail[1:] * np.exp(p[size + 1 :])
        return g

    start = np.zeros(size + k)
    start[size] = gap[0]
    p = adam(grad, start, STEPS, 0.1)
    w, t = unpack(p)
    return OrdinalModel(w.astype(np.float32), t, grades)


def fit(docs: DataFrame, labels: DataFrame, grade: str, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> OrdinalModel:
    rows, y, _ = labelled(docs, labels, [grade], train_rows, word_features, id_col, text_col)
    model = fit_rows(means(rows), y[grade])
    del rows, y
    trim()
    return model


def score(docs: DataFrame, model: OrdinalModel, pass_grade: float, keep_at: float = 0.5, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``docs`` with expected_grade, pass_probability (tail from pass_grade on) and keep; of its own columns all, or those named."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts: pa.Array) -> list[pa.Array]:
        m = shared.value
        (s,) = score_texts(texts, [m.weights])
        cut = int(np.searchsorted(m.grades, pass_grade)) - 1
        tail = np.ones(len(s)) if cut < 0 else np.zeros(len(s)) if cut >= len(m.thresholds) else m.tails(s)[:, cut]
        return [pa.array(m.expected(s), pa.float64()), pa.array(tail, pa.float64()), pa.array(tail >= keep_at)]

    return add_columns(docs, text_col, [("expected_grade", T.DoubleType()), ("pass_probability", T.DoubleType()), ("keep", T.BooleanType())], make, columns)
