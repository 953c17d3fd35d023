"""Toxicity by a classifier chain.

The categories are predicted one after the other. The model of each is logistic over the text's terms and the
log-odds of all earlier categories. For training, the earlier log-odds are out-of-fold: each of FOLDS parts gets them
from models fitted on the others, so a later model sees earlier ones as wrong as they are on new documents. For scoring
each category's model is fitted on all training rows.

Terms are 64-bit hashes of runs of letters and digits, of their stems, and of words' endings. A category's model holds the at most
TERMS terms whose document shares differ most between its classes (two-proportion z of Z or more); each is present or
absent, so neither length nor repetition dilutes it.

Training uses at most ``train_rows`` (documented bound, default 6000) labelled documents with the smallest id hashes;
scoring covers every whole text map-side with at most TERMS weights per category.

Defined results: texts that are null, empty or without words get the bias' probabilities and are never flagged;
a category with one class only in training has that class' probability for all; repeated rows are scored each;
extra columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import _U, add_columns, i64, string_buffer, trim
from .textmodel import Rows, adam, labelled, sigmoid, term_keys

TRAIN_ROWS = 6000
FOLDS = 4
STEPS = 150
TERMS = 4096
Z = 5.0


class Link:
    """One category: sorted term keys and their weights, a weight for each earlier category's log-odds, and a bias."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, earlier: np.ndarray, bias: float):
        self.keys, self.weights, self.earlier, self.bias = keys, weights, earlier, bias
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(keys.view(np.uint64) >> _U(48)).astype(np.int64)] = True

    def logit(self, keys: np.ndarray, first: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """``keys`` are the terms of all rows, ``first`` the row offsets."""
        near = np.flatnonzero(self.filter[(keys.view(np.uint64) >> _U(48)).astype(np.int64)])
        n = len(first) - 1
        total = np.zeros(n)
        if len(near) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys[near]), len(self.keys) - 1)
            hit = self.keys[at] == keys[near]
            row = np.searchsorted(first, near[hit], side="right") - 1
            pair = np.unique(row * len(self.keys) + at[hit])
            total = np.bincount(pair // len(self.keys), self.weights[pair % len(self.keys)], n)
        return total + earlier @ self.earlier + self.bias


def choose_terms(rows: Rows, y: np.ndarray) -> np.ndarray:
    """Sorted keys of the terms that tell the classes apart."""
    keys, at = np.unique(rows.col, return_inverse=True)
    one, zero = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    a = np.bincount(at, y[rows.row], len(keys))
    b = np.bincount(at, 1 - y[rows.row], len(keys))
    share = (a + b) / (one + zero)
    z = np.abs(a / one - b / zero) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / one + 1 / zero))
    ok = np.flatnonzero((a + b >= 4) & (z >= Z))
    return keys[np.sort(ok[np.argsort(-z[ok], kind="stable")[:TERMS]])]


def fit_link(rows: Rows, earlier: np.ndarray, y: np.ndarray, l2: float = 1e-4) -> Link:
    """Logistic regression with classes at equal total weight."""
    k = earlier.shape[1]
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return Link(np.empty(0, np.int64), np.empty(0), np.zeros(k), 30.0 if share else -30.0)
    keys = choose_terms(rows, y)
    size = len(keys)
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y == 0).sum())
    at = np.minimum(np.searchsorted(keys, rows.col), max(0, size - 1))
    hit = np.flatnonzero(keys[at] == rows.col) if size else np.empty(0, np.int64)
    col, row = at[hit], rows.row[hit]

    def grad(p: np.ndarray) -> np.ndarray:
        e = (sigmoid(np.bincount(row, p[col], len(y)) + earlier @ p[size:-1] + p[-1]) - y) * weight
        g = np.empty_like(p)
        g[:size] = np.bincount(col, e[row], size) + l2 * p[:size]
        g[size:-1] = earlier.T @ e + 1e-3 * p[size:-1]
        g[-1] = e.sum()
        return g

    p = adam(grad, np.zeros(size + k + 1), STEPS, 0.1)
    return Link(keys, p[:size], p[size:-1], float(p[-1]))


def fit_chain(rows: Rows, labels: list[np.ndarray], fold: np.ndarray) -> list[Link]:
    n = len(fold)
    links, earlier = [], np.zeros((n, 0))
    for j, y in enumerate(labels):
        links.append(fit_link(rows, earlier, y))
        if j + 1 == len(labels):
            break
        out = np.zeros(n)
        for f in range(FOLDS):
            inside, outside = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            if len(inside) and len(outside):
                part = fit_link(rows.take(outside), earlier[outside], y[outside])
                own = rows.take(inside)
                out[inside] = part.logit(own.col, own.start, earlier[inside])
        earlier = np.column_stack([earlier, np.clip(out, -8, 8)])
    return links


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> list[Link]:
    """The chain over ``categories``, columns of 0 and 1 of ``labels``, in the order given."""
    rows, y, ids = labelled(docs, labels, categories, train_rows, term_keys, id_col, text_col)
    links = fit_chain(rows, [y[c] for c in categories], np.arange(len(ids)) % FOLDS)
    del rows, y
    trim()
    return links


def chain_logits(links: list[Link], keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros((len(first) - 1, 0))
    for link in links:
        s = link.logit(keys, first, np.clip(out, -8, 8))
        out = np.column_stack([out, s])
    return out


def score(docs: DataFrame, links: list[Link], categories: list[str], threshold: float = 0.5, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``docs`` with p_<category> for each category and is_<category> = (p >= threshold); of its own columns all, or those named."""
    shared = docs.sparkSession.sparkContext.broadcast(links)

    def make(texts: pa.Array) -> list[pa.Array]:
        keys, first = term_keys(*string_buffer(texts))
        p = np.ascontiguousarray(sigmoid(chain_logits(shared.value, i64(keys), first)).T)
        return [pa.array(x, pa.float64()) for x in p] + [pa.array((x >= threshold) & (np.diff(first) > 0)) for x in p]

    return add_columns(docs, text_col, [*[(f"p_{c}", T.DoubleType()) for c in categories], *[(f"is_{c}", T.BooleanType()) for c in categories]], make, columns)
