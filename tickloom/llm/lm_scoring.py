"""Masked pseudo-likelihood: a bidirectional window network scores documents.

Every token is predicted from the token on its left and the one on its right: hidden = tanh(L[left] + R[right] + c),
logits = hidden W + b. A document's score is the sum of log P(token | both neighbours) over all its tokens.

Tokens are words between white space, A-Z lower-cased. The vocabulary of SIZE ids has the edge of a text (0), the
most frequent words of the corpus, and hashed buckets of the last two bytes for all other words.

Training sees the whole corpus through its sufficient statistics: counts of (left, right, token) over all documents,
summed map-side and by a shuffle. They are at most SIZE^3 cells, however large the corpus, and so is what the driver
gets. The network is fitted there by full-batch Adam in numpy, with a fixed seed; scoring is map-side with the table
of SIZE^3 log-probabilities broadcast (8 MB).

Defined results: null, empty and blank texts have 0 tokens, a sum of 0 and a null mean; repeated rows count and are
scored each; on an empty table the result is empty; other columns of the input stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _U, i64, mix, run_hashes, slices, string_buffer, word_bounds

SIZE = 128
BUCKETS = 40
HIDDEN = 32
STEPS = 120


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and ending bucket of every word, and row offsets."""
    data, offsets = string_buffer(column)
    st, en, first = word_bounds(data, offsets)
    word = run_hashes(data, st, en, True)
    tail = mix(run_hashes(data, np.maximum(st, en - 2), en, True) ^ _U(0x1B873593)) % _U(BUCKETS)
    return word, tail.astype(np.int64), first


class Vocabulary:
    """Ids: 0 edge, then BUCKETS endings, then the frequent words by key order."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        word, tail, first = _words(column)
        out = 1 + tail
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, word), len(self.keys) - 1)
            hit = self.keys[at] == word
            out[hit] = 1 + BUCKETS + at[hit]
        return out, first

    def cells(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(left * SIZE + right) * SIZE + token of every token, and row offsets."""
        ids, first = self.ids(column)
        left = np.concatenate([[0], ids])[: len(ids)]
        right = np.concatenate([ids[1:], [0]])[: len(ids)]
        filled = np.flatnonzero(np.diff(first) > 0)
        left[first[filled]] = 0
        right[first[filled + 1] - 1] = 0
        return (left * SIZE + right) * SIZE + ids, first


def vocabulary(texts: DataFrame) -> Vocabulary:
    """The SIZE - BUCKETS - 1 most frequent words over all rows of ``texts`` (one column, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            word, n = np.unique(_words(batch.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(i64(word)), pa.array(n.astype(np.int64))], names=["word", "n"])

    counts = texts.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(SIZE - BUCKETS - 1).collect()
    return Vocabulary(np.array([r.word for r in top], np.int64).view(np.uint64))


def cell_counts(texts: DataFrame, vocab: Vocabulary) -> np.ndarray:
    """Counts of all (left, right, token) cells over all rows, shape (SIZE^2, SIZE)."""
    shared = texts.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for batch in slices(batches, "text"):
            total += np.bincount(shared.value.cells(batch.column(0))[0], minlength=SIZE**3)
        cell = np.flatnonzero(total)
        for lo in range(0, len(cell), 200_000):
            part = cell[lo : lo + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["cell", "n"])

    got = texts.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SIZE**3)
    out[np.asarray(got.column("cell"), np.int64)] = np.asarray(got.column("n"), np.float64)
    return out.reshape(SIZE * SIZE, SIZE)


def log_table(p: dict[str, np.ndarray]) -> np.ndarray:
    """log P(token | left, right) for all contexts, shape (SIZE^2, SIZE)."""
    h = np.tanh((p["L"][:, None, :] + p["R"][None, :, :]).reshape(-1, HIDDEN) + p["c"])
    z = h @ p["W"] + p["b"]
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(counts: np.ndarray, steps: int = STEPS, seed: int = 17) -> dict[str, np.ndarray]:
    """The network's parameters, by full-batch Adam on the mean negative log-likelihood of all tokens."""
    rng = np.random.default_rng(seed)
    total = max(1.0, counts.sum())
    seen = np.flatnonzero(counts.sum(axis=1))
    target = (counts[seen] / total).astype(np.float32)
    weight = target.sum(axis=1, keepdims=True)
    left, right = seen // SIZE, seen % SIZE
    one = np.zeros((SIZE, len(seen)), np.float32)
    one[left, np.arange(len(seen))] = 1
    two = np.zeros((SIZE, len(seen)), np.float32)
    two[right, np.arange(len(seen))] = 1
    p = {"L": rng.normal(0, 0.3, (SIZE, HIDDEN)), "R": rng.normal(0, 0.3, (SIZE, HIDDEN)), "c": np.zeros(HIDDEN), "W": rng.normal(0, 0.1, (HIDDEN, SIZE)), "b": np.log(target.sum(axis=0) + 1e-6)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    for t in range(1, steps + 1 if len(seen) else 1):
        h = np.tanh(p["L"][left] + p["R"][right] + p["c"])
        z = h @ p["W"] + p["b"]
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z *= weight / z.sum(axis=1, keepdims=True)
        z -= target
        d = (z @ p["W"].T) * (1 - h * h)
        grad = {"W": h.T @ z, "b": z.sum(axis=0), "c": d.sum(axis=0), "L": one @ d, "R": two @ d}
        for k, g in grad.items():
            m[k] += 0.1 * (g - m[k])
            s[k] += 0.01 * (g * g - s[k])
            p[k] -= 0.05 * (1 - 0.9 * t / steps) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-9)
    return p


def fit(docs: DataFrame, text_col: str = "text") -> tuple[Vocabulary, np.ndarray]:
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    vocab = vocabulary(texts)
    return vocab, log_table(train(cell_counts(texts, vocab))).astype(np.float32)


def score(docs: DataFrame, model: tuple[Vocabulary, np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens, log_likelihood (sum) and mean_log_prob (null without tokens)."""
    own = ("n_tokens", "log_likelihood", "mean_log_prob")
    keep = [c for c in docs.columns if c not in own]
    schema = docs.select(*keep).schema.add("n_tokens", "long").add("log_likelihood", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, table = shared.value
        flat = table.reshape(-1)
        for batch in slices(batches, text_col):
            cells, first = vocab.cells(batch.column(at))
            each = flat[cells].astype(np.float64)
            rows = np.repeat(np.arange(batch.num_rows), np.diff(first))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(first)), pa.array(np.bincount(rows, each, batch.num_rows))], names=[*keep, "n_tokens", "log_likelihood"])

    out = docs.select(*keep).mapInArrow(run, schema)
    return out.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
