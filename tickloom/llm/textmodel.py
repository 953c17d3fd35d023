"""Hashed text features and the small numpy trainers shared by the classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _U, i64, mix, run_hashes, slices, string_buffer, word_bounds

BITS = 17
SCALE = 20.0


def word_features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word, its last three bytes, its length and whether it repeats the word before; and row offsets.

    The buckets are an array (words, 4). A row's features are the means of its words' buckets, so a text counts
    whole and its length doesn't matter.
    """
    st, en, first = word_bounds(data, offsets)
    top = _U(64 - bits)
    out = np.empty((len(st), 4), np.int32)
    out[:, 0] = run_hashes(data, st, en, True) >> top
    tail = np.maximum(st, en - 3)
    out[:, 1] = mix(run_hashes(data, tail, en, True) ^ _U(0x51ED270B)) >> top
    out[:, 2] = mix(np.minimum(en - st, 40).astype(np.uint64) ^ _U(0x7F4A7C15)) >> top
    same = np.zeros(len(st), np.uint64)
    same[1:] = out[1:, 0] == out[:-1, 0]
    head = first[:-1]
    same[head[head < len(st)]] = 0
    out[:, 3] = mix(same ^ _U(0x2545F491)) >> top
    return out, first


_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def term_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of every run of letters and digits (case folded), of its stems of 4 and 5 bytes and of words' last three bytes; row offsets."""
    st, en, first = word_bounds(data, offsets, _APART)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    keys, rows = [run_hashes(data, st, en, True)], [row]
    for size in (4, 5):
        long = en - st > size
        keys.append(mix(run_hashes(data, st[long], st[long] + size, True) ^ _U(0x6C8E9CF5 + size)))
        rows.append(row[long])
    st, en, other = word_bounds(data, offsets)
    keys.append(mix(run_hashes(data, np.maximum(st, en - 3), en, True) ^ _U(0x51ED270B)))
    rows.append(np.repeat(np.arange(len(offsets) - 1), np.diff(other)))
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return np.concatenate(keys)[order], np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(offsets) - 1))])


def row_means(weights: np.ndarray, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SCALE x the mean weight of each row's features; 0 for rows without words."""
    each = weights[buckets].sum(axis=1)
    total = np.concatenate([[0.0], np.cumsum(each, dtype=np.float64)])
    n = np.diff(first)
    return SCALE * (total[first[1:]] - total[first[:-1]]) / np.maximum(4 * n, 1)


def score_texts(column: pa.Array, weights: list[np.ndarray]) -> list[np.ndarray]:
    data, offsets = string_buffer(column)
    buckets, first = word_features(data, offsets)
    return [row_means(w, buckets, first) for w in weights]


class Rows:
    """Sparse training rows: value[j] stands in column col[j] of the row that holds j."""

    def __init__(self, col: np.ndarray, value: np.ndarray, start: np.ndarray):
        self.col, self.value, self.start = col, value, start
        self.row = np.repeat(np.arange(len(start) - 1), np.diff(start))

    def dot(self, w: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(w[self.col] * self.value)])
        return total[self.start[1:]] - total[self.start[:-1]]

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.col, weights=self.value * g[self.row], minlength=size)

    def take(self, rows: np.ndarray) -> Rows:
        n = np.diff(self.start)[rows]
        start = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(start[-1]) + np.repeat(self.start[rows] - start[:-1], n)
        return Rows(self.col[at], self.value[at], start)


def labelled(docs: DataFrame, labels: DataFrame, columns: list[str], limit: int, features, id_col: str = "doc_id", text_col: str = "text") -> tuple[Rows, dict[str, np.ndarray], np.ndarray]:
    """Features, labels and ids of at most ``limit`` labelled documents, those with the smallest id hashes.

    ``features(data, offsets)`` gives 64-bit or 32-bit keys and row offsets; a row gets each distinct key with its
    count. A label row with a null id or label isn't used; of repeated ids one row with the smallest labels counts.
    The driver gets ``limit`` rows of keys at most.
    """
    clean = labels.select(F.col(id_col).alias("id"), *columns).dropna().groupBy("id").agg(*[F.min(c).alias(c) for c in columns])
    chosen = clean.orderBy(F.xxhash64("id"), "id").limit(limit)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    joined = src.join(F.broadcast(chosen), "id").select("id", "text", *[F.col(c).cast("double").alias(f"y{j}") for j, c in enumerate(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            keys, first = features(*string_buffer(batch.column(1)))
            keys = keys.reshape(len(keys), keys.shape[1] if keys.ndim > 1 else 1)
            cols, values = [], []
            for r in range(batch.num_rows):
                c, k = np.unique(keys[first[r] : first[r + 1]], return_counts=True)
                cols.append(i64(c).astype(np.int64))
                values.append(k.astype(np.int32))
            off = pa.array(np.concatenate([[0], np.cumsum([len(c) for c in cols])]), pa.int32())
            lists = [pa.ListArray.from_arrays(off, pa.array(np.concatenate(x))) for x in (cols, values)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *lists], names=["id", *[f"y{j}" for j in range(len(columns))], "col", "value"])

    kind = src.schema["id"].dataType.simpleString()
    got = joined.mapInArrow(run, f"id {kind}, {', '.join(f'y{j} double' for j in range(len(columns)))}, col array<long>, value array<int>").toArrow()
    ids = np.array(got.column("id").to_pylist())
    got = got.take(pa.array(np.argsort(ids, kind="stable"))) if len(ids) else got
    flat = lambda c: np.asarray(pc.list_flatten(got.column(c)), np.int64)
    start = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(got.column("col")), np.int64))])
    rows = Rows(flat("col"), flat("value").astype(np.float64), start)
    return rows, {c: np.array(got.column(f"y{j}").to_pylist(), np.float64) for j, c in enumerate(columns)}, np.sort(ids, kind="stable")


def means(rows: Rows) -> Rows:
    """Counts as shares of the row, times SCALE: the training form of ``row_means``."""
    total = np.bincount(rows.row, rows.value, len(rows.start) - 1)
    return Rows(rows.col, SCALE * rows.value / np.maximum(total, 1)[rows.row], rows.start)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def adam(loss_grad, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Full-batch Adam with a rate that falls linearly to a tenth."""
    w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = loss_grad(w)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= rate * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w
