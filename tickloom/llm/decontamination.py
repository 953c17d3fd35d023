"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

A short test item inside a long document has next to no Jaccard similarity to it, so the search is asymmetric.
Items are partitioned by shingle count (powers of two). An item's sketch is its k smallest shingle hashes, a bottom-k
MinHash; k follows from the partition's upper size u and the threshold t: k = u - ceil(t u) + 1. A document that
holds at least t of the item lacks fewer than k of its shingles, so it holds one of the sketch: no match is
missed, whatever the document's length. Each document streams its shingle hashes past the sketches; a hit is a
candidate, and candidates are verified by exact containment of the shingle sets.

Items are a stated query set. They are taken in blocks, in size order, of at most BLOCK shingles, so what a task holds
and what is broadcast is bounded; each block is one scan of the documents, without a shuffle.

Shingles are five words, A-Z lower-cased, words split at white space; a text of one to four words is one shingle.
Defined results: null or empty items and documents match nothing; repeated rows match each; an item id may repeat
(each row is an item); extra columns are kept by ``decontaminate`` and ignored by ``matches``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import i64, shingles, slices

BLOCK = 1_000_000
FILTER_BITS = 20
THRESHOLD = (4, 5)


class Index:
    """Sketches and shingle sets of a block of items."""

    def __init__(self, ids: list, sets: list[np.ndarray], threshold: tuple[int, int] = THRESHOLD):
        num, den = threshold
        self.ids, self.sets, self.threshold = ids, sets, threshold
        probes, owner = [], []
        for k, s in enumerate(sets):
            upper = (1 << (len(s) - 1).bit_length()) if len(s) > 1 else len(s)
            size = min(len(s), upper - -(-num * upper // den) + 1)
            probes.append(np.sort(s)[:size])
            owner.append(np.full(size, k, np.int32))
        probe, own = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((probes, np.uint64), (owner, np.int32)))
        order = np.argsort(probe, kind="stable")
        self.probe, self.owner = probe[order], own[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.probe >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def find(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, shared shingles) of all matches."""
        values, off = shingles(column)
        none = np.empty(0, np.int64)
        near = np.flatnonzero(self.filter[(values >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        lo = np.searchsorted(self.probe, values[near], "left")
        hi = np.searchsorted(self.probe, values[near], "right")
        hit = hi > lo
        near, lo, hi = near[hit], lo[hit], hi[hit]
        if not len(near):
            return none, none, none
        row = np.repeat(np.searchsorted(off, near, side="right") - 1, hi - lo)
        at = np.arange(int((hi - lo).sum())) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        pair = np.unique(row * len(self.sets) + self.owner[at])
        rows, items, shared = pair // len(self.sets), pair % len(self.sets), np.zeros(len(pair), np.int64)
        last, own = -1, none
        for k, (r, i) in enumerate(zip(rows.tolist(), items.tolist(), strict=True)):
            if r != last:
                last, own = r, np.unique(values[off[r] : off[r + 1]])
            at = np.minimum(np.searchsorted(own, self.sets[i]), len(own) - 1)
            shared[k] = int((own[at] == self.sets[i]).sum())
        num, den = self.threshold
        ok = den * shared >= num * np.array([len(self.sets[i]) for i in items], np.int64)
        return rows[ok], items[ok], shared[ok]


def blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", threshold: tuple[int, int] = THRESHOLD) -> Iterator[Index]:
    """The items as indexes of at most BLOCK shingles each (one item at least), in size order, streamed by the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, off = shingles(batch.column(1))
            sets = [np.unique(values[off[r] : off[r + 1]]) for r in range(batch.num_rows)]
            n = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets) if sets else values
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(i64(flat)))], names=["id", "n", "s"])

    src = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    sets = src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, n long, s array<long>").where("n > 0").orderBy("n", "id")
    ids, held, size = [], [], 0
    for row in sets.toLocalIterator():
        if held and size + row.n > BLOCK:
            yield Index(ids, held, threshold)
            ids, held, size = [], [], 0
        ids.append(row.id)
        held.append(np.array(row.s, np.int64).view(np.uint64))
        size += row.n
    if held:
        yield Index(ids, held, threshold)


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Rows (document id, item id, n_item, n_shared, containment) for every document that holds an item."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind, item_kind = src.schema["id"].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, n_item long, n_shared long"
    out = spark.createDataFrame([], schema)
    for block in blocks(items, item_id, item_text, threshold):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            names = pa.array(index.ids)
            sizes = np.array([len(s) for s in index.sets], np.int64)
            for batch in slices(batches, "text"):
                rows, hit, common = index.find(batch.column(1))
                if len(rows):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), names.take(pa.array(hit)), pa.array(sizes[hit]), pa.array(common)], names=["id", "item", "n_item", "n_shared"])

        out = out.unionByName(src.mapInArrow(run, schema))
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_id), "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that hold an item; no shuffle."""
    spark, out = docs.sparkSession, docs
    at = docs.columns.index(text_col)
    for block in blocks(items, item_id, item_text, threshold):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text_col):
                rows, _, _ = shared.value.find(batch.column(at))
                clean = np.ones(batch.num_rows, bool)
                clean[rows] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out
