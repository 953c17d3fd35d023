"""Exact token counts of whole texts by a map-side two-tier lookup; no pre-token is ever shuffled.

A text is cut at single spaces into chunks that tokenise on their own: byte-level BPE pre-tokens take at most
one leading space, so a boundary before a lone space is always a pre-token boundary. Tier one is a compact
broadcast table of the frequent chunks' lengths, tier two a bounded cache in each worker; a miss is encoded by
the library. Texts where the cut isn't provably exact (adjacent white space with a space in it, special-token
strings, unusual white space) are encoded whole by the library. SentencePiece models are cut before spaces too
where no piece of the vocabulary holds a space behind another character.

The frequent table comes from a pass over every document: each task keeps the counts of its own chunks in
a bounded counter and sends one fixed-size summary; summaries merge in a two-level tree. The table only
saves time; no result depends on what it holds.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are each returned; columns of the
input other than the id and the text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Lexicon, chunk_bounds, chunk_hash, chunk_hashes, run_hashes, slices, string_buffer, unsafe_rows

#: Characters that all engines class alike.
_COMMON = re.compile(r"[\x00-\u024f]*", re.ASCII)
CACHE_ENTRIES = 500_000
LOCAL_COUNTER = 40_000
SLICE = 1 << 20


class _ByteLevel:
    """A tokenizers .json file with a byte-level pre-tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        pre = spec.get("pre_tokenizer") or {}
        self.exact = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.fast = self._ranked(spec) if self.exact else None

    @staticmethod
    def _ranked(spec: dict):
        """The same vocabulary as ranks, if ids rise in the order of the merges: a faster engine for single chunks."""
        import public_tokenizers
        import tiktoken

        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        special = {t["content"] for t in spec.get("added_tokens", [])}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        order = [vocab[a + b] for a, b in pairs]
        if order != sorted(set(order)) or len(vocab) - len(special & set(vocab)) != 256 + len(order) or any(spec["model"].get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
            return None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # printable bytes stand for themselves, the rest follow from 256 on
        back = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in set(plain))}
        ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if t not in special}
        single = sorted(i for t, i in ranks.items() if len(t) == 1)
        if single and order and single[-1] > order[0]:
            return None
        return tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False).ids)

    def apart(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which rows may be cut before each space: where that is sure to be exact."""
        ok = np.full(len(offsets) - 1, self.exact) & ~unsafe_rows(data, offsets)
        if any(s.encode() in (raw := data.tobytes()) for s in self.special):
            for s in self.special:
                at = -1
                while (at := raw.find(s.encode(), at + 1)) >= 0:
                    ok[np.searchsorted(offsets, at, side="right") - 1] = False
        return ok

    def head(self, chunk: str) -> int:
        return self.whole(chunk) if chunk else 0

    def many(self, chunks: list[str]) -> list[int]:
        """Tokens of the chunks, each behind a space."""
        if self.fast is None:
            return [len(e.ids) for e in self.tok.encode_batch([" " + c for c in chunks], add_special_tokens=False)]
        encode, common = self.fast.encode_ordinary, _COMMON.fullmatch
        return [len(encode(" " + c)) if common(c) else self.whole(" " + c) for c in chunks]


class _Piece:
    """A SentencePiece model; the dummy prefix makes the first word like the others."""

    def __init__(self, path: str):
        from .sentencepieces import Encoder

        self.enc = Encoder(path)

    def whole(self, text: str) -> int:
        return len(self.enc.sp.encode(text))

    def apart(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.enc.rows_apart(data, offsets) & ~unsafe_rows(data, offsets)

    def head(self, chunk: str) -> int:
        return self.whole(chunk)

    def many(self, chunks: list[str]) -> list[int]:
        return [len(x) for x in self.enc.sp.encode(chunks, num_threads=1)]


@lru_cache(maxsize=4)
def _engine(path: str):
    return _ByteLevel(path) if path.endswith(".json") else _Piece(path)


class TextCounter:
    """Counts whole texts in one worker: frequent chunks' table first, then the worker's own cache, then the library."""

    def __init__(self, path: str, frequent: dict[str, int]):
        self.engine = _engine(path)
        self.lexicon = Lexicon(lambda words: (np.array(self.engine.many(words), np.int64), []), CACHE_ENTRIES)
        if frequent:
            words = list(frequent)
            make, self.lexicon.make = self.lexicon.make, lambda w: (np.array([frequent[x] for x in w], np.int64), [])
            self.lexicon.pin(*chunk_hash(words), words)
            self.lexicon.make = make

    def count(self, column: pa.Array) -> np.ndarray:
        data, offsets = string_buffer(column)
        n = len(offsets) - 1
        out = np.zeros(n, np.int64)
        filled = np.diff(offsets) > 0
        apart = self.engine.apart(data, offsets) & filled
        text = lambda lo, hi: data[lo:hi].tobytes().decode()
        for r in np.flatnonzero(filled & ~apart).tolist():
            out[r] = self.engine.whole(text(offsets[r], offsets[r + 1]))
        st, en, first = chunk_bounds(data, offsets)
        for r in np.flatnonzero(apart).tolist():
            out[r] = self.engine.head(text(st[first[r]], en[first[r]]))
        rest = np.repeat(apart, np.diff(first))
        rest[first[:-1]] = False
        st, en = st[rest], en[rest]
        if len(st):
            size = self.lexicon.lookup(*chunk_hashes(data, st, en), lambda k: text(st[k], en[k]))
            total = np.concatenate([[0], np.cumsum(self.lexicon.size[size])])
            bound = np.concatenate([[0], np.cumsum(rest)])[first]
            out += np.diff(total[bound])
        return out


def _prune(counter: Counter, size: int) -> Counter:
    return Counter(dict(sorted(counter.items(), key=lambda x: (-x[1], x[0]))[:size]))


def frequent_lengths(docs: DataFrame, path: str, text_col: str = "text", size: int = 20_000) -> dict[str, int]:
    """At most ``size`` frequent chunks of the whole corpus and their token counts.

    Each task folds all its texts into a counter that keeps its LOCAL_COUNTER heaviest chunks, and sends its top ``size // 4`` as one row; groups of about sqrt(tasks) summaries are merged on executors.
    The driver gets at most sqrt(tasks) summaries of ``size`` entries.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine, seen, words = _engine(path), np.empty((2, 0), np.uint64), {}
        for batch in slices(batches, "text", SLICE):
            data, offsets = string_buffer(batch.column(0))
            apart = engine.apart(data, offsets)
            st, en, first = chunk_bounds(data, offsets)
            rest = np.repeat(apart, np.diff(first))
            rest[first[:-1]] = False
            st, en = st[rest], en[rest]
            key, at, n = np.unique(run_hashes(data, st, en), return_index=True, return_counts=True)
            top = np.argsort(-n, kind="stable")[:LOCAL_COUNTER]
            for k in top[~np.isin(key[top], seen[0])].tolist():
                words.setdefault(int(key[k]), data[st[at[k]] : en[at[k]]].tobytes().decode())
            both = np.concatenate([seen, np.stack([key[top], n[top].astype(np.uint64)])], axis=1)
            key, at = np.unique(both[0], return_inverse=True)
            total = np.bincount(at, both[1].astype(np.float64), len(key)).astype(np.uint64)
            top = np.argsort(-total.astype(np.int64), kind="stable")[:LOCAL_COUNTER]
            seen = np.stack([key[top], total[top]])
            words = {k: words[k] for k in seen[0].tolist()}
        top = {w: n for k, n in zip(*seen[:, : size // 4].tolist(), strict=True) if n > 1 and len(w := words[k]) <= 64}
        yield pa.RecordBatch.from_pydict({"summary": [json.dumps(top)]}, schema=pa.schema([("summary", pa.string())]))

    def merge(rows: pa.Table) -> pa.Table:
        total: Counter = Counter()
        for s in rows.column("summary"):
            total.update(json.loads(s.as_py()))
        return pa.table({"summary": [json.dumps(_prune(total, size))]})

    summaries = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(local, "summary string")
    groups = max(1, int(docs.rdd.getNumPartitions() ** 0.5))
    merged = summaries.withColumn("g", F.spark_partition_id() % groups).groupBy("g").applyInArrow(merge, "summary string")
    total: Counter = Counter()
    for row in merged.toLocalIterator():
        total.update(json.loads(row.summary))
        total = _prune(total, size)
    chunks = list(total)
    return dict(zip(chunks, _engine(path).many(chunks), strict=True)) if chunks else {}


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit) for every row of ``docs``, texts taken whole."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent_lengths(docs, path, text_col))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TextCounter(path, table.value)
        for batch in slices(batches, "text", SLICE):
            n = counter.count(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n)], names=["id", "n_bytes", "n_tokens"])

    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
