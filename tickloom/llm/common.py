"""Pieces shared by the training-data operators.

* vectorised tokenising and hashing of whole Arrow batches (no per-word Python),
* shared-folder checkpoints, so that a lost executor costs a re-read and not the job,
* distributed connected components.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a worker takes at once.
SLICE = 1 << 20
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_U = np.uint64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Runs longer than this many bytes are hashed by the library.
LONG = 2048
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SEEDS = [(_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)), (_U(0xA24BAED4963EE407), _U(0x8EBC6AF09C88C6E3))]


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place of ``data`` on as one number; zeros follow the end."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def run_hashes(data: np.ndarray, st: np.ndarray, en: np.ndarray, fold_case: bool = False, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run data[st:en].

    Blocks of 8 bytes are folded in by xor, multiply and shift, so there is no polynomial whose roots repetitive strings
    could hit. Two seeds give independent hashes: both together are 128 bits.
    """
    if fold_case:
        data = _LOWER[data]
    at = eights(data)
    start, step = _SEEDS[seed]
    n = en - st
    h = n.astype(np.uint64) * step + start
    todo, off = np.flatnonzero((n > 0) & (n <= LONG)), 0
    whole = len(todo) == len(n)
    while len(todo):
        left = n - off if whole else n[todo] - off
        block = at[st + off] if whole else at[st[todo] + off]
        block &= _MASK[np.minimum(left, 8)]
        if whole:
            h ^= block
            h *= step
            h ^= h >> _U(29)
        else:
            x = (h[todo] ^ block) * step
            h[todo] = x ^ (x >> _U(29))
        more = left > 8
        if not more.all():
            todo, whole = todo[more], False
        off += 8
    for k in np.flatnonzero(n > LONG).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[st[k] : en[k]], digest_size=8, salt=bytes([seed])).digest(), "little")
    return mix(h)


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets (n + 1), nulls as empty, without a copy per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    if len(off) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    return raw[off[0] : off[-1]], off - off[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of every row, and for each row the index of its first word (n + 1 values).

    Words are maximal runs of bytes other than those that ``apart`` marks (space, tab and 0x0A-0x0D); none crosses rows.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~apart[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edge = offsets[:-1]
    edge = edge[edge < n]
    begins[edge] |= solid[edge]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    last = offsets[1:] - 1
    last = last[(last >= 0)]
    ends[last] |= solid[last]
    st, en = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return st, en, np.searchsorted(st, offsets)


def shingles(column: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of every row and row offsets (n + 1).

    A row with 1 to k-1 words has its whole sequence as its one shingle; a row without words has none.
    A-Z are lower-cased. Repeats are kept, in text order.
    """
    data, offsets = string_buffer(column)
    st, en, first = word_bounds(data, offsets)
    count = np.diff(first)
    sizes = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    out_off = np.zeros(len(count) + 1, np.int64)
    np.cumsum(sizes, out=out_off[1:])
    if len(st) == 0:
        return np.empty(0, np.uint64), out_off
    words = run_hashes(data, st, en, fold_case=True)
    step = _U(0xD6E8FEB86659FD93)
    padded = np.concatenate([words, np.zeros(k - 1, np.uint64)])
    run = np.zeros(len(words), np.uint64)
    for j in range(k):
        run = run * step + padded[j : j + len(words)]
    run = mix(run ^ _U(k))
    row = np.repeat(np.arange(len(count)), count)
    left = first[1:][row] - np.arange(len(words))
    keep = left >= k
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        for r in short:
            h = _U(0)
            for w in words[first[r] : first[r + 1]]:
                h = _U((int(h) * int(step) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            run[first[r]] = mix(np.array([h ^ _U(1000 + count[r])], np.uint64))[0]
            keep[first[r]] = True
    return run[keep], out_off


def distinct_per_row(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of every row, with new offsets."""
    out, sizes = [], np.zeros(len(offsets), np.int64)
    for r in range(len(offsets) - 1):
        u = np.unique(values[offsets[r] : offsets[r + 1]])
        out.append(u)
        sizes[r + 1] = len(u)
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.cumsum(sizes)


def slices(batches: Iterator[pa.RecordBatch], column: str | int, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose text is at most about ``limit`` bytes (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = string_buffer(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def trim() -> None:
    """Give memory that freed arrays have left in this process back to the system: after a fit on the driver."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def i64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x


# ---------------------------------------------------------------- shared storage


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a /tmp one on a local master only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "/tmp/checkpoints"


#: Bytes of an Arrow batch between the JVM and a worker.
BATCH_BYTES = 8 << 20


def lean(spark: SparkSession) -> SparkSession:
    """The session with bounded Arrow batches: a session setting, as plans read it when they run; a smaller bound that is set already stays."""
    size = int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m").rstrip("b").replace("m", "000000").replace("k", "000"))
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write to a Parquet table in the shared folder and read it back: lineage is cut, executors may be lost.

    The shuffle files of the write are deleted at its end. The setting holds for the write only: rows that are fetched later, as by
    toLocalIterator, would miss files that are gone.
    """
    spark, cleanup = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path = f"{shared_dir(spark).rstrip('/')}/tickloom-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables made by ``materialize`` that no later plan reads."""
    for df in frames:
        for path in {p.rsplit("/", 1)[0] for p in df.inputFiles() if "/tickloom-" in p}:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def aside(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns called f0, f1 ..., so that no name clashes with an operator's own, and the names."""
    names = df.columns
    return df.select(*[F.col("`" + c.replace("`", "``") + "`").alias(f"f{j}") for j, c in enumerate(names)]), names


def named(df: DataFrame, names: list[str], *more: str) -> DataFrame:
    """The columns of ``aside`` under their own names again, then ``more``."""
    return df.select(*[F.col(f"f{j}").alias(c) for j, c in enumerate(names)], *more)


def add_columns(docs: DataFrame, text_col: str, added: list[tuple[str, T.DataType]], make, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with columns (name, type) that ``make(texts)``, a list of Arrow arrays, gives for a slice of the text column.

    Of the columns of ``docs`` all stay, or those named in ``keep``; such as are named like added ones are replaced. Names may
    hold any characters.
    """
    spark, names, own = lean(docs.sparkSession), docs.columns, [c for c, _ in added]
    kept = [j for j, c in enumerate(names) if c not in own and (keep is None or c in keep)]
    pick = lambda j: F.col("`" + names[j].replace("`", "``") + "`")
    text = names.index(text_col)
    cols = [pick(j).alias(f"f{j}") for j in kept]
    at = kept.index(text) if text in kept and docs.schema[text].dataType == T.StringType() else len(kept)
    if at == len(kept):
        cols.append(pick(text).cast("string").alias("text"))
    src = docs.select(*cols)
    schema = T.StructType(src.schema.fields[: len(kept)] + [T.StructField(f"a{j}", kind) for j, (_, kind) in enumerate(added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *make(part.column(at))], names=schema.names)

    out = src.mapInArrow(run, schema)
    return out.select(*[F.col(f"f{j}").alias(names[j]) for j in kept], *[F.col(f"a{j}").alias(c) for j, c in enumerate(own)])


BLOOM_WORDS = 1 << 17


def bloom(keys: DataFrame) -> DataFrame:
    """(word, bits): a Bloom filter over the column k in at most BLOOM_WORDS longs, whatever the number of keys; two bits a key."""
    h = F.xxhash64("k")
    one = lambda s: keys.select(F.pmod(F.shiftrightunsigned(h, s), F.lit(BLOOM_WORDS)).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(shiftrightunsigned(xxhash64(k), {s + 20}), 64) as int))").alias("bit"))
    return one(0).union(one(30)).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def maybe_in(df: DataFrame, filter_: DataFrame, key: str = "k") -> DataFrame:
    """``df`` with a column __maybe: false for rows whose key the filter excludes. The filter is broadcast (1 MB)."""
    out = df
    for j, s in enumerate((0, 30)):
        b = F.broadcast(filter_.select(F.col("word").alias(f"__w{j}"), F.col("bits").alias(f"__b{j}")))
        out = out.withColumn(f"__w{j}", F.pmod(F.shiftrightunsigned(F.xxhash64(key), s), F.lit(BLOOM_WORDS)).cast("int")).join(b, f"__w{j}", "left")
        out = out.withColumn(f"__b{j}", F.expr(f"coalesce(__b{j} & shiftleft(1L, cast(pmod(shiftrightunsigned(xxhash64({key}), {s + 20}), 64) as int)), 0L) <> 0"))
    return out.withColumn("__maybe", F.col("__b0") & F.col("__b1")).drop("__w0", "__w1", "__b0", "__b1")


#: Edges that one task takes in memory (8 MB); a larger graph goes round by round.
FEW_EDGES = 1 << 19


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), sorted, and the smallest node that each can reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for x in (label[i], label[j], i, j):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected edge list (a, b): rows (node, component = smallest node reachable).

    Up to FEW_EDGES edges are settled within a task. Beyond, min-label hooking with pointer jumping: each round every node takes the smallest label in its
    neighbourhood, then the label of its label; labels are re-read from the shared folder, so the plan stays
    short. Partial aggregation runs before each shuffle, so a node with many edges is no hot spot.
    Nodes without edges do not appear. Labels only fall, so the rounds end; the driver sees whether any has changed.
    """
    if edges.count() <= FEW_EDGES:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [[np.asarray(batch.column(k), np.int64) for k in (0, 1)] for batch in batches]
            a, b = (np.concatenate([np.empty(0, np.int64), *[x[k] for x in got]]) for k in (0, 1))
            nodes, least = least_labels(a, b)
            for at in range(0, len(nodes), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + (1 << 16)]), pa.array(least[at : at + (1 << 16)])], names=["node", "component"])

        return materialize(edges.select("a", "b").where("a <> b").coalesce(1).mapInArrow(run, "node long, component long"), "cc-labels")
    spark = edges.sparkSession
    both = materialize(edges.select("a", "b").where("a <> b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(), "cc-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "cc-labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        new = labels.join(near, "node").select("node", F.least("label", "low").alias("step"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("step"), F.col("label").alias("far"))
        new = new.join(jump, "step", "left").select("node", F.least("step", F.coalesce("far", "step")).alias("label"), "old")
        new = materialize(new, "cc-labels")
        moved = new.where("label <> old").limit(1).count()
        release(spark, labels)
        labels = new.select("node", "label")
        if not moved:
            release(spark, both)
            break
    return labels.select("node", F.col("label").alias("component"))


# ---------------------------------------------------------------- worker caches


class Lexicon:
    """A bounded worker cache from strings to encodings, read by whole batches with numpy.

    A string is known by two independent 64-bit hashes: the first finds its entry, the second must agree; a string whose
    first hash is taken by another one gets an entry of its own. ``make(words)`` returns (sizes, [flat arrays]): the encodings of the words one behind the other. Entries
    made by ``pin`` are never dropped; of the others the less used half goes when there are ``limit`` of them.
    Hashes sit in an open-addressing table of at most half load.
    """

    def __init__(self, make, limit: int):
        self.make, self.limit = make, limit
        self.fixed = 0
        self.size = np.zeros(0, np.int64)
        self.flat: list[np.ndarray] = []
        self.used = np.zeros(0, np.int64)
        self.key = np.zeros(0, np.uint64)
        self.check = np.zeros(0, np.uint64)
        self._rehash(1 << 16)

    def _rehash(self, slots: int) -> None:
        self.slots = slots
        self.table = np.full(slots, -1, np.int32)
        self._place(np.arange(len(self.key)))

    def _place(self, entries: np.ndarray) -> None:
        mask = _U(self.slots - 1)
        slot = (self.key[entries] & mask).astype(np.int64)
        while len(entries):
            free = self.table[slot] < 0
            self.table[slot[free]] = entries[free]
            left = self.table[slot] != entries
            entries, slot = entries[left], (slot[left] + 1) & (self.slots - 1)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        out = self.table[(hashes & _U(self.slots - 1)).astype(np.int64)].astype(np.int64)
        if len(self.key) == 0:
            return out
        open_ = np.flatnonzero((out >= 0) & (self.key[out] != hashes))
        slot = (hashes[open_] & _U(self.slots - 1)).astype(np.int64)
        while len(open_):
            slot = (slot + 1) & (self.slots - 1)
            got = self.table[slot].astype(np.int64)
            out[open_] = got
            left = (got >= 0) & (self.key[got] != hashes[open_])
            open_, slot = open_[left], slot[left]
        return out

    def _add(self, hashes: np.ndarray, checks: np.ndarray, words: list[str]) -> None:
        sizes, flat = self.make(words)
        old = len(self.key)
        self.key = np.concatenate([self.key, hashes])
        self.check = np.concatenate([self.check, checks])
        self.size = np.concatenate([self.size, sizes])
        self.flat = [np.concatenate([a, b]) for a, b in zip(self.flat, flat, strict=True)] if self.flat else list(flat)
        self.used = np.concatenate([self.used, np.zeros(len(words), np.int64)])
        self.start = np.cumsum(self.size) - self.size
        if 2 * len(self.key) > self.slots:
            self._rehash(1 << (4 * len(self.key)).bit_length())
        else:
            self._place(np.arange(old, len(self.key)))

    def _shrink(self) -> None:
        own = self.used[self.fixed :]
        keep = np.concatenate([np.arange(self.fixed), self.fixed + np.sort(np.argsort(-own, kind="stable")[: self.limit // 2])])
        self.flat = [self.gather(a, keep) for a in self.flat]
        self.size, self.used, self.key, self.check = self.size[keep], self.used[keep] // 2, self.key[keep], self.check[keep]
        self.start = np.cumsum(self.size) - self.size
        self._rehash(self.slots)

    def pin(self, hashes: np.ndarray, checks: np.ndarray, words: list[str]) -> None:
        self._add(hashes, checks, words)
        self.fixed = len(self.key)

    def lookup(self, hashes: np.ndarray, checks: np.ndarray, word) -> np.ndarray:
        """The entry of each string; ``word(k)`` gives the k-th one. Entries hold until the next call."""
        if len(self.key) - self.fixed > self.limit:
            self._shrink()
        entries = self._entries(hashes, checks, word)
        self.used += np.bincount(entries, minlength=len(self.used))
        return entries

    def _entries(self, hashes: np.ndarray, checks: np.ndarray, word) -> np.ndarray:
        entries = self._find(hashes)
        miss = np.flatnonzero(entries < 0)
        if len(miss):
            new, first = np.unique(hashes[miss], return_index=True)
            self._add(new, checks[miss][first], [word(k) for k in miss[first].tolist()])
            entries[miss] = self._find(hashes[miss])
        other = np.flatnonzero(self.check[entries] != checks)
        if len(other):
            entries[other] = self._entries(mix(hashes[other] + checks[other]), checks[other], lambda k: word(other[k]))
        return entries

    def gather(self, flat: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """The encodings of the entries, one behind the other."""
        size = self.size[entries]
        total = int(size.sum())
        shift = np.repeat(self.start[entries] - (np.cumsum(size) - size), size)
        return flat[np.arange(total) + shift]


_SPACE_LIKE = np.zeros(256, bool)
_SPACE_LIKE[[*range(9, 14), *range(28, 33)]] = True
_ODD_LEAD = np.zeros(256, bool)
_ODD_LEAD[[0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True


def chunk_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of the pieces of every row between single spaces, and for each row the index of its first one.

    A row without bytes has one empty piece, as with str.split(" ").
    """
    gap = np.flatnonzero(data == 0x20)
    st = np.concatenate([offsets[:-1], gap + 1])
    en = np.concatenate([offsets[1:], gap])
    st.sort()
    en.sort()
    first = np.searchsorted(gap, offsets) + np.arange(len(offsets))
    return st, en, first


def unsafe_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows where a space touches other white space or an edge, or that hold white space that engines class differently."""
    n = len(data)
    bad = np.zeros(len(offsets) - 1, bool)
    if n == 0:
        return bad
    space, any_ = data == 0x20, _SPACE_LIKE[data]
    at = np.flatnonzero((space[:-1] & any_[1:]) | (any_[:-1] & space[1:]))
    odd = np.flatnonzero(any_ & (data >= 28) & (data < 32))
    lead = np.flatnonzero(_ODD_LEAD[data])
    if len(lead):
        pad = np.concatenate([data, np.zeros(2, np.uint8)])
        a, b, c = pad[lead], pad[lead + 1], pad[lead + 2]
        hit = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80)
        hit |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8F) | (c >= 0xA8) & (c <= 0xAF)) | (b == 0x81) & (c >= 0x9F) & (c <= 0xAF))
        hit |= (a == 0xE3) & (b == 0x80) & (c == 0x80) | (a == 0xEF) & (b == 0xBB) & (c == 0xBF)
        odd = np.concatenate([odd, lead[hit]])
    filled = np.flatnonzero(np.diff(offsets) > 0)
    bad[filled] |= space[offsets[filled]] | space[offsets[filled + 1] - 1]
    for x in (at, odd):
        if len(x):
            bad[np.searchsorted(offsets, x, side="right") - 1] = True
    return bad


def chunk_hashes(data: np.ndarray, st: np.ndarray, en: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of every run."""
    return run_hashes(data, st, en), run_hashes(data, st, en, seed=1)


def chunk_hash(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [w.encode() for w in words]
    en = np.cumsum([len(r) for r in raw]).astype(np.int64)
    return chunk_hashes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], en[:-1]]).astype(np.int64), en)
