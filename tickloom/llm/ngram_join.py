"""N-gram Jaccard self-join with token-combination prefixes.

A document's set are its distinct shingles of five words (all words as one with fewer); two documents link when
intersection / union >= 4/5. Documents with equal sets are one node, so exact copies cost one row. A pair at the threshold
shares at least ceil(4n/5) of either set, so of a set of n at most floor(n/5) shingles may be lacking in the other.

Who can link at all. Every shingle whose hash lies under TAU of the hash range is indexed by one shuffle, and so has its exact
document frequency. A shingle that only one node has is lacking in every other one, so a node with more than floor(n/5) such
shingles links with nothing and goes; most documents end here. The rest is indexed again, with all its shingles.

Candidates. A set's shingles are ordered by (class, hash): those of one node, rare ones (2 to FEW nodes), frequent ones (more), very
frequent ones (a share of the corpus, by a counting sketch). A prefix indexes single shingles of rare class, but
2- or 3-combinations of the frequent classes, formed inside buckets of its shingles; m shingles of a bucket count m - k + 1,
those of one node count each and are not indexed, and the prefix is extended until the counts exceed floor(n/5). Then
a pair shares a signature: of the two prefixes take the one that ends first in the order; what it shares with the other
set lies in the other prefix too, and with less than k shared in every bucket more than floor(n/5) would be lacking. The number
of buckets follows the set's size class, and a set near the upper end of its class also signs for the next one, as its larger
partners do. Sets of less than SMALL shingles index single shingles of all classes. Class bounds shape the order only; the
result doesn't depend on them.

Very frequent shingles are found by a counting sketch: tasks send the cells that are heavy among their own documents, the sums
give the class of a cell, and at most about avg(n) / PHI cells can be heavy, whatever the corpus' size. They are not indexed
alone: each counts as shared.

Links without pairs. Signature lists are long where thousands of documents are near copies, and all their pairs must not be
emitted. So each list first proposes only (member, pivot), the pivot being the list's least node in a random priority, and a node
takes the one that most of its lists propose; proposals are verified exactly and connected components found. Up to ROUNDS times more, as long
as a round settles a tenth of the rows, those outside a list's largest component are asked against one node inside. Lists inside one component are settled, and of lists with the
same members one is enough. In what is left members of different components meet by their parity sketches. A list of up to BLOCK
members meets whole within a task; a longer one is cut into parts of BLOCK, at most PARTS of them, and part meets part. So a member is sent PARTS times at
most: rows follow the lists' length, not its square, while the sketches compared within tasks do grow with the square. A task emits only the pairs that sizes and sketches can't prove to be below the
threshold: no link between components is lost, and no group's pairs become rows. A pair that meets in many lists is emitted by the
first of them, as far as the LOW least lists of both tell. Verification compares the exact shingle sets
of the texts (64-bit hashes).

Lists of frequent shingles' signatures are salted in the first round, so a signature held by a third of all rows is
spread, and its salted pivots meet in a second step.

Defined results: null, empty and blank texts have n_shingles 0 and link with nothing; equal rows link with each other
(if they have words); ids are whole numbers or null, repeated ids are rows of their own, and a group's component_id is its
smallest id that is not null (null if it has none); other columns stay out of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _U, aside, bloom, components, i64, lean, materialize, maybe_in, mix, named, release, shingles, slices

NUM, DEN = 4, 5
CELLS = 1 << 22
PHI = (1 / 1000, 1 / 20)
LEAST = 64
SMALL = 32
TAU = 0.3
FEW = 16
BLOCK = 4096
PARTS = 8
ROUNDS = 3
PAYS = 0.9
LOW = 16
SMALL_SKETCH = 256
SALTS = 32
SKETCH_BITS = (512, 1 << 16)


def needed(n: int) -> int:
    """How many shingles of a set of n a partner shares at least."""
    return -(-NUM * n // DEN)


def _regimes(n: int) -> list[int]:
    """Size classes that a set signs for: its own and that of its largest partner; 0 is single shingles only."""
    regime = lambda x: 0 if x < SMALL else x.bit_length()
    return sorted({regime(n), regime(n * DEN // NUM)})


def signatures(n: int, alone: int, s: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set of n shingles and whether each is of a frequent class.

    ``alone`` of the shingles occur in no other set; ``s`` are the others (distinct hashes), of classes 1 to 3.
    """
    order = np.lexsort((s, cls))
    s, cls = s[order], cls[order]
    error = n - needed(n)
    rare, take = int(np.searchsorted(cls, 2)), max(0, error + 1 - alone)
    if rare >= take:
        return s[:take], np.zeros(take, bool)
    out: list[np.ndarray] = []
    hot: list[np.ndarray] = []
    for regime in _regimes(n):
        if regime == 0:
            out.append(s[:take])
            hot.append(cls[:take] > 1)
            continue
        buckets = max(1, (1 << regime) // 64)
        bucket = np.where(cls > 1, (mix(s ^ _U(0xC2B2AE3D)) % _U(buckets)).astype(np.int64), 0)
        held: dict[tuple[int, int], list[int]] = {}
        count, end = alone + rare, rare
        while count <= error and end < len(s):
            k = int(cls[end])
            mine = held.setdefault((k, int(bucket[end])), [])
            mine.append(int(s[end]))
            count += len(mine) >= k
            end += 1
        if count <= error:
            raise AssertionError("a set of SMALL shingles or more always has enough combinations")
        combos = []
        for (k, b), tokens in held.items():
            tokens.sort()
            for combo in combinations(tokens, k):
                combos.append((k << 32 | b, *combo, *[0] * (3 - k)))
        out.append(s[:rare])
        hot.append(np.zeros(rare, bool))
        if combos:
            c = np.array(combos, np.uint64)
            h = mix(c[:, 0] ^ _U(regime << 48))
            for j in range(1, 4):
                h = mix(h * _U(0xD6E8FEB86659FD93) + c[:, j])
            out.append(h)
            hot.append(np.ones(len(h), bool))
    flat, at = np.unique(np.concatenate(out), return_index=True)
    return flat, np.concatenate(hot)[at]


def sketch(s: np.ndarray) -> bytes:
    """Parity of the set's hashes in a power of two of bits, twice the set's size at least (within SKETCH_BITS)."""
    bits = min(max(SKETCH_BITS[0], 1 << (2 * len(s) - 1).bit_length()), SKETCH_BITS[1])
    bit = (mix(s ^ _U(0x27220A95)) & _U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(a: bytes, size: int) -> np.ndarray:
    """A sketch of the same set in at most ``size`` bytes."""
    x = np.frombuffer(a, np.uint8)
    return np.bitwise_xor.reduce(x.reshape(-1, size), axis=0) if len(x) > size else x


def hamming(a: bytes, b: bytes) -> int:
    """Distance of two sketches, the longer one folded: at most the size of the symmetric difference of the sets."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())


def near_pairs(component: np.ndarray, n: np.ndarray, bits: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of different components that sizes and sketches can't prove to be below the threshold."""
    order = np.argsort(n, kind="stable")
    n, component = n[order], component[order]
    end = np.searchsorted(n * NUM, n * DEN, side="right")  # partners of the i-th set are at most as large
    out = [np.empty((2, 0), np.int64)]
    step = max(1, min(128, (1 << 22) // max(1, len(n))))
    for lo in range(0, len(n), step):
        hi, last = min(lo + step, len(n)), int(end[min(lo + step, len(n)) - 1])
        size = min(len(bits[k]) for k in order[lo:hi])
        words = np.stack([folded(bits[k], size) for k in order[lo:last]]).view(np.uint64)
        far = np.zeros((hi - lo, last - lo), np.int64)
        for w in range(words.shape[1]):
            far += np.bitwise_count(words[: hi - lo, None, w] ^ words[None, :, w])
        at = np.arange(lo, last)
        ok = (n[lo:hi, None] + n[None, lo:last] >= (NUM + DEN) * far) & (component[lo:hi, None] != component[None, lo:last])
        ok &= (at[None, :] > at[: hi - lo, None]) & (at[None, :] < end[lo:hi, None])
        i, j = np.nonzero(ok)
        out.append(np.stack([order[lo + i], order[lo + j]]))
    return tuple(np.concatenate(out, axis=1))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, part, node, component, n, bits, low) sorted by sig and part -> the pairs (a < b) of nodes of each part that may link.

    ``low`` are the least signatures of the node: a pair that has one below this one in common has met there. A part is
    held until its last row has come: about 2 BLOCK rows, or of lists of more than BLOCK * PARTS members a quarter.
    """
    rest: pa.Table | None = None

    def met_before(low: np.ndarray, sig: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        for at in range(0, len(i), 20_000):
            x, y = low[i[at : at + 20_000]], low[j[at : at + 20_000]]
            out[at : at + 20_000] = ((x[:, :, None] == y[:, None, :]) & (x < sig)[:, :, None]).any(axis=(1, 2))
        return out

    def pairs(table: pa.Table) -> pa.RecordBatch:
        sig, part, node, component, n = (np.asarray(table.column(c), np.int64) for c in ("sig", "part", "node", "component", "n"))
        bits = table.column("bits").to_pylist()
        lists = table.column("low").combine_chunks()
        count = np.asarray(lists.value_lengths(), np.int64)
        low = np.full((len(sig), LOW), np.iinfo(np.int64).max)
        low[np.arange(LOW)[None, :] < count[:, None]] = np.asarray(lists.flatten(), np.int64)
        edge = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (part[1:] != part[:-1])]))
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(sig)], strict=True):
            i, j = near_pairs(component[lo:hi], n[lo:hi], bits[lo:hi])
            first = ~met_before(low[lo:hi], sig[lo], i, j)
            x, y = node[lo + i[first]], node[lo + j[first]]
            a.append(np.minimum(x, y))
            b.append(np.maximum(x, y))
        found = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now])
        sig, part = (np.asarray(now.column(c), np.int64) for c in ("sig", "part"))
        cut = int(np.flatnonzero((sig != sig[-1]) | (part != part[-1]))[-1]) + 1 if (sig[0], part[0]) != (sig[-1], part[-1]) else 0
        if cut:
            yield pairs(now.slice(0, cut))
        rest = now.slice(cut).combine_chunks()
    if rest is not None and rest.num_rows:
        yield pairs(rest)


def _identity(s: np.ndarray) -> bytes:
    """A 128-bit identity of a set (sorted distinct hashes)."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    values, off = shingles(column)
    for r in range(len(off) - 1):
        yield np.unique(values[off[r] : off[r + 1]])


def heavy_cells(texts: DataFrame) -> np.ndarray:
    """The class (1 to 3) of every cell of the sketch, from document frequencies over the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, docs = np.zeros(CELLS, np.int32), 0
        for batch in slices(batches, "text"):
            for s in _sets(batch.column(0)):
                count[(s & _U(CELLS - 1)).astype(np.int64)] += 1
            docs += batch.num_rows
        cell = np.flatnonzero(count >= max(2, PHI[0] * docs / 2))
        cells = np.concatenate([[-1], cell]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.concatenate([[docs], count[cell]]).astype(np.int64))], names=["cell", "n"])

    got = texts.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    docs = got.where("cell = -1").first()
    total = docs.n if docs else 0
    out = np.ones(CELLS, np.int8)
    heavy = got.where((F.col("cell") >= 0) & (F.col("n") >= max(LEAST, PHI[0] * total))).toArrow()
    cell, n = (np.asarray(heavy.column(c), np.int64) for c in ("cell", "n"))
    out[cell] = np.where(n >= max(2 * LEAST, PHI[1] * total), 3, 2)
    return out


def row_key(id_col: str, text_col: str):
    """A 128-bit identity of a row's id and text; nulls are told from empty texts."""
    text = F.coalesce(F.concat(F.lit("="), F.col(text_col).cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat_ws("\x1f", F.coalesce(F.col(id_col).cast("string"), F.lit("")), text)))


def _sketches(sets: list[np.ndarray]) -> tuple[list[bytes], list[bytes]]:
    """The sketches, and forms of at most SMALL_SKETCH bytes."""
    full = [sketch(s) for s in sets]
    return full, [folded(x, SMALL_SKETCH).tobytes() for x in full]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    off = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in arrays])]), pa.int32())
    return pa.ListArray.from_arrays(off, pa.array(i64(np.concatenate(arrays))))


def _indexed(src: DataFrame, classes) -> DataFrame:
    """(id, rk, n, set, node, toks) of every row: size, identity (null without words), its first half, and the shingles under TAU that aren't very frequent."""
    top = _U(int(TAU * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls = classes.value
        for batch in slices(batches, "text"):
            sets = list(_sets(batch.column(2)))
            names = [_identity(s) if len(s) else None for s in sets]
            low = [s[: np.searchsorted(s, top)] for s in sets]
            toks = [s[cls[(s & _U(CELLS - 1)).astype(np.int64)] == 1] for s in low]
            node = [None if k is None else int.from_bytes(k[:8], "little", signed=True) for k in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array(node, pa.int64()), _lists(toks)], names=["id", "rk", "n", "set", "node", "toks"])

    return src.select("id", "rk", "text").mapInArrow(run, "id long, rk binary, n long, set binary, node long, toks array<long>")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (t, node) rows -> (t, node, cls) of shingles with two nodes or more, equal rows once; cls 1 with at most FEW nodes, else 2.

    Streams: of a run at most FEW rows are held back until its class is known.
    """
    last, tail, held, long = (None, None), None, np.empty(0, np.int64), False
    batch_of = lambda t, node, cls: pa.RecordBatch.from_arrays([pa.array(t), pa.array(node), pa.array(cls.astype(np.int8))], names=["t", "node", "cls"])
    for batch in batches:
        t, node = (np.asarray(batch.column(c), np.int64) for c in ("t", "node"))
        if not len(t):
            continue
        fresh = np.ones(len(t), bool)
        fresh[1:] = (t[1:] != t[:-1]) | (node[1:] != node[:-1])
        fresh[0] = (t[0], node[0]) != last
        last = (t[-1], node[-1])
        t, node = t[fresh], node[fresh]
        if len(held):
            t, node = np.concatenate([np.full(len(held), tail), t]), np.concatenate([held, node])
        if not len(t):
            continue
        edge = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        size = np.diff(np.append(edge, len(t)))
        cls = np.where(size > FEW, 2, (size > 1).astype(np.int64))
        if long and t[0] == tail:
            cls[0] = 2
        long, tail = bool(cls[-1] == 2), t[-1]
        held = np.empty(0, np.int64)
        if not long:
            held, cls[-1] = node[edge[-1] :], 0
        each = np.repeat(cls, size)
        out = each > 0
        if out.any():
            yield batch_of(t[out], node[out], each[out])
    if len(held) > 1:
        yield batch_of(np.full(len(held), tail), held, np.ones(len(held)))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, cls, t) sorted by node and cls -> (sig, hot, node).

    cls -2 and -1 bring the set's size and how many of its shingles were indexed; 1 and 2 are indexed ones that others have, 4 and 5
    very frequent ones. A set is held until its last row has come.
    """
    rest = None

    def signed(node: np.ndarray, cls: np.ndarray, t: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        sigs, hots, own = [np.empty(0, np.uint64)], [np.empty(0, bool)], [np.empty(0, np.int64)]
        for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(node)], strict=True):
            n, indexed = int(t[lo]), int(t[lo + 1])
            c = cls[lo + 2 : hi]
            alone = indexed - int((c < 3).sum())
            if alone > n - needed(n):
                continue
            sig, hot = signatures(n, alone, t[lo + 2 : hi].view(np.uint64), np.where(c > 3, c - 2, c))
            sigs.append(sig)
            hots.append(hot)
            own.append(np.full(len(sig), node[lo]))
        return pa.RecordBatch.from_arrays([pa.array(i64(np.concatenate(sigs))), pa.array(np.concatenate(hots)), pa.array(np.concatenate(own))], names=["sig", "hot", "node"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [np.asarray(batch.column(c), np.int64) for c in ("node", "cls", "t")]
        now = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if cut:
            yield signed(*[x[:cut] for x in now])
        rest = [x[cut:] for x in now]
    if rest is not None and len(rest[0]):
        yield signed(*rest)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (sig, hot, prio, node) rows -> (sig, hot, node, pivot) of signatures with two nodes or that are hot; equal rows once.

    Streams: a run may be longer than any batch; only its first node is kept.
    """
    last_sig = last_node = pivot = None
    waiting = None  # the first row of a run, until a second node shows up
    for batch in batches:
        sig, node = (np.asarray(batch.column(c), np.int64) for c in ("sig", "node"))
        hot = np.asarray(batch.column("hot").to_pylist(), bool)
        if not len(sig):
            continue
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        fresh[0] = sig[0] != last_sig or node[0] != last_node
        sig, node, hot = sig[fresh], node[fresh], hot[fresh]
        if not len(sig):
            continue
        head = np.ones(len(sig), bool)
        head[1:] = sig[1:] != sig[:-1]
        head[0] = sig[0] != last_sig
        start = np.maximum.accumulate(np.where(head, np.arange(len(sig)), -1))
        piv = np.where(start >= 0, node[np.maximum(start, 0)], pivot if pivot is not None else 0)
        single = head.copy()
        single[:-1] &= head[1:]
        single[-1] = head[-1]  # undecided: kept waiting
        out = ~single | hot
        held = None
        if head[-1] and not hot[-1]:
            out[-1] = False
            held = int(sig[-1]), int(node[-1])
        cols = [sig[out], hot[out], node[out], piv[out]]
        if waiting is not None and not head[0]:
            cols = [np.concatenate([[x], c]) for x, c in zip((waiting[0], False, waiting[1], waiting[1]), cols, strict=True)]
        waiting = held
        last_sig, last_node, pivot = int(sig[-1]), int(node[-1]), int(piv[-1])
        if len(cols[0]):
            yield pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(bool)), pa.array(cols[2].astype(np.int64)), pa.array(cols[3].astype(np.int64))], names=["sig", "hot", "node", "pivot"])


def _verify(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of distinct nodes whose exact similarity reaches the threshold.

    ``nodes`` has node, n, sketch, text. Sizes and sketches go first: overlap <= (n_a + n_b - Hamming) / 2. Only the
    pairs that these can't exclude fetch texts.
    """
    small = nodes.select("node", "n", "sketch")
    left, right = (small.select(*[F.col(c).alias(f"{x}{c}") for c in small.columns]) for x in ("a_", "b_"))
    sized = F.least("a_n", "b_n") * DEN >= F.greatest("a_n", "b_n") * NUM
    near = pairs.join(left, F.col("a") == F.col("a_node")).join(right, F.col("b") == F.col("b_node")).where(sized)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.asarray(batch.column(2), np.int64)
            far = np.array([hamming(x, y) for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)], np.int64)
            # intersection >= 4/9 of the sum of sizes
            ok = (total - far) * (NUM + DEN) >= 2 * NUM * total
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))

    near = materialize(near.select("a", "b", F.col("a_n") + F.col("b_n"), "a_sketch", "b_sketch").mapInArrow(sift, "a long, b long"), "near")
    # of the texts only those of the remaining pairs are shuffled
    ends = near.select(F.col("a").alias("k")).union(near.select("b"))
    texts = maybe_in(nodes.select("node", "text", F.col("node").alias("k")), bloom(ends)).where("__maybe").select("node", "text")
    full = near.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ta"):
            ok = np.array([NUM * (len(x) + len(y) - (both := len(np.intersect1d(x, y, assume_unique=True)))) <= DEN * both for x, y in zip(_sets(batch.column(2)), _sets(batch.column(3)), strict=True)], bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))

    found = materialize(full.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"), "verified")
    release(pairs.sparkSession, near)
    return found


def _unsettled(lists: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of the signatures whose nodes lie in more than one component of ``links``, with their own and the signature's largest component."""
    rows = lists.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    size = rows.groupBy("sig", "component").agg(F.count("*").alias("m"))
    best = size.groupBy("sig").agg(F.count("*").alias("parts"), F.max(F.struct("m", "component")).alias("top")).where("parts > 1")
    # a table of its own, so that AQE can split the rows of a long list in the join
    return materialize(rows.join(materialize(best.select("sig", F.col("top.component").alias("main")), "unsettled"), "sig"), "open")


def parts_of(open_: DataFrame) -> DataFrame:
    """Rows (node, sig, component, part) for rows with m, their list's length: a list in at most PARTS parts, each with itself and each other one."""
    parted = open_.withColumn("of", F.expr(f"cast(least((m + {BLOCK} - 1) div {BLOCK}, {PARTS}) as int)")).withColumn("own", F.pmod(F.xxhash64("node", F.lit(2)), F.col("of")).cast("int"))
    parted = parted.withColumn("other", F.explode(F.when(F.col("of") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("of") - 1))))
    return parted.select("node", "sig", "component", (F.least("own", "other") * F.col("of") + F.greatest("own", "other")).cast("long").alias("part"))


def _candidates(src: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members (id, rk, n, set), and the nodes (node, set, n, sketch, bits, text, cold, hot, cls) that may link: one row for each set."""
    spark = src.sparkSession
    classes = spark.sparkContext.broadcast(heavy_cells(src.select("text")))
    indexed = materialize(_indexed(src, classes), "sets")
    rows = indexed.where("node is not null").select("node", F.explode("toks").alias("t"))
    shared = rows.repartition("t").sortWithinPartitions("t", "node").select("t", "node").mapInArrow(_shared, "t long, node long, cls byte").groupBy("node").agg(F.count("*").alias("others"))
    members = materialize(indexed.select("id", "rk", "n", "set", "node", F.size("toks").alias("m")), "members")
    shared = materialize(shared, "shared")
    release(spark, indexed)
    sets = members.where("node is not null").groupBy("set").agg(F.min("rk").alias("rk"), F.first("n").alias("n"), F.first("m").alias("m"), F.first("node").alias("node"))
    open_ = sets.join(shared, "node", "left").where(F.col("m") - F.coalesce("others", F.lit(0)) <= F.expr(f"n div {DEN}"))
    chosen = materialize(open_.select("rk", "set"), "chosen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = classes.value
        for batch in slices(batches, "text"):
            own = list(_sets(batch.column(1)))
            cls = [heavy[(s & _U(CELLS - 1)).astype(np.int64)] for s in own]
            cold = _lists([s[c == 1] for s, c in zip(own, cls, strict=True)])
            hot = [(s[c > 1], c[c > 1].astype(np.int64)) for s, c in zip(own, cls, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in own], pa.int64()), *[pa.array(x, pa.binary()) for x in _sketches(own)], batch.column(1), cold, *[_lists([h[j] for h in hot]) for j in (0, 1)]], names=["set", "n", "sketch", "bits", "text", "cold", "hot", "cls"])

    # only documents that the bounded filter lets through are shuffled; equal rows once
    some = maybe_in(src.withColumn("k", F.col("rk")), bloom(chosen.select(F.col("rk").alias("k")))).where("__maybe").select("rk", "text").dropDuplicates(["rk"])
    nodes = some.join(chosen, "rk").select("set", "text").mapInArrow(run, "set binary, n long, sketch binary, bits binary, text string, cold array<long>, hot array<long>, cls array<long>")
    return members.drop("node", "m"), materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")


def links(src: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The members and nodes of ``src`` (id, rk, text), and verified links (a, b) between nodes.

    The links connect exactly what all links would; a list of near copies gives its pivots' links, not all pairs.
    """
    spark = lean(src.sparkSession)
    members, nodes = _candidates(src)
    rows = nodes.select("node", F.explode("cold").alias("t"))
    shared = rows.repartition("t").sortWithinPartitions("t", "node").select("t", "node").mapInArrow(_shared, "t long, node long, cls byte")
    # very frequent shingles count as shared; size and number of indexed shingles come first
    every = nodes.select("node", F.explode(F.arrays_zip("hot", "cls")).alias("h")).select("node", (F.col("h.cls") + 2).cast("byte").alias("cls"), F.col("h.hot").alias("t"))
    size = nodes.select("node", F.explode(F.array(F.struct(F.lit(-2).cast("byte").alias("cls"), F.col("n").alias("t")), F.struct(F.lit(-1).cast("byte").alias("cls"), F.size("cold").cast("long").alias("t")))).alias("h")).select("node", "h.*")
    all_ = shared.select("node", "cls", "t").unionByName(every).unionByName(size)
    flat = materialize(all_.repartition("node").sortWithinPartitions("node", "cls").mapInArrow(_sign, "sig long, hot boolean, node long"), "signatures")

    flat = flat.withColumn("prio", F.xxhash64("node"))
    salted = flat.repartition("sig", F.when(F.col("hot"), F.pmod("prio", F.lit(SALTS))).otherwise(0))
    runs = materialize(salted.sortWithinPartitions("sig", "prio", "node").select("sig", "hot", "prio", "node").mapInArrow(_runs, "sig long, hot boolean, node long, pivot long"), "runs")
    # hot signatures: the pivots of the salted runs meet
    top = runs.where("hot").groupBy("sig").agg(F.min(F.struct(F.xxhash64("pivot").alias("prio"), "pivot")).alias("top"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("sig", F.col("top.pivot").alias("head"))
    top = materialize(top, "heads")
    hot = runs.where("hot").join(top, "sig")
    every = materialize(runs.where("not hot").select("sig", "node", F.col("pivot").alias("head")).unionByName(hot.select("sig", "node", "head")), "lists")
    release(spark, flat, runs, top)
    # of lists with the same members one is enough
    print_ = every.groupBy("sig").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("y"))
    one = materialize(print_.groupBy("m", "x", "y").agg(F.min("sig").alias("sig")).select("sig", "m"), "distinct-lists")
    lists = materialize(every.join(one, "sig"), "lists")
    release(spark, every, one)

    pair = lambda p: p.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # first the pivot that most of a node's lists propose: one text fetched a node
    star = lists.select(F.col("node").alias("a"), F.col("head").alias("b"), "sig").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("m"))
    found = _verify(pair(star.groupBy("a").agg(F.max_by("b", F.struct("m", "b")).alias("b"))), nodes)
    open_ = _unsettled(lists, found)
    release(spark, lists)
    # then, a few times, some node of a list's largest component for those outside it: again one for each node
    left = open_.count()
    for k in range(ROUNDS):
        if not left:
            break
        lead = open_.where("component = main").groupBy("sig").agg(F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("p"), F.col("node").alias("b"))).alias("top"))
        lead = materialize(lead.select("sig", "top.b"), "pivots")
        asked = open_.where("component <> main").select("sig", F.col("node").alias("a")).join(lead, "sig").groupBy("a", "b").agg(F.count("*").alias("m"))
        found = found.union(_verify(pair(asked.groupBy("a").agg(F.max_by("b", F.struct("m", "b")).alias("b"))), nodes))
        was, open_ = open_, _unsettled(open_.select("sig", "node", "m"), found)
        release(spark, lead, was)
        before, left = left, open_.count()
        if left > PAYS * before:
            break
    if not left:
        return members, nodes, found
    # whatever is still apart meets by its sketches
    parted = parts_of(open_)
    low = open_.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("sig")), 1, LOW).alias("low"))
    known = materialize(nodes.select("node", "n", "bits").join(low, "node"), "known")
    met = parted.join(known, "node").select("sig", "part", "node", "component", "n", "bits", "low")
    met = met.repartition("sig", "part").sortWithinPartitions("sig", "part").mapInArrow(_meet, "a long, b long")
    found = found.union(_verify(met.distinct(), nodes))
    release(spark, open_, known)
    return members, nodes, found


def _groups(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The members (id, rk, n, set), and for every set its group (one of the group's sets)."""
    at = lambda c: f"`{c}`"
    src = docs.select(F.col(at(id_col)).cast("long").alias("id"), row_key(at(id_col), at(text_col)).alias("rk"), F.col(at(text_col)).cast("string").alias("text"))
    members, nodes, found = links(src)
    comp = components(found)
    name = nodes.select("node", "set")
    # labels come back as sets: nodes that link with nothing have none
    roots = comp.join(name, "node").select("component", "set").join(name.select(F.col("node").alias("component"), F.col("set").alias("root")), "component")
    sets = members.where("set is not null").select("set").distinct()
    groups = materialize(sets.join(roots.select("set", "root"), "set", "left").select("set", F.coalesce("root", "set").alias("root")), "groups")
    release(docs.sparkSession, nodes, found, comp)
    return members, groups


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_shingles, component_id), one per row of ``docs``; component_id is the smallest id reachable by links."""
    members, groups = _groups(docs, id_col, text_col)
    least = members.where("set is not null").groupBy("set").agg(F.min("id").alias("least"))
    low = groups.join(least, "set").groupBy("root").agg(F.min("least").alias("low"))
    # by set, as a table: a set may have a third of all rows, which AQE can split
    by_set = materialize(groups.join(low, "root").select("set", "low"), "lows")
    out = members.where("set is not null").join(by_set, "set").select("id", "n", "low").unionByName(members.where("set is null").select("id", "n", F.col("id").alias("low")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("low").alias("component_id"))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: the smallest id (null last), of rows that share it the least by a hash of the text.

    Rows of equal id and text are one row's repeats, of which any one stays. Rows without words stay, each.
    """
    spark = lean(docs.sparkSession)
    members, groups = _groups(docs, id_col, text_col)
    each = members.where("set is not null").groupBy("set", "rk").agg(F.first("id").alias("id"), F.count("*").alias("times")).join(groups, "set")
    pick = each.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "rk")).alias("p")).select("root", F.col("p.rk").alias("keep"))
    each = each.join(pick, "root").select("rk", "times", (F.col("rk") == F.col("keep")).alias("stays"))
    odd = materialize(each.where("not stays or times > 1").select("rk", "stays"), "dropped")
    release(spark, groups)
    flat, names = aside(docs)
    own = {c: f"f{j}" for j, c in enumerate(names)}
    keyed = maybe_in(flat.withColumn("k", row_key(own[id_col], own[text_col])), bloom(odd.select(F.col("rk").alias("k"))))
    sure = keyed.where("not __maybe").select(*own.values())
    judged = keyed.where("__maybe").join(odd, F.col("k") == F.col("rk"), "left")
    other = judged.where("stays is null").select(*own.values())
    once = judged.where("stays").dropDuplicates(["rk"]).select(*own.values())
    return named(sure.unionByName(other).unionByName(once), names)
