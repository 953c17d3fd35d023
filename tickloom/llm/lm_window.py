"""Masked pseudo-likelihood over a vocabulary and parameters that grow with the corpus.

Every token is predicted from the SPAN tokens on either side: h = tanh(sum of D[j] * E[neighbour j] + c), and
log P(token | neighbours) is the sum over the token's path in a Huffman tree of log sigmoid(+-(W[node] h + b[node])). The
tree makes the distribution over its leaves exact at the cost of a path. A document's score is the sum over its tokens.

Tokens are words between white space, A-Z lower-cased. The leaves are all words with at least ``least`` occurrences
and one for all rarer words; ``least`` is chosen so that about GROWTH * sqrt(tokens) words reach it. As a
neighbour a rarer word has one of a quarter as many hashed rows; as a target it costs its leaf and its spelling under
byte trigrams of all rarer words (a spelling of a frequent word keeps some of that mass).

Training is one pass over all tokens of the corpus: each task takes minibatch steps (row-wise Adagrad) from the same start,
whose biases are the exact frequencies, and the rows it changed are averaged over the tasks that changed them, by a
shuffle on blocks of rows. The driver gets the averaged rows and the spelling counts only.

Defined results: as in ``lm_scoring``, the small exact table over fixed classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Lexicon, add_columns, i64, materialize, release, run_hashes, slices, string_buffer, trim, word_bounds

SPAN = 2
HIDDEN = 16
GROWTH = 16
LEAST = 3
BATCH = 2048
TOP = 31
RATE = 0.05
BLOCK = 2048
SPELL_PARTS = 16
FEW = 6
_OFFSETS = [d for d in range(-SPAN, SPAN + 1) if d]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of a string column: hashes, row offsets, and bytes for spelling."""

    def __init__(self, column: pa.Array):
        self.data, offsets = string_buffer(column)
        self.st, self.en, self.first = word_bounds(self.data, offsets)
        self.hash = run_hashes(self.data, self.st, self.en, fold_case=True)

    def neighbours(self, ids: np.ndarray) -> np.ndarray:
        """ids of the words at each offset, 0 beyond a text's edge; shape (words, 2 SPAN)."""
        row = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        out = np.zeros((len(ids), len(_OFFSETS)), np.int32)
        for j, d in enumerate(_OFFSETS):
            to, at = (slice(-d, None), slice(None, d)) if d < 0 else (slice(None, -d), slice(d, None))
            out[to, j] = np.where(row[to] == row[at], ids[at], 0)
        return out

    def trigrams(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte trigrams of the chosen words, two spaces before and one behind each, and their number for each word."""
        st, en = self.st[which], self.en[which]
        n = en - st + 1
        begin = np.repeat(st, n)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + begin
        low = np.append(_LOWER[self.data], np.uint8(0x20)).astype(np.int32)
        c = np.where(at < np.repeat(en, n), low[at], 0x20)
        b = np.where(at - 1 >= begin, low[at - 1], 0x20)
        a = np.where(at - 2 >= begin, low[at - 2], 0x20)
        return (a << 16) | (b << 8) | c, n


class Tree:
    """Paths of a Huffman tree. Leaf k passes ``node[ptr[k] : ptr[k + 1]]`` with the given bits, and then, of the TOP nodes
    nearest to the root (the last rows of W), those that ``on[exit[k]]`` marks; ``up`` marks bits that are set."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        order = np.argsort(counts, kind="stable")
        weight = np.concatenate([counts[order], np.zeros(max(0, n - 1), np.int64)]).tolist()
        parent, right = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, bool)
        leaf, inner = 0, n
        self.bias = np.zeros(max(1, n - 1), np.float32)
        for new in range(n, 2 * n - 1):
            pair = []
            for _ in range(2):
                if leaf < n and (inner >= new or weight[leaf] <= weight[inner]):
                    pair.append(leaf)
                    leaf += 1
                else:
                    pair.append(inner)
                    inner += 1
            weight[new] = weight[pair[0]] + weight[pair[1]]
            parent[pair] = new
            right[pair[1]] = True
            self.bias[new - n] = np.log((weight[pair[1]] + 0.5) / (weight[pair[0]] + 0.5))
        at, who, steps = np.arange(n), np.arange(n), []
        while len(at := at[(keep := at != 2 * n - 2)]):
            who = who[keep]
            steps.append((order[who], parent[at] - n, right[at]))
            at = parent[at]
        self.first = max(0, n - 1 - TOP)  # ancestors have higher numbers, so the nodes from here on are the tree's top
        m = n - 1 - self.first
        self.on, self.up = np.zeros((2 * m + 1, m), np.float32), np.zeros((2 * m + 1, m), np.float32)
        for code in range(2 * m):
            k, bit = code // 2, code % 2
            while True:
                self.on[code, k], self.up[code, k] = 1, bit
                at = n + self.first + k
                if at == 2 * n - 2:
                    break
                k, bit = parent[at] - n - self.first, right[at]
        self.exit = np.full(n, 2 * m, np.int64)
        low = []
        for leaf_, node_, bit_ in reversed(steps):  # the lowest top node of a leaf comes last
            top = node_ >= self.first
            self.exit[leaf_[top]] = 2 * (node_[top] - self.first) + bit_[top]
            low.append((leaf_[~top], node_[~top], bit_[~top]))
        steps = low
        whose, nodes, bits = (np.concatenate([s[k] for s in steps]) if steps else np.empty(0, np.int64) for k in range(3))
        by = np.argsort(whose, kind="stable")
        self.node, self.bit = nodes[by].astype(np.int32), bits[by].astype(np.float32)
        self.ptr = np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=n))]).astype(np.int64)

    def longest_first(self, leaves: np.ndarray) -> np.ndarray:
        """The order of leaves by falling length of their paths below the top."""
        return np.argsort((self.ptr[leaves] - self.ptr[leaves + 1]).astype(np.int16), kind="stable")

    def levels(self, leaves: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Nodes and bits of the k-th steps below the top, for k = 0, 1, ..; of leaves by ``longest_first``, so those with a k-th step come first."""
        at = self.ptr[leaves]
        n = self.ptr[leaves + 1] - at
        reach = len(n) - np.cumsum(np.bincount(n)) if len(n) else []
        for k, many in enumerate(reach[:-1]):
            pos = at[:many] + k
            yield self.node.take(pos), self.bit.take(pos)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.where(z > 60, z, np.log(1 + np.exp(np.minimum(z, 60))))


def _sorted(rows: np.ndarray) -> np.ndarray:
    """The stable order of non-negative numbers below 2^32: two passes over 16 bits, which numpy sorts by radix."""
    order = np.argsort((rows & 0xFFFF).astype(np.uint16), kind="stable")
    return order[np.argsort((rows >> 16).astype(np.uint16)[order], kind="stable")] if len(rows) and rows.max() > 0xFFFF else order


def _scatter(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their values."""
    order = _sorted(rows)
    rows = rows[order]
    edge = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return rows[edge], np.add.reduceat(values.take(order, axis=0), edge, axis=0)


def _scatter_products(rows: np.ndarray, at: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_scatter(rows, g * h[at])``: most rows occur a few times, so their sums grow by their k-th occurrences for small k;
    the rest of the frequent ones is summed by runs."""
    order = _sorted(rows)
    rows, at, g = rows[order], at[order], g[order][:, None]
    edge = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    n = np.diff(edge, append=len(rows))
    edge = edge[_sorted(n.max() - n)]
    reach = len(edge) - np.cumsum(np.bincount(n, minlength=FEW + 1))
    out = h.take(at[edge], axis=0) * g[edge]
    for k in range(1, FEW):
        pos = edge[: reach[k]] + k
        out[: len(pos)] += h.take(at[pos], axis=0) * g[pos]
    if m := int(reach[FEW]):
        long = rows[edge[:m]]
        end = np.searchsorted(rows, long, side="right")
        size = end - edge[:m] - FEW
        pos = np.arange(int(size.sum())) + np.repeat(edge[:m] + FEW - (np.cumsum(size) - size), size)
        out[:m] += np.add.reduceat(h.take(at[pos], axis=0) * g[pos], np.cumsum(size) - size, axis=0)
    return rows[edge], out


class Model:
    """Vocabulary, tree and parameters. Rows of ``E``: edge, words by rank, buckets; of ``W``: tree nodes, bias last; of ``D``: offsets, then c."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, rare: int, seed: int = 17):
        self.keys, self.counts = keys, np.append(counts, rare).astype(np.int64)
        self.buckets = max(64, len(keys) // 4)
        rng = np.random.default_rng(seed)
        self.E = rng.normal(0, 0.3, (1 + len(keys) + self.buckets, HIDDEN)).astype(np.float32)
        self.D = np.ones((len(_OFFSETS) + 1, HIDDEN), np.float32)
        self.D[-1] = 0
        self.W = np.zeros((max(1, len(keys)), HIDDEN + 1), np.float32)
        self.W[:, -1] = self.tree.bias
        self.spell_key, self.spell_log, self.spell_pair, self.spell_new = (np.empty(0, t) for t in (np.int32, np.float64, np.int32, np.float64))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_tree", "_lexicon")}

    @property
    def tree(self) -> Tree:
        if "_tree" not in self.__dict__:
            self._tree = Tree(self.counts)
        return self._tree

    @property
    def lexicon(self) -> Lexicon:
        if "_lexicon" not in self.__dict__:
            self._lexicon = Lexicon(None, 0)
            self._lexicon.key = self.keys
            self._lexicon._rehash(1 << max(16, (4 * len(self.keys)).bit_length()))
        return self._lexicon

    def ids(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Leaf and row of E of every word."""
        at = self.lexicon._find(words.hash)
        rare = at < 0
        leaf = np.where(rare, len(self.keys), at)
        row = 1 + at
        row[rare] = 1 + len(self.keys) + (words.hash[rare] >> np.uint64(20)).astype(np.int64) % self.buckets
        return leaf, row

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = self.E.take(x, axis=0)
        h = np.ones((len(x), HIDDEN + 1), np.float32)
        np.tanh(np.einsum("ijk,jk->ik", e, self.D[:-1]) + self.D[-1], out=h[:, :-1])
        return h, e

    def log_prob(self, leaf: np.ndarray, x: np.ndarray) -> np.ndarray:
        """log P(leaf | neighbours)."""
        out = np.zeros(len(leaf))
        for lo in range(0, len(leaf), BATCH):
            t = leaf[lo : lo + BATCH]
            order = self.tree.longest_first(t)
            t = t[order]
            h, _ = self.hidden(x[lo : lo + BATCH][order])
            low = np.zeros(len(t), np.float32)
            for node, bit in self.tree.levels(t):
                low[: len(node)] += _softplus(np.einsum("ij,ij->i", self.W.take(node, axis=0), h[: len(node)]) * (1 - 2 * bit))
            at = self.tree.exit.take(t)
            on, up = self.tree.on.take(at, axis=0), self.tree.up.take(at, axis=0)
            top = np.einsum("ij,ij->i", _softplus((h @ self.W[self.tree.first : self.tree.first + on.shape[1]].T) * (1 - 2 * up)), on)
            out[lo + order] = -top - low
        return out

    def spelling(self, words: Words, which: np.ndarray) -> np.ndarray:
        code, n = words.trigrams(which)
        if not len(code):
            return np.zeros(len(which))
        pair = np.append(self.spell_pair, np.int32(-1))
        at = np.searchsorted(self.spell_pair, code >> 8)
        new = np.where(pair[at] == code >> 8, np.append(self.spell_new, 0.0)[at], -np.log(256))
        at = np.searchsorted(self.spell_key, code)
        each = np.where(np.append(self.spell_key, np.int32(-1))[at] == code, np.append(self.spell_log, 0.0)[at], new)
        return np.add.reduceat(each, np.cumsum(n) - n)

    def set_spelling(self, code: np.ndarray, n: np.ndarray) -> None:
        """P(c | a b) = (n(abc) + 1/256) / (n(ab) + 1), over all bytes."""
        order = np.argsort(code)
        self.spell_key, n = code[order], n[order].astype(float)
        self.spell_pair, inv = np.unique(self.spell_key >> 8, return_inverse=True)
        total = np.bincount(inv, n, len(self.spell_pair)) + 1
        self.spell_log = np.log((n + 1 / 256) / total[inv])
        self.spell_new = np.log(1 / 256 / total)

    def score(self, words: Words) -> np.ndarray:
        leaf, row = self.ids(words)
        out = self.log_prob(leaf, words.neighbours(row))
        rare = np.flatnonzero(leaf == len(self.keys))
        out[rare] += self.spelling(words, rare)
        return out


class Trainer:
    """Minibatch steps on a copy of a model's parameters."""

    def __init__(self, model: Model):
        self.m = Model.__new__(Model)
        self.m.__dict__ = dict(model.__dict__)
        self.m.E, self.m.W, self.m.D = model.E.copy(), model.W.copy(), model.D.copy()
        self.seen = {k: np.zeros(len(getattr(model, k)), np.float32) for k in "EWD"}

    def _move(self, name: str, rows: np.ndarray, grad: np.ndarray) -> None:
        seen, values = self.seen[name], getattr(self.m, name)
        now = seen.take(rows) + np.einsum("ij,ij->i", grad, grad) / grad.shape[1]
        seen[rows] = now
        values[rows] = values.take(rows, axis=0) - grad * (RATE / (np.sqrt(now) + 1e-9))[:, None]

    def step(self, leaf: np.ndarray, x: np.ndarray, around: np.ndarray) -> None:
        """``around``: the words' own rows of E, with SPAN more on either side."""
        m = self.m
        if not len(m.keys) or not len(leaf):
            return
        order = m.tree.longest_first(leaf)
        leaf = leaf[order]
        h, e = m.hidden(x[order])
        rows = np.arange(m.tree.first, m.tree.first + m.tree.on.shape[1])
        at, top = m.tree.exit.take(leaf), m.W[rows]
        g_top = (1 / (1 + np.exp(-(h @ top.T))) - m.tree.up.take(at, axis=0)) * m.tree.on.take(at, axis=0)
        d = g_top @ top
        nodes, gs = [], []
        for node, bit in m.tree.levels(leaf):
            w = m.W.take(node, axis=0)
            g = 1 / (1 + np.exp(-np.einsum("ij,ij->i", w, h[: len(node)]))) - bit
            w *= g[:, None]
            d[: len(node)] += w
            nodes.append(node)
            gs.append(g)
        if nodes:
            self._move("W", *_scatter_products(np.concatenate(nodes), np.concatenate([np.arange(len(k)) for k in nodes]), np.concatenate(gs), h))
        self._move("W", rows, g_top.T @ h)
        d = d[:, :-1] * (1 - h[:, :-1] ** 2)
        grad = np.stack([*(np.einsum("ik,ik->k", d, e[:, j]) for j in range(len(_OFFSETS))), d.sum(axis=0)])
        back = np.empty_like(d)
        back[order] = d
        # a word is a neighbour of those around it: its changes are summed by place first, those of the edge apart
        own, edge = np.zeros((len(around), HIDDEN), np.float32), np.zeros(HIDDEN, np.float32)
        for j, off in enumerate(_OFFSETS):
            part, out = back * m.D[j], np.flatnonzero(x[:, j] == 0)
            edge += part[out].sum(axis=0)
            part[out] = 0
            own[SPAN + off : SPAN + off + len(x)] += part
        own[around == 0] = 0
        self._move("E", *_scatter(np.append(around, 0), np.concatenate([own, edge[None]])))
        self._move("D", np.arange(len(grad)), grad)

    def learn(self, leaf: np.ndarray, x: np.ndarray, row: np.ndarray) -> None:
        around = np.concatenate([np.zeros(SPAN, row.dtype), row, np.zeros(SPAN, row.dtype)])
        for lo in range(0, len(leaf), BATCH):
            self.step(leaf[lo : lo + BATCH], x[lo : lo + BATCH], around[lo : min(lo + BATCH, len(leaf)) + 2 * SPAN])


def vocabulary(texts: DataFrame) -> Model:
    """An untrained model; its words are all with at least ``least`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            word, n = np.unique(Words(batch.column(0)).hash, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(i64(word)), pa.array(n.astype(np.int64))], names=["word", "n"])

    counts = materialize(texts.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    hist = counts.groupBy("n").agg(F.count("*").alias("words")).toArrow()
    n, words = (np.asarray(hist.column(c), np.int64) for c in ("n", "words"))
    order = np.argsort(-n)
    tokens = int((n * words).sum())
    reach = np.cumsum(words[order]) <= max(1, GROWTH * int(np.sqrt(tokens)))
    least = max(LEAST, int(n[order][reach].min())) if reach.any() else LEAST
    got = counts.where(F.col("n") >= least).toArrow()
    release(texts.sparkSession, counts)
    key, n = (np.asarray(got.column(c), np.int64) for c in ("word", "n"))
    order = np.lexsort((key, -n))
    return Model(key[order].view(np.uint64), n[order], tokens - int(n.sum()))


_PARTS = "EWD"
_DELTA = "part string, block int, task int, rows binary, data binary"


def _learn(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """One task's changes to the parameters and its counts of trigrams of rarer words, in blocks."""
    trainer, code, count = Trainer(model), np.empty(0, np.int32), np.empty(0, np.int64)
    for batch in slices(batches, "text"):
        words = Words(batch.column(0))
        leaf, row = model.ids(words)
        trainer.learn(leaf, words.neighbours(row), row)
        new, n = np.unique(words.trigrams(np.flatnonzero(leaf == len(model.keys)))[0], return_counts=True)
        code, inv = np.unique(np.concatenate([code, new]), return_inverse=True)
        count = np.bincount(inv, np.concatenate([count, n]), len(code)).astype(np.int64)
    task = TaskContext.get().partitionId()
    row = lambda part, block, rows, data: pa.RecordBatch.from_pylist([{"part": part, "block": block, "task": task, "rows": rows.astype(np.int32).tobytes(), "data": data.tobytes()}], _SCHEMA)
    for k in _PARTS:
        touched = np.flatnonzero(trainer.seen[k])
        for rows in np.split(touched, np.flatnonzero(np.diff(touched // BLOCK)) + 1) if len(touched) else []:
            yield row(k, int(rows[0]) // BLOCK, rows, (getattr(trainer.m, k)[rows] - getattr(model, k)[rows]).astype(np.float16))
    for p in range(SPELL_PARTS):
        if (own := code % SPELL_PARTS == p).any():
            yield row("S", p, code[own], count[own])


_SCHEMA = pa.schema([("part", pa.string()), ("block", pa.int32()), ("task", pa.int32()), ("rows", pa.binary()), ("data", pa.binary())])


def _merge(table: pa.Table) -> pa.Table:
    """Means of the changes to each row over the tasks that changed it, in the order of tasks; sums of trigram counts."""
    table = table.sort_by("task")
    part = table.column("part")[0].as_py()
    kind = np.int64 if part == "S" else np.float16  # changes are small: half precision halves the shuffle
    rows = np.concatenate([np.frombuffer(x, np.int32) for x in table.column("rows").to_pylist()])
    data = np.concatenate([np.frombuffer(x, kind) for x in table.column("data").to_pylist()]).reshape(len(rows), -1)
    data = data if part == "S" else data.astype(np.float32)
    own, total = _scatter(rows, data)
    if part != "S":
        total /= np.unique(rows, return_counts=True)[1].astype(np.float32)[:, None]
    return pa.Table.from_pylist([{"part": part, "block": table.column("block")[0].as_py(), "task": 0, "rows": own.tobytes(), "data": total.tobytes()}], _SCHEMA)


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    model = vocabulary(texts)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    changes = texts.mapInArrow(lambda batches: _learn(batches, shared.value), _DELTA)
    got = changes.groupBy("part", "block").applyInArrow(_merge, _DELTA).toArrow().to_pylist()
    code, count = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    for r in got:
        rows = np.frombuffer(r["rows"], np.int32)
        if r["part"] == "S":
            code.append(rows)
            count.append(np.frombuffer(r["data"], np.int64))
        else:
            getattr(model, r["part"])[rows] += np.frombuffer(r["data"], np.float32).reshape(len(rows), -1)
    model.set_spelling(np.concatenate(code), np.concatenate(count))
    shared.destroy()
    del got
    trim()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``docs`` with n_tokens, log_likelihood (sum) and mean_log_prob (null without tokens); of its own columns all, or those named."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts: pa.Array) -> list[pa.Array]:
        words = Words(texts)
        n = np.diff(words.first)
        total = np.bincount(np.repeat(np.arange(len(n)), n), shared.value.score(words), len(n))
        return [pa.array(n, pa.int64()), pa.array(total, pa.float64()), pa.array(total / np.maximum(n, 1), pa.float64(), mask=n == 0)]

    return add_columns(docs, text_col, [("n_tokens", T.LongType()), ("log_likelihood", T.DoubleType()), ("mean_log_prob", T.DoubleType())], make, columns)
