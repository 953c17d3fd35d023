"""Embedding near-duplicates by product quantisation: coarse inverted lists, residual codes, exact cosine rerank.

1. Equal vectors of a label are one class with a multiplicity (sums combine map-side), so a very common vector is one row.
2. Coarse centroids and one codebook per subspace of the residuals are fitted by k-means on at most SAMPLE classes
   (documented bound); the number of lists follows the square root of the number of classes, up to MAX_LISTS. Every class
   is indexed in its nearest list.
3. Each class is a query. It probes every list whose border with its own list is nearer than PROBE times the chord of
   the cosine threshold; PROBE = 1 can't miss a pair, 0.5 is four standard deviations of a random direction in
   64 dimensions. Within a list, distances to all members come from tables over their codes (asymmetric: the query isn't
   quantised). A member is a candidate if its table distance is at most the chord plus its own stored quantisation
   error, so the tables lose nothing (triangle inequality); candidates are reranked by exact cosine in double precision.
4. Lists are cut into blocks of BLOCK members and BLOCK queries, so no task holds a large list; a block sends the number
   of links of each query and one edge per linked vector to the smallest of its local component, never the pairs.

There is no cap on partners or candidates. Vectors of different length never link.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, or whose label is null, link
with nothing and are kept; repeated ids are rows of their own; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize

SAMPLE = 16_000
MAX_LISTS = 4096
SUBSPACES = 8
CODES = 64
PROBE = 0.5
BLOCK = 2048
ROUNDS = 6


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances to all centroids, and the nearest one."""
    d = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]
    return np.maximum(d, 0), d.argmin(1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        _, a = _nearest(x, c)
        n = np.bincount(a, minlength=k)
        order = np.argsort(a, kind="stable")
        full = np.flatnonzero(n)
        total = np.add.reduceat(x[order], (np.cumsum(n) - n)[full], axis=0)
        c[full] = total / n[full, None]
    return c


class Quantizer:
    """Coarse centroids and residual codebooks for unit vectors of one length."""

    def __init__(self, x: np.ndarray, lists: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.dim = x.shape[1]
        self.cuts = np.linspace(0, self.dim, min(SUBSPACES, self.dim) + 1).astype(int)
        self.coarse = _kmeans(x, lists, rng)
        _, a = _nearest(x, self.coarse)
        rest = x - self.coarse[a]
        self.books = [_kmeans(rest[:, lo:hi], CODES, rng) for lo, hi in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        self.apart = np.sqrt(_nearest(self.coarse, self.coarse)[0])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Own list, squared distances to all lists, codes and quantisation error of each vector."""
        d, own = _nearest(x, self.coarse)
        rest = x - self.coarse[own]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        err = np.zeros(len(x))
        for j, book in enumerate(self.books):
            part = rest[:, self.cuts[j] : self.cuts[j + 1]]
            codes[:, j] = _nearest(part, book)[1]
            err += ((part - book[codes[:, j]]) ** 2).sum(1)
        return own, d, codes, np.sqrt(err)

    def probes(self, own: np.ndarray, d: np.ndarray, reach: float) -> np.ndarray:
        """Which lists each vector probes."""
        mine = d[np.arange(len(d)), own]
        return (d - mine[:, None]) <= 2 * reach * self.apart[own]

    def tables(self, x: np.ndarray, at: int) -> np.ndarray:
        """Squared distances from each query's residual to every code of each subspace."""
        rest = x - self.coarse[at]
        out = np.full((len(x), len(self.books), CODES), np.inf)
        for j, book in enumerate(self.books):
            out[:, j, : len(book)] = _nearest(rest[:, self.cuts[j] : self.cuts[j + 1]], book)[0]
        return out


def _unit(column) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in column])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def search_block(q: Quantizer, at: int, queries: np.ndarray, members: np.ndarray, codes: np.ndarray, err: np.ndarray, threshold: float) -> np.ndarray:
    """Links (query, member) as a boolean matrix: table distances, then exact cosine of the candidates."""
    chord = np.sqrt(max(0.0, 2 - 2 * threshold))
    limit = (chord + err + 1e-6) ** 2
    links = np.zeros((len(queries), len(members)), bool)
    for lo in range(0, len(queries), 256):
        part = queries[lo : lo + 256]
        t = q.tables(part, at)
        d = np.zeros((len(part), len(members)))
        for j in range(codes.shape[1]):
            d += t[:, j, :][:, codes[:, j]]
        a, b = np.nonzero(d <= limit[None, :])
        for s in range(0, len(a), 1 << 16):
            i, k = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
            ok = np.einsum("ij,ij->i", part[i], members[k]) >= threshold
            links[lo + i[ok], k[ok]] = True
    return links


def local_components(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One edge from every linked id to the smallest id of its component within the block."""
    a, b = [], []
    todo = links.any(1)
    while todo.any():
        rows = np.zeros(len(left), bool)
        rows[todo.argmax()] = True
        fresh, cols = rows.copy(), np.zeros(len(right), bool)
        while fresh.any():
            more = links[fresh].any(0) & ~cols
            cols |= more
            fresh = links[:, more].any(1) & ~rows if more.any() else np.zeros(len(left), bool)
            rows |= fresh
        todo &= ~rows
        ids = np.unique(np.concatenate([left[rows], right[cols]]))
        a.append(ids[1:])
        b.append(np.full(len(ids) - 1, ids[0]))
    none = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", probe: float = PROBE) -> DataFrame:
    """Rows (id, n_links, component_id, kept), one per row of ``vectors``; ids are whole numbers."""
    spark = vectors.sparkSession
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e300)) & F.exists(v, lambda x: x != 0), F.lit(False))
    usable = F.col("label").isNotNull() & F.coalesce(F.size(v) > 0, F.lit(False)) & finite
    keyed = materialize(rows.withColumn("usable", usable).withColumns({"h1": F.when(F.col("usable"), F.xxhash64("label", "v")), "h2": F.when(F.col("usable"), F.hash("v", "label"))}), "vectors")
    classes = materialize(keyed.where("usable").groupBy("h1", "h2").agg(F.min("id").alias("c"), F.count("*").alias("m"), F.first("label").alias("label"), F.first("v").alias("v")), "classes")

    edges = links = None
    sizes = [(r.d, r.n) for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()]
    for dim, n in sizes:
        own = classes.where(F.size("v") == dim)
        sample = own.select("v", "c").orderBy(F.xxhash64("c"), "c").limit(SAMPLE).select("v").toArrow().column("v").to_pylist()
        lists = int(min(MAX_LISTS, max(1, np.sqrt(n)), max(1, len(sample) // 4)))
        shared = spark.sparkContext.broadcast(Quantizer(_unit(sample), lists))
        e, k = _search(own, shared, threshold, probe)
        edges, links = (e, k) if edges is None else (edges.unionByName(e), links.unionByName(k))
    base = keyed.select("id", "usable", "h1", "h2")
    if edges is None:
        return base.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    comp = components(edges)
    known = classes.select("h1", "h2", "c", "m").join(links, "c", "left").join(comp.withColumnRenamed("node", "c"), "c", "left")
    known = known.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("component", "c").alias("component"))
    out = base.join(known, ["h1", "h2"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))


def _search(classes: DataFrame, shared, threshold: float, probe: float) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) that keep connectivity, and (c, links) summed over all lists."""
    reach = probe * float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def index(batches):
        q = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                if part.num_rows == 0:
                    continue
                own, d, codes, err = q.encode(_unit(part.column("v").to_pylist()))
                lists = [np.flatnonzero(x) for x in q.probes(own, d, reach)]
                off = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("c"), part.column("m"), part.column("label"), part.column("v"), pa.array(own.astype(np.int32)), pa.array([x.tobytes() for x in codes]), pa.array(err), pa.ListArray.from_arrays(off, pa.array(np.concatenate(lists).astype(np.int32)))],
                    names=["c", "m", "label", "v", "list", "codes", "err", "probes"],
                )

    kind = classes.schema["label"].dataType.simpleString()
    src = classes.select("c", "m", "label", "v")
    indexed = materialize(src.mapInArrow(index, f"c long, m long, label {kind}, v array<double>, list int, codes binary, err double, probes array<int>"), "indexed")
    probed = indexed.select("c", "v", "label", F.explode("probes").alias("list"))
    width = indexed.groupBy("label", "list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    depth = indexed.select("label", F.explode("probes").alias("list")).groupBy("label", "list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("shares"))
    plan = materialize(width.join(depth, ["label", "list"]), "lists")
    spread = lambda n, salt: F.pmod(F.xxhash64("c", F.lit(salt)), F.col(n)).cast("int")
    members = indexed.join(plan, ["label", "list"]).select("label", "list", spread("blocks", 1).alias("block"), F.explode(F.expr("sequence(0, shares - 1)")).alias("share"), "c", "m", "v", "codes", "err")
    queries = probed.join(plan, ["label", "list"]).select("label", "list", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), spread("shares", 2).alias("share"), "c", "v")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
        if left.num_rows == 0 or right.num_rows == 0:
            return schema.empty_table()
        a, b = np.asarray(left.column("c")), np.asarray(right.column("c"))
        x, y = _unit(left.column("v").to_pylist()), _unit(right.column("v").to_pylist())
        codes = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(len(b), -1)
        links = search_block(shared.value, left.column("list")[0].as_py(), x, y, codes, np.asarray(right.column("err")), threshold)
        links &= a[:, None] != b[None, :]
        n = links @ np.asarray(right.column("m"), np.int64)
        some = np.flatnonzero(n)
        ea, eb = local_components(links[some], a[some], b)
        none = lambda k: pa.nulls(k, pa.int64())
        return pa.concat_tables([pa.table([pa.array(a[some]), none(len(some)), pa.array(n[some])], schema=schema), pa.table([pa.array(ea), pa.array(eb), none(len(ea))], schema=schema)])

    keys = ["label", "list", "block", "share"]
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])  # columns apart from those of members
    found = materialize(queries.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(run, "a long, b long, n long"), "links")
    edges = found.where("b is not null").select("a", "b")
    links = found.where("n is not null").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("links"))
    return edges, links
