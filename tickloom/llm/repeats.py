"""Suffix-array dedup of long byte strings by distributed prefix doubling over sampled suffixes.

A byte goes when a string of ``length`` (400) bytes that covers it also starts anywhere else, in any document.
The suffix array is built as far as that needs, and no further: sampled positions are ranked by a short prefix, Spark sorts
the pairs (rank, rank at an offset) at growing offsets, equal pairs get one new rank, and only positions whose rank isn't
unique go on, until the prefix passes the threshold.

Ranking all positions of a corpus costs more shuffle than the corpus itself, so suffixes are sampled by content.
The leftmost least of the hashed 8-grams of a window of ``length`` bytes is its anchor, a function of the window's own
bytes, so equal windows have equal anchors at equal offsets. Neighbouring windows with one anchor form a block of up to
128 windows. All windows of a block share its core of length - 127 bytes, the suffix that is ranked; two windows can be
equal only if their blocks' cores are. With the core the sample holds the places inside it that the offsets lead to.

Offsets, for 400 bytes:  0  rank of 69 bytes, by their hash; what is unique goes.
                        68  (rank, rank at 68) -> rank of 137 bytes, at the core's start and at its place 136.
                       136  (rank, rank at 136) -> rank of the core's 273 bytes.
                            Where the whole stretch of a block occurs twice, all its windows are repeats, settled as one row;
                            one copy of a settled stretch stays in play where blocks with its core are open.
                     +-112  what is left is cut into blocks of up to 16 windows; (rank, place, ranks of the bytes on either
                            side) -> rank of 385 bytes; same rule.
                      +-15  what is left is ranked window by window: (rank, place, bytes on either side), 400 bytes.

First ranks and the bytes on either side are 64-bit hashes, four and two of them independent in a core's and a block's rank.
Counts combine map-side, only distinct pairs are sorted, and rows meet their ranks in joins that AQE can split, so a passage
in a third of the documents is no hot spot. Texts are read three times; only documents that a bounded Bloom filter (1 MB,
whatever the corpus) lets through are shuffled. A row is known by 128 bits of its id and text.

With ``words`` (n) a run of n words that also starts anywhere else goes too, judged on the same input: each word stands as eight
bytes, its hash, so the passages are the repeated strings of 8 n bytes that start at a word, found by the same operator. Their bytes
go from the first word's first to the last word's last; how much white space lies between words is no matter.

Defined results: null is the empty text; shorter texts than ``length`` are kept whole; equal rows are repeats of
each other, ids may repeat; other columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, bloom, eights, i64, lean, materialize, maybe_in, mix, release, run_hashes, slices, string_buffer, word_bounds

GRAM = 8
WIDE, NARROW = 128, 16
PIECE = 1 << 20


KEY = ["k", "l"]
HASHES = ["h0", "h1", "h2", "h3"]


def offsets_of(length: int) -> tuple[int, int, int]:
    """Bytes of the first prefix and the two offsets that double it to a core of length - WIDE + 1 bytes."""
    core = length - WIDE + 1
    half = -(-core // 2)
    first = -(-half // 2)
    return first, half - first, core - half


def anchors(data: np.ndarray, length: int) -> np.ndarray:
    """For every window start p <= n - length the position of the leftmost least 8-gram inside the window."""
    n = len(data)
    at = np.arange(n - GRAM + 1, dtype=np.uint64)
    key = (mix(eights(data)[: len(at)]) & np.uint64(0xFFFFFFFF00000000)) | at
    m = length - GRAM + 1
    pad = -len(key) % m
    full = np.concatenate([key, np.full(pad, 2**64 - 1, np.uint64)]).reshape(-1, m)
    ahead = np.minimum.accumulate(full, axis=1).reshape(-1)
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    low = np.minimum(behind[: n - length + 1], ahead[m - 1 : m - 1 + n - length + 1])
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def wide_blocks(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Blocks: row, place (first window, from the row's start), n windows, c (start of the core), h0 to h3 (first ranks at the core's sampled places), stretch."""
    n = len(data)
    if n < length:
        return {k: np.empty(0, np.int64) for k in ("row", "place", "n", "c", *HASHES, "stretch")}
    anchor = anchors(data, length)
    p = np.arange(len(anchor))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    inside = p + length <= offsets[1:][row]
    p, anchor, row = p[inside], anchor[inside], row[inside]
    block = (anchor - p) // WIDE
    cut = np.ones(len(p), bool)
    cut[1:] = (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(p)) - 1 if len(first) else first
    lo, hi, row = p[first], p[last], row[first]
    c = anchor[first] - WIDE * block[first]
    base = offsets[row]
    size, one, two = offsets_of(length)
    ranks = {h: run_hashes(data, c + d, c + d + size) for h, d in zip(HASHES, (0, one, two, one + two), strict=True)}
    # a stretch is told apart by where the core lies in it
    return {"row": row, "place": lo - base, "n": hi - lo + 1, "c": c - base, **ranks, "stretch": mix(run_hashes(data, lo, hi + length, seed=1) + (c - lo).astype(np.uint64))}


def narrow_blocks(data: np.ndarray, place: np.ndarray, n: np.ndarray, c: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Within one text: the given blocks cut at c, c - NARROW, ...; src is the block, d how far its core is extended to the left, left and right the ranks of the bytes beside the core."""
    lo_m, hi_m = (c - (place + n - 1)) // NARROW, (c - place) // NARROW
    count = hi_m - lo_m + 1
    src = np.repeat(np.arange(len(place)), count)
    m = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + lo_m[src]
    end = c[src] - NARROW * m
    lo = np.maximum(place[src], end - NARROW + 1)
    hi = np.minimum(place[src] + n[src] - 1, end)
    left, right = run_hashes(data, end, c[src]), run_hashes(data, c[src] + length - WIDE + 1, end + length - NARROW + 1)
    return {"src": src, "place": lo, "n": hi - lo + 1, "c": end, "d": NARROW * m, "left": left, "right": right, "stretch": mix(run_hashes(data, lo, hi + length, seed=1) + (end - lo).astype(np.uint64))}


def ranks(pairs: DataFrame, name: str = "rank") -> DataFrame:
    """The distinct rows of ``pairs`` that occur more than once, sorted, with a rank that follows their order.

    A table of its own, so that the join with its rows is between two plain shuffles and AQE can split a hot pair's rows.
    """
    keys = pairs.columns
    repeated = pairs.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").select(*keys)
    return materialize(repeated.orderBy(*keys).withColumn(name, F.monotonically_increasing_id()), "ranks")


def _settle(alive: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows (with core, a rank that isn't unique) told apart by whether the whole stretch repeats: (repeats, open ones)."""
    whole = materialize(alive.groupBy("core", "stretch").agg(F.count("*").alias("__n")).where("__n > 1"), "counts")
    marked = materialize(alive.join(whole, ["core", "stretch"], "left"), name)
    release(alive.sparkSession, whole)
    return marked.where("__n is not null").drop("__n"), marked.where("__n is null").drop("__n")


def _with_samples(sure: DataFrame, open_: DataFrame) -> DataFrame:
    """The open rows and, for each core they have, one row of each settled stretch: open windows may equal theirs."""
    rest = [c for c in open_.columns if c not in ("core", "stretch")]
    cores = materialize(open_.select("core").distinct(), "cores")
    one = materialize(sure.groupBy("core", "stretch").agg(F.min(F.struct(*rest)).alias("r")), "samples").join(cores, "core", "left_semi")
    return open_.unionByName(one.select("core", "stretch", "r.*"))


def repeated_ranges(keyed: DataFrame, length: int = 400) -> DataFrame:
    """Rows (k, l, ranges): for each text key with repeats its window ranges (place, n). ``keyed`` has k, l and text."""
    spark = keyed.sparkSession

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            data, off = string_buffer(batch.column(2))
            # a text longer than PIECE comes alone and is taken piece by piece, so memory doesn't follow its length
            for at in range(0, max(1, len(data) - length + 1) if batch.num_rows == 1 else 1, PIECE):
                part = data[at : at + PIECE + length - 1] if batch.num_rows == 1 else data
                b = wide_blocks(part, np.array([0, len(part)]) if batch.num_rows == 1 else off, length)
                place = [pa.array((b[x] + (at if x != "n" else 0)).astype(np.int32)) for x in ("place", "n", "c")]
                yield pa.RecordBatch.from_arrays([*[batch.column(j).take(pa.array(b["row"])) for j in (0, 1)], *place, *[pa.array(i64(b[x])) for x in (*HASHES, "stretch")]], names=[*KEY, "place", "n", "c", *HASHES, "stretch"])

    schema = "k long, l long, place int, n int, c int, "
    rows = materialize(keyed.select(*KEY, "text").mapInArrow(first, schema + "h0 long, h1 long, h2 long, h3 long, stretch long"), "wide")
    # offset 0: first ranks
    once = ranks(rows.select("h0"))
    some = maybe_in(rows, bloom(once.select(F.col("h0").alias("k"))), "h0").where("__maybe").drop("__maybe")  # of the others only those are shuffled
    alive = materialize(some.join(once.select("h0"), "h0"), "alive")
    release(spark, rows, once)
    # the first offset, at both places that the second one needs
    pair = lambda a, b: alive.select(F.col(a).alias("a"), F.col(b).alias("b"))
    twice = ranks(pair("h0", "h1").union(pair("h2", "h3")))
    at = lambda a, b, name: twice.select(F.col("a").alias(a), F.col("b").alias(b), F.col("rank").alias(name))
    doubled = materialize(alive.join(at("h0", "h1", "r0"), ["h0", "h1"]).join(at("h2", "h3", "r1"), ["h2", "h3"]).drop(*HASHES), "alive")
    release(spark, alive, twice)
    # the second offset: the whole core
    cores = ranks(doubled.select("r0", "r1"), "core")
    sure, open_ = _settle(doubled.join(cores, ["r0", "r1"]).drop("r0", "r1"), "cores")
    release(spark, doubled)

    open_ = materialize(_with_samples(sure, open_), "open")
    todo = open_.groupBy(*KEY).agg(F.collect_list(F.struct("place", "n", "c", "core")).alias("blocks"))
    some = maybe_in(keyed.select(*KEY, "text"), bloom(open_.select("k"))).where("__maybe").select(*KEY, "text")

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, off = string_buffer(batch.column(2))
            for r in range(batch.num_rows):
                text = data[off[r] : off[r + 1]]
                place, n, c, core = (np.asarray(batch.column(3)[r].values.field(x), np.int64) for x in ("place", "n", "c", "core"))
                b = narrow_blocks(text, place, n, c, length)
                end, size = b["c"], length - NARROW + 1
                raw = text.tobytes()
                before = [raw[x:y] for x, y in zip(np.maximum(end - (NARROW - 1), 0).tolist(), end.tolist(), strict=True)]
                behind = [raw[y + size : y + length] for y in end.tolist()]
                key = [pa.array(np.full(len(end), batch.column(j)[r].as_py())) for j in (0, 1)]
                numbers = [pa.array(b[x].astype(np.int32)) for x in ("place", "n", "c", "d")]
                yield pa.RecordBatch.from_arrays([*key, *numbers, pa.array(core[b["src"]]), *[pa.array(i64(b[x])) for x in ("left", "right", "stretch")], pa.array(before, pa.binary()), pa.array(behind, pa.binary())], names=[*KEY, "place", "n", "c", "d", "wide", "left", "right", "stretch", "before", "behind"])

    fine = materialize(some.join(todo, KEY).mapInArrow(second, schema + "d int, wide long, left long, right long, stretch long, before binary, behind binary"), "narrow")
    sides = ["wide", "d", "left", "right"]
    sure2, open2 = _settle(fine.join(ranks(fine.select(*sides), "core"), sides).drop(*sides), "narrow")
    release(spark, fine, open_)
    # a window j bytes left of the core's start is the core with j bytes before it and NARROW - 1 - j behind it
    each = _with_samples(sure2, open2).withColumn("j", F.explode(F.sequence(F.col("c") - F.col("place") - F.col("n") + 1, F.col("c") - F.col("place"))))
    each = each.select(*KEY, (F.col("c") - F.col("j")).alias("place"), F.lit(1).alias("n"), "core", "j", F.expr("substring(before, length(before) - j + 1, j)").alias("before"), F.expr(f"substring(behind, 1, {NARROW - 1} - j)").alias("behind"))
    window = ["core", "j", "before", "behind"]
    each = each.join(ranks(each.select(*window)), window)
    ranges = [x.select(*KEY, "place", "n") for x in (sure, sure2, each)]
    return ranges[0].union(ranges[1]).union(ranges[2]).groupBy(*KEY).agg(F.sort_array(F.collect_set(F.struct("place", "n"))).alias("ranges"))


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [begin, end) that the given ones cover; begins sorted."""
    end = np.maximum.accumulate(end)
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    first = np.flatnonzero(new)
    return begin[first], end[np.append(first[1:], len(begin)) - 1]


def word_symbols(keyed: DataFrame, words: int) -> DataFrame:
    """``keyed`` with eight bytes, the hash, for each word in place of the text; only texts of ``words`` words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            data, off = string_buffer(batch.column(2))
            st, en, first = word_bounds(data, off)
            ends = pa.py_buffer((8 * first).astype(np.int64).tobytes())
            symbols = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, ends, pa.py_buffer(run_hashes(data, st, en).tobytes())])
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), symbols.cast(pa.binary())], names=[*KEY, "text"])
            yield out.filter(pa.array(np.diff(first) >= words))

    return keyed.select(*KEY, "text").mapInArrow(run, "k long, l long, text binary")


def passages(raw: bytes, place: np.ndarray, n: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte runs [begin, end) of the repeated passages of one text, from the window ranges of its symbols; starts inside a word's symbol don't count."""
    st, en, _ = word_bounds(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    first, last = -(-place // 8), (place + n - 1) // 8
    some = last >= first
    return st[first[some]], en[last[some] + words - 1]


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", removed: str = "removed", kept: str = "kept", words: int | None = None) -> DataFrame:
    """``docs`` with removed (array of (begin, end) byte runs) and kept (the remaining bytes), under the given names, in place of columns of these names.

    Repeats are strings of ``length`` bytes and, where ``words`` is given, runs of so many words.
    """
    if min(length, 8 * (words or length)) < WIDE + GRAM:
        raise ValueError(f"length must be at least {WIDE + GRAM} and words {(WIDE + GRAM) // 8}")
    lean(docs.sparkSession)
    src, names = aside(docs)
    own = {c: f"f{j}" for j, c in enumerate(names)}
    text = F.coalesce(F.col(own[text_col]).cast("string"), F.lit(""))
    key = [F.xxhash64(F.col(own[id_col]), text).alias("k"), F.xxhash64(text, F.col(own[id_col]), F.lit(1)).alias("l")]
    keyed = src.select(*key, text.alias("text"))
    ranges = repeated_ranges(keyed.where(F.octet_length("text") >= length), length)
    if words:
        ranges = materialize(ranges, "ranges").join(materialize(repeated_ranges(word_symbols(keyed.where(F.octet_length("text") >= 2 * words - 1), words), 8 * words).withColumnRenamed("ranges", "passages"), "passages"), KEY, "full")
    else:
        ranges = ranges.withColumn("passages", F.lit(None).cast(ranges.schema["ranges"].dataType))
    ranges = materialize(ranges, "ranges")
    names = [c for c in names if c not in (removed, kept)]
    fields = [own[c] for c in names]
    split = maybe_in(src.select(*fields, *key, text.alias("text")), bloom(ranges.select("k")))
    runs = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    whole = split.where(~F.col("__maybe")).select(*fields, F.array().cast(runs).alias("removed"), F.col("text").cast("binary").alias("kept"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches, "text"):
            gone, left = [], []
            for raw, *todo in zip(batch.column("text"), batch.column("ranges"), batch.column("passages"), strict=True):
                raw = raw.as_py().encode()
                at = [tuple(np.asarray(x.values.field(c), np.int64) for c in ("place", "n")) if x.is_valid else None for x in todo]
                runs = [(at[0][0], at[0][0] + at[0][1] - 1 + length)] if at[0] else []
                runs += [passages(raw, *at[1], words)] if at[1] else []
                a, b = (np.concatenate(x) for x in zip(*runs, strict=True)) if runs else (np.empty(0, np.int64),) * 2
                if not len(a):
                    gone.append([])
                    left.append(raw)
                    continue
                order = np.argsort(a, kind="stable")
                a, b = merged(a[order], b[order])
                gone.append([{"begin": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
                left.append(b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(gone, kind), pa.array(left, pa.binary())], names=[*fields, "removed", "kept"])

    maybe = split.where("__maybe").drop("__maybe").join(ranges, KEY, "left").select(*fields, "text", "ranges", "passages")
    out = whole.unionByName(maybe.mapInArrow(cut, whole.schema))
    return out.select(*[F.col(f).alias(c) for f, c in zip(fields, names, strict=True)], F.col("removed").alias(removed), F.col("kept").alias(kept))
