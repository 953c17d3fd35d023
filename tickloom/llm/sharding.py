"""Extendible hashing into shards of a byte limit, with DataFrame operations only.

A directory is indexed by the leading bits of a 60-bit key hash. A bucket over the byte limit splits on its
next bit, others stay, until each holds at most ``limit`` bytes or a single row. Splitting runs over histograms:
bytes are summed by a prefix a few bits longer than an even spread needs, all shorter prefixes follow by rolling up,
and only buckets that are still over go to the next, deeper histogram. Rows never meet in one task: sums combine
map-side, and each row finds its bucket by an equi-join on its prefix.

Rows whose keys are equal share the hash and can't be parted by it. Those still over the limit at the last bit are
hashed again by row identity and split in the same way, so that a key with a third of all rows
ends in many shards.

Defined results: a null key hashes as a key of its own, a null text has 0 bytes, an empty table has no shards,
repeated rows are all placed, a row over the limit is alone in a shard with oversized = true. Columns of the
input keep their place in ``assign``'s result unless they are named like its own columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

BITS = 60
STEP = 5


def key_hash(*columns: Column) -> Column:
    """60 bits of MD5 over the columns as text; nulls are told from empty strings."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) if k else F.coalesce(c.cast("string"), F.lit("\0")) for k, c in enumerate(columns)]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 15), 16, 10).cast("long")


def _prefix(h: Column, depth: int) -> Column:
    return F.shiftright(h, BITS - depth)


def _place(items: DataFrame, limit: int, start: int) -> tuple[DataFrame, DataFrame | None]:
    """items (rid, n_bytes, h) with depth, prefix, shard_bytes, shard_rows; and the rows that no bit parts."""
    placed, rest, low, level = [], items, 0, max(1, min(start, BITS))
    while True:
        fine = rest.groupBy(_prefix(F.col("h"), level).alias("fine")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"))
        levels = F.explode(F.sequence(F.lit(low), F.lit(level))).alias("depth")
        rolled = fine.select("fine", "bytes", "rows", levels).groupBy("depth", F.expr(f"shiftright(fine, {level} - depth)").alias("prefix")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows")).where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
        each = fine.select("fine", levels).select("fine", "depth", F.expr(f"shiftright(fine, {level} - depth)").alias("prefix"))
        first = each.join(rolled, ["depth", "prefix"]).groupBy("fine").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_rows")).alias("b"))
        directory = materialize(fine.select("fine").join(first, "fine", "left").select("fine", "b.*"), "directory")
        found = rest.withColumn("fine", _prefix(F.col("h"), level)).join(directory, "fine")
        placed.append(found.where("depth is not null").drop("fine"))
        if not directory.where("depth is null").limit(1).count():
            rest = None
            break
        rest = found.where("depth is null").select("rid", "n_bytes", "h")
        if level == BITS:
            break
        rest = materialize(rest, "overfull")
        low, level = level + 1, min(BITS, level + STEP)
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out, rest


def _name(prefix: Column, depth: Column) -> Column:
    return F.concat(F.lit("s"), F.when(depth == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')")))


def _assigned(docs: DataFrame, limit: int, key: list[str], text_col: str, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (rid, k0, k1 ... for the columns ``keep``), and for every rid its n_bytes and shard."""
    src = docs.select(
        *[F.col(f"`{c}`").alias(f"k{j}") for j, c in enumerate(keep)],
        F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"),
        key_hash(*[F.col(f"`{c}`") for c in key]).alias("h"),
        F.monotonically_increasing_id().alias("rid"),
    )
    src = materialize(src, "shard-items")  # row ids hold from here on
    items = src.select("rid", "n_bytes", "h")
    total = items.agg(F.sum("n_bytes")).first()[0] or 0
    start = math.ceil(math.log2(max(1, total / limit))) + 2
    placed, rest = _place(items, limit, start)
    placed = placed.select("rid", "n_bytes", _name(F.col("prefix"), F.col("depth")).alias("shard_id"), "depth", "shard_bytes", "shard_rows")
    if rest is not None:
        rest = materialize(rest, "equal-keys")
        again, left = _place(rest.select("rid", "n_bytes", key_hash(F.col("h"), F.col("rid")).alias("h")), limit, start)
        if left is not None:
            raise ValueError("row identities collide in 60 bits")
        again = again.join(rest.select("rid", F.col("h").alias("key")), "rid")
        name = F.concat(F.expr(f"concat('s', lpad(bin(key), {BITS}, '0'), '-')"), F.substring(_name(F.col("prefix"), F.col("depth")), 2, BITS))
        placed = placed.unionByName(again.select("rid", "n_bytes", name.alias("shard_id"), (F.col("depth") + BITS).alias("depth"), "shard_bytes", "shard_rows"))
    return src.drop("n_bytes", "h"), placed


def assign(docs: DataFrame, limit: int, key: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with n_bytes, shard_id, depth, shard_bytes, shard_rows and oversized.

    shard_id is "s" and the bucket's hash prefix in binary; rows parted by identity add "-" and a second prefix.
    """
    own = ("n_bytes", "shard_id", "depth", "shard_bytes", "shard_rows", "oversized")
    keep = [c for c in docs.columns if c != text_col and c not in own]
    src, placed = _assigned(docs, limit, key or ["doc_id"], text_col, keep)
    out = src.join(placed, "rid")
    return out.select(*[F.col(f"k{j}").alias(c) for j, c in enumerate(keep)], "n_bytes", "shard_id", "depth", "shard_bytes", "shard_rows", (F.col("shard_bytes") > limit).alias("oversized"))


def write_shards(docs: DataFrame, path: str, limit: int, key: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Write ``docs`` partitioned by shard_id; returns the directory (shard_id, depth, shard_bytes, shard_rows)."""
    keep = [c for c in docs.columns if c != "shard_id"]
    src, placed = _assigned(docs, limit, key or ["doc_id"], text_col, keep)
    placed = materialize(placed, "shards")
    # by row identity: a key may lie in many shards, or be null
    rows = src.join(placed.select("rid", "shard_id"), "rid").select(*[F.col(f"k{j}").alias(c) for j, c in enumerate(keep)], "shard_id")
    rows.repartition("shard_id").write.partitionBy("shard_id").parquet(path)
    directory = materialize(placed.select("shard_id", "depth", "shard_bytes", "shard_rows").distinct(), "directory")
    release(docs.sparkSession, src, placed)
    return directory
