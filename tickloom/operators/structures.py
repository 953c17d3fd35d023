"""Multi-leg structures: completeness, availability bitmasks, risk and marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def availability_mask(df: DataFrame, keys: list[str], bit: Column, masks: dict[str, Column]) -> DataFrame:
    """Per key one bigint mask per name: the or of 1 << bit over the rows that meet its condition (0 if none)."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))
    return df.groupBy(*keys).agg(*[F.coalesce(F.bit_or(F.when(c, one)), F.lit(0).cast("long")).alias(name) for name, c in masks.items()])


def structures_available(masks: DataFrame, mask: str, required: dict[str, int]) -> DataFrame:
    """(row, structure, available): does the mask hold all bits that the structure requires? Structures are a small constant list."""
    items = F.explode(F.array(*[F.struct(F.lit(n).alias("structure"), F.lit(m).cast("long").alias("required_mask")) for n, m in required.items()]))
    return masks.withColumn("x", items).select("*", "x.*").drop("x").withColumn("available", F.col(mask).bitwiseAND(F.col("required_mask")) == F.col("required_mask"))


def complete_legs(legs: DataFrame, keys: list[str], leg: str, needed: int) -> DataFrame:
    """Per key: legs seen and whether all are there exactly once."""
    return legs.groupBy(*keys).agg(F.count("*").alias("leg_rows"), F.count_distinct(leg).alias("legs")).withColumn("complete", (F.col("legs") == needed) & (F.col("leg_rows") == needed))


def coverage(df: DataFrame, keys: list[str], day: str, ok: Column) -> DataFrame:
    """Two levels: share of good rows per day, then over days: days, perfect days, mean, 5th percentile and worst share."""
    daily = df.groupBy(*keys, day).agg((F.count_if(ok) / F.count("*")).alias("share"))
    return daily.groupBy(*keys).agg(F.count("*").alias("days"), F.count_if(F.col("share") == 1).alias("perfect_days"), F.round(100 * F.avg("share"), 4).alias("mean_pct"), F.round(100 * F.percentile("share", F.lit(0.05)), 4).alias("p05_pct"), F.round(100 * F.min("share"), 4).alias("worst_pct"))


def mark(legs: DataFrame, keys: list[str], weight: str, entry: str, exit_: str) -> DataFrame:
    """Signed-weight sums per structure: entry value, exit value and P&L; null where a leg's price is missing."""
    whole = lambda c: F.when(F.count(c) == F.count("*"), F.sum(F.col(weight) * F.col(c)))
    return legs.groupBy(*keys).agg(whole(entry).alias("entry_value"), whole(exit_).alias("exit_value")).withColumn("pnl", F.col("exit_value") - F.col("entry_value"))


def terminal_risk(legs: DataFrame, keys: list[str], weight: str, strike: str, is_call: str, entry: str) -> DataFrame:
    """Max loss and max profit at expiry over the candidate spots 0, every strike and twice the largest strike."""
    per = legs.groupBy(*keys).agg(F.collect_list(F.struct(F.col(weight).cast("double").alias("w"), F.col(strike).cast("double").alias("k"), F.col(is_call).alias("c"))).alias("__legs"), F.sum(F.col(weight) * F.col(entry)).alias("entry_value"))
    strikes = F.transform("__legs", lambda x: x["k"])
    spots = F.concat(F.array(F.lit(0.0)), strikes, F.array(2 * F.array_max(strikes)))
    pay = lambda s: F.aggregate("__legs", F.lit(0.0), lambda a, x: a + x["w"] * F.greatest(F.lit(0.0), F.when(x["c"], s - x["k"]).otherwise(x["k"] - s)))
    values = F.transform(spots, lambda s: pay(s) - F.col("entry_value"))
    return per.withColumn("__v", values).select(*keys, "entry_value", F.greatest(F.lit(0.0), -F.array_min("__v")).alias("max_loss"), F.greatest(F.lit(0.0), F.array_max("__v")).alias("max_profit"))


def net_exposure(legs: DataFrame, keys: list[str], weight: str, columns: list[str]) -> DataFrame:
    """Signed-weight sums of Greeks or prices."""
    return legs.groupBy(*keys).agg(*[F.sum(F.col(weight) * F.col(c)).alias(f"net_{c}") for c in columns])
