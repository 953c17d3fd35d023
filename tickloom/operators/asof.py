"""Point-in-time joins: backward as-of with tolerance, status and reason; nearest snapshot; exact-horizon self-join.

The as-of join is a union of both sides and one running ``last`` over (keys; time, side): one shuffle on the keys and one
sort, linear in the rows, with right rows before left ones at equal times. No row of the left side is ever dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MATCHED, BLOCKED = "MATCHED", "BLOCKED"


def seconds_between(late: Column, early: Column) -> Column:
    """Elapsed seconds, whole microseconds exact."""
    return (F.unix_micros(late.cast("timestamp")) - F.unix_micros(early.cast("timestamp"))) / F.lit(1e6)


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, values: list[str], tolerance_s: float | None = 60.0, shift: str | None = None, prefix: str = "r_") -> DataFrame:
    """``left`` with the latest right row at or before ``left_ts`` (plus ``shift``, an interval) on equal ``keys``.

    Adds prefix + ts, each of ``values`` with the prefix, prefix + age_s, prefix + status (MATCHED or BLOCKED) and
    prefix + reason: null, NULL_KEY, NO_ROWS (keys absent on the right), FUTURE_ONLY, STALE (older than the tolerance),
    NON_FINITE (a matched value is null or NaN). Values are null unless MATCHED. Of equal right times the one
    with the greatest values wins.
    """
    target = F.col(left_ts) + F.expr(shift) if shift else F.col(left_ts)
    lcols = left.columns
    ls = left.select(*[F.col(k).alias(f"__k{j}") for j, k in enumerate(keys)], target.alias("__t"), F.lit(1).alias("__side"), F.struct(*lcols).alias("__l"), F.lit(None).cast(right.select(F.struct(F.col(right_ts).alias("ts"), *values)).schema[0].dataType).alias("__r"))
    payload = F.struct(F.col(right_ts).alias("ts"), *values)
    rs = right.where(F.col(right_ts).isNotNull()).select(*[F.col(k).alias(f"__k{j}") for j, k in enumerate(keys)], F.col(right_ts).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(ls.schema["__l"].dataType).alias("__l"), payload.alias("__r"))
    by = [f"__k{j}" for j in range(len(keys))]
    order = ["__t", "__side", "__r"]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    u = rs.unionByName(ls).withColumns({"__m": F.last("__r", ignorenulls=True).over(w), "__any": F.max(F.when(F.col("__side") == 0, 1).otherwise(0)).over(whole)})
    u = u.where("__side = 1")
    age = seconds_between(F.col("__t"), F.col("__m.ts"))
    null_key = F.lit(False)
    for k in by:
        null_key = null_key | F.col(k).isNull()
    bad = F.lit(False)
    for v in values:
        kind = right.schema[v].dataType.simpleString()
        bad = bad | F.col(f"__m.{v}").isNull() | (F.isnan(F.col(f"__m.{v}")) if kind in ("double", "float") else F.lit(False))
    late = F.lit(False) if tolerance_s is None else age > F.lit(float(tolerance_s))
    reason = F.when(null_key | F.col("__t").isNull(), "NULL_KEY").when(F.col("__any") == 0, "NO_ROWS").when(F.col("__m").isNull(), "FUTURE_ONLY").when(late, "STALE").when(bad, "NON_FINITE")
    u = u.withColumns({"__age": age, "__reason": reason})
    ok = F.col("__reason").isNull()
    return u.select(
        *[F.col(f"__l.{c}").alias(c) for c in lcols],
        F.when(ok, F.col("__m.ts")).alias(f"{prefix}ts"),
        *[F.when(ok, F.col(f"__m.{v}")).alias(f"{prefix}{v}") for v in values],
        F.when(ok, F.col("__age")).alias(f"{prefix}age_s"),
        F.when(ok, MATCHED).otherwise(BLOCKED).alias(f"{prefix}status"),
        F.col("__reason").alias(f"{prefix}reason"),
    )


def quarantine_duplicates(right: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key with n_rows and is_duplicate; joins can then block ambiguous matches."""
    w = Window.partitionBy(*keys)
    return right.withColumns({"n_rows": F.count("*").over(w), "__rn": F.row_number().over(w.orderBy(*order))}).where("__rn = 1").drop("__rn").withColumn("is_duplicate", F.col("n_rows") > 1)


def nearest_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, values: list[str], prefix: str = "r_") -> DataFrame:
    """The right row nearest in time in either direction, the earlier one at a tie; none within the keys gives nulls."""
    back = asof_join(left, right, keys, left_ts, right_ts, values, None, prefix="b_")
    flip = lambda c: -F.unix_micros(F.col(c).cast("timestamp"))
    lcols = left.columns
    l2 = back.withColumn("__neg", flip(left_ts))
    r2 = right.withColumn("__neg", flip(right_ts))
    by = [f"__k{j}" for j in range(len(keys))]
    payload = F.struct("__neg", F.col(right_ts).alias("ts"), *values)
    ls = l2.select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)], F.col("__neg").alias("__t"), F.lit(1).alias("__side"), F.struct(*[c for c in l2.columns if c != "__neg"]).alias("__l"), F.lit(None).cast(r2.select(payload).schema[0].dataType).alias("__r"))
    rs = r2.select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)], F.col("__neg").alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(ls.schema["__l"].dataType).alias("__l"), payload.alias("__r"))
    w = Window.partitionBy(*by).orderBy("__t", "__side", "__r").rowsBetween(Window.unboundedPreceding, 0)
    u = rs.unionByName(ls).withColumn("__f", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    ahead = seconds_between(F.col("__f.ts"), F.col(f"__l.{left_ts}"))
    behind = F.col("__l.b_age_s")
    use_back = behind.isNotNull() & (ahead.isNull() | (behind <= ahead))
    pick = lambda b, f: F.when(use_back, F.col(f"__l.b_{b}")).otherwise(F.col(f"__f.{f}"))
    return u.select(*[F.col(f"__l.{c}").alias(c) for c in lcols], pick("ts", "ts").alias(f"{prefix}ts"), *[pick(v, v).alias(f"{prefix}{v}") for v in values])


def exact_horizon(df: DataFrame, keys: list[str], ts: str, interval: str, values: list[str], prefix: str = "next_") -> DataFrame:
    """``df`` with ``values`` of the row of the same keys exactly ``interval`` later; null where there is none."""
    later = df.select(*[F.col(k).alias(f"__{k}") for k in keys], (F.col(ts) - F.expr(f"INTERVAL {interval}")).alias("__ts"), *[F.col(v).alias(f"{prefix}{v}") for v in values])
    on = F.col(ts) == F.col("__ts")
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return df.join(later, on, "left").drop("__ts", *[f"__{k}" for k in keys])
