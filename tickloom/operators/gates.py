"""Quality gates, reasons and single-pass audits. Rows are never dropped: failures become a status and reasons."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """Not null, not NaN, not infinite."""
    d = c.cast("double")
    return F.coalesce(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), F.lit(False))


def gate(df: DataFrame, conditions: Mapping[str, Column], status: str = "gate_status", reasons: str = "gate_reasons") -> DataFrame:
    """READY where all conditions hold, else BLOCKED; reasons joins the names of the failed ones (null if none). Null fails."""
    holds = {k: F.coalesce(c, F.lit(False)) for k, c in conditions.items()}
    failed = F.concat_ws(";", *[F.when(~c, k) for k, c in holds.items()])
    return df.withColumn(reasons, F.nullif(failed, F.lit(""))).withColumn(status, F.when(F.col(reasons).isNull(), "READY").otherwise("BLOCKED"))


def first_failure(conditions: Mapping[str, Column]) -> Column:
    """The first name whose condition fails (or is null), in order."""
    return F.coalesce(*[F.when(~F.coalesce(c, F.lit(False)), k) for k, c in conditions.items()])


def bar_violations(open_: str = "open", high: str = "high", low: str = "low", close: str = "close", volume: str = "volume") -> Column:
    """First violated bar invariant, or null."""
    o, h, lo, c, v = (F.col(x) for x in (open_, high, low, close, volume))
    return first_failure({"NON_FINITE": finite(o) & finite(h) & finite(lo) & finite(c), "HIGH_BELOW": (h >= o) & (h >= c) & (h >= lo), "LOW_ABOVE": (lo <= o) & (lo <= c), "NEGATIVE_VOLUME": v >= 0})


def split_exceptions(df: DataFrame, reason: str) -> tuple[DataFrame, DataFrame]:
    """(valid, exceptions) by whether the reason is null."""
    return df.where(F.col(reason).isNull()).drop(reason), df.where(F.col(reason).isNotNull())


def audit(df: DataFrame, checks: Mapping[str, Column], keys: list[str] | None = None) -> DataFrame:
    """One scan: total rows, rows per check, and for ``keys`` the duplicates beyond the first of each key."""
    aggs = [F.count("*").alias("total_rows"), *[F.count_if(c).alias(k) for k, c in checks.items()]]
    if not keys:
        return df.agg(*aggs)
    per_key = df.groupBy(*keys).agg(*aggs)  # partial sums by key, then one small sum
    return per_key.agg(F.sum("total_rows").alias("total_rows"), *[F.sum(k).alias(k) for k in checks], F.sum(F.col("total_rows") - 1).alias("excess_duplicates"))


def key_excess(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: duplicate_keys and excess_rows."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return g.agg(F.count("*").alias("duplicate_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess_rows"))


def verdict(violations: DataFrame) -> DataFrame:
    """Audit columns as rows (check, violations, passed); column names are compared as they are."""
    names = [c for c in violations.columns if c != "total_rows"]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("violations")) for c in names]))
    return violations.select(pairs.alias("x")).select("x.*", (F.col("x.violations") == 0).alias("passed"))


def signature(df: DataFrame) -> DataFrame:
    """Order-free content signature: rows and the sum of row hashes as text; compare it before and after a rewrite.

    A sum, as an xor would cancel repeated rows; each value is hashed with whether it is null, as a hash alone skips nulls.
    """
    names = ["`" + c.replace("`", "``") + "`" for c in df.columns]
    row = F.xxhash64(*[x for c in names for x in (F.col(c).isNull(), F.col(c))])
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(row.cast("decimal(20,0)")), F.lit(0)).cast("string").alias("signature"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) for all columns in one pass; null is <NULL>."""
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("<NULL>")).alias("value")) for c in columns]))
    return df.select(items.alias("x")).groupBy("x.column", "x.value").agg(F.count("*").alias("n"))


def null_coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls, null_pct) in one pass."""
    one = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns]))
    return one.select("__n", items.alias("x")).select("x.*", F.round(100.0 * F.col("x.nulls") / F.nullif(F.col("__n"), F.lit(0)), 4).alias("null_pct"))


def half_up_grid(x: Column, grid: float) -> Column:
    """The nearest multiple of ``grid``, halves up."""
    return F.floor(x / F.lit(grid) + F.lit(0.5)).cast("double") * F.lit(grid)


def label_offset(label: Column) -> Column:
    """The signed offset of an ATM, ATM+n or ATM-n label; null for anything else."""
    return F.when(label == "ATM", F.lit(0)).when(label.rlike(r"^ATM[+-]\d+$"), F.expr("1").cast("int") * label.substr(F.lit(4), F.length(label)).try_cast("int"))


def ladder_check(df: DataFrame, peers: list[str], at_money: Column, strike: str, offset: str, step: float) -> DataFrame:
    """Is each row's strike its partition's at-the-money strike plus offset steps? Adds atm_strike, ladder_valid, ladder_reason."""
    from pyspark.sql import Window

    atm = F.max(F.when(at_money, F.col(strike))).over(Window.partitionBy(*peers))
    out = df.withColumn("atm_strike", atm)
    wanted = F.col("atm_strike") + F.col(offset) * F.lit(step)
    reason = F.when(F.col("atm_strike").isNull(), "NO_ATM_PEER").when(F.col(offset).isNull(), "BAD_LABEL").when(F.abs(F.col(strike) - wanted) > 1e-9, "OFF_LADDER")
    return out.withColumn("ladder_reason", reason).withColumn("ladder_valid", F.col("ladder_reason").isNull())


def divergence(df: DataFrame, a: str, b: str, tolerance: float, severe_abs: float, severe_rel: float) -> DataFrame:
    """Signed, absolute, relative and bps difference of two sources with a status; division by zero gives null."""
    diff = F.col(a) - F.col(b)
    rel = F.try_divide(F.abs(diff), F.abs(F.col(b)))
    status = (
        F.when(F.col(a).isNull() & F.col(b).isNull(), "BOTH_MISSING").when(F.col(a).isNull(), "LEFT_MISSING").when(F.col(b).isNull(), "RIGHT_MISSING").when(~finite(F.col(a)) | ~finite(F.col(b)), "NON_FINITE")
        .when((F.abs(diff) >= severe_abs) & (rel >= severe_rel), "SEVERE").when(F.abs(diff) > tolerance, "DIVERGENT").otherwise("CONSISTENT")
    )
    return df.withColumns({"diff": diff, "abs_diff": F.abs(diff), "rel_diff": rel, "diff_bps": rel * 10000, "divergence_status": status})


def redact(text: Column) -> Column:
    """Values of token, key, secret and password fields replaced."""
    return F.regexp_replace(text, r'(?i)("?(?:[a-z_]*token|api_?key|secret|password)"?\s*[:=]\s*)"?[^",\s}]+"?', "$1***")
