"""Time-series windows: exact lags, islands, rolling and causal statistics, crossings and reversals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_shift(value: str | Column, ts: str, keys: list[str], steps: int, step: str) -> Column:
    """The value ``steps`` rows back (ahead if negative), only if the times differ by exactly that many ``step`` intervals."""
    w = Window.partitionBy(*keys).orderBy(ts)
    v = F.col(value) if isinstance(value, str) else value
    move = F.lag if steps > 0 else F.lead
    n, unit = step.split(" ")
    span = F.expr(f"INTERVAL {abs(steps) * int(n)} {unit}")
    here, there = F.col(ts), move(ts, abs(steps)).over(w)
    return F.when(here == there + span if steps > 0 else here == there - span, move(v, abs(steps)).over(w))


def islands(df: DataFrame, keys: list[str], ts: str, step: str) -> DataFrame:
    """``df`` with run_id (1, 2, ... within the keys) of contiguous rows, run_start, run_end and run_rows."""
    w = Window.partitionBy(*keys).orderBy(ts)
    starts = F.when(F.lag(ts).over(w) == F.col(ts) - F.expr(f"INTERVAL {step}"), 0).otherwise(1)
    out = df.withColumn("__s", starts).withColumn("run_id", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")
    r = Window.partitionBy(*keys, "run_id")
    return out.withColumns({"run_start": F.min(ts).over(r), "run_end": F.max(ts).over(r), "run_rows": F.count("*").over(r)})


def rolling_median(value: str, ts: str, keys: list[str], rows: int, step: str) -> Column:
    """Median of the last ``rows`` rows, null unless they are all there and contiguous."""
    w = Window.partitionBy(*keys).orderBy(ts)
    frame = w.rowsBetween(-(rows - 1), 0)
    n, unit = step.split(" ")
    whole = F.lag(ts, rows - 1).over(w) == F.col(ts) - F.expr(f"INTERVAL {(rows - 1) * int(n)} {unit}")
    return F.when(whole & (F.count(value).over(frame) == rows), F.percentile(value, F.lit(0.5)).over(frame))


def forward_extremes(value: str, ts: str, keys: list[str], rows: int) -> tuple[Column, Column, Column]:
    """Maximum and minimum over this row and the next ``rows``, and the value at the end (null if there are fewer)."""
    w = Window.partitionBy(*keys).orderBy(ts)
    frame = w.rowsBetween(0, rows)
    return F.max(value).over(frame), F.min(value).over(frame), F.lead(value, rows).over(w)


def realised_volatility(df: DataFrame, keys: list[str], ts: str, price: str, horizon: int, step: str) -> DataFrame:
    """``df`` with log_return (within contiguous runs), trailing_rv and forward_rv over ``horizon`` returns; null if short."""
    runs = islands(df, keys, ts, step)
    by = [*keys, "run_id"]
    w = Window.partitionBy(*by).orderBy(ts)
    ret = F.log(F.col(price) / F.lag(price).over(w))
    out = runs.withColumn("log_return", ret)
    sq = F.col("log_return") * F.col("log_return")
    back, ahead = w.rowsBetween(-(horizon - 1), 0), w.rowsBetween(1, horizon)
    total = lambda f: F.when(F.count("log_return").over(f) == horizon, F.sqrt(F.sum(sq).over(f)))
    return out.withColumns({"trailing_rv": total(back), "forward_rv": total(ahead)})


def causal_percentile(df: DataFrame, bucket: list[str], date: str, value: str, least: int = 60, out: str = "causal_pct") -> DataFrame:
    """Share of the same bucket's values on strictly earlier dates that are <= this one; null with less than ``least`` of them.

    Works on one row per (bucket, date, value) with a count, so equal values cost one row, in Arrow batches per bucket: a
    sorted list of earlier values is searched by bisection, memory is one bucket's values.
    """
    import bisect

    import pandas as pd

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*bucket, date, value).schema)
    cells = df.where(F.col(value).isNotNull()).groupBy(*bucket, date, value).agg(F.count("*").alias("__n"))

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date, kind="stable")
        seen: list[float] = []
        share = []
        for _, day in pdf.groupby(date, sort=True):
            share += [bisect.bisect_right(seen, v) / len(seen) if len(seen) >= max(1, least) else None for v in day[value]]
            for v, n in zip(day[value], day["__n"], strict=True):
                at = bisect.bisect_right(seen, v)
                seen[at:at] = [v] * n
        return pdf[[*bucket, date, value]].assign(__p=pd.Series(share, index=pdf.index, dtype=float))

    ranks = cells.groupBy(*bucket).applyInPandas(rank, f"{kind}, __p double")
    on = [*bucket, date, value]
    ranks = ranks.select(*[F.col(c).alias(f"__{c}") for c in on], F.when(~F.isnan("__p"), F.col("__p")).alias(out))
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return df.join(ranks, cond, "left").drop(*[f"__{c}" for c in on])


def ecdf(df: DataFrame, reference: DataFrame, value: str, out: str = "ecdf") -> DataFrame:
    """Share of the frozen reference's values <= each value, by a running count over the union of both."""
    r = reference.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n"))
    points = r.select(value, "__n").unionByName(df.where(F.col(value).isNotNull()).select(value, F.lit(0).cast("long").alias("__n"))).groupBy(value).agg(F.sum("__n").alias("__n"))
    points = running_total(points, value, "__n", "__upto")
    total = reference.agg(F.count(value).alias("__all"))
    ranks = points.crossJoin(total).select(F.col(value).alias("__v"), F.try_divide(F.col("__upto"), F.col("__all")).alias(out))
    return df.join(ranks, F.col(value) == F.col("__v"), "left").drop("__v")


def running_total(df: DataFrame, order: str, amount: str, out: str, parts: int = 64) -> DataFrame:
    """A cumulative sum in the order of one numeric column without a single-partition window.

    Rows fall into ranges between at most ``parts`` approximate quantiles, taken as constants; sums of whole ranges, one row
    each, are accumulated and added.
    """
    cuts = sorted(set(df.approxQuantile(order, [k / parts for k in range(1, parts)], 1 / parts))) if parts > 1 else []
    part = F.lit(0)
    for c in cuts:
        part = part + (F.col(order) > c).cast("int")
    inner = Window.partitionBy("__part").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    ranged = df.withColumn("__part", part).withColumn("__in", F.sum(amount).over(inner))
    heads = ranged.groupBy("__part").agg(F.sum(amount).alias("__all_in"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    heads = heads.select(F.col("__part").alias("__head"), F.coalesce(F.sum("__all_in").over(before), F.lit(0)).alias("__before"))
    return ranged.join(F.broadcast(heads), F.col("__part") == F.col("__head")).withColumn(out, F.col("__in") + F.col("__before")).drop("__part", "__head", "__in", "__before")


def average_rank(keys: list[str], value: str) -> Column:
    """Rank within the keys, ties at their mean rank."""
    w = Window.partitionBy(*keys)
    ties = Window.partitionBy(*keys, value)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(ties) - 1) / F.lit(2.0)


def crossings(value: str, previous: Column, threshold: Column) -> Column:
    """UP where previous < threshold <= value, DOWN where previous > threshold >= value, else null."""
    v = F.col(value)
    return F.when((previous < threshold) & (v >= threshold), "UP").when((previous > threshold) & (v <= threshold), "DOWN")


def first_event(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def tail_reversal(df: DataFrame, keys: list[str], ts: str, value: str, high: float = 0.9, drop: float = 0.1) -> DataFrame:
    """Rows with reversal: HIGH after a running maximum >= high has been left by >= drop while falling, LOW mirrored.

    The running extremes exclude the row itself; a rise or fall is against the row before.
    """
    w = Window.partitionBy(*keys).orderBy(ts)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    v, prev = F.col(value), F.lag(value).over(w)
    top, low = F.max(value).over(before), F.min(value).over(before)
    out = df.withColumns({"__v": v - prev, "__top": top, "__low": low})
    up = (F.col("__top") >= high) & (F.col("__top") - v >= drop) & (F.col("__v") < 0)
    down = (F.col("__low") <= 1 - high) & (v - F.col("__low") >= drop) & (F.col("__v") > 0)
    return out.withColumn("reversal", F.when(up, "HIGH").when(down, "LOW")).drop("__v", "__top", "__low")


def minute_grid(dates: DataFrame, date: str, start: str, end: str, step: str = "1 MINUTE") -> DataFrame:
    """One row (date, ts) per step from date + start to date + end, both intervals; the series generator."""
    d = F.col(date).cast("timestamp_ntz")
    return dates.select(date, F.explode(F.sequence(d + F.expr(start), d + F.expr(end), F.expr(f"INTERVAL {step}"))).alias("ts"))


def completed_prefix(df: DataFrame, keys: list[str], index: str, done: Column) -> DataFrame:
    """Per key the frontier: the smallest index that isn't done (null if all are), and how many rows lie before it."""
    g = df.groupBy(*keys).agg(F.min(F.when(~done, F.col(index))).alias("frontier"), F.collect_list(index).alias("__i"))
    return g.withColumn("completed", F.size(F.filter("__i", lambda i: F.col("frontier").isNull() | (i < F.col("frontier")))).cast("long")).drop("__i")
