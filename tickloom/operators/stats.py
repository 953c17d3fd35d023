"""Aggregations: distributions, tail means, correlations, coverage, resampling, bootstrap and permutation tests, ridge."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .timeseries import average_rank

PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, mean, std, win_rate, profit_factor and exact percentiles p01 ... p99 per key."""
    v = F.col(value)
    loss = F.abs(F.sum(F.when(v < 0, v)))
    aggs = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.avg((v > 0).cast("double")).alias("win_rate"), F.try_divide(F.sum(F.when(v > 0, v)), loss).alias("profit_factor")]
    aggs += [F.percentile(v, F.lit(p)).alias(f"p{round(100 * p):02d}") for p in PERCENTILES]
    return df.groupBy(*keys).agg(*aggs)


def cvar(df: DataFrame, keys: list[str], value: str, share: float = 0.05) -> DataFrame:
    """Mean of the ceil(share n) smallest values per key."""
    w = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).withColumns({"__r": F.row_number().over(w.orderBy(value)), "__n": F.count("*").over(w)})
    return ranked.where(F.col("__r") <= F.ceil(F.col("__n") * share)).groupBy(*keys).agg(F.count("*").alias("tail_n"), F.avg(value).alias("cvar"))


def correlations(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson and Spearman (average ranks) per key; null under three pairs."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"__x": average_rank(keys, x), "__y": average_rank(keys, y)})
    g = ok.groupBy(*keys).agg(F.count("*").alias("n"), F.corr(x, y).alias("pearson"), F.corr("__x", "__y").alias("spearman"))
    return g.withColumns({c: F.when(F.col("n") >= 3, F.col(c)) for c in ("pearson", "spearman")})


def mode_with_ties(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value per key, the smallest one at a tie, and its count."""
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), value)
    return c.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*keys, F.col(value).alias("mode"), F.col("n").alias("mode_n"))


def grouping_sets(df: DataFrame, sets: list[list[str]], aggregates: dict[str, str]) -> DataFrame:
    """Aggregates over several groupings in one scan; ``aggregates``: name -> SQL. Columns outside a set are null, grouping_id tells them."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    view = f"__gs_{abs(hash((id(df), tuple(columns))))}"
    df.createOrReplaceTempView(view)
    body = ", ".join(f"{sql} AS {name}" for name, sql in aggregates.items())
    groups = ", ".join("(" + ", ".join(s) + ")" for s in sets)
    out = df.sparkSession.sql(f"SELECT {', '.join(columns)}, grouping_id() AS grouping_id, {body} FROM {view} GROUP BY GROUPING SETS ({groups})")
    df.sparkSession.catalog.dropTempView(view)
    return out


def weekly(df: DataFrame, keys: list[str], date: str, value: str, day: str = "FRI") -> DataFrame:
    """Last value, sum and minimum per week that ends on ``day``."""
    end = F.next_day(F.date_sub(F.col(date).cast("date"), 1), day)
    return df.withColumn("week_end", end).groupBy(*keys, "week_end").agg(F.max_by(value, date).alias("last_value"), F.sum(value).alias("sum_value"), F.min(value).alias("min_value"), F.count("*").alias("n"))


def resample(df: DataFrame, keys: list[str], date: str, value: str, period: str) -> DataFrame:
    """Last value, sum and minimum per calendar period ("month", "quarter" or "year"), named by its last day."""
    months = {"month": 1, "quarter": 3, "year": 12}[period]
    end = F.date_sub(F.add_months(F.trunc(F.col(date).cast("date"), period), months), 1)
    return df.withColumn("period_end", end).groupBy(*keys, "period_end").agg(F.max_by(value, date).alias("last_value"), F.sum(value).alias("sum_value"), F.min(value).alias("min_value"), F.count("*").alias("n"))


def payoff(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, win rate, profit factor (gains / losses) and payoff ratio (mean win / mean loss); a ratio without losses is null."""
    v = F.col(value)
    win, loss = F.when(v > 0, v), F.when(v < 0, -v)
    rate = F.avg(F.when(v.isNotNull(), (v > 0).cast("double")))
    return df.groupBy(*keys).agg(F.count(v).alias("n"), rate.alias("win_rate"), (F.sum(win) / F.nullif(F.sum(loss), F.lit(0.0))).alias("profit_factor"), (F.avg(win) / F.nullif(F.avg(loss), F.lit(0.0))).alias("payoff_ratio"))


def paired_differences(df: DataFrame, unit: str, arm: str, value: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows (pair, n, mean, median, positive_rate) of mean(first arm) - mean(second arm) over the units that have both arms.

    The arms are pivoted by conditional means in one aggregation; the pairs are given, so no pass looks for them.
    """
    arms = sorted({a for p in pairs for a in p})
    wide = df.groupBy(unit).agg(*[F.avg(F.when(F.col(arm) == a, F.col(value))).alias(f"a{j}") for j, a in enumerate(arms)])
    at = {a: F.col(f"a{j}") for j, a in enumerate(arms)}
    each = wide.select(F.explode(F.array(*[F.struct(F.lit(f"{a}-{b}").alias("pair"), (at[a] - at[b]).alias("d")) for a, b in pairs])).alias("x")).select("x.*").where("d is not null")
    return each.groupBy("pair").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.median("d").alias("median"), F.avg((F.col("d") > 0).cast("double")).alias("positive_rate"))


def quantile_buckets(df: DataFrame, keys: list[str], value: str, buckets: int, outcome: str) -> DataFrame:
    """Equal-count buckets of ``value`` (1 ... buckets, by average rank) with the outcome's count, mean and win rate."""
    w = Window.partitionBy(*keys)
    ok = df.where(F.col(value).isNotNull()).withColumns({"__r": average_rank(keys, value), "__n": F.count("*").over(w)})
    b = F.least(F.lit(buckets), F.ceil(F.col("__r") * buckets / F.col("__n"))).cast("int")
    return ok.withColumn("bucket", b).groupBy(*keys, "bucket").agg(F.count("*").alias("n"), F.avg(outcome).alias("mean_outcome"), F.avg((F.col(outcome) > 0).cast("double")).alias("win_rate"))


def bootstrap_mean(df: DataFrame, keys: list[str], value: str, block: str | None = None, draws: int = 1000, seed: int = 7) -> DataFrame:
    """Seeded 95 % bootstrap interval of the mean per key; with ``block`` whole blocks (such as dates) are drawn.

    A key's values are reduced to (sum, count) per block first, map-side, so a task holds blocks, not rows; without
    a block distinct values with their counts are drawn as a multinomial.
    """
    unit = block or value
    cells = df.where(F.col(value).isNotNull()).groupBy(*keys, unit).agg(F.sum(value).alias("__s"), F.count("*").alias("__n"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(unit, kind="stable")
        s, n = pdf["__s"].to_numpy(float), pdf["__n"].to_numpy(float)
        rng = np.random.default_rng(seed)
        if block:
            counts = rng.multinomial(len(s), np.full(len(s), 1 / len(s)), draws)
            means = counts @ s / (counts @ n)
        else:
            counts = rng.multinomial(int(n.sum()), n / n.sum(), draws)
            means = counts @ (s / n) / n.sum()
        lo, hi = np.percentile(means, [2.5, 97.5])
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "n": [int(n.sum())], "mean": [s.sum() / n.sum()], "ci_low": [lo], "ci_high": [hi]})

    return cells.groupBy(*keys).applyInPandas(run, f"{kind}, n long, mean double, ci_low double, ci_high double")


def permutation_break(df: DataFrame, keys: list[str], flag: str, value: str, draws: int = 2000, seed: int = 11) -> DataFrame:
    """Two-sample permutation test of equal means between flag = true and false, per key: difference and two-sided p."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([flag, value], kind="stable")
        f, v = pdf[flag].to_numpy(bool), pdf[value].to_numpy(float)
        k, n = int(f.sum()), len(v)
        head = {x: [pdf[x].iloc[0]] for x in keys}
        if k in (0, n):
            return pd.DataFrame({**head, "n_true": [k], "n_false": [n - k], "difference": [None], "p_value": [None]})
        gap = lambda total: total / k - (v.sum() - total) / (n - k)
        seen = gap(v[f].sum())
        rng = np.random.default_rng(seed)
        hits = sum(abs(gap(v[rng.permutation(n)[:k]].sum())) >= abs(seen) - 1e-12 for _ in range(draws))
        return pd.DataFrame({**head, "n_true": [k], "n_false": [n - k], "difference": [seen], "p_value": [(hits + 1) / (draws + 1)]})

    ok = df.where(F.col(value).isNotNull() & F.col(flag).isNotNull()).select(*keys, flag, value)
    return ok.groupBy(*keys).applyInPandas(run, f"{kind}, n_true long, n_false long, difference double, p_value double")


def rank_correlation_test(df: DataFrame, keys: list[str], x: str, y: str, draws: int = 500, seed: int = 13) -> DataFrame:
    """Spearman correlation per key with a bootstrap interval and a one-sided permutation p."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def rho(a: np.ndarray, b: np.ndarray) -> float:
        ra, rb = (pd.Series(v).rank().to_numpy() for v in (a, b))
        ra, rb = ra - ra.mean(), rb - rb.mean()
        d = np.sqrt((ra @ ra) * (rb @ rb))
        return float(ra @ rb / d) if d else float("nan")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([x, y], kind="stable")
        a, b = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        rng = np.random.default_rng(seed)
        seen = rho(a, b)
        boot = [rho(a[i], b[i]) for i in (rng.integers(0, len(a), len(a)) for _ in range(draws))]
        lo, hi = np.nanpercentile(boot, [2.5, 97.5])
        hits = sum(rho(a, rng.permutation(b)) >= seen for _ in range(draws))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "n": [len(a)], "rho": [seen], "ci_low": [lo], "ci_high": [hi], "p_value": [(hits + 1) / (draws + 1)]})

    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    return ok.groupBy(*keys).applyInPandas(run, f"{kind}, n long, rho double, ci_low double, ci_high double, p_value double")


def ridge(df: DataFrame, keys: list[str], features: list[str], target: str, penalty: float = 1.0) -> DataFrame:
    """Ridge regression per key: (keys, term, coefficient) on standardised features, intercept unpenalised.

    Missing features take the key's median. Only moments meet: X'X and X'y are sums of products per key, taken by
    Spark's partial aggregation, so no task holds a key's rows.
    """
    med = df.groupBy(*keys).agg(*[F.median(f).alias(f"__m_{f}") for f in features])
    filled = df.join(med, keys).where(F.col(target).isNotNull()).select(*keys, target, *[F.coalesce(F.col(f).cast("double"), F.col(f"__m_{f}")).alias(f) for f in features])
    moments = filled.groupBy(*keys).agg(*[F.avg(f).alias(f"__a_{f}") for f in features], *[F.stddev_pop(f).alias(f"__s_{f}") for f in features], F.avg(target).alias("__y"))
    z = filled.join(moments, keys).select(*keys, (F.col(target) - F.col("__y")).alias("__t"), "__y", *[F.coalesce(F.try_divide(F.col(f) - F.col(f"__a_{f}"), F.col(f"__s_{f}")), F.lit(0.0)).alias(f) for f in features])
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    sums = z.groupBy(*keys).agg(F.first("__y").alias("__y"), *[F.sum(F.col(a) * F.col(b)).alias(f"__{a}__{b}") for a, b in pairs], *[F.sum(F.col(a) * F.col("__t")).alias(f"__t_{a}") for a in features])
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def solve(batches):
        for pdf in batches:
            for r in pdf.to_dict("records"):
                x = np.zeros((len(features), len(features)))
                for a, b in pairs:
                    i, j = features.index(a), features.index(b)
                    x[i, j] = x[j, i] = r[f"__{a}__{b}"]
                beta = np.linalg.pinv(x + penalty * np.eye(len(features))) @ np.array([r[f"__t_{a}"] for a in features])
                yield pd.DataFrame({**{k: [r[k]] * (len(features) + 1) for k in keys}, "term": ["intercept", *features], "coefficient": [r["__y"], *beta]})

    return sums.mapInPandas(solve, f"{kind}, term string, coefficient double")
