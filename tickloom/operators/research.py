"""Research operators: calendars, session offsets, event labels, exit panels, attribution, decay, reserves, acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expected_sessions(spark, start: str, end: str, weekdays: list[int], overrides: DataFrame | None = None) -> DataFrame:
    """(date, state, source): the weekly rule (0 = Monday) from start to end, explicit overrides (date, state) on top."""
    days = spark.range(1).select(F.explode(F.expr(f"sequence(date'{start}', date'{end}', interval 1 day)")).alias("date"))
    rule = F.when(F.weekday("date").isin(weekdays), "OPEN").otherwise("CLOSED")
    if overrides is None:
        return days.select("date", rule.alias("state"), F.lit("RULE").alias("source"))
    o = overrides.select("date", F.col("state").alias("__o"))
    return days.join(o, "date", "left").select("date", F.coalesce("__o", rule).alias("state"), F.when(F.col("__o").isNull(), "RULE").otherwise("OVERRIDE").alias("source"))


def session_index(sessions: DataFrame, date: str = "date") -> DataFrame:
    """Distinct session dates with their running number; a calendar is a few thousand rows, so one window is its natural size."""
    return sessions.select(date).distinct().withColumn("session", F.row_number().over(Window.orderBy(date)))


def nth_next_session(df: DataFrame, sessions: DataFrame, date: str, steps: list[int], session_date: str = "date") -> DataFrame:
    """One row per step n with exit_date, the n-th session after the row's own; null beyond the calendar or off it."""
    idx = session_index(sessions, session_date)
    here = idx.select(F.col(session_date).alias("__d"), F.col("session").alias("__s"))
    there = idx.select(F.col(session_date).alias("exit_date"), F.col("session").alias("__t"))
    out = df.join(F.broadcast(here), F.col(date) == F.col("__d"), "left").withColumn("step", F.explode(F.array(*[F.lit(s) for s in steps])))
    return out.join(F.broadcast(there), F.col("__s") + F.col("step") == F.col("__t"), "left").drop("__d", "__s", "__t")


def nearest_event(df: DataFrame, date: str, events: DataFrame, event_date: str, label: str, within: int = 5) -> DataFrame:
    """Business-day distance to the nearest event within ``within`` business days and its labels, joined by |; null if none.

    Events are spread over the days around them, so that the join is an equi-join.
    """
    # Monday to Friday are numbered without gaps; a weekend day counts as the Friday before it
    number = lambda d: (F.floor(F.datediff(d, F.lit("1970-01-05").cast("date")) / 7) * 5 + F.least(F.weekday(d), F.lit(4))).cast("long")
    near = events.select(number(F.col(event_date)).alias("__n"), F.col(label).alias("__l")).distinct()
    near = near.select(F.explode(F.sequence(F.col("__n") - within, F.col("__n") + within)).alias("__day"), "__n", "__l")
    near = near.withColumn("__gap", F.abs(F.col("__n") - F.col("__day")))
    best = near.groupBy("__day").agg(F.min("__gap").alias("event_distance"), F.collect_set(F.struct("__gap", "__l")).alias("__all"))
    best = best.withColumn("event_labels", F.array_join(F.array_sort(F.transform(F.filter("__all", lambda x: x["__gap"] == F.col("event_distance")), lambda x: x["__l"])), "|")).drop("__all")
    return df.withColumn("__day", number(F.col(date))).join(best, "__day", "left").drop("__day")


def exit_panel(legs: DataFrame, quotes: DataFrame, keys: list[str], contract: list[str], exit_ts: str, quote_ts: str, leg: str, legs_named: list[str], price: str) -> DataFrame:
    """Per trade and exit time one column of quote prices per leg and the number found; missing legs stay null."""
    q = quotes.select(*[F.col(c).alias(f"__{c}") for c in contract], F.col(quote_ts).alias("__q"), F.col(price).alias("__p"))
    on = F.col(exit_ts) == F.col("__q")
    for c in contract:
        on = on & (F.col(c) == F.col(f"__{c}"))
    j = legs.join(q, on, "left")
    return j.groupBy(*keys, exit_ts).agg(*[F.max(F.when(F.col(leg) == n, F.col("__p"))).alias(f"{n}_{price}") for n in legs_named], F.count("__p").alias("legs_found"), (F.count("__p") == len(legs_named)).alias("complete"))


def attribution(df: DataFrame, split: str, components: list[str]) -> DataFrame:
    """Components as rows with their sum and share of the total, per split and over all (ALL)."""
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).cast("double").alias("amount")) for c in components]))
    long = df.select(F.explode(F.array(F.col(split).cast("string"), F.lit("ALL"))).alias("split"), items.alias("x")).select("split", "x.*")
    g = long.groupBy("split", "component").agg(F.sum("amount").alias("amount"))
    return g.withColumn("share", F.try_divide(F.col("amount"), F.sum("amount").over(Window.partitionBy("split"))))


def execution_decay(df: DataFrame, keys: list[str], gross: str, cost: str, multipliers: list[float]) -> DataFrame:
    """Net result under cost multipliers, and the multiplier at which the total breaks even."""
    m = df.withColumn("multiplier", F.explode(F.array(*[F.lit(float(x)) for x in multipliers])))
    net = F.col(gross) - F.col("multiplier") * F.col(cost)
    g = m.groupBy(*keys, "multiplier").agg(F.sum(net).alias("net"), F.avg((net > 0).cast("double")).alias("win_rate"), F.sum(gross).alias("__g"), F.sum(cost).alias("__c"))
    return g.withColumn("break_even_multiplier", F.try_divide(F.col("__g"), F.col("__c"))).drop("__g", "__c")


def cost_reserve(df: DataFrame, split: str, discovery: str, lots: str, cost: str, share: float = 0.95) -> DataFrame:
    """Exact percentile of the cost per number of lots on the discovery split alone."""
    return df.where(F.col(split) == discovery).groupBy(lots).agg(F.percentile(cost, F.lit(share)).alias("reserve"), F.count("*").alias("n"))


def touch_zero(df: DataFrame, keys: list[str], ts: str, value: str, horizon: int, eps: float = 0.0) -> DataFrame:
    """For each row the first time within the next ``horizon`` rows when the value's sign changes or reaches zero; null if never."""
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(1, horizon)
    ahead = F.collect_list(F.struct(F.col(ts).alias("t"), F.col(value).alias("v"))).over(w)
    hits = F.filter(ahead, lambda x: (x["v"] * F.col(value) <= 0) | (F.abs(x["v"]) <= eps))
    return df.withColumn("__h", hits).withColumn("touch_ts", F.when(F.size("__h") > 0, F.try_element_at("__h", F.lit(1))["t"])).drop("__h")


def confidence_score(parts: dict[str, float], cap: float = 1.0) -> Column:
    """Weighted mean of scores in [0, 1]; a null part takes none of the weight."""
    total = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts.items()), F.lit(0.0))
    value = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in parts.items()), F.lit(0.0))
    return F.least(F.try_divide(value, total), F.lit(cap))


def risk_ladder(score: Column, rungs: list[tuple[float, float]]) -> Column:
    """The risk share of the highest rung (least score, share) reached, 0 below all."""
    out = F.lit(0.0)
    for least, share in sorted(rungs):
        out = F.when(score >= least, F.lit(share)).otherwise(out)
    return out


def acceptance(metrics: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """Named boolean gates over a metrics row, the number passed and accepted = all."""
    out = metrics.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in gates.items()})
    n = sum((F.col(k).cast("int") for k in gates), F.lit(0))
    return out.withColumn("gates_passed", n).withColumn("accepted", n == len(gates))


def integrated_variance(df: DataFrame, keys: list[str], ts: str, price: str, until: str) -> DataFrame:
    """Sum of squared log returns from each row's time to the last observation at or before ``until``, per key.

    Running sums to both ends are subtracted, so the work is linear.
    """
    w = Window.partitionBy(*keys).orderBy(ts)
    r = F.log(F.col(price) / F.lag(price).over(w))
    run = df.withColumn("__r", r).withColumn("__c", F.sum(F.coalesce(F.col("__r") * F.col("__r"), F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = run.where(F.col(ts) <= F.col(until)).groupBy(*keys, until).agg(F.max_by("__c", ts).alias("__end"))
    on = [*keys, until]
    return run.join(ends, on, "left").withColumn("integrated_variance", F.when(F.col(ts) <= F.col(until), F.col("__end") - F.col("__c"))).drop("__r", "__c", "__end")


def difference_verdict(value: Column, base: Column, warn_abs: float, warn_rel: float, fail_abs: float, fail_rel: float) -> Column:
    """PASS, WARN or FAIL: a level needs both its absolute and its relative difference (against max(|base|, 1)) exceeded."""
    d = F.abs(value - base)
    rel = d / F.greatest(F.abs(base), F.lit(1.0))
    return F.when((d > fail_abs) & (rel > fail_rel), "FAIL").when((d > warn_abs) & (rel > warn_rel), "WARN").otherwise("PASS")


def slot_matrix(days: DataFrame, day: str, slots: list[str], logs: dict[str, DataFrame]) -> DataFrame:
    """Days x slots with each log's latest state; logs have (day, slot, line, state). outcome is the worst that applies."""
    cells = days.select(F.col(day).alias("day")).distinct().withColumn("slot", F.explode(F.array(*[F.lit(s) for s in slots])))
    for name, log in logs.items():
        last = log.groupBy(F.col("day").alias("__d"), F.col("slot").alias("__s")).agg(F.max_by("state", "line").alias(f"{name}_state"))
        cells = cells.join(last, (F.col("day") == F.col("__d")) & (F.col("slot") == F.col("__s")), "left").drop("__d", "__s")
    states = F.array(*[F.col(f"{n}_state") for n in logs])
    missing = F.exists(states, lambda s: s.isNull())
    outcome = F.when(F.exists(states, lambda s: s == "CORRUPT"), "FAIL_INTEGRITY").when(F.exists(states, lambda s: s == "BLOCKED"), "BLOCKED_SOURCE").when(missing | F.exists(states, lambda s: s != "DONE"), "FAIL_INCOMPLETE").otherwise("PASS_READY")
    return cells.withColumn("outcome", outcome)


def requested_and_inverse(signals: DataFrame, outcomes: DataFrame, on: list[str], direction: str, value: str) -> DataFrame:
    """Every signal's outcome as requested and inverted."""
    j = signals.join(outcomes, on)
    sign = F.when(F.upper(direction) == "LONG", F.lit(1.0)).otherwise(-1.0)
    sides = F.explode(F.array(F.struct(F.lit("REQUESTED").alias("side"), (sign * F.col(value)).alias("result")), F.struct(F.lit("INVERSE").alias("side"), (-sign * F.col(value)).alias("result"))))
    return j.withColumn("__x", sides).select("*", "__x.*").drop("__x")
