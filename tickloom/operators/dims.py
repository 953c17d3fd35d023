"""Dimension joins: interval-valid rules, ambiguity status, mark and anti joins, cardinality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A dimension up to this many rows is broadcast for a range join; a larger one is joined on its keys first.
BROADCAST_ROWS = 200_000


def _sized(dim: DataFrame) -> DataFrame:
    return F.broadcast(dim) if dim.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else dim


def interval_join(left: DataFrame, rules: DataFrame, at: str, valid_from: str, valid_to: str, on: list[tuple[str, str]] = (), prefix: str = "rule_") -> DataFrame:
    """Every left row with the rule in force at ``at``: from <= at <= to, a null bound is open, a null rule key is a wildcard.

    Adds the rule's columns with the prefix, prefix + matches and prefix + status: MATCHED, MISSING or AMBIGUOUS (columns null
    unless MATCHED). Left rows are conserved. Equal keys narrow the join before the range is tested.
    """
    left = left.withColumn("__id", F.monotonically_increasing_id())
    named = rules.select(*[F.col(c).alias(f"{prefix}{c}") for c in rules.columns])
    f, t = F.col(f"{prefix}{valid_from}"), F.col(f"{prefix}{valid_to}")
    cond = (f.isNull() | (F.col(at) >= f)) & (t.isNull() | (F.col(at) <= t))
    for a, b in on:
        r = F.col(f"{prefix}{b}")
        cond = cond & (r.isNull() | (F.col(a) == r))
    hits = left.join(_sized(named), cond, "left")
    found = F.col(f"{prefix}{valid_from}").isNotNull()
    for c in rules.columns:
        found = found | F.col(f"{prefix}{c}").isNotNull()
    w = Window.partitionBy("__id")
    hits = hits.withColumns({"__n": F.sum(F.when(found, 1).otherwise(0)).over(w), "__rn": F.row_number().over(w.orderBy(*[f"{prefix}{c}" for c in rules.columns]))}).where("__rn = 1")
    ok = F.col("__n") == 1
    return hits.select(
        *[c for c in left.columns if c != "__id"],
        *[F.when(ok, F.col(f"{prefix}{c}")).alias(f"{prefix}{c}") for c in rules.columns],
        F.col("__n").alias(f"{prefix}matches"),
        F.when(ok, "MATCHED").when(F.col("__n") == 0, "MISSING").otherwise("AMBIGUOUS").alias(f"{prefix}status"),
    )


def unique_dimension(dim: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key with match_count and dimension_status (UNIQUE or AMBIGUOUS)."""
    w = Window.partitionBy(*keys)
    return dim.withColumns({"match_count": F.count("*").over(w), "__rn": F.row_number().over(w.orderBy(*order))}).where("__rn = 1").drop("__rn").withColumn("dimension_status", F.when(F.col("match_count") == 1, "UNIQUE").otherwise("AMBIGUOUS"))


def lookup(left: DataFrame, dim: DataFrame, keys: list[str], order: list[str], prefix: str = "dim_") -> DataFrame:
    """Equi-join to a dimension with status MATCHED, MISSING or AMBIGUOUS; left rows are conserved."""
    one = unique_dimension(dim, keys, order)
    rest = [c for c in dim.columns if c not in keys]
    one = one.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.when(F.col("match_count") == 1, F.col(c)).alias(f"{prefix}{c}") for c in rest], F.col("match_count").alias(f"{prefix}matches"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__{k}"))
    n = F.coalesce(F.col(f"{prefix}matches"), F.lit(0))
    out = left.join(one, cond, "left").drop(*[f"__{k}" for k in keys])
    return out.withColumn(f"{prefix}matches", n).withColumn(f"{prefix}status", F.when(n == 1, "MATCHED").when(n == 0, "MISSING").otherwise("AMBIGUOUS"))


def next_on_or_after(left: DataFrame, calendar: DataFrame, at: str, date: str, out: str = "next_date") -> DataFrame:
    """``left`` with the smallest calendar date on or after ``at``, by one forward fill over the union of both."""
    dates = calendar.select(F.col(date).alias("__d")).where("__d is not null").distinct()
    points = left.select(F.col(at).alias("__d")).distinct().join(dates.withColumn("__is", F.lit(True)), "__d", "full")
    month = F.date_trunc("year", F.col("__d"))  # parts of the time line, so that no window holds it all
    w = Window.partitionBy("__y").orderBy("__d").rowsBetween(0, Window.unboundedFollowing)
    points = points.withColumn("__y", month).withColumn("__n", F.first(F.when(F.col("__is"), F.col("__d")), ignorenulls=True).over(w))
    heads = points.where("__is").groupBy("__y").agg(F.min("__d").alias("__h"))
    later = Window.orderBy("__y").rowsBetween(1, Window.unboundedFollowing)  # one row a year
    heads = points.select("__y").distinct().join(heads, "__y", "left").withColumn("__next", F.first("__h", ignorenulls=True).over(later))
    points = points.join(heads.select("__y", "__next"), "__y").select(F.col("__d").alias("__at"), F.coalesce("__n", "__next").alias(out))
    return left.join(points, F.col(at) == F.col("__at"), "left").drop("__at")


def mark_join(left: DataFrame, right: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """``left`` with a boolean: is there a right row of equal keys."""
    r = right.select(*keys).distinct().withColumn("__m", F.lit(True))
    return left.join(r, keys, "left").withColumn(mark, F.coalesce("__m", F.lit(False))).drop("__m")


def cardinality_audit(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: left_rows, right_rows, matched, unmatched, right_duplicate_keys, output_rows of the left join."""
    counts = right.groupBy(*keys).agg(F.count("*").alias("__n"))
    j = left.join(counts, keys, "left")
    a = j.agg(F.count("*").alias("left_rows"), F.count("__n").alias("matched"), F.sum(F.coalesce("__n", F.lit(1))).alias("output_rows"))
    b = counts.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("right_rows"), F.count_if(F.col("__n") > 1).alias("right_duplicate_keys"))
    return a.crossJoin(b).select("left_rows", "right_rows", "matched", (F.col("left_rows") - F.col("matched")).alias("unmatched"), "right_duplicate_keys", "output_rows")


def assert_unique(df: DataFrame, keys: list[str], name: str = "table") -> DataFrame:
    """``df`` itself; a plan that fails at run time where a key repeats (one_to_one and many_to_one merges)."""
    n = F.count("*").over(Window.partitionBy(*keys))
    checked = df.withColumn("__n", n).withColumn("__ok", F.when(F.col("__n") > 1, F.raise_error(F.lit(f"{name}: repeated key {keys}"))).otherwise(F.lit(True)))
    return checked.where("__ok").drop("__n", "__ok")


def conflict_dedupe(df: DataFrame, keys: list[str], business: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(clean, conflicts): equal business rows of a key collapse to the first; keys with different ones are all quarantined.

    Rows are equal if all their values are, where null equals null only; the least and the greatest row of a key tell.
    """
    w = Window.partitionBy(*keys)
    row = F.struct(*business)
    marked = df.withColumns({"__same": F.min(row).over(w).eqNullSafe(F.max(row).over(w)), "__rn": F.row_number().over(w.orderBy(*order))})
    return marked.where("__same and __rn = 1").drop("__same", "__rn"), marked.where("not __same").drop("__same", "__rn")


def latest_event(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last event of each identity in an append-only log."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def reconcile(planned: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with state MATCHED, MISSING (planned only) or UNEXPECTED (present only)."""
    p = planned.select(*keys).distinct().withColumn("__p", F.lit(1))
    q = present.select(*keys).distinct().withColumn("__q", F.lit(1))
    state = F.when(F.col("__p").isNull(), "UNEXPECTED").when(F.col("__q").isNull(), "MISSING").otherwise("MATCHED")
    return p.join(q, keys, "full").select(*keys, state.alias("state"))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one input more often than in the other, with side (A or B), repeats kept."""
    return a.exceptAll(b).withColumn("side", F.lit("A")).unionByName(b.exceptAll(a).withColumn("side", F.lit("B")))


def slot_choice(slots: list[tuple[str, Column, Column]]) -> Column:
    """The name of the eligible slot with the latest effective time; ties go to the later slot of the list.

    slots: (name, effective time, eligible).
    """
    items = F.array(*[F.struct(F.when(ok, t).alias("t"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (name, t, ok) in enumerate(slots)])
    return F.array_max(F.filter(items, lambda s: s["t"].isNotNull()))["name"]
