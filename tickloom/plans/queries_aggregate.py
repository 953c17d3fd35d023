"""Aggregations, audits, distributions, structures and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates, portfolio, stats, structures
from .book import Book

BOOK = Book()


@BOOK.query("""
SELECT count(*) AS total_rows, count(*) FILTER (l_discount > 0.05) AS high_discount, count(*) FILTER (l_returnflag = 'R') AS returned,
  count(*) FILTER (l_extendedprice <= 0) AS bad_price, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS excess_duplicates FROM lineitem
""")
def single_pass_audit(t):
    checks = {"high_discount": F.col("l_discount") > 0.05, "returned": F.col("l_returnflag") == "R", "bad_price": F.col("l_extendedprice") <= 0}
    return gates.audit(t.lineitem, checks, ["l_orderkey", "l_linenumber"])


@BOOK.query("SELECT count(*) AS duplicate_keys, sum(n - 1)::BIGINT AS excess_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def key_duplicate_excess(t):
    return gates.key_excess(t.lineitem, ["l_orderkey", "l_linenumber"])


@BOOK.query("""
WITH a AS (SELECT count(*) FILTER (l_quantity <= 0) AS bad_quantity, count(*) FILTER (l_discount > 0.09) AS large_discount FROM lineitem)
SELECT 'bad_quantity' AS "check", bad_quantity AS violations, bad_quantity = 0 AS passed FROM a UNION ALL SELECT 'large_discount', large_discount, large_discount = 0 FROM a
""")
def audit_verdict(t):
    return gates.verdict(gates.audit(t.lineitem, {"bad_quantity": F.col("l_quantity") <= 0, "large_discount": F.col("l_discount") > 0.09}))


@BOOK.query("SELECT 'event_type' AS \"column\", event_type AS value, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'user_id', user_id::VARCHAR, count(*) FROM events GROUP BY 2")
def status_value_counts(t):
    return gates.value_counts(t.events, ["event_type", "user_id"])


@BOOK.query("""
SELECT user_id, max(value) FILTER (event_type = 'click') AS max_click, max(value) FILTER (event_type = 'view') AS max_view, count(*) FILTER (event_type = 'error') AS errors,
  round(100.0 * count(*) FILTER (event_type = 'purchase') / nullif(count(*), 0), 4) AS purchase_pct FROM events GROUP BY user_id
""")
def conditional_pivot(t):
    k = lambda n: F.col("event_type") == n
    return t.events.groupBy("user_id").agg(F.max(F.when(k("click"), F.col("value"))).alias("max_click"), F.max(F.when(k("view"), F.col("value"))).alias("max_view"), F.count_if(k("error")).alias("errors"), F.round(100.0 * F.count_if(k("purchase")) / F.nullif(F.count("*"), F.lit(0)), 4).alias("purchase_pct"))


@BOOK.query("""
WITH m AS (SELECT event_type, u, n, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, u) AS rn FROM (SELECT event_type, user_id AS u, count(*) AS n FROM events GROUP BY ALL))
SELECT e.event_type, round(median(value), 6) AS median_value, round(quantile_cont(value, 0.9), 6) AS p90, any_value(m.u) AS mode, any_value(m.n) AS mode_n
FROM events e JOIN m ON m.event_type = e.event_type AND rn = 1 GROUP BY e.event_type
""")
def mode_median_quantile(t):
    e = t.events
    q = e.groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median_value"), F.round(F.percentile("value", F.lit(0.9)), 6).alias("p90"))
    return q.join(stats.mode_with_ties(e, ["event_type"], "user_id"), "event_type")


@BOOK.query("""
SELECT o_orderpriority, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, round(quantile_cont(o_totalprice, 0.05), 4) AS p05,
  round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.95), 4) AS p95 FROM orders GROUP BY 1
""")
def distribution_record(t):
    d = stats.distribution(t.orders, ["o_orderpriority"], "o_totalprice")
    return d.select("o_orderpriority", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "p05", "p50", "p95")])


@BOOK.query("""
WITH r AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderpriority, count(*) AS tail_n, round(avg(o_totalprice), 4) AS cvar FROM r WHERE rn <= ceil(n * 0.05) GROUP BY 1
""")
def cvar_distribution(t):
    return stats.cvar(t.orders, ["o_orderpriority"], "o_totalprice").withColumn("cvar", F.round("cvar", 4))


@BOOK.query("""
WITH r AS (SELECT l_returnflag, l_quantity AS x, l_extendedprice AS y, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS ry FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(corr(x, y), 8) AS pearson, round(corr(rx, ry), 8) AS spearman FROM r GROUP BY 1
""")
def spearman_pearson(t):
    c = stats.correlations(t.lineitem, ["l_returnflag"], "l_quantity", "l_extendedprice")
    return c.withColumns({x: F.round(x, 8) for x in ("pearson", "spearman")})


@BOOK.query("""
SELECT o_orderstatus, o_orderpriority, year(o_orderdate)::INT AS y, (grouping(o_orderstatus) * 4 + grouping(o_orderpriority) * 2 + grouping(year(o_orderdate)))::BIGINT AS grouping_id,
  count(*) AS n, round(avg(o_totalprice), 8) AS mean_price FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (year(o_orderdate)), (o_orderstatus, year(o_orderdate)), ())
""")
def grouping_sets_regimes(t):
    o = t.orders.withColumn("y", F.year("o_orderdate"))
    out = stats.grouping_sets(o, [["o_orderstatus"], ["o_orderpriority"], ["y"], ["o_orderstatus", "y"], []], {"n": "count(*)", "mean_price": "round(avg(o_totalprice), 8)"})
    return out.select("o_orderstatus", "o_orderpriority", "y", F.expr("cast(grouping_id as bigint)").alias("grouping_id"), "n", "mean_price")


@BOOK.query("""
WITH d AS (SELECT o_orderdate::DATE AS d, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1)
SELECT (d + ((5 - isodow(d) + 7) % 7)::INT)::VARCHAR AS week_end, max_by(v, d) AS last_value, round(sum(v), 2) AS sum_value, min(v) AS min_value, count(*) AS n FROM d GROUP BY 1
""")
def weekly_friday_resample(t):
    d = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return stats.weekly(d, [], "d", "v").withColumns({"sum_value": F.round("sum_value", 2), "week_end": F.col("week_end").cast("string")})


@BOOK.query("""
WITH r AS (SELECT l_returnflag, l_discount AS y, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, least(10, ceil(r * 10 / n))::INT AS bucket, count(*) AS n, round(avg(y), 8) AS mean_outcome, round(avg((y > 0)::INT), 8) AS win_rate FROM r GROUP BY ALL
""")
def decile_buckets(t):
    b = stats.quantile_buckets(t.lineitem, ["l_returnflag"], "l_extendedprice", 10, "l_discount")
    return b.withColumns({c: F.round(c, 8) for c in ("mean_outcome", "win_rate")})


@BOOK.query("""
WITH m AS (SELECT l_orderkey, bit_or(1::BIGINT << l_linenumber) AS all_mask, coalesce(bit_or(1::BIGINT << l_linenumber) FILTER (l_returnflag = 'R'), 0) AS returned_mask FROM lineitem GROUP BY 1)
SELECT l_orderkey, all_mask, returned_mask, s.structure, s.required_mask, (all_mask & s.required_mask) = s.required_mask AS available
FROM m, (VALUES ('pair', 6::BIGINT), ('condor', 30::BIGINT), ('wide', 146::BIGINT)) s(structure, required_mask)
""")
def bitmask_structure_availability(t):
    m = structures.availability_mask(t.lineitem, ["l_orderkey"], F.col("l_linenumber"), {"all_mask": F.lit(True), "returned_mask": F.col("l_returnflag") == "R"})
    return structures.structures_available(m, "all_mask", {"pair": 6, "condor": 30, "wide": 146})


@BOOK.query("""
WITH d AS (SELECT event_type, ts::DATE AS d, count(*) FILTER (value > 5)::DOUBLE / count(*) AS share FROM events GROUP BY ALL)
SELECT event_type, count(*) AS days, count(*) FILTER (share = 1) AS perfect_days, round(100 * avg(share), 4) AS mean_pct, round(100 * quantile_cont(share, 0.05), 4) AS p05_pct, round(100 * min(share), 4) AS worst_pct FROM d GROUP BY 1
""")
def completeness_coverage_two_level(t):
    return structures.coverage(t.events.withColumn("d", F.col("ts").cast("date")), ["event_type"], "d", F.col("value") > 5)


@BOOK.query("SELECT l_orderkey, count(*) AS leg_rows, count(DISTINCT l_linenumber) AS legs, count(*) = 4 AND count(DISTINCT l_linenumber) = 4 AS complete FROM lineitem GROUP BY 1")
def structure_completeness(t):
    return structures.complete_legs(t.lineitem, ["l_orderkey"], "l_linenumber", 4)


@BOOK.query("""
SELECT l_orderkey, round(sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * l_extendedprice), 4) AS entry_value, round(sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * l_extendedprice * (1 - l_discount)), 4) AS exit_value,
  round(sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * l_extendedprice * -l_discount), 4) AS pnl FROM lineitem GROUP BY 1
""")
def structure_marks(t):
    legs = t.lineitem.withColumns({"w": F.when(F.col("l_returnflag") == "R", -1).otherwise(1), "exit": F.col("l_extendedprice") * (1 - F.col("l_discount"))})
    return structures.mark(legs, ["l_orderkey"], "w", "l_extendedprice", "exit").select("l_orderkey", *[F.round(c, 4).alias(c) for c in ("entry_value", "exit_value", "pnl")])


@BOOK.query("""
SELECT p_partkey, p_size, CASE WHEN atm IS NULL THEN 'NO_ATM_PEER' WHEN o IS NULL THEN 'BAD_LABEL' WHEN abs(p_size - (atm + o * 5)) > 1e-9 THEN 'OFF_LADDER' END AS ladder_reason, atm AS atm_strike,
  atm IS NOT NULL AND o IS NOT NULL AND abs(p_size - (atm + o * 5)) <= 1e-9 AS ladder_valid, (floor(p_retailprice / 50 + 0.5) * 50)::DOUBLE AS grid_price
FROM (SELECT *, max(p_size) FILTER (p_partkey % 20 = 0) OVER (PARTITION BY p_brand) AS atm, CASE WHEN p_partkey % 20 = 0 THEN 0 WHEN p_partkey % 3 = 0 THEN NULL ELSE (p_partkey % 10)::INT END AS o FROM part)
""")
def partition_peer_ladder(t):
    label = F.when(F.col("p_partkey") % 20 == 0, "ATM").when(F.col("p_partkey") % 3 == 0, "NEAR").otherwise(F.concat(F.lit("ATM+"), (F.col("p_partkey") % 10).cast("string")))
    p = t.part.withColumn("offset", gates.label_offset(label))
    p = gates.ladder_check(p, ["p_brand"], F.col("p_partkey") % 20 == 0, "p_size", "offset", 5)
    return p.select("p_partkey", "p_size", "ladder_reason", "atm_strike", "ladder_valid", gates.half_up_grid(F.col("p_retailprice"), 50).alias("grid_price"))


@BOOK.query("""
WITH m AS (SELECT o_custkey, avg(o_totalprice) AS a FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), n AS (SELECT o_custkey, avg(o_totalprice) AS b FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
j AS (SELECT c_custkey, a, b, a - b AS diff, abs(a - b) / nullif(abs(b), 0) AS rel FROM customer LEFT JOIN m ON m.o_custkey = c_custkey LEFT JOIN n ON n.o_custkey = c_custkey)
SELECT c_custkey, round(diff, 4) AS diff, round(rel * 10000, 4) AS diff_bps, CASE WHEN a IS NULL AND b IS NULL THEN 'BOTH_MISSING' WHEN a IS NULL THEN 'LEFT_MISSING' WHEN b IS NULL THEN 'RIGHT_MISSING'
  WHEN abs(diff) >= 100000 AND rel >= 0.5 THEN 'SEVERE' WHEN abs(diff) > 20000 THEN 'DIVERGENT' ELSE 'CONSISTENT' END AS divergence_status FROM j
""")
def source_divergence(t):
    mean = lambda s, n: t.orders.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias(n))
    j = t.customer.select("c_custkey").join(mean("F", "a"), "c_custkey", "left").join(mean("O", "b"), "c_custkey", "left")
    return gates.divergence(j, "a", "b", 20000, 100000, 0.5).select("c_custkey", F.round("diff", 4).alias("diff"), F.round("diff_bps", 4).alias("diff_bps"), "divergence_status")


@BOOK.query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_25_orders(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@BOOK.query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def argmax_per_group(t):
    return portfolio.best_by(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", ["o_orderkey"])


@BOOK.query("""
WITH b AS (SELECT l_orderkey, l_linenumber, unnest(generate_series(1, 5)) AS lots, l_extendedprice * 0.01 - l_tax * 100 AS unit FROM lineitem),
c AS (SELECT lots, round(sum(unit * lots - lots * lots * 20), 2) AS total FROM b GROUP BY 1)
SELECT lots, total, total = (SELECT max(total) FROM c) AS best FROM c
""")
def capacity_curve(t):
    b = t.lineitem.withColumn("lots", F.explode(F.sequence(F.lit(1), F.lit(5)).cast("array<bigint>"))).withColumn("unit", F.col("l_extendedprice") * 0.01 - F.col("l_tax") * 100)
    c = b.groupBy("lots").agg(F.round(F.sum(F.col("unit") * F.col("lots") - F.col("lots") * F.col("lots") * 20), 2).alias("total"))
    return c.crossJoin(F.broadcast(c.agg(F.max("total").alias("__m")))).select("lots", "total", (F.col("total") == F.col("__m")).alias("best"))


@BOOK.query("""
SELECT sum(e)::BIGINT AS elements, count(*) AS rows_, min(e) AS least, max(e) AS most FROM (SELECT len(embedding)::BIGINT AS e FROM embeddings)
""")
def array_lengths(t):
    e = F.size("embedding").cast("long")
    return t.embeddings.agg(F.sum(e).alias("elements"), F.count("*").alias("rows_"), F.min(e).alias("least"), F.max(e).alias("most"))


@BOOK.query("SELECT count(*) AS n_rows, true AS same_after_reorder, false AS same_with_repeats, false AS same_with_moved_nulls FROM orders")
def dataset_signature(t):
    o = t.orders
    sign = lambda df, name: gates.signature(df).select("rows", F.col("signature").alias(name))
    none = F.lit(None).cast("string")
    left, right = (o.select("o_orderkey", *x) for x in ((none.alias("a"), F.col("o_orderpriority").alias("b")), (F.col("o_orderpriority").alias("a"), none.alias("b"))))
    parts = [sign(o, "s0"), sign(o.repartition(7, "o_custkey"), "s1").drop("rows"), sign(o.union(o).union(o), "s2").drop("rows"), sign(left, "s3").drop("rows"), sign(right, "s4").drop("rows")]
    one = parts[0]
    for p in parts[1:]:
        one = one.crossJoin(p)  # single rows
    return one.select(F.col("rows").alias("n_rows"), (F.col("s0") == F.col("s1")).alias("same_after_reorder"), (F.col("s0") == F.col("s2")).alias("same_with_repeats"), (F.col("s3") == F.col("s4")).alias("same_with_moved_nulls"))


@BOOK.query("""
WITH d AS (SELECT o_orderdate::DATE AS d, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1),
p AS (SELECT 'month' AS period, (date_trunc('month', d) + INTERVAL 1 MONTH - INTERVAL 1 DAY)::DATE AS e, d, v FROM d UNION ALL SELECT 'year', (date_trunc('year', d) + INTERVAL 1 YEAR - INTERVAL 1 DAY)::DATE, d, v FROM d)
SELECT period, e::VARCHAR AS period_end, max_by(v, d) AS last_value, round(sum(v), 2) AS sum_value, min(v) AS min_value, count(*) AS n FROM p GROUP BY period, e
""")
def monthly_annual_resample(t):
    d = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    each = [stats.resample(d, [], "d", "v", p).select(F.lit(p).alias("period"), F.col("period_end").cast("string").alias("period_end"), "last_value", F.round("sum_value", 2).alias("sum_value"), "min_value", "n") for p in ("month", "year")]
    return each[0].unionByName(each[1])


@BOOK.query("""
WITH v AS (SELECT l_returnflag, l_linestatus, l_extendedprice * (l_discount - l_tax) AS v FROM lineitem)
SELECT l_returnflag, l_linestatus, count(v) AS n, round(avg((v > 0)::INT), 8) AS win_rate, round(sum(v) FILTER (WHERE v > 0) / sum(-v) FILTER (WHERE v < 0), 8) AS profit_factor,
       round(avg(v) FILTER (WHERE v > 0) / avg(-v) FILTER (WHERE v < 0), 8) AS payoff_ratio FROM v GROUP BY l_returnflag, l_linestatus
""")
def payoff_ratio(t):
    v = t.lineitem.select("l_returnflag", "l_linestatus", (F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))).alias("v"))
    return stats.payoff(v, ["l_returnflag", "l_linestatus"], "v").withColumns({c: F.round(c, 8) for c in ("win_rate", "profit_factor", "payoff_ratio")})


@BOOK.query("""
WITH w AS (SELECT l_suppkey, avg(l_quantity) FILTER (WHERE l_returnflag = 'A') AS a, avg(l_quantity) FILTER (WHERE l_returnflag = 'N') AS n, avg(l_quantity) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY l_suppkey),
d AS (SELECT 'A-N' AS pair, a - n AS d FROM w UNION ALL SELECT 'A-R', a - r FROM w UNION ALL SELECT 'R-N', r - n FROM w)
SELECT pair, count(*) AS n, round(avg(d), 8) AS mean, round(median(d), 8) AS median, round(avg((d > 0)::INT), 8) AS positive_rate FROM d WHERE d IS NOT NULL GROUP BY pair
""")
def paired_differences(t):
    out = stats.paired_differences(t.lineitem, "l_suppkey", "l_returnflag", "l_quantity", [("A", "N"), ("A", "R"), ("R", "N")])
    return out.withColumns({c: F.round(c, 8) for c in ("mean", "median", "positive_rate")})


@BOOK.query("""
WITH v AS (SELECT year(o_orderdate) AS y, round(o_totalprice - 150000, 2) AS v FROM orders)
SELECT y AS year, count(*) AS n, round(quantile_cont(v, 0.05), 6) AS p05, round(quantile_cont(v, 0.25), 6) AS p25, round(median(v), 6) AS median, round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.95), 6) AS p95, round(avg((v > 0)::INT), 8) AS positive_rate
FROM v GROUP BY y
""")
def annual_regimes(t):
    v = t.orders.select(F.year("o_orderdate").cast("long").alias("year"), F.round(F.col("o_totalprice") - 150000, 2).alias("v"))
    q = F.percentile("v", F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    out = v.groupBy("year").agg(F.count("*").alias("n"), q.alias("q"), F.round(F.avg((F.col("v") > 0).cast("double")), 8).alias("positive_rate"))
    return out.select("year", "n", *[F.round(F.col("q")[j], 6).alias(c) for j, c in enumerate(("p05", "p25", "median", "p75", "p95"))], "positive_rate")
