"""Research operators on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import research
from .book import Book
from .queries_series import _BARS, bars

BOOK = Book()


@BOOK.query("""
WITH d AS (SELECT unnest(generate_series(DATE '1995-01-01', DATE '1996-12-31', INTERVAL 1 DAY))::DATE AS d), o AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders WHERE isodow(o_orderdate) > 5 AND o_totalprice > 450000)
SELECT d.d::VARCHAR AS "date", CASE WHEN o.d IS NOT NULL THEN 'OPEN' WHEN isodow(d.d) <= 5 THEN 'OPEN' ELSE 'CLOSED' END AS state, CASE WHEN o.d IS NULL THEN 'RULE' ELSE 'OVERRIDE' END AS source FROM d LEFT JOIN o ON o.d = d.d
""")
def session_calendar(t):
    d = t.orders.where((F.weekday("o_orderdate") > 4) & (F.col("o_totalprice") > 450000)).select(F.col("o_orderdate").cast("date").alias("date"), F.lit("OPEN").alias("state")).distinct()
    return research.expected_sessions(t.spark, "1995-01-01", "1996-12-31", [0, 1, 2, 3, 4], d).withColumn("date", F.col("date").cast("string"))


@BOOK.query("""
WITH s AS (SELECT d, row_number() OVER (ORDER BY d) AS n FROM (SELECT DISTINCT o_orderdate::DATE AS d FROM orders)), e AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT o_orderkey, k.step::INT AS step, x.d::VARCHAR AS exit_date FROM e JOIN s ON s.d = e.d, (VALUES (1), (2), (5)) k(step) LEFT JOIN s x ON x.n = s.n + k.step
""")
def nth_next_session(t):
    s = t.orders.select(F.col("o_orderdate").cast("date").alias("date"))
    e = t.orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return research.nth_next_session(e, s, "d", [1, 2, 5]).select("o_orderkey", "step", F.col("exit_date").cast("string").alias("exit_date"))


_BDAY = "(floor(({d} - DATE '1970-01-05') / 7.0) * 5 + least(isodow({d}) - 1, 4))::BIGINT"


@BOOK.query(f"""
WITH o AS (SELECT o_orderkey, {_BDAY.format(d='o_orderdate::DATE')} AS n FROM orders), e AS (SELECT DISTINCT {_BDAY.format(d='o_orderdate::DATE')} AS n, o_orderpriority AS l FROM orders WHERE o_totalprice > 470000),
j AS (SELECT o_orderkey, abs(e.n - o.n) AS gap, l FROM o JOIN e ON e.n BETWEEN o.n - 5 AND o.n + 5), m AS (SELECT o_orderkey, min(gap) AS gap FROM j GROUP BY 1)
SELECT o.o_orderkey, m.gap AS event_distance, list_aggregate(list_sort(list(DISTINCT j.l)), 'string_agg', '|') AS event_labels
FROM o LEFT JOIN m USING (o_orderkey) LEFT JOIN j ON j.o_orderkey = o.o_orderkey AND j.gap = m.gap GROUP BY ALL
""")
def nearest_business_event(t):
    o = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    e = t.orders.where("o_totalprice > 470000").select(F.col("o_orderdate").cast("date").alias("e"), "o_orderpriority")
    return research.nearest_event(o, "d", e, "e", "o_orderpriority").select("o_orderkey", "event_distance", "event_labels")


@BOOK.query(f"""
WITH {_BARS}, l AS (SELECT b.h AS entry, b.h + INTERVAL 2 HOUR AS exit_ts, g.leg, g.event_type FROM (SELECT DISTINCT h FROM bars) b, (VALUES ('near', 'click'), ('far', 'view')) g(leg, event_type))
SELECT l.entry, l.exit_ts, max(v) FILTER (leg = 'near') AS near_v, max(v) FILTER (leg = 'far') AS far_v, count(v) AS legs_found, count(v) = 2 AS complete
FROM l LEFT JOIN bars ON bars.h = l.exit_ts AND bars.event_type = l.event_type GROUP BY ALL
""")
def exit_panel(t):
    b = bars(t)
    legs = F.explode(F.array(F.struct(F.lit("near").alias("leg"), F.lit("click").alias("event_type")), F.struct(F.lit("far").alias("leg"), F.lit("view").alias("event_type"))))
    each = b.select(F.col("h").alias("entry")).distinct().withColumn("x", legs).select("entry", (F.col("entry") + F.expr("INTERVAL 2 HOUR")).alias("exit_ts"), "x.*")
    return research.exit_panel(each, b, ["entry"], ["event_type"], "exit_ts", "h", "leg", ["near", "far"], "v")


@BOOK.query("""
WITH x AS (SELECT l_returnflag AS split, l_extendedprice * l_discount AS discount, l_extendedprice * l_tax AS tax, l_quantity * 1.0 AS fee FROM lineitem),
g AS (SELECT coalesce(split, 'ALL') AS split, sum(discount) AS discount, sum(tax) AS tax, sum(fee) AS fee FROM x GROUP BY GROUPING SETS ((split), ())),
u AS (UNPIVOT g ON discount, tax, fee INTO NAME component VALUE amount)
SELECT split, component, round(amount, 2) AS amount, round(amount / sum(amount) OVER (PARTITION BY split), 8) AS share FROM u
""")
def cost_attribution(t):
    x = t.lineitem.select(F.col("l_returnflag").alias("split"), (F.col("l_extendedprice") * F.col("l_discount")).alias("discount"), (F.col("l_extendedprice") * F.col("l_tax")).alias("tax"), F.col("l_quantity").alias("fee"))
    a = research.attribution(x, "split", ["discount", "tax", "fee"])
    return a.select("split", "component", F.round("amount", 2).alias("amount"), F.round("share", 8).alias("share"))


@BOOK.query("""
WITH x AS (SELECT l_returnflag, l_discount * l_extendedprice AS g, l_tax * l_extendedprice AS c, m FROM lineitem, (VALUES (0.5::DOUBLE), (1.0), (1.5), (2.0)) k(m))
SELECT l_returnflag, m AS multiplier, round(sum(g - m * c), 2) AS net, round(avg((g - m * c > 1e-9)::INT), 6) AS win_rate, round(sum(g) / sum(c), 6) AS break_even_multiplier FROM x GROUP BY ALL
""")
def execution_decay(t):
    x = t.lineitem.select("l_returnflag", (F.col("l_discount") * F.col("l_extendedprice") - 1e-9).alias("g"), (F.col("l_tax") * F.col("l_extendedprice")).alias("c"))
    d = research.execution_decay(x, ["l_returnflag"], "g", "c", [0.5, 1.0, 1.5, 2.0])
    return d.select("l_returnflag", "multiplier", F.round("net", 2).alias("net"), F.round("win_rate", 6).alias("win_rate"), F.round("break_even_multiplier", 6).alias("break_even_multiplier"))


@BOOK.query("SELECT l_linenumber, round(quantile_cont(l_extendedprice * l_tax, 0.95), 6) AS reserve, count(*) AS n FROM lineitem WHERE year(l_shipdate) < 1998 GROUP BY 1")
def cost_reserve(t):
    x = t.lineitem.select("l_linenumber", (F.col("l_extendedprice") * F.col("l_tax")).alias("cost"), F.when(F.year("l_shipdate") < 1998, "discovery").otherwise("later").alias("split"))
    return research.cost_reserve(x, "split", "discovery", "l_linenumber", "cost").withColumn("reserve", F.round("reserve", 6))


@BOOK.query(f"""
WITH {_BARS}, z AS (SELECT event_type, h, round(v - 50, 6) AS z, row_number() OVER (PARTITION BY event_type ORDER BY h) AS rn FROM bars)
SELECT a.event_type, a.h, min(b.h) AS touch_ts FROM z a LEFT JOIN z b ON b.event_type = a.event_type AND b.rn BETWEEN a.rn + 1 AND a.rn + 6 AND a.z * b.z <= 0 GROUP BY ALL
""")
def touch_zero(t):
    z = bars(t).withColumn("z", F.round(F.col("v") - 50, 6))
    return research.touch_zero(z, ["event_type"], "h", "z", 6).select("event_type", "h", "touch_ts")


@BOOK.query(f"""
WITH {_BARS}, r AS (SELECT *, date_trunc('day', h) + INTERVAL 15 HOUR AS until, date_trunc('day', h) AS d FROM bars WHERE v > 0), x AS (SELECT *, ln(v / lag(v) OVER (PARTITION BY event_type, d ORDER BY h)) AS r FROM r)
SELECT a.event_type, a.h, CASE WHEN a.h <= a.until THEN round(coalesce(sum(b.r * b.r), 0), 8) END AS integrated_variance
FROM x a LEFT JOIN x b ON b.event_type = a.event_type AND b.d = a.d AND b.h > a.h AND b.h <= a.until GROUP BY a.event_type, a.h, a.until
""")
def integrated_variance(t):
    day = F.date_trunc("day", "h").cast("timestamp_ntz")
    b = bars(t).where("v > 0").withColumns({"d": day, "until": day + F.expr("INTERVAL 15 HOUR")})
    v = research.integrated_variance(b, ["event_type", "d"], "h", "v", "until")
    return v.select("event_type", "h", F.round("integrated_variance", 8).alias("integrated_variance"))


@BOOK.query("""
WITH d AS (SELECT DISTINCT ts::DATE AS d FROM events), c AS (SELECT d, s.slot FROM d, (VALUES ('click'), ('view'), ('error')) s(slot)),
l AS (SELECT ts::DATE AS d, event_type AS slot, max_by(CASE WHEN value < 5 THEN 'CORRUPT' WHEN value < 12 THEN 'BLOCKED' ELSE 'DONE' END, event_id) AS a FROM events GROUP BY ALL),
m AS (SELECT ts::DATE AS d, event_type AS slot, max_by(CASE WHEN user_id % 9 = 0 THEN 'OPEN' ELSE 'DONE' END, event_id) AS b FROM events WHERE user_id % 2 = 0 GROUP BY ALL)
SELECT c.d::VARCHAR AS "day", c.slot, a AS load_state, b AS check_state, CASE WHEN a = 'CORRUPT' OR b = 'CORRUPT' THEN 'FAIL_INTEGRITY' WHEN a = 'BLOCKED' OR b = 'BLOCKED' THEN 'BLOCKED_SOURCE'
  WHEN a IS NULL OR b IS NULL OR a <> 'DONE' OR b <> 'DONE' THEN 'FAIL_INCOMPLETE' ELSE 'PASS_READY' END AS outcome FROM c LEFT JOIN l ON l.d = c.d AND l.slot = c.slot LEFT JOIN m ON m.d = c.d AND m.slot = c.slot
""")
def slot_matrix_reconciliation(t):
    e = t.events.withColumns({"day": F.col("ts").cast("date"), "slot": F.col("event_type"), "line": F.col("event_id")})
    load = e.withColumn("state", F.when(F.col("value") < 5, "CORRUPT").when(F.col("value") < 12, "BLOCKED").otherwise("DONE"))
    check = e.where("user_id % 2 = 0").withColumn("state", F.when(F.col("user_id") % 9 == 0, "OPEN").otherwise("DONE"))
    return research.slot_matrix(e, "day", ["click", "view", "error"], {"load": load, "check": check}).withColumn("day", F.col("day").cast("string"))


@BOOK.query("""
SELECT p_partkey, CASE WHEN d > 20 AND d / greatest(abs(b), 1) > 0.02 THEN 'FAIL' WHEN d > 5 AND d / greatest(abs(b), 1) > 0.005 THEN 'WARN' ELSE 'PASS' END AS verdict
FROM (SELECT p_partkey, p_retailprice AS b, abs(p_size * 1.0) AS d FROM part)
""")
def difference_verdicts(t):
    return t.part.select("p_partkey", research.difference_verdict(F.col("p_retailprice") + F.col("p_size"), F.col("p_retailprice"), 5, 0.005, 20, 0.02).alias("verdict"))


@BOOK.query("""
WITH m AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS a, min(o_totalprice) AS lo FROM orders GROUP BY 1)
SELECT o_orderpriority, n >= 2900 AS enough, a > 250000 AS profitable, lo > 1000 AS floor_ok, (n >= 2900)::INT + (a > 250000)::INT + (lo > 1000)::INT AS gates_passed, n >= 2900 AND a > 250000 AND lo > 1000 AS accepted FROM m
""")
def acceptance_gates(t):
    m = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("a"), F.min("o_totalprice").alias("lo"))
    g = research.acceptance(m, {"enough": F.col("n") >= 2900, "profitable": F.col("a") > 250000, "floor_ok": F.col("lo") > 1000})
    return g.drop("n", "a", "lo")


@BOOK.query("""
WITH s AS (SELECT c_custkey, least((c_acctbal / 10000 * 0.7 + CASE WHEN c_nationkey % 5 = 0 THEN 0 ELSE c_nationkey / 25.0 * 0.3 END) / (0.7 + CASE WHEN c_nationkey % 5 = 0 THEN 0 ELSE 0.3 END), 1) AS score FROM customer)
SELECT c_custkey, round(score, 8) AS score, CASE WHEN score >= 0.8 THEN 0.02 WHEN score >= 0.5 THEN 0.01 WHEN score >= 0.2 THEN 0.005 ELSE 0 END::DOUBLE AS risk_share FROM s
""")
def confidence_ladder(t):
    c = t.customer.select("c_custkey", (F.col("c_acctbal") / 10000).alias("a"), F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey") / 25.0).alias("b"))
    c = c.withColumn("score", research.confidence_score({"a": 0.7, "b": 0.3}))
    return c.select("c_custkey", F.round("score", 8).alias("score"), research.risk_ladder(F.col("score"), [(0.2, 0.005), (0.5, 0.01), (0.8, 0.02)]).alias("risk_share"))


@BOOK.query("""
WITH s AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'LONG' ELSE 'SHORT' END AS d FROM orders WHERE o_totalprice > 450000)
SELECT o_orderkey, l_linenumber, x.side, round(CASE WHEN d = 'LONG' THEN 1 ELSE -1 END * CASE WHEN x.side = 'REQUESTED' THEN 1 ELSE -1 END * l_extendedprice, 4) AS result FROM s JOIN lineitem ON l_orderkey = o_orderkey, (VALUES ('REQUESTED'), ('INVERSE')) x(side)
""")
def requested_and_inverse(t):
    s = t.orders.where("o_totalprice > 450000").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "LONG").otherwise("SHORT").alias("d"))
    o = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_extendedprice")
    return research.requested_and_inverse(s, o, ["o_orderkey"], "d", "l_extendedprice").select("o_orderkey", "l_linenumber", "side", F.round("result", 4).alias("result"))
