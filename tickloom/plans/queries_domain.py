"""Domain kernels: pricing, implied volatility, costs, charges, margin, payload flattening, seeded tests and ridge."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import execution, pricing
from ..operators import stats, structures
from ..sources import payloads
from ..streaming import streams
from .book import Book

BOOK = Book()

_OPTION = """o AS (SELECT p_partkey, p_retailprice AS s, p_retailprice * (0.9 + (p_size % 21) / 100.0) AS k, 0.05 + (p_partkey % 40) / 100.0 AS v, (7 + p_partkey % 100) / 365.0 AS t, p_partkey % 2 = 0 AS c FROM part),
d AS (SELECT *, (ln(s / k) + (0.1 + v * v / 2) * t) / (v * sqrt(t)) AS d1, (ln(s / k) + (0.1 + v * v / 2) * t) / (v * sqrt(t)) - v * sqrt(t) AS d2 FROM o)"""


def _options(t):
    return t.part.select("p_partkey", F.col("p_retailprice").alias("s"), (F.col("p_retailprice") * (0.9 + (F.col("p_size") % 21) / 100)).alias("k"), (0.05 + (F.col("p_partkey") % 40) / 100).alias("v"), ((7 + F.col("p_partkey") % 100) / 365).alias("t"), (F.col("p_partkey") % 2 == 0).alias("c"))


# beyond 7 the distribution differs from 0 or 1 by less than 1.3e-12, below every rounding here
_N1, _N2 = (f"CASE WHEN abs({x}) < 7 THEN {pricing.normal_cdf_sql(x)} WHEN {x} > 0 THEN 1.0 ELSE 0.0 END" for x in ("d1", "d2"))


@BOOK.query(f"""
WITH {_OPTION}, n AS (SELECT *, {_N1} AS n1, {_N2} AS n2, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS f FROM d)
SELECT p_partkey, round(CASE WHEN c THEN s * n1 - k * exp(-0.1 * t) * n2 ELSE k * exp(-0.1 * t) * (1 - n2) - s * (1 - n1) END, 6) AS price, round(CASE WHEN c THEN n1 ELSE n1 - 1 END, 8) + 0.0 AS delta,
  round(f / (s * v * sqrt(t)), 8) AS gamma, round(s * f * sqrt(t), 6) AS vega,
  round((CASE WHEN c THEN -s * f * v / (2 * sqrt(t)) - 0.1 * k * exp(-0.1 * t) * n2 ELSE -s * f * v / (2 * sqrt(t)) + 0.1 * k * exp(-0.1 * t) * (1 - n2) END) / 365, 8) + 0.0 AS theta FROM n
""")
def bsm_price_greeks(t):
    g = pricing.bsm(F.col("s"), F.col("k"), F.col("t"), F.col("v"), F.col("c"))
    return _options(t).select("p_partkey", *[F.round(g[c], n).alias(c) for c, n in (("price", 6), ("delta", 8), ("gamma", 8), ("vega", 6), ("theta", 8))])


#: Options whose vega is large enough for the price to fix the volatility to six decimals. All are solved; the oracles can
#: tell the outcome of these only, the others' is null here and given by the ``_all`` queries.
_FIXED = "v >= 0.1 AND s * exp(-d1 * d1 / 2) / sqrt(2 * pi()) * sqrt(t) > 1"


def _where_fixed(column):
    d1 = (F.log(F.col("s") / F.col("k")) + (0.1 + F.col("v") * F.col("v") / 2) * F.col("t")) / (F.col("v") * F.sqrt("t"))
    return F.when((F.col("v") >= 0.1) & (F.col("s") * pricing.normal_pdf(d1) * F.sqrt("t") > 1), column)


@BOOK.query(f"WITH {_OPTION} SELECT p_partkey, CASE WHEN {_FIXED} THEN round(v, 6) END AS iv, CASE WHEN {_FIXED} THEN 'ok' END AS bsm_status FROM d")
def implied_vol_roundtrip(t):
    o = _options(t).withColumn("price", pricing.bsm(F.col("s"), F.col("k"), F.col("t"), F.col("v"), F.col("c"))["price"])
    o = pricing.with_implied_vol(o, "s", "k", "price", "t", "c")
    return o.select("p_partkey", _where_fixed(F.round("iv", 6)).alias("iv"), _where_fixed(F.col("bsm_status")).alias("bsm_status"))


@BOOK.query(f"WITH {_OPTION} SELECT p_partkey, CASE WHEN {_FIXED} THEN round(v, 6) END AS iv FROM d")
def black76_roundtrip(t):
    o = _options(t).withColumn("f", F.col("s") * F.exp(0.1 * F.col("t")))
    o = o.withColumn("price", pricing.black76(F.col("f"), F.col("k"), F.col("t"), F.col("v"), F.col("c")))
    return pricing.with_black76_iv(o, "f", "k", "price", "t", "c").select("p_partkey", _where_fixed(F.round("iv", 6)).alias("iv"))


# Every row of part with every outcome, without an oracle; tested against numpy.


@BOOK.query()
def bsm_price_greeks_all(t):
    g = pricing.bsm(F.col("s"), F.col("k"), F.col("t"), F.col("v"), F.col("c"))
    return _options(t).select("p_partkey", *[F.round(g[c], n).alias(c) for c, n in (("price", 6), ("delta", 8), ("gamma", 8), ("vega", 6), ("theta", 8))])


@BOOK.query()
def implied_vol_all(t):
    o = _options(t)
    o = o.withColumn("price", pricing.bsm(F.col("s"), F.col("k"), F.col("t"), F.col("v"), F.col("c"))["price"])
    return pricing.with_implied_vol(o, "s", "k", "price", "t", "c").select("p_partkey", "iv", "bsm_status", "iv_method", "iv_residual")


@BOOK.query()
def black76_all(t):
    o = _options(t).withColumn("f", F.col("s") * F.exp(0.1 * F.col("t")))
    o = o.withColumn("price", pricing.black76(F.col("f"), F.col("k"), F.col("t"), F.col("v"), F.col("c")))
    status = F.when(F.col("iv").isNull(), "no_arbitrage_violation").otherwise("ok")
    return pricing.with_black76_iv(o, "f", "k", "price", "t", "c").select("p_partkey", "iv", status.alias("status"))


@BOOK.query("""
WITH x AS (SELECT p_partkey, p_retailprice AS s, 5.0 AS a, 3.0 AS b FROM part)
SELECT p_partkey, round(s * 0.99 + (6.0 - 2.0) * exp(0.1 * 30 / 365.0), 6) AS forward, round(0.3 * 0.3 - 0.05 * 0.05 * 525600.0 / 94500.0, 10) AS vrp FROM x
""")
def parity_forward(t):
    k = F.col("p_retailprice")
    lit = lambda x: F.lit(float(x))
    strikes = [(k * 0.98, lit(7), lit(2)), (k * 0.99, lit(6), lit(2)), (k * 1.0, lit(1), lit(5))]
    # the median of the three: 0.99 k + 4 e^(rt), as 0.98 k + 5 e^(rt) and k - 4 e^(rt) lie below it for k >= 900
    return t.part.select("p_partkey", F.round(pricing.parity_forward(strikes, F.lit(30 / 365)), 6).alias("forward"), F.round(pricing.variance_risk_premium(F.lit(0.3), F.lit(0.05)), 10).alias("vrp"))


@BOOK.query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 100 AS close, l_quantity * 10 AS vol, l_partkey * 100.0 AS oi, l_suppkey * 30.0 AS mins, 10 + l_discount * 100 AS vix FROM lineitem),
b AS (SELECT *, greatest(0.05, close * 0.001599 * pow(vix / 15, 1.5)) AS base, 1 + 0.045543 / sqrt(greatest(mins / 60, 0.1)) AS tm, CASE WHEN vol / (oi + 1) < 0.001 THEN 1.5 ELSE 1.0 END AS st, 1 + 1.501812 / greatest(ln(oi + 1), 0.1) AS dm FROM x)
SELECT l_orderkey, l_linenumber, round(base, 12) AS base_spread, round(base * tm * st * dm, 10) AS slippage, round(base * tm * st * dm * ((l_linenumber - 1) / 59.0 + sqrt(least((l_linenumber - 1) * 50 / greatest(vol, 1), 1)) + sqrt(least((l_linenumber - 1) * 50 / greatest(oi, 1), 1))), 8) AS impact FROM b
""")
def slippage_impact(t):
    x = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 100).alias("close"), (F.col("l_quantity") * 10).alias("vol"), (F.col("l_partkey") * 100.0).alias("oi"), (F.col("l_suppkey") * 30.0).alias("mins"), (10 + F.col("l_discount") * 100).alias("vix"))
    s = execution.slippage(*[F.col(c) for c in ("close", "vol", "oi", "mins", "vix")])
    i = execution.participation_impact(s["slippage"], F.col("l_linenumber") * 50, F.lit(50), F.col("vol"), F.col("oi"))
    return x.select("l_orderkey", "l_linenumber", F.round(s["base_spread"], 12).alias("base_spread"), F.round(s["slippage"], 10).alias("slippage"), F.round(i["impact"], 8).alias("impact"))


@BOOK.query("""
WITH x AS (SELECT l_orderkey, l_extendedprice * l_quantity AS tv, l_returnflag = 'R' AS sell, l_linenumber = 1 AS fut, CASE WHEN l_shipdate < DATE '1997-01-01' THEN 0.0005 WHEN l_shipdate < DATE '1999-01-01' THEN 0.0005 ELSE 0.0005 END AS stt FROM lineitem),
y AS (SELECT *, 20.0 AS br, CASE WHEN sell THEN CASE WHEN fut THEN 0.0002 ELSE stt END * tv ELSE 0 END AS tax, CASE WHEN NOT sell THEN CASE WHEN fut THEN 0.00002 ELSE 0.00003 END * tv ELSE 0 END AS st,
  CASE WHEN fut THEN 0.0000173 ELSE 0.0003503 END * tv AS ex, 0.000001 * tv AS se, CASE WHEN fut THEN 0.000001 ELSE 0.000005 END * tv AS ip FROM x)
SELECT l_orderkey, count(*) AS legs, round(sum(tax), 7) AS stt, round(sum(st), 7) AS stamp, round(sum(ex), 4) AS exchange_fee, round(sum(0.18 * (br + ex + se + ip)), 4) AS gst, round(sum(br + tax + st + ex + se + ip + 0.18 * (br + ex + se + ip)), 4) AS charges FROM y GROUP BY 1
""")
def basket_charges(t):
    li = t.lineitem.withColumn("slip", F.lit(0.0))
    c = execution.leg_charges(F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY"), F.col("l_linenumber") == 1, F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_shipdate"))
    b = execution.basket_cost(li, ["l_orderkey"], c, "l_quantity", "slip")
    return b.select("l_orderkey", "legs", *[F.round(x, 7 if x in ("stt", "stamp") else 4).alias(x) for x in ("stt", "stamp", "exchange_fee", "gst", "charges")])


@BOOK.query("""
SELECT d::VARCHAR AS d, CASE WHEN d < DATE '2023-04-01' THEN 0.0005 WHEN d < DATE '2024-10-01' THEN 0.000625 WHEN d < DATE '2026-04-01' THEN 0.001 ELSE 0.0015 END::DOUBLE AS rate
FROM (SELECT DISTINCT (o_orderdate + INTERVAL 25 YEAR)::DATE AS d FROM orders)
""")
def stt_regimes(t):
    d = t.orders.select((F.col("o_orderdate") + F.expr("INTERVAL 25 YEAR")).cast("date").alias("d")).distinct()
    return d.select(F.col("d").cast("string").alias("d"), execution.option_stt_rate(F.col("d")).alias("rate"))


@BOOK.query("""
WITH f AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS sell, l_extendedprice AS p, l_tax * 10 AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN sell THEN greatest(p - s, 0.05) ELSE p + s END, 6) AS fill_price, round(abs(CASE WHEN sell THEN greatest(p - s, 0.05) ELSE p + s END - p), 6) AS slippage_realised FROM f
""")
def adverse_fill(t):
    f = execution.adverse_fill(F.col("l_extendedprice"), F.col("l_tax") * 10, F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(f["fill_price"], 6).alias("fill_price"), F.round(f["slippage_realised"], 6).alias("slippage_realised"))


_S = [f"s{k}" for k in range(1, 17)]


@BOOK.query(f"""
WITH x AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS sg, l_quantity AS q, l_linenumber <> 1 AS opt, l_extendedprice / 1000 AS p, {', '.join(f"l_extendedprice / 1000 * ({k} - 8.5) / 100 AS s{k}" for k in range(1, 17))} FROM lineitem),
g AS (SELECT l_orderkey, {', '.join(f'sum(sg * q * {s}) AS {s}' for s in _S)}, bool_or(NOT opt OR sg < 0) AS risky, sum(CASE WHEN opt AND sg < 0 THEN q * p ELSE 0 END) AS credit, sum(CASE WHEN opt AND sg > 0 THEN q * p ELSE 0 END) AS lv FROM x GROUP BY 1),
m AS (SELECT *, greatest(0, {', '.join(_S)}) AS scan FROM g)
SELECT l_orderkey, round(scan, 9) AS scan_risk, round(lv - credit, 6) AS net_option_value, round(greatest(CASE WHEN risky THEN greatest(scan - (lv - credit), 0) ELSE 0 END + lv, 1), 9) AS margin FROM m
""")
def span_scenario_max(t):
    legs = t.lineitem.withColumns({"sg": F.when(F.col("l_returnflag") == "R", -1).otherwise(1), "opt": F.col("l_linenumber") != 1, "p": F.col("l_extendedprice") / 1000})
    legs = legs.withColumns({f"s{k}": F.col("p") * (k - 8.5) / 100 for k in range(1, 17)})
    m = execution.scenario_margin(legs, ["l_orderkey"], "sg", "l_quantity", "opt", "p", "p", _S)
    return m.select("l_orderkey", F.round("scan_risk", 9).alias("scan_risk"), F.round("net_option_value", 6).alias("net_option_value"), F.round("margin", 9).alias("margin"))


@BOOK.query("""
WITH x AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN -1.0 ELSE 1.0 END AS w, l_partkey / 10.0 AS k, l_linenumber % 2 = 0 AS c, l_tax * 100 AS p FROM lineitem),
sp AS (SELECT l_orderkey, k AS s FROM x UNION ALL SELECT l_orderkey, 2 * max(k) FROM x GROUP BY 1 UNION ALL SELECT DISTINCT l_orderkey, 0.0 FROM x),
v AS (SELECT sp.l_orderkey, sp.s, sum(w * (greatest(0, CASE WHEN c THEN s - k ELSE k - s END) - p)) AS v FROM sp JOIN x USING (l_orderkey) GROUP BY ALL)
SELECT l_orderkey, round(greatest(0, -min(v2)), 4) AS max_loss, round(greatest(0, max(v2)), 4) AS max_profit FROM (SELECT DISTINCT l_orderkey, s, v / n AS v2 FROM v JOIN (SELECT l_orderkey, s, count(*) AS n FROM sp GROUP BY ALL) USING (l_orderkey, s)) GROUP BY 1
""")
def terminal_payoff_risk(t):
    x = t.lineitem.select("l_orderkey", F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0).alias("w"), (F.col("l_partkey") / 10.0).alias("k"), (F.col("l_linenumber") % 2 == 0).alias("c"), (F.col("l_tax") * 100).alias("p"))
    r = structures.terminal_risk(x, ["l_orderkey"], "w", "k", "c", "p")
    return r.select("l_orderkey", F.round("max_loss", 4).alias("max_loss"), F.round("max_profit", 4).alias("max_profit"))


@BOOK.query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_field_extract(t):
    return t.events.select("event_id", payloads.first_number(F.col("props"), ["k", "key"]).cast("long").alias("k"))


@BOOK.query("SELECT vec_id, i::INT AS i, round(embedding[i + 1]::DOUBLE, 6) AS x FROM embeddings, range(0, 64) r(i) WHERE i < len(embedding)")
def array_flatten(t):
    return t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.round(F.col("x").cast("double"), 6))


@BOOK.query("SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) AS bucket, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_half_hour_windows(t):
    """The streaming aggregate run to completion over the events file."""
    return streams.run_available(t.spark, f"{t.dir}/events.parquet", t.events.schema, lambda s: streams.windowed_totals(s, "ts", "event_type", "value", "30 minutes", "1 hour")).select("event_type", "bucket", "n", F.round("total", 6).alias("total"))


@BOOK.query()
def bootstrap_ci(t):
    return stats.bootstrap_mean(t.events.withColumn("d", F.col("ts").cast("date").cast("string")), ["event_type"], "value", "d")


@BOOK.query()
def permutation_break(t):
    e = t.events.groupBy("event_type", "user_id").agg(F.avg("value").alias("v")).withColumn("late", F.col("user_id") % 2 == 0)
    return stats.permutation_break(e, ["event_type"], "late", "v", 500)


@BOOK.query()
def ridge_cells(t):
    return stats.ridge(t.lineitem, ["l_returnflag"], ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 1.0)
