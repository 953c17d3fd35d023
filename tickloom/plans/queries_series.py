"""Time-series operators on hourly bars of events, and daily portfolio curves."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import portfolio, timeseries
from .book import Book

BOOK = Book()

_BARS = "bars AS (SELECT event_type, date_trunc('hour', ts) AS h, round(avg(value), 6) AS v, count(*) AS n FROM events GROUP BY ALL)"
_RUNS = _BARS + """, s AS (SELECT *, CASE WHEN lag(h) OVER w = h - INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM bars WINDOW w AS (PARTITION BY event_type ORDER BY h)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY h) AS run_id FROM s)"""


def bars(t):
    return t.events.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h")).agg(F.round(F.avg("value"), 6).alias("v"), F.count("*").alias("n"))


@BOOK.query(f"""
WITH {_BARS}, l AS (SELECT *, CASE WHEN lag(h, 1) OVER w = h - INTERVAL 1 HOUR THEN lag(v, 1) OVER w END AS l1, CASE WHEN lag(h, 2) OVER w = h - INTERVAL 2 HOUR THEN lag(v, 2) OVER w END AS l2,
  CASE WHEN lead(h, 3) OVER w = h + INTERVAL 3 HOUR THEN lead(v, 3) OVER w END AS ahead FROM bars WINDOW w AS (PARTITION BY event_type ORDER BY h))
SELECT event_type, h, round(v - l1, 6) AS velocity, round(v - 2 * l1 + l2, 6) AS acceleration, ahead FROM l
""")
def exact_lag_velocity_acceleration(t):
    shift = lambda k: timeseries.exact_shift("v", "h", ["event_type"], k, "1 HOUR")
    b = bars(t).withColumns({"l1": shift(1), "l2": shift(2), "ahead": shift(-3)})
    return b.select("event_type", "h", F.round(F.col("v") - F.col("l1"), 6).alias("velocity"), F.round(F.col("v") - 2 * F.col("l1") + F.col("l2"), 6).alias("acceleration"), "ahead")


@BOOK.query(f"""
WITH {_BARS} SELECT event_type, h, CASE WHEN lag(h, 4) OVER w = h - INTERVAL 4 HOUR THEN round(quantile_cont(v, 0.5) OVER (PARTITION BY event_type ORDER BY h ROWS 4 PRECEDING), 6) END AS median5
FROM bars WINDOW w AS (PARTITION BY event_type ORDER BY h)
""")
def rolling_median_contiguous(t):
    return bars(t).select("event_type", "h", F.round(timeseries.rolling_median("v", "h", ["event_type"], 5, "1 HOUR"), 6).alias("median5"))


@BOOK.query(f"WITH {_RUNS} SELECT event_type, h, run_id::BIGINT AS run_id, min(h) OVER r AS run_start, max(h) OVER r AS run_end, count(*) OVER r AS run_rows FROM runs WINDOW r AS (PARTITION BY event_type, run_id)")
def gaps_islands_run_end(t):
    return timeseries.islands(bars(t).select("event_type", "h"), ["event_type"], "h", "1 HOUR")


@BOOK.query(f"WITH {_BARS} SELECT event_type, h, max(v) OVER f AS hi, min(v) OVER f AS lo, lead(v, 12) OVER (PARTITION BY event_type ORDER BY h) AS at_end FROM bars WINDOW f AS (PARTITION BY event_type ORDER BY h ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)")
def forward_extreme_window(t):
    hi, lo, end = timeseries.forward_extremes("v", "h", ["event_type"], 12)
    return bars(t).select("event_type", "h", hi.alias("hi"), lo.alias("lo"), end.alias("at_end"))


@BOOK.query(f"""
WITH {_BARS} SELECT event_type, h, coalesce(lead(h, 1) OVER w = h + INTERVAL 1 HOUR, false) AS path1, coalesce(lead(h, 6) OVER w = h + INTERVAL 6 HOUR, false) AS path6 FROM bars WINDOW w AS (PARTITION BY event_type ORDER BY h)
""")
def strict_path_complete(t):
    w = Window.partitionBy("event_type").orderBy("h")
    path = lambda k: F.coalesce(F.lead("h", k).over(w) == F.col("h") + F.expr(f"INTERVAL {k} HOUR"), F.lit(False))
    return bars(t).select("event_type", "h", path(1).alias("path1"), path(6).alias("path6"))


@BOOK.query(f"""
WITH {_RUNS}, r AS (SELECT *, ln(v / lag(v) OVER (PARTITION BY event_type, run_id ORDER BY h)) AS x FROM runs WHERE v > 0)
SELECT event_type, h, round(x, 8) AS log_return, CASE WHEN count(x) OVER b = 4 THEN round(sqrt(sum(x * x) OVER b), 8) END AS trailing_rv, CASE WHEN count(x) OVER f = 4 THEN round(sqrt(sum(x * x) OVER f), 8) END AS forward_rv
FROM r WINDOW b AS (PARTITION BY event_type, run_id ORDER BY h ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), f AS (PARTITION BY event_type, run_id ORDER BY h ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)
""")
def trailing_forward_rv(t):
    r = timeseries.realised_volatility(bars(t).where("v > 0"), ["event_type"], "h", "v", 4, "1 HOUR")
    return r.select("event_type", "h", *[F.round(c, 8).alias(c) for c in ("log_return", "trailing_rv", "forward_rv")])


@BOOK.query("""
WITH x AS (SELECT event_id, hour(ts) AS b, ts::DATE AS d, value FROM events)
SELECT a.event_id, CASE WHEN count(e.value) >= 60 THEN round(count(*) FILTER (e.value <= a.value)::DOUBLE / count(e.value), 8) END AS causal_pct
FROM x a LEFT JOIN x e ON e.b = a.b AND e.d < a.d GROUP BY a.event_id
""")
def causal_percentile(t):
    x = t.events.select("event_id", F.hour("ts").alias("b"), F.col("ts").cast("date").alias("d"), "value")
    return timeseries.causal_percentile(x, ["b"], "d", "value", 60).select("event_id", F.round("causal_pct", 8).alias("causal_pct"))


@BOOK.query("""
WITH r AS (SELECT value FROM events WHERE ts < TIMESTAMP '2024-01-11'), c AS (SELECT e.event_id, count(r.value) AS k FROM events e LEFT JOIN r ON r.value <= e.value GROUP BY 1)
SELECT event_id, round(k::DOUBLE / (SELECT count(*) FROM r), 8) AS ecdf FROM c
""")
def discovery_ecdf(t):
    e = t.events.select("event_id", "value", "ts")
    return timeseries.ecdf(e, e.where("ts < TIMESTAMP_NTZ '2024-01-11'").select("value"), "value").select("event_id", F.round("ecdf", 8).alias("ecdf"))


@BOOK.query("""
WITH x AS (SELECT o_orderkey, CASE WHEN year(o_orderdate) < 1998 THEN 'discovery' ELSE 'validation' END AS split, o_totalprice AS price, o_custkey::DOUBLE AS cust FROM orders),
c AS (SELECT quantile_cont(price, 0.6) AS tp, quantile_cont(cust, 0.3) AS tc FROM x WHERE split = 'discovery')
SELECT o_orderkey, split, nullif(concat_ws(';', CASE WHEN price < tp THEN 'PRICE_LOW' END, CASE WHEN cust < tc THEN 'CUST_LOW' END), '') AS gate_reasons, price >= tp AND cust >= tc AS gate_pass,
  round(least((price - tp) / abs(tp), (cust - tc) / abs(tc)), 8) AS gate_cushion FROM x, c
""")
def discovery_gates(t):
    x = t.orders.select("o_orderkey", F.when(F.year("o_orderdate") < 1998, "discovery").otherwise("validation").alias("split"), F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("cust"))
    g = portfolio.discovery_gates(x, "split", "discovery", {"price": 0.6, "cust": 0.3})
    return g.select("o_orderkey", "split", "gate_reasons", "gate_pass", F.round("gate_cushion", 8).alias("gate_cushion"))


@BOOK.query(f"""
WITH {_BARS}, c AS (SELECT event_type, h, h::DATE AS d, th.th, CASE WHEN lag(v) OVER w < th.th AND v >= th.th THEN 'UP' WHEN lag(v) OVER w > th.th AND v <= th.th THEN 'DOWN' END AS direction
  FROM bars, (VALUES (8.0::DOUBLE), (12.0)) th(th) WINDOW w AS (PARTITION BY event_type, th.th ORDER BY h))
SELECT event_type, d::VARCHAR AS d, th, direction, min(h) AS h FROM c WHERE direction IS NOT NULL GROUP BY ALL
""")
def first_daily_crossing(t):
    b = bars(t).withColumn("th", F.explode(F.array(F.lit(8.0), F.lit(12.0))))
    prev = F.lag("v").over(Window.partitionBy("event_type", "th").orderBy("h"))
    c = b.withColumn("direction", timeseries.crossings("v", prev, F.col("th"))).where("direction is not null").withColumn("d", F.col("h").cast("date"))
    return timeseries.first_event(c, ["event_type", "d", "th", "direction"], ["h"]).select("event_type", F.col("d").cast("string").alias("d"), "th", "direction", "h")


@BOOK.query(f"""
WITH {_BARS}, p AS (SELECT event_type, h, h::DATE AS d, rank() OVER (PARTITION BY event_type ORDER BY v) / count(*) OVER (PARTITION BY event_type) AS v FROM bars),
w AS (SELECT *, v - lag(v) OVER d AS step, max(v) OVER (PARTITION BY event_type, d ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, min(v) OVER (PARTITION BY event_type, d ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low
  FROM p WINDOW d AS (PARTITION BY event_type, d ORDER BY h))
SELECT event_type, h, CASE WHEN top >= 0.9 AND top - v >= 0.1 AND step < 0 THEN 'HIGH' WHEN low <= 1 - 0.9::DOUBLE AND v - low >= 0.1 AND step > 0 THEN 'LOW' END AS reversal FROM w
""")
def tail_reversal(t):
    w = Window.partitionBy("event_type")
    p = bars(t).withColumn("p", F.rank().over(w.orderBy("v")) / F.count("*").over(w)).withColumn("d", F.col("h").cast("date"))
    return timeseries.tail_reversal(p, ["event_type", "d"], "h", "p").select("event_type", "h", "reversal")


@BOOK.query("""
WITH d AS (SELECT DISTINCT ts::DATE AS d FROM events), g AS (SELECT d, unnest(generate_series(d::TIMESTAMP + INTERVAL 555 MINUTE, d::TIMESTAMP + INTERVAL 930 MINUTE, INTERVAL 1 MINUTE)) AS m FROM d),
e AS (SELECT date_trunc('minute', ts) AS m, count(*) AS n FROM events GROUP BY 1)
SELECT d::VARCHAR AS d, count(*) AS minutes, count(n) AS filled, coalesce(sum(n), 0)::BIGINT AS events_ FROM g LEFT JOIN e USING (m) GROUP BY d
""")
def minute_grid_universe(t):
    days = t.events.select(F.col("ts").cast("date").alias("d")).distinct()
    g = timeseries.minute_grid(days, "d", "INTERVAL 555 MINUTE", "INTERVAL 930 MINUTE")
    e = t.events.groupBy(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("n"))
    return g.join(e, "ts", "left").groupBy(F.col("d").cast("string").alias("d")).agg(F.count("*").alias("minutes"), F.count("n").alias("filled"), F.coalesce(F.sum("n"), F.lit(0)).alias("events_"))


@BOOK.query("""
WITH o AS (SELECT o_orderpriority, o_orderdate::DATE AS d, sum(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END) / 100 AS p FROM orders GROUP BY ALL),
b AS (SELECT o_orderpriority, min(d) AS a, max(d) AS z FROM o GROUP BY 1), cal AS (SELECT o_orderpriority, unnest(generate_series(a, z, INTERVAL 1 DAY))::DATE AS d FROM b), bd AS (SELECT * FROM cal WHERE isodow(d) <= 5),
j AS (SELECT o_orderpriority, d, coalesce(p, 0) AS p FROM bd FULL JOIN o USING (o_orderpriority, d)), e AS (SELECT *, 1e6 + sum(p) OVER (PARTITION BY o_orderpriority ORDER BY d) AS q FROM j),
k AS (SELECT *, greatest(1e6, max(q) OVER (PARTITION BY o_orderpriority ORDER BY d)) AS k FROM e)
SELECT o_orderpriority, d::VARCHAR AS "date", round(q, 4) AS equity, round(k, 4) AS peak, round(q - k, 4) AS drawdown FROM k
""")
def equity_curve_drawdown(t):
    c = _curve(t)
    return c.select("o_orderpriority", F.col("date").cast("string").alias("date"), *[F.round(x, 4).alias(x) for x in ("equity", "peak", "drawdown")])


def _curve(t):
    pnl = t.orders.select("o_orderpriority", F.col("o_orderdate").cast("date").alias("d"), (F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice")) / 100).alias("p"))
    return portfolio.equity_curve(pnl, ["o_orderpriority"], "d", "p", 1e6)


_CURVE_SQL = BOOK.oracles["equity_curve_drawdown"].rsplit("SELECT", 1)[0]


@BOOK.query(_CURVE_SQL.rstrip() + """,
u AS (SELECT *, q - k AS dd, (q - k < -1e-9)::INT AS u, lead(d) OVER w AS nxt, lag((q - k < -1e-9)::INT, 1, 0) OVER w AS pu FROM k WINDOW w AS (PARTITION BY o_orderpriority ORDER BY d)),
e2 AS (SELECT *, sum(CASE WHEN u = 1 AND pu = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY o_orderpriority ORDER BY d) AS ep FROM u)
SELECT o_orderpriority, ep::BIGINT AS episode, min(d)::VARCHAR AS start, max(d)::VARCHAR AS "end", count(*) AS days, round(min(dd), 4) AS depth, arg_max_null(nxt, d)::VARCHAR AS recovery FROM e2 WHERE u = 1 GROUP BY ALL
""")
def drawdown_episodes(t):
    e = portfolio.drawdown_episodes(_curve(t), ["o_orderpriority"])
    s = lambda c: F.col(c).cast("string").alias(c)
    return e.select("o_orderpriority", "episode", s("start"), s("end"), "days", F.round("depth", 4).alias("depth"), s("recovery"))


@BOOK.query("""
WITH f AS (SELECT o_custkey, (o_orderstatus = 'F')::INT AS f, sum((o_orderstatus <> 'F')::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS g FROM orders)
SELECT o_custkey, max(n)::BIGINT AS longest_run FROM (SELECT o_custkey, g, sum(f) AS n FROM f GROUP BY ALL) GROUP BY 1
""")
def longest_streak(t):
    o = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", (F.col("o_orderstatus") == "F").alias("lost"))
    return portfolio.longest_run(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "lost")


@BOOK.query(_CURVE_SQL.rstrip() + """,
m AS (SELECT o_orderpriority, date_trunc('month', d)::DATE AS month, max_by(q, d) AS e FROM k GROUP BY ALL)
SELECT o_orderpriority, month::VARCHAR AS month, round(e, 4) AS end_equity, round(lag(e, 1, 1e6) OVER (PARTITION BY o_orderpriority ORDER BY month), 4) AS start_equity FROM m
""")
def month_start_equity(t):
    m = portfolio.month_starts(_curve(t), ["o_orderpriority"], 1e6)
    return m.select("o_orderpriority", F.col("month").cast("string").alias("month"), F.round("end_equity", 4).alias("end_equity"), F.round("start_equity", 4).alias("start_equity"))


@BOOK.query(_CURVE_SQL.rstrip() + """,
r AS (SELECT *, q / lag(q, 1, 1e6) OVER (PARTITION BY o_orderpriority ORDER BY d) - 1 AS x FROM k)
SELECT o_orderpriority, count(*) AS days, round(avg(x) / stddev_samp(x) * sqrt(252), 6) AS sharpe, round(avg(x) / sqrt(avg(pow(least(x, 0), 2))) * sqrt(252), 6) AS sortino_rms,
  round(stddev_samp(x) * sqrt(252), 6) AS annual_volatility, round(min((q - k) / k), 6) AS max_drawdown_pct FROM r GROUP BY 1
""")
def performance_metrics(t):
    p = portfolio.performance(_curve(t), ["o_orderpriority"], 1e6)
    return p.select("o_orderpriority", "days", *[F.round(c, 6).alias(c) for c in ("sharpe", "sortino_rms", "annual_volatility", "max_drawdown_pct")])


@BOOK.query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT user_id, event_id, ts, rn, true AS take, ts + INTERVAL 36 HOUR AS busy FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.event_id, e.ts, e.rn, e.ts >= f.busy, CASE WHEN e.ts >= f.busy THEN e.ts + INTERVAL 36 HOUR ELSE f.busy END FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
SELECT user_id, event_id, ts FROM f WHERE take
""")
def nonoverlap_greedy(t):
    e = t.events.select("user_id", "event_id", "ts").withColumn("until", F.col("ts") + F.expr("INTERVAL 36 HOUR"))
    return portfolio.greedy_non_overlapping(e, ["user_id"], "ts", "until", ["event_id"]).drop("until")


@BOOK.query("""
WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END / 1000 AS p, 200 + o_totalprice / 500 AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders),
f AS (SELECT o_custkey, o_orderkey, rn, least(floor(100000 * 0.02 / r), floor(100000 / 9000.0), 10)::BIGINT AS lots, 100000 + least(floor(100000 * 0.02 / r), floor(100000 / 9000.0), 10) * p AS equity FROM o WHERE rn = 1
  UNION ALL SELECT o.o_custkey, o.o_orderkey, o.rn, least(floor(greatest(f.equity, 0) * 0.02 / o.r), floor(greatest(f.equity, 0) / 9000.0), 10)::BIGINT, f.equity + least(floor(greatest(f.equity, 0) * 0.02 / o.r), floor(greatest(f.equity, 0) / 9000.0), 10) * o.p
  FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.rn = f.rn + 1)
SELECT o_custkey, o_orderkey, lots, round(equity, 6) AS equity FROM f
""")
def sizing_fold(t):
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", (F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice")) / 1000).alias("p"), (200 + F.col("o_totalprice") / 500).alias("r"), F.lit(9000.0).alias("m"))
    f = portfolio.sizing_fold(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "p", "r", "m", 100_000, 0.02, 10)
    return f.select("o_custkey", "o_orderkey", "lots", F.round("equity", 6).alias("equity"))
