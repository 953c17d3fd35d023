"""Joins, dimensions, set operations and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, dims, gates
from .book import Book

BOOK = Book()

_ASOF = """
WITH l AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL),
k AS (SELECT DISTINCT user_id FROM r),
j AS (SELECT l.event_id, l.user_id, l.ts, r.ts AS m, r.value AS v, k.user_id AS any_row, epoch_us(l.ts + {shift}) - epoch_us(r.ts) AS age_us
  FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts + {shift} >= r.ts LEFT JOIN k ON k.user_id = l.user_id)
SELECT event_id, user_id, CASE WHEN reason IS NULL THEN m END AS r_ts, CASE WHEN reason IS NULL THEN v END AS r_value,
  CASE WHEN reason IS NULL THEN age_us / 1e6 END AS r_age_s, CASE WHEN reason IS NULL THEN 'MATCHED' ELSE 'BLOCKED' END AS r_status, reason AS r_reason
FROM (SELECT *, CASE WHEN any_row IS NULL THEN 'NO_ROWS' WHEN m IS NULL THEN 'FUTURE_ONLY' WHEN age_us > {tolerance} * 1e6 THEN 'STALE' WHEN v IS NULL OR isnan(v) THEN 'NON_FINITE' END AS reason FROM j)
"""
_SHOWN = ("event_id", "user_id", "r_ts", "r_value", "r_age_s", "r_status", "r_reason")


def _kind(t, name):
    return t.events.where(F.col("event_type") == name).select("event_id", "user_id", "ts", "value")


@BOOK.query(_ASOF.format(shift="INTERVAL 0 SECOND", tolerance=86400))
def asof_backward_tolerance(t):
    return asof.asof_join(_kind(t, "purchase"), _kind(t, "view"), ["user_id"], "ts", "ts", ["value"], 86400).select(*_SHOWN)


@BOOK.query(_ASOF.format(shift="INTERVAL 6 HOUR", tolerance=43200))
def asof_target_staleness(t):
    return asof.asof_join(_kind(t, "purchase"), _kind(t, "view"), ["user_id"], "ts", "ts", ["value"], 43200, shift="INTERVAL 6 HOUR").select(*_SHOWN)


@BOOK.query("""
WITH l AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'),
v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL), c AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY ALL),
a AS (SELECT l.*, v.ts AS vt FROM l ASOF LEFT JOIN v ON l.user_id = v.user_id AND l.ts >= v.ts),
b AS (SELECT a.*, c.ts AS ct FROM a ASOF LEFT JOIN c ON a.user_id = c.user_id AND a.ts >= c.ts),
g AS (SELECT event_id, coalesce(epoch_us(ts) - epoch_us(vt) <= 86400e6, false) AS ok_v, coalesce(epoch_us(ts) - epoch_us(ct) <= 86400e6, false) AS ok_c, coalesce(value > 0, false) AS ok_p FROM b)
SELECT event_id, CASE WHEN ok_v AND ok_c AND ok_p THEN 'READY' ELSE 'BLOCKED' END AS gate_status,
  nullif(concat_ws(';', CASE WHEN NOT ok_v THEN 'NO_VIEW' END, CASE WHEN NOT ok_c THEN 'NO_CLICK' END, CASE WHEN NOT ok_p THEN 'NO_VALUE' END), '') AS gate_reasons,
  CASE WHEN NOT ok_v THEN 'NO_VIEW' WHEN NOT ok_c THEN 'NO_CLICK' WHEN NOT ok_p THEN 'NO_VALUE' END AS first_reason FROM g
""")
def asof_two_sources_gate(t):
    one = asof.asof_join(_kind(t, "purchase"), _kind(t, "view"), ["user_id"], "ts", "ts", ["value"], 86400, prefix="v_")
    two = asof.asof_join(one, _kind(t, "click"), ["user_id"], "ts", "ts", ["value"], 86400, prefix="c_")
    conditions = {"NO_VIEW": F.col("v_status") == "MATCHED", "NO_CLICK": F.col("c_status") == "MATCHED", "NO_VALUE": F.col("value") > 0}
    return gates.gate(two, conditions).withColumn("first_reason", gates.first_failure(conditions)).select("event_id", "gate_status", "gate_reasons", "first_reason")


@BOOK.query("""
WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL),
b AS (SELECT l.*, r.ts AS bt, r.value AS bv FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts),
c AS (SELECT b.*, r.ts AS ft, r.value AS fv FROM b ASOF LEFT JOIN r ON b.user_id = r.user_id AND b.ts <= r.ts)
SELECT event_id, CASE WHEN back THEN bt ELSE ft END AS r_ts, CASE WHEN back THEN bv ELSE fv END AS r_value
FROM (SELECT *, bt IS NOT NULL AND (ft IS NULL OR epoch_us(ts) - epoch_us(bt) <= epoch_us(ft) - epoch_us(ts)) AS back FROM c)
""")
def asof_nearest(t):
    return asof.nearest_join(_kind(t, "purchase"), _kind(t, "view"), ["user_id"], "ts", "ts", ["value"]).select("event_id", "r_ts", "r_value")


@BOOK.query("""
WITH b AS (SELECT event_type, date_trunc('hour', ts) AS h, round(avg(value), 6) AS v FROM events GROUP BY ALL)
SELECT b.event_type, b.h, b.v, n.v AS next_v FROM b LEFT JOIN b n ON n.event_type = b.event_type AND n.h = b.h + INTERVAL 3 HOUR
""")
def exact_horizon_self_join(t):
    b = t.events.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h")).agg(F.round(F.avg("value"), 6).alias("v"))
    return asof.exact_horizon(b, ["event_type"], "h", "3 HOUR", ["v"])


@BOOK.query("""
SELECT user_id, h, event_id AS first_event, n AS n_rows, n > 1 AS is_duplicate FROM (
  SELECT user_id, date_trunc('hour', ts) AS h, event_id, count(*) OVER w AS n, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY event_id) AS rn
  FROM events WINDOW w AS (PARTITION BY user_id, date_trunc('hour', ts))) WHERE rn = 1
""")
def duplicate_right_quarantine(t):
    e = t.events.select("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h"), "event_id")
    return asof.quarantine_duplicates(e, ["user_id", "h"], ["event_id"]).select("user_id", "h", F.col("event_id").alias("first_event"), "n_rows", "is_duplicate")


_RATES = [("1995-01-01", "1996-12-31", 0.0005, None), ("1997-01-01", "1998-12-31", 0.000625, None), ("1998-06-01", "1999-06-30", 0.001, "1-URGENT"), ("2000-01-01", None, 0.0015, None)]
_RATE_SQL = "(VALUES (DATE '1995-01-01', DATE '1996-12-31', 0.0005::DOUBLE, NULL), ('1997-01-01', '1998-12-31', 0.000625, NULL), ('1998-06-01', '1999-06-30', 0.001, '1-URGENT'), ('2000-01-01', NULL, 0.0015, NULL)) r(f, t, rate, prio)"


@BOOK.query(f"""
WITH j AS (SELECT o_orderkey, o_orderdate::DATE AS d, r.rate, count(r.rate) OVER (PARTITION BY o_orderkey) AS n, row_number() OVER (PARTITION BY o_orderkey ORDER BY r.f) AS rn
  FROM orders LEFT JOIN {_RATE_SQL} ON o_orderdate::DATE >= r.f AND (r.t IS NULL OR o_orderdate::DATE <= r.t) AND (r.prio IS NULL OR r.prio = o_orderpriority))
SELECT o_orderkey, CASE WHEN n = 1 THEN rate END AS rule_rate, n AS rule_matches, CASE n WHEN 1 THEN 'MATCHED' WHEN 0 THEN 'MISSING' ELSE 'AMBIGUOUS' END AS rule_status FROM j WHERE rn = 1
""")
def interval_rate_join(t):
    rules = t.spark.createDataFrame(_RATES, "f string, t string, rate double, prio string").select(F.to_date("f").alias("f"), F.to_date("t").alias("t"), "rate", "prio")
    o = t.orders.select("o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("d"))
    return dims.interval_join(o, rules, "d", "f", "t", [("o_orderpriority", "prio")]).select("o_orderkey", "rule_rate", F.col("rule_matches").cast("long").alias("rule_matches"), "rule_status")


@BOOK.query("""
WITH d AS (SELECT o_custkey AS k, count(*) AS n, min(o_orderpriority) AS p FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN n = 1 THEN p END AS dim_o_orderpriority, coalesce(n, 0) AS dim_matches, CASE WHEN n IS NULL THEN 'MISSING' WHEN n = 1 THEN 'MATCHED' ELSE 'AMBIGUOUS' END AS dim_status FROM customer LEFT JOIN d ON k = c_custkey
""")
def dimension_ambiguity(t):
    dim = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return dims.lookup(t.customer.select("c_custkey"), dim, ["c_custkey"], ["o_orderpriority"])


@BOOK.query("""
WITH c AS (SELECT DISTINCT ts::DATE + 365 * 3 AS d FROM events WHERE event_type = 'signup' UNION SELECT DISTINCT (o_orderdate::DATE + 5) FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT o_orderkey, (SELECT min(d) FROM c WHERE d >= o_orderdate::DATE)::VARCHAR AS next_date FROM orders
""")
def next_calendar_date(t):
    cal = t.events.where("event_type = 'signup'").select(F.date_add(F.col("ts").cast("date"), 1095).alias("d")).union(t.orders.where("o_orderpriority = '1-URGENT'").select(F.date_add(F.col("o_orderdate").cast("date"), 5)))
    o = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("d0"))
    return dims.next_on_or_after(o, cal, "d0", "d").select("o_orderkey", F.col("next_date").cast("string").alias("next_date"))


@BOOK.query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ANTI JOIN (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1) d USING (l_orderkey, l_linenumber)")
def anti_duplicate_identity(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    dup = li.groupBy("l_orderkey", "l_linenumber").count().where("count > 1")
    return li.join(dup, ["l_orderkey", "l_linenumber"], "left_anti")


@BOOK.query("SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS returned FROM orders")
def mark_join(t):
    r = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return dims.mark_join(t.orders.select("o_orderkey"), r, ["o_orderkey"], "returned")


@BOOK.query("SELECT c_custkey, c_acctbal FROM customer SEMI JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000")
def membership_semi_join(t):
    big = t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey", "c_acctbal").join(big, "c_custkey", "left_semi")


@BOOK.query("""
WITH r AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT count(*) AS left_rows, (SELECT sum(n)::BIGINT FROM r) AS right_rows, count(n) AS matched, count(*) - count(n) AS unmatched,
  (SELECT count(*) FROM r WHERE n > 1) AS right_duplicate_keys, sum(coalesce(n, 1))::BIGINT AS output_rows FROM orders LEFT JOIN r ON k = o_orderkey
""")
def join_cardinality_audit(t):
    return dims.cardinality_audit(t.orders, t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@BOOK.query("""
WITH a AS (SELECT o_custkey, o_orderpriority FROM orders WHERE o_totalprice > 200000), b AS (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O')
SELECT *, 'A' AS side FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT *, 'B' AS side FROM (FROM b EXCEPT ALL FROM a)
""")
def symmetric_difference_multiset(t):
    o = t.orders.select("o_custkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    a, b = o.where("o_totalprice > 200000"), o.where("o_orderstatus = 'O'")
    return dims.multiset_difference(a.select("o_custkey", "o_orderpriority"), b.select("o_custkey", "o_orderpriority"))


@BOOK.query("""
WITH k AS (SELECT source, lang, count(DISTINCT n_chars) AS v FROM documents GROUP BY ALL)
SELECT source, lang, min(doc_id) AS doc_id, count(*) AS n_rows, max(v) > 1 AS conflict FROM documents JOIN k USING (source, lang) GROUP BY source, lang
""")
def conflict_dedupe(t):
    d = t.documents.select("source", "lang", "doc_id", "n_chars")
    clean, conflicts = dims.conflict_dedupe(d, ["source", "lang"], ["n_chars"], ["doc_id"])
    rows = d.groupBy("source", "lang").agg(F.count("*").alias("n_rows"))
    both = clean.select("source", "lang", "doc_id", F.lit(False).alias("conflict")).unionByName(conflicts.groupBy("source", "lang").agg(F.min("doc_id").alias("doc_id")).withColumn("conflict", F.lit(True)))
    return both.join(rows, ["source", "lang"])


@BOOK.query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_event_state(t):
    return dims.latest_event(t.events.select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@BOOK.query("""
WITH p AS (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 DAY))::DATE AS d), planned AS (SELECT d FROM p WHERE isodow(d) <= 5),
present AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders)
SELECT coalesce(planned.d, present.d)::VARCHAR AS d, CASE WHEN planned.d IS NULL THEN 'UNEXPECTED' WHEN present.d IS NULL THEN 'MISSING' ELSE 'MATCHED' END AS state FROM planned FULL JOIN present ON planned.d = present.d
""")
def session_coverage(t):
    planned = t.spark.sql("SELECT explode(sequence(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 DAY)) AS d").where(F.weekday("d") < 5)
    return dims.reconcile(planned, t.orders.select(F.col("o_orderdate").cast("date").alias("d")), ["d"]).withColumn("d", F.col("d").cast("string"))


@BOOK.query("""
WITH s AS (SELECT o_orderkey, o_orderdate AS t0, o_orderdate + to_days((o_custkey % 7)::INT) AS t1, o_orderdate + to_days((o_orderkey % 7)::INT) AS t2, o_totalprice > 100000 AS ok1 FROM orders)
SELECT o_orderkey, CASE WHEN o_orderstatus_ok AND t2 >= greatest(t0, CASE WHEN ok1 THEN t1 ELSE t0 END) THEN 'ID2' WHEN ok1 AND t1 >= t0 THEN 'ID1' ELSE 'BOD' END AS slot
FROM (SELECT s.*, o_orderstatus = 'O' AS o_orderstatus_ok FROM s JOIN orders USING (o_orderkey))
""")
def latest_eligible_slot(t):
    o = t.orders.withColumns({"t1": F.expr("o_orderdate + make_dt_interval(cast(o_custkey % 7 as int))"), "t2": F.expr("o_orderdate + make_dt_interval(cast(o_orderkey % 7 as int))")})
    slots = [("BOD", F.col("o_orderdate"), F.lit(True)), ("ID1", F.col("t1"), F.col("o_totalprice") > 100000), ("ID2", F.col("t2"), F.col("o_orderstatus") == "O")]
    return o.select("o_orderkey", dims.slot_choice(slots).alias("slot"))


@BOOK.query("""
SELECT o_orderkey, l_linenumber, s.slot, CASE s.slot WHEN 'qty' THEN l_quantity WHEN 'disc' THEN l_discount ELSE l_tax END AS x
FROM lineitem JOIN orders ON o_orderkey = l_orderkey, (VALUES ('qty'), ('disc'), ('tax')) s(slot)
""")
def union_of_slots(t):
    j = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    slots = F.explode(F.array(*[F.struct(F.lit(n).alias("slot"), F.col(c).alias("x")) for n, c in (("qty", "l_quantity"), ("disc", "l_discount"), ("tax", "l_tax"))]))
    return j.select("o_orderkey", "l_linenumber", slots.alias("s")).select("o_orderkey", "l_linenumber", "s.*")
