"""Semantics that SQL oracles don't reach: reasons, ties, negative gates, publishing, parsers, kernels."""

import datetime as dt
import io
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.functions import execution, pricing
from tickloom.operators import asof, dims, gates, portfolio, stats, structures, timeseries
from tickloom.sources import payloads, riskfile, tables

T0 = dt.datetime(2024, 1, 2, 10, 0, 0)
SEC = lambda n: T0 + dt.timedelta(seconds=n)


def _asof(spark, left, right, tolerance=60):
    lf = spark.createDataFrame(left, "id int, k string, ts timestamp")
    rf = spark.createDataFrame(right, "k string, ts timestamp, v double")
    return {r.id: r for r in asof.asof_join(lf, rf, ["k"], "ts", "ts", ["v"], tolerance).collect()}


def test_asof_reasons_and_conservation(spark):
    left = [(1, "a", SEC(0)), (2, "a", SEC(30)), (3, "a", SEC(61)), (4, "b", SEC(0)), (5, "c", SEC(0)), (6, None, SEC(0)), (7, "d", SEC(0)), (8, "a", None)]
    right = [("a", SEC(0), 1.0), ("c", SEC(5), 2.0), ("d", SEC(0), float("nan")), (None, SEC(0), 3.0), ("a", None, 9.0)]
    got = _asof(spark, left, right)
    assert len(got) == len(left)
    assert (got[1].r_status, got[1].r_v, got[1].r_age_s) == ("MATCHED", 1.0, 0.0)
    assert (got[2].r_status, got[2].r_age_s) == ("MATCHED", 30.0)
    assert [got[i].r_reason for i in (3, 4, 5, 6, 7, 8)] == ["STALE", "NO_ROWS", "FUTURE_ONLY", "NULL_KEY", "NON_FINITE", "NULL_KEY"]
    assert all(got[i].r_v is None for i in (3, 4, 5, 6, 7, 8))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=12), st.lists(st.integers(0, 300), max_size=12, unique=True))
def test_asof_never_looks_ahead(spark, lefts, rights):
    got = _asof(spark, [(i, "a", SEC(s)) for i, s in enumerate(lefts)], [("a", SEC(s), float(s)) for s in rights])
    assert len(got) == len(lefts)
    for i, s in enumerate(lefts):
        best = max((r for r in rights if r <= s), default=None)
        want = float(best) if best is not None and s - best <= 60 else None
        assert got[i].r_v == want


def test_slot_ties_go_to_the_later_slot(spark):
    df = spark.range(1).select(F.lit(T0).alias("t"))
    choice = dims.slot_choice([("BOD", F.col("t"), F.lit(True)), ("ID1", F.col("t"), F.lit(True)), ("ID2", F.col("t"), F.lit(False))])
    assert df.select(choice.alias("s")).first().s == "ID1"


def test_every_gate_can_fail(spark):
    df = spark.createDataFrame([(1, 10.0, 12.0, 9.0, 11.0, 5), (2, 10.0, 8.0, 9.0, 11.0, 5), (3, 10.0, 12.0, 11.0, 11.0, 5), (4, 10.0, 12.0, 9.0, float("nan"), 5), (5, 10.0, 12.0, 9.0, 11.0, -1)], "id int, open double, high double, low double, close double, volume int")
    got = {r.id: r.x for r in df.select("id", gates.bar_violations().alias("x")).collect()}
    assert got == {1: None, 2: "HIGH_BELOW", 3: "LOW_ABOVE", 4: "NON_FINITE", 5: "NEGATIVE_VOLUME"}
    g = {r.id: (r.gate_status, r.gate_reasons) for r in gates.gate(df, {"A": F.col("id") > 1, "B": F.when(F.col("id") != 2, F.col("id") > 2)}).collect()}
    assert g[1] == ("BLOCKED", "A;B") and g[2] == ("BLOCKED", "B") and g[3] == ("READY", None)
    names = {"MATCHED", "matched"}
    assert spark.createDataFrame([(x,) for x in names], "s string").where(F.upper("s") == "MATCHED").count() == 2


def test_cardinality_and_conflicts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "k int, v string")
    with pytest.raises(Exception, match="repeated key"):
        dims.assert_unique(df, ["k"]).collect()
    clean, bad = dims.conflict_dedupe(df.withColumn("i", F.monotonically_increasing_id()), ["k"], ["v"], ["i"])
    assert [r.k for r in clean.collect()] == [1] and bad.count() == 2
    moved = spark.createDataFrame([(1, None, "a", 0), (1, "a", None, 1), (2, None, "a", 2), (2, None, "a", 3)], "k int, v string, w string, i int")
    clean, bad = dims.conflict_dedupe(moved, ["k"], ["v", "w"], ["i"])
    assert [r.i for r in clean.collect()] == [2] and sorted(r.i for r in bad.collect()) == [0, 1]
    sign = lambda *rows: gates.signature(spark.createDataFrame(list(rows), "v string, w string")).first().signature
    assert sign(("a", "x"), ("a", "x")) != sign(("b", "x"), ("b", "x")) and sign((None, "a")) != sign(("a", None)) and sign(("a", "x"), ("b", "y")) == sign(("b", "y"), ("a", "x"))


def test_running_total_equals_a_window(spark):
    df = spark.createDataFrame([(float(i % 17), 1) for i in range(400)], "v double, n int")
    got = timeseries.running_total(df, "v", "n", "c").groupBy("v").agg(F.max("c").alias("c")).collect()
    assert all(r.c == sum(1 for i in range(400) if i % 17 <= r.v) for r in got)


def test_completed_prefix(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("a", 3, False), ("a", 4, True), ("b", 1, True)], "k string, i int, ok boolean")
    got = {r.k: (r.frontier, r.completed) for r in timeseries.completed_prefix(df, ["k"], "i", F.col("ok")).collect()}
    assert got == {"a": (3, 2), "b": (None, 1)}


def test_publish_is_staged_audited_and_resumable(spark, tmp_path):
    root, df = str(tmp_path), spark.range(100).withColumn("v", F.col("id") * 2)
    one = tables.publish(df, root, "year=2024/month=1", ["id"], {"negative": F.col("v") < 0}, {"a": "1"}, 100)
    assert one["action"] == "published" and one["rows"] == 100
    assert tables.publish(df, root, "year=2024/month=1", ["id"], {}, {"a": "1"})["action"] == "skipped"
    for bad, checks, n in ((df.union(df), {}, None), (df, {"big": F.col("v") > 10}, None), (df, {}, 99)):
        with pytest.raises(ValueError, match="isn't published"):
            tables.publish(bad, root, "year=2024/month=2", ["id"], checks, {"a": "2"}, n)
    assert tables.published(spark, root).count() == 100
    again = tables.publish(df.withColumn("v", F.col("v") + 1), root, "year=2024/month=1", ["id"], {}, {"a": "3"})
    assert again["action"] == "published" and again["content"] != one["content"]


def test_journal_drops_a_truncated_tail_only(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n{"k": 2}\n{"k": ')
    assert sorted(r.k for r in tables.journal(spark, str(tmp_path), "k int").collect()) == [1, 2]
    (tmp_path / "b.jsonl").write_text('{"k": \n{"k": 2}\n')
    with pytest.raises(Exception, match="malformed"):
        tables.journal(spark, str(tmp_path), "k int").collect()


def test_payloads(spark):
    df = spark.createDataFrame([(1, '{"t":[1,2],"c":[5.0,6.0]}'), (2, '{"t":[1],"c":[5.0,6.0]}'), (3, "no"), (4, '{"t":[1]}')], "id int, p string")
    rows, bad = payloads.parallel_arrays(df, "p", {"t": "bigint", "c": "double"})
    assert sorted((r.id, r.t, r.c) for r in rows.collect()) == [(1, 1, 5.0), (1, 2, 6.0)]
    assert {r.id: r.reason for r in bad.collect()} == {2: "UNEQUAL_LENGTHS", 3: "MISSING_ARRAY", 4: "MISSING_ARRAY"} or {r.id: r.reason for r in bad.collect()}[3] == "UNPARSED"
    m = spark.createDataFrame([(1, '{"100.0":{"ce":{"last_price":1.5},"pe":{"last_price":2.5}},"110.0":{"ce":{"last_price":1.0}}}')], "id int, p string")
    assert sorted((r.strike, r.side, r.last_price) for r in payloads.strike_map(m, "p").collect()) == [(100.0, "CE", 1.5), (100.0, "PE", 2.5), (110.0, "CE", 1.0)]
    plan = payloads.request_plan(spark, "2024-01-10", "2024-03-05", {"side": ["CALL", "PUT"]}, 15)
    spans = sorted({(r.chunk_start, r.chunk_end) for r in plan.collect()})
    assert spans[0][0] == dt.date(2024, 1, 10) and spans[-1][1] == dt.date(2024, 3, 5) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert all(a.month == (b - dt.timedelta(days=1)).month and (b - a).days <= 15 for a, b in spans)


RISK_XML = """<spanFile><pointInTime><clearingOrg><exchange>
<futPf><pfCode>nifty</pfCode><cvf>1</cvf><fut><pe>20240125</pe><p>100</p><d>1</d><scanRate><priceScan>10</priceScan><volScan>0.04</volScan></scanRate><ra><a>1</a><a>-2</a><d>0.9</d></ra></fut></futPf>
<oopPf><pfCode>NIFTY</pfCode><series><pe>20240125</pe><scanRate><priceScan>10</priceScan></scanRate><opt><o>C</o><k>105</k><p>3</p><d>0.4</d><v>0.2</v><ra><a>5</a><d>0.3</d></ra></opt><opt><o>P</o><k>95</k></opt></series></oopPf>
<oopPf><pfCode>OTHER</pfCode><series><pe>20240125</pe><opt><o>C</o><k>1</k></opt></series></oopPf></exchange></clearingOrg></pointInTime></spanFile>"""


def test_risk_file(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("a.spn", RISK_XML)
    rows = sorted(riskfile.read(spark, str(tmp_path / "x.zip"), ["NIFTY"]).collect(), key=lambda r: r.strike)
    assert [(r.instrument, r.strike, r.s1, r.s2, r.s16) for r in rows] == [("FUT", 0.0, 1.0, -2.0, 0.0), ("PE", 95.0, 0.0, 0.0, 0.0), ("CE", 105.0, 5.0, 0.0, 0.0)]
    assert rows[2].expiry == dt.date(2024, 1, 25) and rows[2].implied_vol == 0.2 and rows[0].price_scan_range == 10.0
    with pytest.raises(ValueError, match="entity"):
        list(riskfile.parse(io.BytesIO(b'<!DOCTYPE x [<!ENTITY a "b">]><x/>'), "m"))


def test_implied_vol_statuses_and_recovery():
    rng = np.random.default_rng(3)
    n = 300
    s, t, v = rng.uniform(18e3, 28e3, n), rng.uniform(0.03, 0.3, n), rng.uniform(0.1, 1.0, n)
    k, call = s * rng.uniform(0.92, 1.08, n), rng.random(n) < 0.5
    price, _ = pricing._price(s, k, t, v, call, 0.1)
    r = pricing.implied_vol(s, k, price, t, call)
    assert set(r["status"]) == {"ok"} and np.abs(r["iv"] - v).max() < 2e-8
    forced = pricing.implied_vol(s[:20], k[:20], price[:20], t[:20], call[:20], newton_steps=1)
    assert "BRENT" in set(forced["method"]) and np.abs(forced["iv"] - v[:20]).max() < 1e-6
    odd = pricing.implied_vol([100, 100, 100, np.nan, 100], [100] * 5, [200, 0.0, 5, 5, 5], [0.1, 0.1, -1, 0.1, 0.1], [True] * 5, [True, True, True, True, False])
    assert list(odd["status"]) == ["no_arbitrage_violation", "no_arbitrage_violation", "invalid_input", "invalid_input", "blocked"]
    up, down = (pricing._price(s, k, t, v, np.full(n, c), 0.1)[0] for c in (True, False))
    assert np.abs(up - down - (s - k * np.exp(-0.1 * t))).max() < 1e-8


def test_option_queries_return_every_row(spark):
    from statistics import NormalDist

    from tickloom.plans.catalogue import QUERIES

    sf = "/root/testdata/sf0.01"
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_retailprice", "p_size").toPandas()
    key, s, size = (part[c].to_numpy() for c in ("p_partkey", "p_retailprice", "p_size"))
    s = s.astype(float)
    k, v, t, call = s * (0.9 + size % 21 / 100), 0.05 + key % 40 / 100, (7 + key % 100) / 365, key % 2 == 0
    d1 = (np.log(s / k) + (0.1 + v * v / 2) * t) / (v * np.sqrt(t))
    d2, disc = d1 - v * np.sqrt(t), k * np.exp(-0.1 * t)
    n = np.vectorize(NormalDist().cdf)
    price = np.where(call, s * n(d1) - disc * n(d2), disc * n(-d2) - s * n(-d1))
    low = (v < 0.1) | (s * np.exp(-d1 * d1 / 2) / np.sqrt(2 * np.pi) * np.sqrt(t) <= 1)
    assert low.sum() > 50
    greeks = {r.p_partkey: r for r in QUERIES["bsm_price_greeks_all"](spark, sf).collect()}
    assert set(greeks) == set(key) and max(abs(greeks[i].price - x) for i, x in zip(key, price)) < 1e-5
    back = lambda i, iv: float(pricing._price(s[i : i + 1], k[i : i + 1], t[i : i + 1], np.array([iv]), call[i : i + 1], 0.1)[0][0])
    for name, status in (("implied_vol_all", "bsm_status"), ("black76_all", "status")):
        got = {r.p_partkey: r for r in QUERIES[name](spark, sf).collect()}
        assert set(got) == set(key) and len(got) == len(part)
        assert all((r.iv is None) == (r[status] != "ok") for r in got.values())
        for i in range(len(key)):
            r = got[key[i]]
            if not low[i]:
                assert r[status] == "ok" and abs(r.iv - v[i]) < 1e-6
            elif r[status] == "ok":
                assert abs(back(i, r.iv) - price[i]) < 1e-7
            else:  # nothing is left unsolved but prices at their bound
                assert r[status] == "no_arbitrage_violation" and price[i] - max(0, (s[i] - disc[i]) * (1 if call[i] else -1)) < 1e-11


def test_costs(spark):
    df = spark.createDataFrame([("BUY", 100.0, 50, "2024-01-01"), ("SELL", 100.0, 50, "2023-03-31"), ("SELL", 100.0, 50, "2026-04-01")], "side string, p double, q int, d string")
    c = execution.leg_charges(F.col("side"), F.lit(False), F.col("p"), F.col("q"), F.to_date("d"))
    rows = df.select(*[x.alias(n) for n, x in c.items()]).collect()
    assert [r.stt for r in rows] == pytest.approx([0.0, 2.5, 7.5]) and rows[0].stamp == pytest.approx(0.15)
    assert rows[0].charges == pytest.approx(20 + 0.15 + 5000 * (0.0003503 + 0.000001 + 0.000005) + 0.18 * (20 + 5000 * (0.0003503 + 0.000001 + 0.000005)))
    ticks = spark.createDataFrame([(10.01, "BUY"), (10.04, "SELL"), (10.05, "BUY")], "p double, s string").select(execution.tick_round(F.col("p"), F.col("s")).alias("x"))
    assert [r.x for r in ticks.collect()] == pytest.approx([10.05, 10.0, 10.05])
    f = spark.createDataFrame([("b", dt.date(2024, 2, 1), 10, 100.0, dt.date(2024, 1, 1)), ("b", dt.date(2024, 3, 1), -10, 110.0, dt.date(2024, 1, 1)), ("c", dt.date(2024, 2, 1), 10, 100.0, dt.date(2024, 1, 1))], "b string, e date, q int, p double, now date")
    got = {r.b: r.exposure for r in execution.calendar_spread_exposure(f, ["b"], "e", "q", "p", "now", 0.02).collect()}
    assert got == {"b": pytest.approx(0.02 * 110 * 10 / 3), "c": pytest.approx(0.02 * 1000)}


def test_iron_condor_risk(spark):
    legs = spark.createDataFrame([("x", 1.0, 90.0, False, 1.0), ("x", -1.0, 95.0, False, 3.0), ("x", -1.0, 105.0, True, 3.0), ("x", 1.0, 110.0, True, 1.0)], "s string, w double, k double, c boolean, p double")
    r = structures.terminal_risk(legs, ["s"], "w", "k", "c", "p").first()
    assert (r.entry_value, r.max_loss, r.max_profit) == (-4.0, 1.0, 4.0)


def test_sizing_grid_and_ridge(spark):
    import pandas as pd

    trades = pd.DataFrame({"score": [0.9, 0.2, 0.8, 0.7], "pnl": [10.0, -5.0, -20.0, 30.0], "risk": [100.0] * 4})
    cfg = spark.createDataFrame([(1, 0.5, 1.0, 0.02, 0.5, 99.0), (2, 0.95, 1.0, 0.02, 0.5, 99.0)], "config_id int, score_floor double, score_power double, risk_share double, brake_drawdown double, streak_limit double")
    got = {r.config_id: r for r in portfolio.sizing_grid(trades, cfg, 100_000.0).collect()}
    assert got[2].trades == 0 and got[2].final_equity == 100_000 and got[1].trades == 3
    df = spark.createDataFrame([("a", float(i), float(i % 7), 3.0 * i - 2.0 * (i % 7) + 5) for i in range(200)], "k string, x double, z double, y double")
    coef = {r.term: r.coefficient for r in stats.ridge(df, ["k"], ["x", "z"], "y", 1e-9).collect()}
    assert coef["x"] == pytest.approx(3 * np.std(np.arange(200)), rel=1e-6) and coef["z"] == pytest.approx(-2 * np.std(np.arange(200) % 7), rel=1e-6)


def test_registry_names_and_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns[0] == "event_id"
