"""Every registered query with an oracle against DuckDB on the smallest tables, and the others for rows."""

import glob
import math
import os

import duckdb
import pytest

from tickloom.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 7) + 0.0
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(str(_plain(r[k])) for k in order) for r in rows))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, duck, sf_dir, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    want = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_has_rows(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_performance_over_zero(spark, tmp_path):
    days = [f"2024-01-{d:02d} 10:00:00" for d in (2, 3, 4, 5)]
    pnl = {"gains only": (1e6, 2e6, 3e6, 1e6), "no change": (0, 0, 0, 0), "zero equity": (1e6, -2e6, -1e6 * 100, 5e6), "lost all": (-1e8, 3e6, 1e6, -2e6), "one day": (1e6,)}
    rows = [(k, "F" if x < 0 else "O", abs(float(x)), d) for k, v in pnl.items() for x, d in zip(v, days)]
    df = spark.createDataFrame(rows, "o_orderpriority string, o_orderstatus string, o_totalprice double, d string").selectExpr("*", "cast(d as timestamp) as o_orderdate").drop("d")
    df.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * REPLACE (o_orderdate::TIMESTAMP AS o_orderdate) FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.execute(catalogue.ORACLES["performance_metrics"])
    columns = [c[0] for c in want.description]
    got = catalogue.QUERIES["performance_metrics"](spark, str(tmp_path))
    want = want.fetchall()
    assert any(math.inf in r for r in want) and _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(columns, want)
