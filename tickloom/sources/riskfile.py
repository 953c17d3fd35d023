"""Zipped risk-parameter XML files as rows: one task reads whole archives, elements are dropped as soon as they are read."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCENARIOS = 16
COLUMNS = ["symbol", "instrument", "expiry", "strike", "price", "delta", "implied_vol", "price_scan_range", "vol_scan_range", "cvf", "composite_delta", *[f"s{k}" for k in range(1, SCENARIOS + 1)], "source_member"]
SCHEMA = "symbol string, instrument string, expiry string, strike double, price double, delta double, implied_vol double, price_scan_range double, vol_scan_range double, cvf double, composite_delta double, " + ", ".join(f"s{k} double" for k in range(1, SCENARIOS + 1)) + ", source_member string"


def _number(node, name: str, missing: float = 0.0) -> float:
    text = node.findtext(name) if node is not None else None
    try:
        return float(text)
    except (TypeError, ValueError):
        return missing


def _row(symbol: str, kind: str, expiry: str, node, scan, cvf: float, member: str) -> tuple:
    array = node.find("ra")
    losses = [float(a.text or 0) for a in array.findall("a")][:SCENARIOS] if array is not None else []
    losses += [0.0] * (SCENARIOS - len(losses))
    option = kind != "FUT"
    return (symbol, kind, expiry, _number(node, "k") if option else 0.0, _number(node, "p"), _number(node, "d"), _number(node, "v") if option else 0.0, _number(scan, "priceScan"), _number(scan, "volScan"), cvf, _number(array, "d"), *losses, member)


def parse(stream, member: str, symbols: set[str] | None = None) -> Iterator[tuple]:
    """Rows of one XML document. Documents that declare entities are refused."""
    raw = stream.read()
    if re.search(rb"<!ENTITY", raw, re.I):
        raise ValueError(f"{member} declares an entity")
    for _, node in ElementTree.iterparse(io.BytesIO(raw), events=("end",)):
        if node.tag not in ("futPf", "oopPf"):
            continue
        symbol = (node.findtext("pfCode") or "").strip().upper()
        if symbols is None or symbol in symbols:
            base = _number(node, "cvf", 1.0)
            groups = [(f, [("FUT", f)]) for f in node.findall("fut")] if node.tag == "futPf" else [(s, [({"C": "CE", "P": "PE"}.get((o.findtext("o") or "?").strip().upper()[:1]), o) for o in s.findall("opt")]) for s in node.findall("series")]
            for head, items in groups:
                expiry = re.sub(r"\D", "", head.findtext("pe") or "")
                if len(expiry) == 8:
                    yield from (_row(symbol, kind, expiry, item, head.find("scanRate"), _number(head, "cvf", base), member) for kind, item in items if kind)
        node.clear()


def read(spark: SparkSession, path: str, symbols: list[str] | None = None) -> DataFrame:
    """All members of all archives under the path, through Spark's reader; expiry as a date, source_file kept."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = set(symbols) if symbols else None
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        with z.open(name) as stream:
                            block = []
                            for row in parse(stream, name, wanted):
                                block.append(row)
                                if len(block) == 20_000:
                                    yield pd.DataFrame(block, columns=COLUMNS).assign(source_file=file)
                                    block = []
                            if block:
                                yield pd.DataFrame(block, columns=COLUMNS).assign(source_file=file)

    return files.mapInPandas(run, SCHEMA + ", source_file string").withColumn("expiry", F.to_date("expiry", "yyyyMMdd"))


def contract_join(options: DataFrame, risk: DataFrame, gaps: DataFrame | None = None, prefix: str = "span_") -> DataFrame:
    """Options LEFT JOIN risk rows on (date, expiry, strike as double, CALL -> CE, PUT -> PE), with a status: matched, source_gap or unmatched_contract."""
    side = F.when(F.upper("option_type") == "CALL", "CE").when(F.upper("option_type") == "PUT", "PE")
    rest = [c for c in risk.columns if c not in ("date", "expiry", "strike", "instrument")]
    r = risk.select(F.col("date").alias("__d"), F.col("expiry").alias("__e"), F.col("strike").cast("double").alias("__k"), F.col("instrument").alias("__i"), *[F.col(c).alias(f"{prefix}{c}") for c in rest], F.lit(True).alias("__hit"))
    out = options.join(r, (F.col("trade_date") == F.col("__d")) & (F.col("expiry_date") == F.col("__e")) & (F.col("strike").cast("double") == F.col("__k")) & (side == F.col("__i")), "left")
    gap = F.lit(False)
    if gaps is not None:
        g = gaps.select(F.col("trading_date").alias("__g")).distinct().withColumn("__gap", F.lit(True))
        out = out.join(F.broadcast(g) if g.limit(100_001).count() <= 100_000 else g, F.col("trade_date") == F.col("__g"), "left")
        gap = F.coalesce(F.col("__gap"), F.lit(False))
    status = F.when(F.col("__hit"), "matched").when(gap, "source_gap").otherwise("unmatched_contract")
    return out.withColumn(f"{prefix}join_status", status).drop("__d", "__e", "__k", "__i", "__hit", "__g", "__gap")


def slots_wide(risk: DataFrame, keys: list[str], slot: str, slots: list[str], values: list[str]) -> DataFrame:
    """One row per contract with every slot's values side by side (slot_value): one shuffle instead of a join per slot."""
    return risk.groupBy(*keys).agg(*[F.max(F.when(F.col(slot) == s, F.col(v))).alias(f"{s.lower()}_{v}") for s in slots for v in values])


def effective_time(reference, created, first_seen):
    """Point in time from which a file may be used: the latest of the three, up to the full minute."""
    latest = F.greatest(*[c.cast("timestamp") for c in (reference, created, first_seen)])
    floor = F.date_trunc("minute", latest)
    return F.when(reference.isNotNull() & created.isNotNull() & first_seen.isNotNull(), F.when(latest == floor, latest).otherwise(floor + F.expr("INTERVAL 1 MINUTE")))
