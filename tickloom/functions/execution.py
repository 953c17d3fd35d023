"""Execution costs and scenario margin as columns: slippage, participation impact, charges, fills, portfolio scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.gates import finite

# The slippage calibration. Rates are fractions of the price.
SLIPPAGE = {
    "base_rate": 0.001599,
    "time_constant": 0.045543,
    "depth_constant": 1.501812,
    "vix_power": 1.5,
    "vix_baseline": 15.0,
    "tick": 0.05,
    "stale_turnover": 0.001,
    "stale_factor": 1.5,
    "least_hours": 0.1,
    "least_log_oi": 0.1,
}

# Charge rates per rupee of turnover (brokerage per order).
CHARGES = {
    "brokerage": 20.0,
    "gst": 0.18,
    "sebi": 0.000001,
    "margin_reserve": 0.0007,
    "stt_sell_future": 0.0002,
    "stamp_buy_future": 0.00002,
    "stamp_buy_option": 0.00003,
    "exchange_future_nse": 0.0000173,
    "exchange_option_nse": 0.0003503,
    "exchange_future_bse": 0.0,
    "exchange_option_bse": 0.000325,
    "ipft_future_nse": 0.000001,
    "ipft_option_nse": 0.000005,
}

# Tax on sold option premium by the first trade date of each regime.
OPTION_STT = ((None, 0.0005), ("2023-04-01", 0.000625), ("2024-10-01", 0.001), ("2026-04-01", 0.0015))


def _or(c: Column, fallback: float) -> Column:
    return F.when(finite(c), F.greatest(c.cast("double"), F.lit(0.0))).otherwise(F.lit(float(fallback)))


def slippage(close: Column, volume: Column, open_interest: Column, minutes_to_expiry: Column, vix: Column) -> dict[str, Column]:
    """Per-unit slippage and its additive parts; missing volume, interest and time count as 0, a missing index as its baseline.

    Null where the close isn't finite and positive.
    """
    p = SLIPPAGE
    price = F.when(finite(close) & (close > 0), close.cast("double"))
    oi = _or(open_interest, 0)
    base = F.when(price.isNotNull(), F.greatest(F.lit(p["tick"]), price * p["base_rate"] * F.pow(_or(vix, p["vix_baseline"]) / p["vix_baseline"], F.lit(p["vix_power"]))))
    timed = base * (1 + F.lit(p["time_constant"]) / F.sqrt(F.greatest(_or(minutes_to_expiry, 0) / 60, F.lit(p["least_hours"]))))
    stale = timed * F.when(_or(volume, 0) / (oi + 1) < p["stale_turnover"], p["stale_factor"]).otherwise(1.0)
    total = stale * (1 + F.lit(p["depth_constant"]) / F.greatest(F.log(oi + 1), F.lit(p["least_log_oi"])))
    return {"base_spread": base, "time_penalty": timed - base, "stale_penalty": stale - timed, "depth_penalty": total - stale, "slippage": total, "bid_proxy": price - total, "ask_proxy": price + total}


def participation_impact(base: Column, quantity: Column, lot_size: Column, volume: Column, open_interest: Column, parity_lots: float = 60.0, volume_weight: float = 1.0, oi_weight: float = 1.0, power: float = 0.5) -> dict[str, Column]:
    """Impact of the quantity above the first lot: a ladder plus square-root shares of volume and open interest."""
    extra = F.greatest(quantity - lot_size, F.lit(0)).cast("double")
    share = lambda x: F.least(extra / F.greatest(_or(x, 0), F.lit(1.0)), F.lit(1.0))
    steps = F.greatest(quantity / lot_size - 1, F.lit(0.0))
    ladder = base * steps / F.lit(parity_lots - 1)
    by_volume = base * volume_weight * F.pow(share(volume), F.lit(power))
    by_oi = base * oi_weight * F.pow(share(open_interest), F.lit(power))
    return {"ladder_impact": ladder, "volume_impact": by_volume, "oi_impact": by_oi, "impact": ladder + by_volume + by_oi, "adjusted_slippage": base + ladder + by_volume + by_oi}


def option_stt_rate(trade_date: Column) -> Column:
    rate = F.lit(OPTION_STT[0][1])
    for start, value in OPTION_STT[1:]:
        rate = F.when(trade_date.cast("date") >= F.lit(start).cast("date"), value).otherwise(rate)
    return rate


def leg_charges(side: Column, is_future: Column, price: Column, quantity: Column, trade_date: Column, exchange: Column | None = None) -> dict[str, Column]:
    """Charges of one executed leg by kind, and their total."""
    c = CHARGES
    turnover = price * quantity
    nse = F.lit(True) if exchange is None else F.upper(F.trim(exchange)) == "NSE"
    bse = F.lit(False) if exchange is None else F.upper(F.trim(exchange)) == "BSE"
    pick = lambda f, o: F.when(is_future, F.lit(f)).otherwise(o if isinstance(o, Column) else F.lit(o))
    brokerage = F.when(turnover > 0, F.lit(c["brokerage"])).otherwise(0.0)
    stt = F.when(F.upper(F.trim(side)) == "SELL", pick(c["stt_sell_future"], option_stt_rate(trade_date)) * turnover).otherwise(0.0)
    stamp = F.when(F.upper(F.trim(side)) == "BUY", pick(c["stamp_buy_future"], c["stamp_buy_option"]) * turnover).otherwise(0.0)
    exch = F.when(bse, pick(c["exchange_future_bse"], c["exchange_option_bse"])).otherwise(pick(c["exchange_future_nse"], c["exchange_option_nse"])) * turnover
    sebi = F.lit(c["sebi"]) * turnover
    ipft = F.when(nse, pick(c["ipft_future_nse"], c["ipft_option_nse"]) * turnover).otherwise(0.0)
    gst = F.lit(c["gst"]) * (brokerage + exch + sebi + ipft)
    return {"turnover": turnover, "brokerage": brokerage, "stt": stt, "stamp": stamp, "exchange_fee": exch, "sebi": sebi, "ipft": ipft, "gst": gst, "charges": brokerage + stt + stamp + exch + sebi + ipft + gst}


def basket_cost(legs: DataFrame, keys: list[str], charges: dict[str, Column], quantity: str, per_unit: str) -> DataFrame:
    """Sums of all charge kinds, slippage and total cost per basket; brokerage is one order per leg."""
    rows = legs.withColumns(charges).withColumn("slippage_cost", F.col(quantity) * F.col(per_unit))
    out = rows.groupBy(*keys).agg(F.count("*").alias("legs"), *[F.sum(c).alias(c) for c in (*charges, "slippage_cost")])
    return out.withColumn("total_cost", F.col("charges") + F.col("slippage_cost"))


def margin_reserve(turnover: Column) -> Column:
    return turnover * F.lit(CHARGES["margin_reserve"])


def tick_round(price: Column, side: Column, tick: float = 0.05) -> Column:
    """Buys up and sells down to the tick; a price on the tick within 1e-9 stays."""
    steps = price / F.lit(tick)
    near = F.abs(steps - F.round(steps)) < 1e-9
    steps = F.when(near, F.round(steps)).when(F.upper(side) == "BUY", F.ceil(steps).cast("double")).otherwise(F.floor(steps).cast("double"))
    return steps * F.lit(tick)


def adverse_fill(close: Column, per_unit: Column, side: Column, floor: float = 0.05) -> dict[str, Column]:
    """Fill price moved against the trader; sells don't fill under the floor. Modelled and realised slippage are both given."""
    buy = F.upper(side) == "BUY"
    fill = F.when(buy, close + per_unit).otherwise(F.greatest(close - per_unit, F.lit(floor)))
    return {"fill_price": fill, "slippage_modelled": per_unit, "slippage_realised": F.abs(fill - close)}


def scenario_margin(legs: DataFrame, keys: list[str], sign: str, quantity: str, is_option: str, entry_price: str, span_price: str, scenarios: list[str], elm_rate: str | None = None, reference_spot: str | None = None, extra: str | None = None, floor_rate: str | None = None) -> DataFrame:
    """Portfolio scan margin per basket: the worst of the summed scenario losses net of option value, plus the add-ons.

    Legs are signed (+1 long, -1 short). A basket of long options alone has no scan risk. Sums per scenario combine
    map-side; the scan is a greatest over 16 columns.
    """
    q = F.abs(F.col(quantity)).cast("double")
    s = F.col(sign)
    short_option = F.col(is_option) & (s < 0)
    long_option = F.col(is_option) & (s > 0)
    value = q * F.when(F.col(span_price) > 0, F.col(span_price)).otherwise(F.col(entry_price))
    notional = q * F.when(F.col(is_option) & F.lit(reference_spot is not None), F.col(reference_spot or entry_price)).otherwise(F.col(entry_price))
    rate = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c else F.lit(0.0)
    aggs = [F.sum(s * q * F.col(x)).alias(f"scan_{x}") for x in scenarios]
    aggs += [F.max((~F.col(is_option) | (s < 0)).cast("int")).alias("__risky"), F.sum(F.when(short_option, value).otherwise(0.0)).alias("credit"), F.sum(F.when(long_option, value).otherwise(0.0)).alias("long_value")]
    aggs += [F.sum(F.when(long_option, q * F.col(entry_price)).otherwise(0.0)).alias("long_premium"), F.sum(F.when(~F.col(is_option) | (s < 0), rate(elm_rate) * notional).otherwise(0.0)).alias("exposure"), F.sum(F.greatest(rate(extra), F.lit(0.0))).alias("add_on"), F.sum(F.greatest(rate(floor_rate), F.lit(0.0)) * notional).alias("floor_margin")]
    g = legs.groupBy(*keys).agg(*aggs)
    g = g.withColumn("scan_risk", F.greatest(F.lit(0.0), *[F.col(f"scan_{x}") for x in scenarios])).withColumn("net_option_value", F.col("long_value") - F.col("credit"))
    net = F.when(F.col("__risky") == 1, F.greatest(F.col("scan_risk") - F.col("net_option_value"), F.lit(0.0))).otherwise(0.0)
    g = g.withColumn("net_scan", net)
    return g.withColumn("margin", F.greatest(F.col("net_scan") + F.col("exposure") + F.col("long_premium") + F.col("add_on"), F.col("floor_margin"), F.lit(1.0))).drop("__risky")


def calendar_spread_exposure(futures: DataFrame, keys: list[str], expiry: str, quantity: str, price: str, as_of: str, rate: float, is_index: bool = True) -> DataFrame:
    """Exposure margin of futures with near-far pairs at a third: a fold over each basket's expiries, nearest first.

    A near expiry pairs with later ones of opposite sign if it lies after ``as_of`` (on it too, if not an index).
    """
    import pandas as pd

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in futures.select(*keys).schema)
    q = F.col(quantity).cast("double")
    net = futures.groupBy(*keys, expiry).agg(F.sum(q).alias("q"), F.sum(F.abs(q) * F.col(price)).alias("notional"), F.max(as_of).alias("as_of"))
    net = net.where("q <> 0").withColumn("p", F.col("notional") / F.abs("q"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(expiry)
        left, total = pdf["q"].tolist(), 0.0
        prices, dates, now = pdf["p"].tolist(), pdf[expiry].tolist(), pdf["as_of"].iloc[0]
        for i in range(len(left)):
            if not (dates[i] > now or (not is_index and dates[i] == now)):
                continue
            for j in range(i + 1, len(left)):
                if left[i] * left[j] < 0:
                    pair = min(abs(left[i]), abs(left[j]))
                    total += rate * prices[j] * pair / 3
                    left[i] -= pair if left[i] > 0 else -pair
                    left[j] -= pair if left[j] > 0 else -pair
        total += sum(rate * p * abs(x) for p, x in zip(prices, left, strict=True))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "exposure": [total]})

    return net.groupBy(*keys).applyInPandas(fold, f"{kind}, exposure double")
