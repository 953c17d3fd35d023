"""Option pricing as columns and Arrow kernels: the normal distribution, Black-Scholes-Merton, Black-76, implied volatility.

Prices and Greeks are column expressions, inside whole-stage code generation. The implied-volatility solvers iterate per
row over Arrow batches in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATE = 0.10

# Coefficients of the double-precision rational approximation of the normal distribution (Hart 1968,
# algorithm 5666, as published by West 2005), numerator and denominator from the highest power down.
NUMERATOR = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
DENOMINATOR = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _horner(c, x):
    out = c[0]
    for a in c[1:]:
        out = out * x + a
    return out


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function; 2e-16 absolute."""
    a = F.abs(x)
    e = F.exp(-(a * a) / 2)
    body = e * _horner([F.lit(c) for c in NUMERATOR], a) / _horner([F.lit(c) for c in DENOMINATOR], a)
    far = e / ((a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) * F.lit(2.506628274631))
    tail = F.when(a > 37, F.lit(0.0)).when(a < 7.07106781186547, body).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def normal_cdf_sql(x: str) -> str:
    """The same as a SQL expression, |x| < 7."""
    num = den = ""
    for k, c in enumerate(NUMERATOR):
        num = f"({num} * abs({x}) + {c!r})" if k else repr(c)
    for k, c in enumerate(DENOMINATOR):
        den = f"({den} * abs({x}) + {c!r})" if k else repr(c)
    tail = f"(exp(-({x}) * ({x}) / 2) * {num} / {den})"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def normal_pdf(x: Column) -> Column:
    return F.exp(-(x * x) / 2) / F.lit(float(np.sqrt(2 * np.pi)))


def bsm(spot: Column, strike: Column, t: Column, vol: Column, is_call: Column, rate: float = RATE, dividend: float = 0.0) -> dict[str, Column]:
    """price, delta, gamma, vega (per 1.00 of volatility), theta (per day, ACT/365) and rho of a European option."""
    root = F.sqrt(t)
    d1 = (F.log(spot / strike) + (F.lit(rate - dividend) + vol * vol / 2) * t) / (vol * root)
    d2 = d1 - vol * root
    df, dq = F.exp(F.lit(-rate) * t), F.exp(F.lit(-dividend) * t)
    n1, n2, m1, m2 = (normal_cdf(x) for x in (d1, d2, -d1, -d2))
    call, put = spot * dq * n1 - strike * df * n2, strike * df * m2 - spot * dq * m1
    decay = -spot * dq * normal_pdf(d1) * vol / (2 * root)
    pick = lambda c, p: F.when(is_call, c).otherwise(p)
    return {
        "price": pick(call, put),
        "delta": pick(dq * n1, -dq * m1),
        "gamma": dq * normal_pdf(d1) / (spot * vol * root),
        "vega": spot * dq * normal_pdf(d1) * root,
        "theta": pick(decay - rate * strike * df * n2 + dividend * spot * dq * n1, decay + rate * strike * df * m2 - dividend * spot * dq * m1) / 365,
        "rho": pick(strike * t * df * n2, -strike * t * df * m2),
    }


def black76(forward: Column, strike: Column, t: Column, vol: Column, is_call: Column, rate: float = RATE) -> Column:
    root = vol * F.sqrt(t)
    d1 = F.log(forward / strike) / root + root / 2
    d2 = d1 - root
    df = F.exp(F.lit(-rate) * t)
    return df * F.when(is_call, forward * normal_cdf(d1) - strike * normal_cdf(d2)).otherwise(strike * normal_cdf(-d2) - forward * normal_cdf(-d1))


# ------------------------------------------------------------------ numpy kernels


def cdf(x: np.ndarray) -> np.ndarray:
    a = np.abs(x)
    with np.errstate(over="ignore", under="ignore"):
        e = np.exp(-a * a / 2)
        body = e * _horner(NUMERATOR, a) / _horner(DENOMINATOR, a)
        far = e / ((a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) * 2.506628274631)
        tail = np.where(a > 37, 0.0, np.where(a < 7.07106781186547, body, far))
    return np.where(x > 0, 1 - tail, tail)


def _price(s, k, t, v, call, rate):
    root = v * np.sqrt(t)
    d1 = (np.log(s / k) + (rate + v * v / 2) * t) / root
    df = np.exp(-rate * t)
    up = s * cdf(d1) - k * df * cdf(d1 - root)
    vega = s * np.exp(-d1 * d1 / 2) / np.sqrt(2 * np.pi) * np.sqrt(t)
    return np.where(call, up, up - s + k * df), vega


def _brent(f, a: float, b: float, tol: float = 1e-12, steps: int = 100) -> tuple[float, int, bool]:
    """Root of f in [a, b] by inverse quadratic interpolation, secant and bisection; False if the ends don't bracket one."""
    fa, fb = f(a), f(b)
    if fa * fb > 0:
        return float("nan"), 0, False
    if abs(fa) < abs(fb):
        a, b, fa, fb = b, a, fb, fa
    c, fc, d, bisected = a, fa, a, True
    for n in range(1, steps + 1):
        if fb == 0 or abs(b - a) < tol:
            return b, n, True
        if fa != fc and fb != fc:
            s = a * fb * fc / ((fa - fb) * (fa - fc)) + b * fa * fc / ((fb - fa) * (fb - fc)) + c * fa * fb / ((fc - fa) * (fc - fb))
        else:
            s = b - fb * (b - a) / (fb - fa)
        lo, hi = sorted(((3 * a + b) / 4, b))
        width = abs(b - c) if bisected else abs(c - d)
        bisected = not lo < s < hi or abs(s - b) >= width / 2 or width < tol
        if bisected:
            s = (a + b) / 2
        fs = f(s)
        d, c, fc = c, b, fb
        if fa * fs < 0:
            b, fb = s, fs
        else:
            a, fa = s, fs
        if abs(fa) < abs(fb):
            a, b, fa, fb = b, a, fb, fa
    return b, steps, True


def implied_vol(s, k, price, t, call, eligible=None, rate: float = RATE, tol: float = 1e-8, newton_steps: int = 20, low: float = 1e-6, high: float = 5.0) -> dict[str, np.ndarray]:
    """Vectorised implied volatility: bounds, clipped Newton on the rows still open, Brent for the rest.

    status: ok, blocked (not eligible), invalid_input, no_arbitrage_violation, iv_solver_failed; method: NEWTON, BRENT or null.
    """
    s, k, price, t = (np.asarray(x, float) for x in (s, k, price, t))
    call = np.asarray(call, bool)
    n = len(s)
    eligible = np.ones(n, bool) if eligible is None else np.asarray(eligible, bool)
    iv, residual, used = np.full(n, np.nan), np.full(n, np.nan), np.zeros(n, np.int32)
    status, method = np.full(n, "iv_solver_failed", object), np.full(n, None, object)
    valid = np.isfinite(s) & np.isfinite(k) & np.isfinite(price) & np.isfinite(t) & (s > 0) & (k > 0) & (t > 0) & (price >= 0)
    with np.errstate(all="ignore"):
        disc = k * np.exp(-rate * t)
        floor = np.maximum(0, np.where(call, s - disc, disc - s))
        top = np.where(call, s, disc)
        inside = (price > floor + 1e-12) & (price < top - 1e-12)
    status[valid & ~inside] = "no_arbitrage_violation"
    status[~valid] = "invalid_input"
    status[~eligible] = "blocked"
    open_ = np.flatnonzero(valid & inside & eligible)
    with np.errstate(all="ignore"):
        v = np.clip(np.sqrt(2 * np.pi / t[open_]) * price[open_] / s[open_], 0.05, 1.5)
        for _ in range(newton_steps):
            if not len(open_):
                break
            p, vega = _price(s[open_], k[open_], t[open_], v, call[open_], rate)
            gap = p - price[open_]
            used[open_] += 1
            done = np.abs(gap) <= tol
            hit = open_[done]
            iv[hit], residual[hit], status[hit], method[hit] = v[done], np.abs(gap[done]), "ok", "NEWTON"
            go = ~done & (vega > 1e-10)
            stuck = ~done & ~go
            used[open_[stuck]] = newton_steps
            open_, v = open_[go], np.clip(v[go] - gap[go] / vega[go], low, high)
    left = np.flatnonzero(valid & inside & eligible & (method == None))  # noqa: E711
    for i in left:
        f = lambda x, i=i: float(_price(s[i : i + 1], k[i : i + 1], t[i : i + 1], np.array([x]), call[i : i + 1], rate)[0][0] - price[i])
        root, steps, ok = _brent(f, low, high)
        used[i] += steps
        if ok:
            iv[i], residual[i], status[i], method[i] = root, abs(f(root)), "ok", "BRENT"
    return {"iv": iv, "status": status, "method": method, "iterations": used, "residual": residual}


def black76_iv(forward, k, price, t, call, rate: float = RATE, steps: int = 64, low: float = 1e-6, high: float = 5.0) -> np.ndarray:
    """Bisection under a given forward; NaN where the price isn't inside the bounds."""
    f, k, price, t = (np.asarray(x, float) for x in (forward, k, price, t))
    call = np.asarray(call, bool)
    with np.errstate(all="ignore"):
        df = np.exp(-rate * t)

        def value(v):
            root = v * np.sqrt(t)
            d1 = np.log(f / k) / root + root / 2
            up = df * (f * cdf(d1) - k * cdf(d1 - root))
            return np.where(call, up, up - df * (f - k))

        a, b = np.full(len(f), low), np.full(len(f), high)
        ok = (value(a) <= price) & (value(b) >= price) & (t > 0)
        for _ in range(steps):
            m = (a + b) / 2
            under = value(m) < price
            a, b = np.where(under, m, a), np.where(under, b, m)
    return np.where(ok, (a + b) / 2, np.nan)


def with_implied_vol(df: DataFrame, spot: str, strike: str, price: str, t: str, is_call: str, eligible: str | None = None, rate: float = RATE) -> DataFrame:
    """``df`` with iv, bsm_status, iv_method, iv_iterations and iv_residual (NaN becomes null)."""
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, k) for n, k in (("iv", T.DoubleType()), ("bsm_status", T.StringType()), ("iv_method", T.StringType()), ("iv_iterations", T.IntegerType()), ("iv_residual", T.DoubleType()))]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            flag = pdf[is_call].fillna(False).to_numpy(bool)
            r = implied_vol(*[pdf[c].astype(float).to_numpy() for c in (spot, strike, price, t)], flag, None if eligible is None else pdf[eligible].fillna(False).to_numpy(bool), rate)
            yield pdf.assign(iv=r["iv"], bsm_status=r["status"], iv_method=r["method"], iv_iterations=r["iterations"], iv_residual=r["residual"])

    out = df.mapInPandas(run, schema)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("iv", "iv_residual")})


def with_black76_iv(df: DataFrame, forward: str, strike: str, price: str, t: str, is_call: str, rate: float = RATE) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(iv=black76_iv(*[pdf[c].astype(float).to_numpy() for c in (forward, strike, price, t)], pdf[is_call].fillna(False).to_numpy(bool), rate))

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("iv", T.DoubleType())])).withColumn("iv", F.when(~F.isnan("iv"), F.col("iv")))


def parity_forward(strikes: list[tuple[Column, Column, Column]], t: Column, rate: float = RATE) -> Column:
    """Median over strikes of K + (call - put) exp(r t); strikes: (K, call, put); nulls are left out."""
    values = F.array_sort(F.filter(F.array(*[k + (c - p) * F.exp(F.lit(rate) * t) for k, c, p in strikes]), lambda x: x.isNotNull()))
    n = F.size(values)
    mid = lambda i: F.try_element_at(values, i.cast("int"))
    return F.when(n > 0, (mid(F.floor((n + 1) / 2)) + mid(F.floor(n / 2) + 1)) / 2)


def smile_features(atm_call: Column, atm_put: Column, wing_call: Column, wing_put: Column) -> dict[str, Column]:
    """atm_iv, call and put skew, risk reversal, curvature and the call-put gap from implied volatilities."""
    atm = F.coalesce((atm_call + atm_put) / 2, atm_call, atm_put)
    return {"atm_iv": atm, "call_skew": wing_call - atm, "put_skew": wing_put - atm, "risk_reversal": wing_call - wing_put, "curvature": (wing_call + wing_put) / 2 - atm, "call_put_gap": atm_call - atm_put}


def variance_risk_premium(iv: Column, rv: Column, minutes_from: float = 94_500.0, minutes_to: float = 525_600.0) -> Column:
    """IV^2 less the realised variance rescaled from trading to calendar minutes."""
    return iv * iv - rv * rv * F.lit(minutes_to / minutes_from)
