"""Base series of price and of what is traded behind it, and the library of formulas over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.functions.formulas import evaluated
from tickframe.operators import frames as W

c = F.col


def _after(value: Column, n: int) -> Column:
    """value from the bar number n (from 0) on."""
    return F.when(c("n_") >= n, value)


def base_series(bars: DataFrame) -> DataFrame:
    """bars with m4, m16, m32, m64 (log momentum), pos (place in the range of 64 closes, -1 to 1), dev (deviation from
    their mean), vz (robust z of log volume over 40 bars, by upper medians), vr (short over long volatility), eff (net over
    path of 16 returns), accel and curv (differences of m4), body and wick (shares of the range, wick upper less lower)."""
    w = W.order()
    rows = bars.withColumns({"n_": F.row_number().over(w) - 1, "ret_": F.coalesce(F.log(c("close") / F.lag("close").over(w)), F.lit(0.0)), "lv_": F.log(F.greatest("volume", F.lit(1e-9)))})
    rows = rows.withColumns({f"m{k}": F.log(c("close") / F.lag("close", k).over(w)) for k in (4, 16, 32, 64)})
    low, high, sd = F.min("close").over(W.last(64)), F.max("close").over(W.last(64)), F.stddev_samp("close").over(W.last(64))
    rows = rows.withColumns({"pos": _after(F.when(high > low, ((c("close") - low) / (high - low) - 0.5) * 2).otherwise(0.0), 64), "dev": _after(F.when(sd > 0, (c("close") - F.avg("close").over(W.last(64))) / sd).otherwise(0.0), 64), "w_": W.windowed("lv_", 40)})
    rows = rows.withColumn("vm_", F.get(F.array_sort("w_"), F.lit(20)))
    rows = rows.withColumn("vs_", F.get(F.array_sort(F.transform("w_", lambda x: F.abs(x - c("vm_")))), F.lit(20)) * 1.4826)
    short, long = F.stddev_samp("ret_").over(W.last(16)), F.stddev_samp("ret_").over(W.last(64))
    net, path = F.abs(F.sum("ret_").over(W.last(16))), F.sum(F.abs("ret_")).over(W.last(16))
    rows = rows.withColumns({"vz": _after(F.when(c("vs_") > 0, (c("lv_") - c("vm_")) / c("vs_")).otherwise(0.0), 40), "vr": _after(F.when(long > 0, short / long), 64), "eff": _after(F.when(path > 0, net / path).otherwise(0.0), 16), "accel": c("m4") - F.lag("m4", 4).over(w)})
    span = c("high") - c("low")
    upper, lower = c("high") - F.greatest("open", "close"), F.least("open", "close") - c("low")
    rows = rows.withColumns({"curv": c("accel") - F.lag("accel", 4).over(w), "body": F.when(span > 0, (c("close") - c("open")) / span).otherwise(0.0), "wick": F.when(span > 0, (upper - lower) / span).otherwise(0.0)})
    return rows.drop("ret_", "lv_", "w_", "vm_", "vs_")


def derivative_series(rows: DataFrame, flow: Column, interest: Column, funding: Column, ratio: Column, value: Column) -> DataFrame:
    """rows of base_series with ofi, oi, fund, ls and dv: each series' deviation from its mean over the last 121 bars, 0
    without any spread or with five values or less; null for the first 30 bars and where funding or the ratio is unknown."""
    raw = {"ofi": flow, "oi": interest, "fund": funding, "ls": ratio, "dv": value}
    rows = rows.withColumns({f"{n}_": x for n, x in raw.items()})
    known = (c("n_") >= 30) & c("fund_").isNotNull() & c("ls_").isNotNull()
    out = {}
    for n in raw:
        name = f"{n}_"
        mean, sd = F.avg(name).over(W.last(121)), F.stddev_samp(name).over(W.last(121))
        enough = F.lit(True) if n == "ofi" else F.count(name).over(W.last(121)) > 5
        out[n] = F.when(known, F.when(enough & (sd > 0) & c(name).isNotNull(), (c(name) - mean) / sd).otherwise(0.0))
    return rows.withColumns(out).drop(*(f"{n}_" for n in raw))


#: The sixteen formulas, eight of price and eight of price with derivatives.
FORMULAS = {
    "f1": "tanh((2 * m4 + 1.2 * m16 + 0.7 * m32) * (1 + 0.8 * vz) / (vr + 0.25))",
    "f2": "tanh((1 - power(pos, 2)) * (m4 + 0.6 * accel) * (1 + abs(vz))) - 0.35 * pos",
    "f3": "tanh((m16 + 0.7 * m32) * (0.4 + 1.8 * eff) * (1 + 0.5 * vz))",
    "f4": "case when vr is not null then tanh((curv + 0.8 * accel) * (1 + abs(vz)) * sqrt(greatest(vr, 0.05))) end",
    "f5": "tanh(-dev * (1 + 0.7 * abs(vz)) / (0.7 + vr) + 0.25 * m4)",
    "f6": "tanh((m4 * (1 + 1.5 * pos) + m16 * (1 - pos) + 0.5 * m32) * (1 + vz) / (0.5 + vr))",
    "f7": "tanh((m4 + 0.5 * m16) * (1 + 0.8 * vz) + 0.8 * body - 0.4 * wick)",
    "f8": "tanh((m4 + 0.8 * m16 + 0.5 * m32 + 0.25 * m64) * (1 + 0.6 * eff) * (1 + 0.5 * abs(vz)))",
    "a": "tanh(((m4 + 0.7 * m16) * (1 + 0.7 * ofi) * (1 + 0.5 * oi)) / (0.5 + vr))",
    "b": "tanh((oi * ofi - 0.8 * fund * oi) * (1 + abs(vz)))",
    "c": "tanh((ofi * oi) * (1 + abs(fund) + abs(ls)) * (1 + 0.5 * dv))",
    "d": "tanh((m16 + 0.5 * m32) * (0.5 + eff) * (1 + 0.8 * ofi) * (1 + 0.4 * oi))",
    "e": "tanh(-ls * fund * (1 + abs(oi)) + 0.35 * (-dev))",
    "f": "tanh((m4 + 0.5 * m16) + 0.8 * ofi + 0.5 * oi - 0.4 * fund + 0.3 * dv)",
    "g": "tanh((m4 * (1 + ofi)) * (1 + oi * ofi) * (1 + 0.6 * abs(vz)))",
    "h": "tanh((ofi * oi) * (1 + vr) * (1 + abs(fund)) + 0.4 * (dv - vz))",
}


def scored(rows: DataFrame) -> DataFrame:
    """rows of both series with a column for each formula and `ensemble`, the mean of those known."""
    out = evaluated(rows, FORMULAS)
    values = F.array_compact(F.array(*FORMULAS))
    return out.withColumn("ensemble", F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)))
