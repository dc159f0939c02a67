"""Registered queries of the formula library; the SQL states series and formulas in its own terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickframe.operators import frames as W
from tickframe.operators import pressure as P
from tickframe.plans.queries import BARS, OVER, hourly, last, query, rounded


def momentum(k: int) -> str:
    return f"ln(close) - ln(lag(close, {k}) OVER {OVER}) AS m{k}"


def z(x: str, least: str = "count({x}) OVER {w} > 5") -> str:
    w = last(121)
    return f"CASE WHEN i >= 30 AND lsr IS NOT NULL AND fnd IS NOT NULL THEN CASE WHEN {least.format(x=x, w=w)} AND stddev_samp({x}) OVER {w} > 0 THEN coalesce(({x} - avg({x}) OVER {w}) / stddev_samp({x}) OVER {w}, 0) ELSE 0 END END"


SERIES = f"""s0 AS (SELECT *, row_number() OVER {OVER} - 1 AS i, coalesce(ln(close / lag(close) OVER {OVER}), 0) AS rt, ln(greatest(volume, 1e-9)) AS lv, {momentum(4)}, {momentum(16)}, {momentum(32)}, {momentum(64)}, (2 * buy - volume) / greatest(1, volume) AS fl, sum(volume) OVER {last(24)} AS oin, close / open - 1 AS fnd, buy / nullif(volume - buy, 0) AS lsr FROM bars),
 s1 AS (SELECT *, list(lv) OVER {last(40)} AS lw, m4 - lag(m4, 4) OVER {OVER} AS accel, CASE WHEN i >= 64 THEN CASE WHEN max(close) OVER v > min(close) OVER v THEN 2 * (close - min(close) OVER v) / (max(close) OVER v - min(close) OVER v) - 1 ELSE 0 END END AS pos, CASE WHEN i >= 64 THEN CASE WHEN stddev_samp(close) OVER v > 0 THEN (close - avg(close) OVER v) / stddev_samp(close) OVER v ELSE 0 END END AS dev, CASE WHEN i >= 64 AND stddev_samp(rt) OVER v > 0 THEN stddev_samp(rt) OVER u / stddev_samp(rt) OVER v END AS vr, CASE WHEN i >= 16 THEN CASE WHEN sum(abs(rt)) OVER u > 0 THEN abs(sum(rt) OVER u) / sum(abs(rt)) OVER u ELSE 0 END END AS eff, CASE WHEN high > low THEN (close - open) / (high - low) ELSE 0 END AS body, CASE WHEN high > low THEN (high + low - greatest(open, close) - least(open, close)) / (high - low) ELSE 0 END AS wick,
  {z('fl', 'TRUE')} AS ofi, {z('oin')} AS oi, {z('fnd')} AS fund, {z('lsr')} AS ls, {z('volume')} AS dv FROM s0 WINDOW u AS {last(16)}, v AS {last(64)}),
 s2 AS (SELECT *, accel - lag(accel, 4) OVER {OVER} AS curv, list_sort(lw)[21] AS vm FROM s1), s3 AS (SELECT *, 1.4826::DOUBLE * list_sort([abs(x - vm) FOR x IN lw])[21] AS vs FROM s2),
 s AS (SELECT *, CASE WHEN i >= 40 THEN CASE WHEN vs > 0 THEN (lv - vm) / vs ELSE 0 END END AS vz FROM s3)"""
#: The formulas again, with their terms set out in another way.
OWN = {
    "f1": "tanh((m4 + 0.6 * m16 + 0.35 * m32) * (2 + 1.6 * vz) / (vr + 0.25))",
    "f2": "tanh((1 - pos) * (1 + pos) * (m4 + accel * 3 / 5) + abs(vz) * (1 - pos) * (1 + pos) * (m4 + accel * 3 / 5)) - pos * 7 / 20",
    "f3": "tanh((m16 * 10 + m32 * 7) * (2 + 9 * eff) * (2 + vz) / 100)",
    "f4": "tanh((curv + accel * 4 / 5) * (1 + abs(vz)) * CASE WHEN vr > 0.05 THEN sqrt(vr) WHEN vr IS NOT NULL THEN sqrt(0.05) END)",
    "f5": "tanh(m4 / 4 - dev * (10 + 7 * abs(vz)) / (7 + 10 * vr))",
    "f6": "tanh((m4 + m16 + m32 / 2 + pos * (m4 * 3 / 2 - m16)) * (1 + vz) * 2 / (1 + 2 * vr))",
    "f7": "tanh((2 * m4 + m16) * (5 + 4 * vz) / 10 + (2 * body - wick) * 2 / 5)",
    "f8": "tanh((20 * m4 + 16 * m16 + 10 * m32 + 5 * m64) * (5 + 3 * eff) * (2 + abs(vz)) / 200)",
    "a": "tanh((10 * m4 + 7 * m16) * (10 + 7 * ofi) * (2 + oi) / (100 + 200 * vr))",
    "b": "tanh(oi * (ofi - fund * 4 / 5) * (1 + abs(vz)))",
    "c": "tanh(ofi * oi * (2 + dv) / 2 * (1 + abs(fund) + abs(ls)))",
    "d": "tanh((2 * m16 + m32) * (1 + 2 * eff) * (5 + 4 * ofi) * (5 + 2 * oi) / 100)",
    "e": "tanh(dev * -7 / 20 - ls * fund - ls * fund * abs(oi))",
    "f": "tanh((10 * m4 + 5 * m16 + 8 * ofi + 5 * oi - 4 * fund + 3 * dv) / 10)",
    "g": "tanh(m4 * (1 + ofi) * (1 + oi * ofi) * (5 + 3 * abs(vz)) / 5)",
    "h": "tanh(ofi * oi * (1 + vr) * (1 + abs(fund)) + (dv - vz) * 2 / 5)",
}


@query("formula_scores", f"WITH {BARS}, {SERIES}, f AS (SELECT symbol, bar, {', '.join(f'{x} AS {k}' for k, x in OWN.items())} FROM s), l AS (SELECT *, [x FOR x IN [{', '.join(OWN)}] IF x IS NOT NULL] AS v FROM f) SELECT symbol, bar, {', '.join(f'round({k}, 4) AS {k}' for k in OWN)}, CASE WHEN len(v) > 0 THEN round(list_sum(v) / len(v), 4) END AS ensemble FROM l")
def formula_scores(spark, sf_dir):
    """Eight formulas of price and eight with derivatives (a day's volume for open interest, bought over sold for the ratio), and their mean."""
    b, v = F.col("buy"), F.col("volume")
    rows = P.base_series(hourly(spark, sf_dir)).withColumn("day", F.sum("volume").over(W.last(24)))
    rows = P.derivative_series(rows, (2 * b - v) / F.greatest(F.lit(1.0), v), F.col("day"), F.col("close") / F.col("open") - 1, b / F.nullif(v - b, F.lit(0.0)), v)
    return rounded(P.scored(rows), "symbol", "bar", *P.FORMULAS, "ensemble", to=4)


@query("base_thirteen", f"WITH {BARS}, {SERIES} SELECT symbol, bar, {', '.join(f'round({k}, 4) AS {k}' for k in ('m4', 'm16', 'm32', 'm64', 'pos', 'dev', 'vz', 'vr', 'eff', 'accel', 'curv', 'body', 'wick'))} FROM s")
def base_thirteen(spark, sf_dir):
    """The thirteen base series of price and volume."""
    return rounded(P.base_series(hourly(spark, sf_dir)), "symbol", "bar", "m4", "m16", "m32", "m64", "pos", "dev", "vz", "vr", "eff", "accel", "curv", "body", "wick", to=4)
