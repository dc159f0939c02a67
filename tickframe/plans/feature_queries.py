"""Registered queries of more window features; a query's SQL states the same frames."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tickframe.operators import events as E
from tickframe.operators import frames as W
from tickframe.operators import quantiles as Q
from tickframe.operators import recursive as R
from tickframe.plans.queries import BARS, OVER, before, frame, hourly, last, query, rounded
from tickframe.plans.recurrences import N, W14, mean, recursion

RET = f"r AS (SELECT *, ln(close / lag(close) OVER {OVER}) AS ret FROM bars)"

for name, least in (("rolling_strict", 20), ("rolling_tolerant", 10)):
    frame(name, lambda b, least=least: W.rolling(W.returns(b), "ret", 20, least), ["mean", "sd"], f", {RET} SELECT symbol, bar, CASE WHEN count(ret) OVER w >= {least} THEN round(avg(ret) OVER w, 6) END AS mean, CASE WHEN count(ret) OVER w >= {least} THEN round(stddev_pop(ret) OVER w, 6) END AS sd FROM r WINDOW w AS {last(20)}")
frame("relative_volume", W.relative_volume, ["rel"], f"SELECT symbol, bar, round(volume / nullif(avg(volume) OVER {before(100)}, 0), 6) AS rel FROM bars")
frame("robust_z", W.robust_z, ["med", "rz"], f"SELECT symbol, bar, round(med, 6) AS med, CASE WHEN c >= 48 AND d > 0 THEN round((close - med) / (1.4826::DOUBLE * d), 6) END AS rz FROM (SELECT symbol, bar, close, median(close) OVER w AS med, mad(close) OVER w AS d, count(*) OVER w AS c FROM bars WINDOW w AS {last(48)})")
frame("day_quantile", lambda b: Q.trailing_quantile(b, "volume", 5, 0.9), ["volume", "cut"], ", d AS (SELECT DISTINCT symbol, date_trunc('day', bar) AS day FROM bars), c AS (SELECT d.symbol, d.day, quantile_cont(b.volume, 0.9) AS cut FROM d JOIN bars b ON b.symbol = d.symbol AND b.bar >= d.day - INTERVAL 5 days AND b.bar < d.day GROUP BY 1, 2) SELECT b.symbol, b.bar, b.volume, round(c.cut, 6) AS cut FROM bars b LEFT JOIN c ON c.symbol = b.symbol AND c.day = date_trunc('day', b.bar)")
frame(
    "weighted_vwap",
    W.vwap,
    ["day_vwap", "day_sd", "vwap_n"],
    f", t AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), m AS (SELECT *, sum(tp * volume) OVER d / nullif(sum(volume) OVER d, 0) AS mu, sum(tp * tp * volume) OVER d / nullif(sum(volume) OVER d, 0) AS sq, sum(close * volume) OVER w / nullif(sum(volume) OVER w, 0) AS vn, count(*) OVER w AS c FROM t WINDOW d AS (PARTITION BY symbol, date_trunc('day', bar) ORDER BY bar), w AS {last(24)}) SELECT symbol, bar, round(mu, 4) AS day_vwap, round(sqrt(greatest(0, sq - mu * mu)), 4) AS day_sd, CASE WHEN c >= 24 THEN round(vn, 4) END AS vwap_n FROM m",
    to=4,
)
frame("williams_r", W.williams, ["wr"], f"SELECT symbol, bar, CASE WHEN count(*) OVER w >= 14 AND max(high) OVER w > min(low) OVER w THEN round(100 * (close - min(low) OVER w) / (max(high) OVER w - min(low) OVER w) - 100, 6) END AS wr FROM bars WINDOW w AS {last(14)}")
frame("channel_index", W.channel_index, ["cci"], f", t AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), l AS (SELECT symbol, bar, tp, list(tp) OVER w AS v, avg(tp) OVER w AS m FROM t WINDOW w AS {last(20)}) SELECT symbol, bar, CASE WHEN len(v) >= 20 THEN round((tp - m) / greatest(0.015::DOUBLE * list_avg([abs(x - m) FOR x IN v]), 1e-12), 4) END AS cci FROM l", to=4)
frame(
    "ichimoku",
    W.ichimoku,
    ["turn", "base", "cloud_top", "cloud_floor"],
    f", c AS (SELECT symbol, bar, CASE WHEN count(*) OVER a >= 9 THEN (max(high) OVER a + min(low) OVER a) / 2 END AS turn, CASE WHEN count(*) OVER b >= 26 THEN (max(high) OVER b + min(low) OVER b) / 2 END AS base, CASE WHEN count(*) OVER c >= 52 THEN (max(high) OVER c + min(low) OVER c) / 2 END AS long FROM bars WINDOW a AS {last(9)}, b AS {last(26)}, c AS {last(52)}), s AS (SELECT *, lag((turn + base) / 2, 26) OVER {OVER} AS p, lag(long, 26) OVER {OVER} AS q FROM c) SELECT symbol, bar, round(turn, 6) AS turn, round(base, 6) AS base, round(greatest(p, q), 6) AS cloud_top, round(least(p, q), 6) AS cloud_floor FROM s",
)
frame(
    "trend_residual",
    W.trend_residual,
    ["resid_z", "channel"],
    f", i AS (SELECT *, row_number() OVER {OVER}::DOUBLE AS i FROM bars), f AS (SELECT symbol, bar, close, count(*) OVER w AS c, regr_intercept(close, i) OVER w + regr_slope(close, i) OVER w * i AS fit, sqrt(greatest(0, (regr_syy(close, i) OVER w - regr_slope(close, i) OVER w * regr_sxy(close, i) OVER w) / 20)) AS dev FROM i WINDOW w AS {last(20)}) SELECT symbol, bar, CASE WHEN c >= 20 AND dev > 1e-9 THEN round((close - fit) / dev, 3) END AS resid_z, CASE WHEN c >= 20 THEN round(4 * dev / abs(fit), 3) END AS channel FROM f",
    to=3,
)
frame("tail_index", W.tail_index, ["hill"], f", {RET}, l AS (SELECT symbol, bar, list_sort(list(abs(ret)) FILTER (ret IS NOT NULL) OVER w, 'DESC') AS v, count(ret) OVER w AS c FROM r WINDOW w AS {last(100)}) SELECT symbol, bar, CASE WHEN c >= 100 AND v[11] > 0 AND list_avg([ln(x / v[11]) FOR x IN v[1:10]]) > 0 THEN round(1 / list_avg([ln(x / v[11]) FOR x IN v[1:10]]), 6) END AS hill FROM l")
frame("fractal_dimension", W.fractal_dimension, ["katz"], f", s AS (SELECT *, abs(close - lag(close) OVER {OVER}) AS step FROM bars), l AS (SELECT symbol, bar, list(close) OVER w AS v, sum(step) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 46 PRECEDING AND CURRENT ROW) AS path FROM s WINDOW w AS {last(48)}), m AS (SELECT *, list_max([abs(x - v[1]) FOR x IN v]) AS reach FROM l) SELECT symbol, bar, CASE WHEN len(v) >= 48 AND path > 0 AND reach > 0 THEN round(ln(47) / (ln(47) + ln(reach / path)), 6) END AS katz FROM m")
frame(
    "mean_reversion",
    W.reversion,
    ["kappa", "half_life", "ou_z"],
    f", o AS (SELECT *, lag(close) OVER {OVER} AS old FROM bars), f AS (SELECT symbol, bar, close, CASE WHEN count(old) OVER w >= 60 THEN regr_slope(close, old) OVER w END AS b, regr_intercept(close, old) OVER w AS a, stddev_pop(close) OVER w AS sd FROM o WINDOW w AS {last(60)}) SELECT symbol, bar, CASE WHEN b > 0 AND b < 1 THEN round(-ln(b), 3) END AS kappa, CASE WHEN b > 0 AND b < 1 THEN round(ln(2) / -ln(b), 3) END AS half_life, CASE WHEN b > 0 AND b < 1 AND sd > 0 THEN round((close - a / (1 - b)) / sd, 3) END AS ou_z FROM f",
    to=3,
)


#: Weights of the last eleven values for the derivatives of their cubic at its end (numerators and denominator).
MOTION = {
    1: ((-525, 258, 529, 431, 107, -300, -647, -791, -589, 102, 1425), 2574),
    2: ((-120, 42, 108, 103, 52, -20, -88, -127, -112, -18, 180), 858),
    3: ((-30, 6, 22, 23, 14, 0, -14, -23, -22, -6, 30), 858),
}


def weighted(derivative):
    numbers, base = MOTION[derivative]
    return "(" + " + ".join(f"lag(close, {10 - i}) OVER {OVER} * ({w}::DOUBLE)" for i, w in enumerate(numbers)) + f") / {base}"


frame("motion", W.motion, ["velocity", "acceleration", "jerk"], f"SELECT symbol, bar, round({weighted(1)}, 4) AS velocity, round({weighted(2)}, 4) AS acceleration, round({weighted(3)}, 4) AS jerk FROM bars", to=4)
frame("autocorrelation", W.autocorrelation, ["acf"], f", {RET}, o AS (SELECT *, lag(ret) OVER {OVER} AS old FROM r) SELECT symbol, bar, CASE WHEN count(old) OVER w >= 60 THEN round(corr(ret, old) OVER w, 6) END AS acf FROM o WINDOW w AS {last(60)}")
frame("place_in_range", W.place_in_range, ["place"], f"SELECT symbol, bar, CASE WHEN count(*) OVER w >= 48 AND max(high) OVER w > min(low) OVER w THEN round((close - min(low) OVER w) / (max(high) OVER w - min(low) OVER w), 6) END AS place FROM bars WINDOW w AS {last(48)}")
AFTER3 = "(PARTITION BY symbol ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)"
frame("last_pivots", W.last_pivots, ["last_top", "last_floor"], f", p AS (SELECT symbol, bar, CASE WHEN count(*) OVER l = 3 AND count(*) OVER r = 3 AND high > max(high) OVER l AND high > max(high) OVER r THEN high END AS t, CASE WHEN count(*) OVER l = 3 AND count(*) OVER r = 3 AND low < min(low) OVER l AND low < min(low) OVER r THEN low END AS f FROM bars WINDOW l AS {before(3)}, r AS {AFTER3}), k AS (SELECT symbol, bar, lag(t, 3) OVER {OVER} AS t, lag(f, 3) OVER {OVER} AS f FROM p) SELECT symbol, bar, round(last_value(t IGNORE NULLS) OVER {OVER}, 6) AS last_top, round(last_value(f IGNORE NULLS) OVER {OVER}, 6) AS last_floor FROM k")
frame("session_range", W.session_range, ["range_high", "range_low"], "SELECT symbol, bar, CASE WHEN hour(bar) >= 7 THEN round(max(high) FILTER (hour(bar) < 7) OVER d, 6) END AS range_high, CASE WHEN hour(bar) >= 7 THEN round(min(low) FILTER (hour(bar) < 7) OVER d, 6) END AS range_low FROM bars WINDOW d AS (PARTITION BY symbol, date_trunc('day', bar))")
frame("crossings", lambda b: W.crossings(b, F.avg("close").over(W.last(10)), F.avg("close").over(W.last(40))), ["cross"], f", a AS (SELECT symbol, bar, avg(close) OVER {last(10)} AS a, avg(close) OVER {last(40)} AS b FROM bars), o AS (SELECT *, lag(a) OVER {OVER} AS oa, lag(b) OVER {OVER} AS ob FROM a) SELECT symbol, bar, CASE WHEN a > b AND oa <= ob THEN 1 ELSE -1 END AS cross FROM o WHERE (a > b AND oa <= ob) OR (a < b AND oa >= ob)")
SCALES = (2, 4, 8, 16)
frame(
    "momentum_field",
    W.momentum_field,
    ["field", "coherence"],
    ", r AS (SELECT symbol, bar, " + ", ".join(f"ln(close / lag(close, {k}) OVER {OVER}) AS r{k}" for k in SCALES) + " FROM bars), s AS (SELECT *, " + ", ".join(f"CASE WHEN count(r{k}) OVER w >= 48 AND stddev_pop(r{k}) OVER w > 0 THEN tanh(r{k} / stddev_pop(r{k}) OVER w) END AS p{k}" for k in SCALES) + f" FROM r WINDOW w AS {last(48)}) SELECT symbol, bar, round((p2 + p4 + p8 + p16) / 4, 6) AS field, abs(sign(p2) + sign(p4) + sign(p8) + sign(p16)) / 4.0::DOUBLE AS coherence FROM s",
)
frame("realised_volatility", W.realised, ["vol"], f", {RET} SELECT symbol, bar, CASE WHEN count(ret) OVER w >= 24 THEN round(stddev_samp(ret) OVER w, 6) END AS vol FROM r WINDOW w AS {last(24)}")


def wma(column, m):
    return "(" + " + ".join(f"lag({column}, {k}) OVER {OVER} * {m - k}" for k in range(m)) + f") / {m * (m + 1) // 2}"


frame("weighted_means", W.weighted_means, ["wma", "hma"], f", w AS (SELECT symbol, bar, {wma('close', 10)} AS wma, 2 * {wma('close', 5)} - {wma('close', 10)} AS d FROM bars) SELECT symbol, bar, round(wma, 6) AS wma, round({wma('d', 3)}, 6) AS hma FROM w")
POWER = ", ".join("pow(" + " + ".join(f"(v[{t + 1}] - m) * {math.cos(2 * math.pi * k * t / 32)!r}::DOUBLE" for t in range(32)) + ", 2) + pow(" + " + ".join(f"(v[{t + 1}] - m) * {math.sin(2 * math.pi * k * t / 32)!r}::DOUBLE" for t in range(32)) + ", 2)" for k in range(1, 17))
frame("spectral_entropy", W.spectral, ["spectral_entropy", "period"], f", {RET}, l AS (SELECT symbol, bar, list(ret) FILTER (ret IS NOT NULL) OVER w AS v, avg(ret) OVER w AS m FROM r WINDOW w AS {last(32)}), p AS (SELECT symbol, bar, [{POWER}] AS p FROM l WHERE len(v) = 32) SELECT symbol, bar, round(-list_sum([CASE WHEN x > 0 THEN x / list_sum(p) * ln(x / list_sum(p)) ELSE 0 END FOR x IN p]) / ln(16), 4) AS spectral_entropy, round(32.0::DOUBLE / list_position(p, list_max(p)), 4) AS period FROM p WHERE list_sum(p) > 0", to=4)


@query("breadth_entropy", f"WITH {BARS}, {RET}, b AS (SELECT bar, count(*) AS n, avg((ret > 0)::INT) AS u, avg((ret < 0)::INT) AS d FROM r WHERE ret IS NOT NULL GROUP BY 1), e AS (SELECT *, 1 - u - d AS f FROM b) SELECT bar, n, round(-(CASE WHEN u > 0 THEN u * ln(u) ELSE 0 END + CASE WHEN d > 0 THEN d * ln(d) ELSE 0 END + CASE WHEN f > 1e-12 THEN f * ln(f) ELSE 0 END) / ln(3), 6) AS entropy, round(u - lag(u, 16) OVER (ORDER BY bar), 6) AS shift FROM e")
def breadth_entropy(spark, sf_dir):
    """Entropy of the shares of rises, falls and flats of each bar, and the share of rises against 16 bars ago."""
    return rounded(E.breadth_entropy(hourly(spark, sf_dir)), "bar", "n", "entropy", "shift")


PAIRS = f"{RET}, p AS (SELECT a.symbol AS a, b.symbol AS b, a.bar, a.ret AS x, b.ret AS y FROM r a JOIN r b ON a.bar = b.bar AND a.symbol < b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL)"


@query("pair_correlation", f"WITH {BARS}, {PAIRS} SELECT a, b, bar, CASE WHEN count(*) OVER w >= 64 THEN round(corr(x, y) OVER w, 6) END AS rho FROM p WINDOW w AS (PARTITION BY a, b ORDER BY bar ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)")
def pair_correlation(spark, sf_dir):
    """Rolling correlation of the returns of each pair of symbols: rows of a bar meet by equality on the bar."""
    return rounded(E.pairs(hourly(spark, sf_dir), 64), "a", "b", "bar", "rho")


@query("pair_beta_daily", f"WITH {BARS}, {PAIRS}, d AS (SELECT a, b, date_trunc('day', bar) AS day, regr_count(x, y) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy, sum(y * y) AS syy FROM p GROUP BY 1, 2, 3), s AS (SELECT a, b, day, sum(n) OVER w AS n, sum(sx) OVER w AS sx, sum(sy) OVER w AS sy, sum(sxy) OVER w AS sxy, sum(syy) OVER w AS syy, count(*) OVER w AS days FROM d WINDOW w AS (PARTITION BY a, b ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) SELECT a, b, strftime(day, '%Y-%m-%d') AS day, round((sxy - sx * sy / n) / (syy - sy * sy / n), 6) AS beta FROM s WHERE days = 10 AND syy - sy * sy / n > 1e-12")
def pair_beta_daily(spark, sf_dir):
    """Slope of each pair's hourly returns over ten days: sums of each day, added over the days."""
    return rounded(E.daily_beta(hourly(spark, sf_dir), 10), "a", "b", "day", "beta")


KELTNER = {"e": ("close", mean("n.close", "(2.0::DOUBLE / 21)", "e")), "a": ("tr", mean("n.tr", W14, "a"))}


@query("keltner", f"WITH RECURSIVE {BARS}, {recursion(N, KELTNER)} SELECT symbol, bar, round(e + 2 * a, 6) AS upper, round(e - 2 * a, 6) AS lower FROM rec")
def keltner(spark, sf_dir):
    rows = R.atr_kinds(R.ema(hourly(spark, sf_dir), 20))
    return rows.select("symbol", "bar", F.round(F.col("ema20") + 2 * F.col("rma"), 6).alias("upper"), F.round(F.col("ema20") - 2 * F.col("rma"), 6).alias("lower"))


GRID = {
    "roc": lambda n: F.col("close") / F.lag("close", n).over(W.order()) - 1,
    "donchian": lambda n: W.full((F.col("close") - F.min("low").over(W.last(n))) / F.nullif(F.max("high").over(W.last(n)) - F.min("low").over(W.last(n)), F.lit(0.0)), n, W.last(n)),
    "bollinger": lambda n: W.full((F.col("close") - F.avg("close").over(W.last(n))) / F.nullif(F.stddev_pop("close").over(W.last(n)), F.lit(0.0)), n, W.last(n)),
    "push": lambda n: F.col("volume") / F.nullif(F.avg("volume").over(W.before(n)), F.lit(0.0)),
}
GRID_SQL = {
    "roc": lambda n: f"close / lag(close, {n}) OVER {OVER} - 1",
    "donchian": lambda n: f"CASE WHEN count(*) OVER {last(n)} >= {n} THEN (close - min(low) OVER {last(n)}) / nullif(max(high) OVER {last(n)} - min(low) OVER {last(n)}, 0) END",
    "bollinger": lambda n: f"CASE WHEN count(*) OVER {last(n)} >= {n} THEN (close - avg(close) OVER {last(n)}) / nullif(stddev_pop(close) OVER {last(n)}, 0) END",
    "push": lambda n: f"volume / nullif(avg(volume) OVER {before(n)}, 0)",
}
SIZES = (5, 20, 60)


@query("indicator_grid", f"WITH {BARS}, g AS (" + " UNION ALL ".join(f"SELECT symbol, bar, '{k}' AS kind, {n} AS n, {f(n)} AS v FROM bars" for k, f in GRID_SQL.items() for n in SIZES) + ") SELECT symbol, kind, n, count(v) AS known, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd FROM g GROUP BY 1, 2, 3")
def indicator_grid(spark, sf_dir):
    """A grid of indicators by their lengths, in one pass over the bars: columns first, then rows."""
    names = [(k, n) for k in GRID for n in SIZES]
    wide = hourly(spark, sf_dir).select("symbol", *(GRID[k](n).alias(f"{k}_{n}") for k, n in names))
    sums = wide.groupBy("symbol").agg(*(a for k, n in names for a in (F.count(f"{k}_{n}").alias(f"c_{k}_{n}"), F.avg(f"{k}_{n}").alias(f"m_{k}_{n}"), F.stddev_samp(f"{k}_{n}").alias(f"s_{k}_{n}"))))
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(n).alias("n"), F.col(f"c_{k}_{n}").alias("known"), F.round(f"m_{k}_{n}", 4).alias("mean"), F.round(f"s_{k}_{n}", 4).alias("sd")) for k, n in names))
    return sums.select("symbol", F.explode(rows).alias("x")).select("symbol", "x.*")
