"""Registered queries of the strategies; their SQL states indicators and rules by hand, with a recursive table for all that carries a state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickframe.operators import strategies as S
from tickframe.plans.queries import BARS, ORACLE_SQL, OVER, QUERIES, hourly, last, query
from tickframe.plans.recurrences import LINE, N, mean, recursion

W14, W2 = "(1.0::DOUBLE / 14)", "0.5::DOUBLE"
GAIN, LOSS = "greatest(n.close - n.pc, 0)", "greatest(n.pc - n.close, 0)"
UP, DOWN = "(n.high - r.hh)", "(r.ll - n.low)"
STATES = {f"e{k}": ("close", mean("n.close", f"(2.0::DOUBLE / {k + 1})", f"e{k}")) for k in (9, 20, 21, 50, 200, 12, 26)}
STATES |= {
    "sig": ("0", mean("q_e12 - q_e26", "0.2::DOUBLE", "sig")),
    "g14": ("0", mean(GAIN, W14, "g14")),
    "l14": ("0", mean(LOSS, W14, "l14")),
    "g2": ("0", mean(GAIN, W2, "g2")),
    "l2": ("0", mean(LOSS, W2, "l2")),
    "hh": ("high", "n.high"),
    "ll": ("low", "n.low"),
    "p": ("0", mean(f"CASE WHEN {UP} > {DOWN} AND {UP} > 0 THEN {UP} ELSE 0 END", W14, "p")),
    "m": ("0", mean(f"CASE WHEN {DOWN} > {UP} AND {DOWN} > 0 THEN {DOWN} ELSE 0 END", W14, "m")),
    "t": ("tr", mean("n.tr", W14, "t")),
    "pdi": ("0", "100 * q_p / greatest(q_t, 1e-12)"),
    "mdi": ("0", "100 * q_m / greatest(q_t, 1e-12)"),
    "adx": ("0", mean("100 * abs(q_pdi - q_mdi) / greatest(q_pdi + q_mdi, 1e-12)", W14, "adx")),
    "a10": ("tr", mean("n.tr", "0.1::DOUBLE", "a10")),
    "bt": ("(high + low) / 2 + 3 * tr", "CASE WHEN (n.high + n.low) / 2 + 3 * q_a10 < r.bt OR n.pc > r.bt THEN (n.high + n.low) / 2 + 3 * q_a10 ELSE r.bt END"),
    "bf": ("(high + low) / 2 - 3 * tr", "CASE WHEN (n.high + n.low) / 2 - 3 * q_a10 > r.bf OR n.pc < r.bf THEN (n.high + n.low) / 2 - 3 * q_a10 ELSE r.bf END"),
    "k_trend": ("1", "CASE WHEN n.close > r.bt THEN 1 WHEN n.close < r.bf THEN -1 ELSE r.k_trend END"),
    "h1": ("high", "n.high"),
    "h2": ("high", "r.h1"),
    "l1": ("low", "n.low"),
    "lo2": ("low", "r.l1"),
    "line": ("low", f"CASE WHEN r.k_side > 0 THEN least({LINE}, r.l1, r.lo2) ELSE greatest({LINE}, r.h1, r.h2) END"),
    "flip": ("0", "CASE WHEN (r.k_side > 0 AND n.low < q_line) OR (r.k_side < 0 AND n.high > q_line) THEN 1 ELSE 0 END"),
    "sar": ("low", "CASE WHEN q_flip = 1 THEN r.best ELSE q_line END"),
    "ahead": ("0", "CASE WHEN r.k_side > 0 THEN n.high > r.best ELSE n.low < r.best END::INT"),
    "best": ("high", "CASE WHEN q_flip = 1 THEN CASE WHEN r.k_side > 0 THEN n.low ELSE n.high END WHEN q_ahead = 1 THEN CASE WHEN r.k_side > 0 THEN n.high ELSE n.low END ELSE r.best END"),
    "pace": ("0.02", "CASE WHEN q_flip = 1 THEN 0.02 WHEN q_ahead = 1 THEN least(r.pace + 0.02::DOUBLE, 0.2) ELSE r.pace END"),
    "k_side": ("1", "CASE WHEN q_flip = 1 THEN -r.k_side ELSE r.k_side END"),
    "ho": ("(open + close) / 2", "(r.ho + r.hc) / 2"),
    "hc": ("(open + high + low + close) / 4", "(n.open + n.high + n.low + n.close) / 4"),
}
NAMED = "e9, e20, e21, e50, e200, e12 - e26 AS macd, sig, g14, l14, g2, l2, pdi, mdi, adx, t AS atr, k_trend, k_side, ho, hc"


def top(n: int) -> str:
    return f"CASE WHEN count(*) OVER {last(n)} = {n} THEN max(high) OVER {last(n)} END AS top{n}, CASE WHEN count(*) OVER {last(n)} = {n} THEN min(low) OVER {last(n)} END AS low{n}"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER {OVER}"


def session(name: str, a: int, b: int) -> str:
    day = "(PARTITION BY symbol, date_trunc('day', bar))"
    return f"CASE WHEN hour(bar) >= {b} THEN max(CASE WHEN hour(bar) >= {a} AND hour(bar) < {b} THEN high END) OVER {day} END AS {name}_top, CASE WHEN hour(bar) >= {b} THEN min(CASE WHEN hour(bar) >= {a} AND hour(bar) < {b} THEN low END) OVER {day} END AS {name}_floor"


DAY = "(PARTITION BY symbol, date_trunc('day', bar) ORDER BY bar)"
INDICATED = f"""WITH RECURSIVE {BARS}, {recursion(N, STATES)},
 x0 AS (SELECT n.*, {NAMED} FROM n JOIN rec USING (symbol, bar)),
 x1 AS (SELECT *, (high + low + close) / 3 AS tp, greatest(high - low, 1e-12) AS size, abs(close - open) AS body, macd - sig AS hist, hour(bar) AS hr, CASE WHEN count(*) OVER {last(20)} = 20 THEN avg(close) OVER {last(20)} END AS mid, CASE WHEN count(*) OVER {last(20)} = 20 THEN stddev_pop(close) OVER {last(20)} END AS sd, CASE WHEN count(*) OVER {last(50)} = 50 THEN (close - avg(close) OVER {last(50)}) / greatest(stddev_pop(close) OVER {last(50)}, 1e-12) END AS z50, 100 - 100 / (1 + g14 / greatest(l14, 1e-12)) AS rsi14, 100 - 100 / (1 + g2 / greatest(l2, 1e-12)) AS rsi2, CASE WHEN count(*) OVER {last(20)} = 20 THEN avg(volume) OVER {last(20)} END AS usual, {', '.join(top(k) for k in (3, 9, 14, 20, 26, 52, 55))}, {session('asia', 0, 7)}, {session('op', 13, 14)}, sum(sign(coalesce(close - pc, 0)) * volume) OVER {OVER} AS obv FROM x0),
 x2 AS (SELECT *, mid + 2 * sd AS bu, mid - 2 * sd AS bl, 4 * sd / greatest(mid, 1e-12) AS width, (top9 + low9) / 2 AS turn, (top26 + low26) / 2 AS base, (top52 + low52) / 2 AS wide, coalesce(100 * (close - low14) / greatest(top14 - low14, 1e-12), 50) AS raw, sum(tp * volume) OVER {DAY} / greatest(sum(volume) OVER {DAY}, 1e-12) AS vwap, sum(tp * tp * volume) OVER {DAY} / greatest(sum(volume) OVER {DAY}, 1e-12) AS sq, CASE WHEN tp > {lag('tp')} THEN tp * volume ELSE 0 END AS inn, CASE WHEN tp < {lag('tp')} THEN tp * volume ELSE 0 END AS outt, list(tp) OVER {last(20)} AS tps, avg(tp) OVER {last(20)} AS tpm FROM x1),
 x3 AS (SELECT *, CASE WHEN count(*) OVER {last(3)} = 3 THEN avg(raw) OVER {last(3)} END AS k, CASE WHEN top14 IS NOT NULL THEN raw - 100 END AS wr, sqrt(greatest(sq - vwap * vwap, 0)) AS vsd, CASE WHEN count(*) OVER {last(14)} = 14 THEN 100 - 100 / (1 + sum(inn) OVER {last(14)} / greatest(sum(outt) OVER {last(14)}, 1e-12)) END AS mfi, CASE WHEN len(tps) = 20 THEN (tp - tpm) / greatest(0.015::DOUBLE * list_avg([abs(v - tpm) FOR v IN tps]), 1e-12) END AS cci, {lag('(turn + base) / 2', 26)} AS ca, {lag('wide', 26)} AS cb, coalesce(width <= CASE WHEN count(width) OVER {last(120)} = 120 THEN min(width) OVER {last(120)} END * 1.1::DOUBLE, FALSE) AS tight, coalesce(size <= CASE WHEN count(*) OVER {last(7)} = 7 THEN min(size) OVER {last(7)} END, FALSE) AS narrow FROM x2),
 i AS (SELECT *, CASE WHEN count(k) OVER {last(3)} = 3 THEN avg(k) OVER {last(3)} END AS d FROM x3)"""


def crossed(a: str, b: str, up: bool = True) -> str:
    return f"({a} > {b} AND {lag(a)} <= {lag(b)})" if up else f"({a} < {b} AND {lag(a)} >= {lag(b)})"


def level(a: str, x: float, up: bool) -> str:
    return f"({a} > {x} AND {lag(a)} <= {x})" if up else f"({a} < {x} AND {lag(a)} >= {x})"


def rules(source: str, pairs: dict[str, tuple[str, str]], table: str = "i") -> str:
    return f"{source} SELECT symbol, bar, " + ", ".join(f"CASE WHEN {a} THEN 1 WHEN {b} THEN -1 ELSE 0 END AS {k}" for k, (a, b) in pairs.items()) + f" FROM {table}"


HI, LO = "close > e200", "close < e200"
TREND = {
    "t01": (crossed("e9", "e21"), crossed("e9", "e21", False)),
    "t02": (f"{crossed('e20', 'e50')} AND {HI}", f"{crossed('e20', 'e50', False)} AND {LO}"),
    "t03": (f"{crossed('macd', 'sig')} AND macd > 0", f"{crossed('macd', 'sig', False)} AND macd < 0"),
    "t04": (f"{crossed('macd', 'sig')} AND {HI}", f"{crossed('macd', 'sig', False)} AND {LO}"),
    "t05": (f"k_trend = 1 AND {lag('k_trend')} = -1", f"k_trend = -1 AND {lag('k_trend')} = 1"),
    "t06": (f"k_trend = 1 AND {lag('k_trend')} = -1 AND {HI}", f"k_trend = -1 AND {lag('k_trend')} = 1 AND {LO}"),
    "t07": (f"k_side = 1 AND {lag('k_side')} = -1 AND {HI}", f"k_side = -1 AND {lag('k_side')} = 1 AND {LO}"),
    "t08": (f"{crossed('pdi', 'mdi')} AND adx > 25", f"{crossed('pdi', 'mdi', False)} AND adx > 25"),
    "t09": (f"{crossed('turn', 'base')} AND close > greatest(ca, cb)", f"{crossed('turn', 'base', False)} AND close < least(ca, cb)"),
    "t10": (f"hc > ho AND NOT {lag('(hc > ho)')} AND close > e50", f"NOT hc > ho AND {lag('(hc > ho)')} AND close < e50"),
    "t11": ("e20 > e50 AND e50 > e200 AND low <= e20 AND close > e20 AND close > open", "e20 < e50 AND e50 < e200 AND high >= e20 AND close < e20 AND close < open"),
}
INSIDE = f"{lag('high')} < {lag('high', 2)} AND {lag('low')} > {lag('low', 2)}"
BREAKOUT = {
    "b01": (f"close > {lag('top20')}", f"close < {lag('low20')}"),
    "b02": (f"close > {lag('top55')}", f"close < {lag('low55')}"),
    "b03": (f"{lag('tight')} AND close > bu", f"{lag('tight')} AND close < bl"),
    "b04": (crossed("close", "(e20 + 2 * atr)").replace("lag((e20 + 2 * atr), 1)", "lag(e20 + 2 * atr, 1)"), crossed("close", "(e20 - 2 * atr)", False)),
    "b05": (f"{INSIDE} AND close > {lag('high')}", f"{INSIDE} AND close < {lag('low')}"),
    "b06": (f"{lag('narrow')} AND close > {lag('high')}", f"{lag('narrow')} AND close < {lag('low')}"),
    "b07": (f"hr >= 7 AND hr < 11 AND {crossed('close', 'asia_top')}", f"hr >= 7 AND hr < 11 AND {crossed('close', 'asia_floor', False)}"),
    "b08": (f"hr >= 14 AND hr < 18 AND {crossed('close', 'op_top')}", f"hr >= 14 AND hr < 18 AND {crossed('close', 'op_floor', False)}"),
}
REVERSION = {
    "m01": (f"rsi2 < 10 AND {HI}", f"rsi2 > 90 AND {LO}"),
    "m02": (level("rsi14", 30, True), level("rsi14", 70, False)),
    "m03": (f"{lag('close')} < {lag('bl')} AND close > bl", f"{lag('close')} > {lag('bu')} AND close < bu"),
    "m04": (f"{crossed('k', 'd')} AND k < 20 AND {HI}", f"{crossed('k', 'd', False)} AND k > 80 AND {LO}"),
    "m05": ("close < vwap - 2 * vsd AND close > open", "close > vwap + 2 * vsd AND close < open"),
    "m06": (level("z50", -2, True), level("z50", 2, False)),
    "m07": (level("wr", -80, True), level("wr", -20, False)),
    "m08": (level("cci", -100, True), level("cci", 100, False)),
    "m09": (level("mfi", 20, True), level("mfi", 80, False)),
}
NEIGHBOURS = "(PARTITION BY symbol ORDER BY bar ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)", "(PARTITION BY symbol ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)"
SHAPED = f"""{INDICATED}, fr AS (SELECT *, CASE WHEN count(*) OVER a = 2 AND count(*) OVER b = 2 AND high > max(high) OVER a AND high > max(high) OVER b THEN high END AS fh, CASE WHEN count(*) OVER a = 2 AND count(*) OVER b = 2 AND low < min(low) OVER a AND low < min(low) OVER b THEN low END AS fl FROM i WINDOW a AS {NEIGHBOURS[0]}, b AS {NEIGHBOURS[1]}),
 ff AS (SELECT *, {lag('fh', 2)} AS fh2, {lag('fl', 2)} AS fl2 FROM fr), fg AS (SELECT *, last_value(fh2 IGNORE NULLS) OVER {OVER} AS ftop, last_value(fl2 IGNORE NULLS) OVER {OVER} AS fflr FROM ff),
 mi AS MATERIALIZED (SELECT symbol, s.way, bar, fg.i, CASE WHEN s.way > 0 THEN low ELSE -high END AS l, CASE WHEN s.way > 0 THEN high ELSE -low END AS h, s.way * close AS x, atr FROM fg, (VALUES (1), (-1)) s(way)),
 sw AS (SELECT *, count(*) OVER a = 3 AND count(*) OVER b = 3 AND l < min(l) OVER a AND l < min(l) OVER b AS ok FROM mi WINDOW a AS (PARTITION BY symbol, way ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY symbol, way ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
 pr AS (SELECT *, lag(i) OVER w AS i0, lag(l) OVER w AS l0 FROM sw WHERE ok WINDOW w AS (PARTITION BY symbol, way ORDER BY i)),
 pq AS (SELECT p.symbol, p.way, p.i, least(p.l, p.l0) AS least_, max(m.h) AS line FROM pr p JOIN mi m ON m.symbol = p.symbol AND m.way = p.way AND m.i BETWEEN p.i0 AND p.i WHERE p.i - p.i0 BETWEEN 10 AND 60 AND abs(p.l - p.l0) <= 0.3::DOUBLE * p.atr GROUP BY 1, 2, 3, 4),
 ev AS (SELECT q.symbol, q.way, q.i AS at, m.bar, m.i, m.x > q.line AS hit, row_number() OVER (PARTITION BY q.symbol, q.way, q.i ORDER BY m.i) AS nth FROM pq q JOIN mi m ON m.symbol = q.symbol AND m.way = q.way AND m.i BETWEEN q.i + 3 AND q.i + 29 WHERE m.x > q.line OR m.l < q.least_),
 nk AS (SELECT symbol, bar, max(way) AS neck FROM ev WHERE nth = 1 AND hit GROUP BY 1, 2), a AS (SELECT fg.*, neck FROM fg LEFT JOIN nk USING (symbol, bar))"""
SMALL = "body / size <= 0.3"
ACTION = {
    "p01": (f"(least(open, close) - low) / size >= 0.6 AND {SMALL} AND low <= low20", f"(high - greatest(open, close)) / size >= 0.6 AND {SMALL} AND high >= top20"),
    "p02": (f"{lag('close')} < {lag('open')} AND close > open AND close >= {lag('open')} AND open <= {lag('close')} AND low3 <= low20", f"{lag('close')} > {lag('open')} AND close < open AND close <= {lag('open')} AND open >= {lag('close')} AND top3 >= top20"),
    "p03": (f"close > open AND {lag('close')} > {lag('open')} AND {lag('close', 2)} > {lag('open', 2)} AND close > {lag('close')} AND {lag('close')} > {lag('close', 2)}", f"close < open AND {lag('close')} < {lag('open')} AND {lag('close', 2)} < {lag('open', 2)} AND close < {lag('close')} AND {lag('close')} < {lag('close', 2)}"),
    "p04": (f"{lag('close', 2)} < {lag('open', 2)} AND {lag('body')} <= 0.3::DOUBLE * {lag('size')} AND close > open AND close > ({lag('open', 2)} + {lag('close', 2)}) / 2", f"{lag('close', 2)} > {lag('open', 2)} AND {lag('body')} <= 0.3::DOUBLE * {lag('size')} AND close < open AND close < ({lag('open', 2)} + {lag('close', 2)}) / 2"),
    "p05": (f"low < {lag('low20')} AND close > {lag('low20')}", f"high > {lag('top20')} AND close < {lag('top20')}"),
    "p06": (f"{crossed('close', 'ftop')} AND close > e50", f"{crossed('close', 'fflr', False)} AND close < e50"),
    "p07": ("neck = 1", "neck = -1"),
}


def extreme(x: str, name: str) -> str:
    return f"CASE WHEN count(*) OVER {last(20)} = 20 THEN max({x}) OVER {last(20)} END AS {name}_top, CASE WHEN count(*) OVER {last(20)} = 20 THEN min({x}) OVER {last(20)} END AS {name}_low"


FLOWING = f"{INDICATED}, f AS (SELECT *, {extreme('obv', 'ob')}, {extreme('rsi14', 'rs')}, {extreme('hist', 'hi')}, coalesce(last_value(CASE WHEN hr = 0 THEN open END IGNORE NULLS) OVER {OVER}, first_value(close) OVER {OVER}) AS day_open FROM i)"
FLOW = {
    "v01": (f"volume >= 2 * {lag('usual')} AND close > open AND (close - low) / size >= 0.75", f"volume >= 2 * {lag('usual')} AND close < open AND (high - close) / size >= 0.75"),
    "v02": (f"obv >= ob_top AND close < {lag('top20')} AND close > e50", f"obv <= ob_low AND close > {lag('low20')} AND close < e50"),
    "v03": (f"{crossed('close', 'vwap')} AND {HI}", f"{crossed('close', 'vwap', False)} AND {LO}"),
    "d01": (f"low <= low20 AND rsi14 > {lag('rs_low', 10)} + 5 AND low < {lag('low20', 10)} AND close > open", f"high >= top20 AND rsi14 < {lag('rs_top', 10)} - 5 AND high > {lag('top20', 10)} AND close < open"),
    "d02": (f"low <= low20 AND hist > {lag('hi_low', 10)} AND hist < 0 AND hist > {lag('hist')}", f"high >= top20 AND hist < {lag('hi_top', 10)} AND hist > 0 AND hist < {lag('hist')}"),
    "s01": ("hr = 8 AND close > asia_top", "hr = 8 AND close < asia_floor"),
    "s02": ("hr = 14 AND close < day_open * 0.99::DOUBLE", "hr = 14 AND close > day_open * 1.01::DOUBLE"),
}

for family, sql in {"trend": rules(INDICATED, TREND), "breakout": rules(INDICATED, BREAKOUT), "reversion": rules(INDICATED, REVERSION), "action": rules(SHAPED, ACTION, "a"), "flow": rules(FLOWING, FLOW, "f")}.items():
    QUERIES[f"{family}_strategies"] = lambda spark, sf_dir, family=family: S.signals(hourly(spark, sf_dir), family)
    ORACLE_SQL[f"{family}_strategies"] = sql


@query("strategy_returns", f"{INDICATED}, r AS (SELECT symbol, bar, lead(open) OVER {OVER} AS entry, lead(close, 12) OVER {OVER} AS leave, " + ", ".join(f"CASE WHEN {a} THEN 1 WHEN {b} THEN -1 ELSE 0 END AS {k}" for k, (a, b) in TREND.items()) + " FROM i), u AS (UNPIVOT r ON " + ", ".join(TREND) + " INTO NAME rule VALUE side) SELECT rule, side::INT AS side, count(*) AS n, round(avg(side * (leave / entry - 1)), 6) AS mean FROM u WHERE side <> 0 AND leave IS NOT NULL GROUP BY 1, 2")
def strategy_returns(spark, sf_dir):
    """Mean result of the trend strategies' signals, from the next open to the close eleven bars on."""
    bars = hourly(spark, sf_dir)
    ahead = bars.select("symbol", "bar", F.lead("open").over(S.W.order()).alias("entry"), F.lead("close", 12).over(S.W.order()).alias("leave"))
    names = list(TREND)
    rows = S.signals(bars, "trend").unpivot(["symbol", "bar"], names, "rule", "side").where("side <> 0").join(ahead, ["symbol", "bar"]).where("leave is not null")
    return rows.groupBy("rule", "side").agg(F.count("*").alias("n"), F.round(F.avg(F.col("side") * (F.col("leave") / F.col("entry") - 1)), 6).alias("mean"))
