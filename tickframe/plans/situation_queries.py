"""Registered queries of the filter catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickframe.operators import decisions as D
from tickframe.operators import situations as S
from tickframe.plans.queries import BARS, OVER, RACE, TR, hourly, last, query, race

SIDES = "(VALUES ('L'), ('S')) s(side)"


def kept(table: str, filters: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT symbol, bar, side, '{k}' AS filter, CASE WHEN {a} THEN coalesce(NOT ({r}), TRUE) ELSE TRUE END AS kept FROM {table}" for k, (a, r) in filters.items())


def share(x: str, name: str, n: int) -> str:
    return f"CASE WHEN count(*) OVER {last(n)} = {n} AND count({name}) OVER {last(n)} >= 0.9::DOUBLE * {n} THEN {x} END"


#: No given table has open interest: a day's volume stands for it, bought over sold volume for the long/short ratio.
CROWD = f"""cr AS (SELECT symbol, bar, nullif(sum(volume) OVER {last(24)}, 0) AS oi, nullif(buy / nullif(volume - buy, 0), 0) AS ls, (2 * buy - volume) / nullif(volume, 0) AS tk FROM bars),
 fe AS (SELECT symbol, bar, {share(f'ln(oi / lag(oi, 24) OVER {OVER})', 'oi', 25)} AS build, {share(f'ln(oi / avg(oi) OVER {last(120)})', 'oi', 120)} AS high, {share(f'ln(ls / median(ls) OVER {last(120)})', 'ls', 120)} AS lean, {share(f'avg(tk) OVER {last(24)}', 'tk', 24)} AS taken FROM cr), g AS (SELECT fe.*, side FROM fe, {SIDES})"""
CROWDING = {"S_RETAIL_LONG": ("side = 'S'", "lean <= 0"), "S_OI_BUILD": ("side = 'S'", "build <= 0"), "S_OI_HIGH": ("side = 'S'", "high <= 0"), "S_TAKER_SELL": ("side = 'S'", "taken >= 0"), "L_RETAIL_SHORT": ("side = 'L'", "lean >= 0"), "L_OI_BUILD": ("side = 'L'", "build <= 0"), "L_OI_HIGH": ("side = 'L'", "high <= 0"), "L_TAKER_BUY": ("side = 'L'", "taken <= 0")}


def both_sides(rows):
    return rows.withColumn("side", F.explode(F.array(F.lit("L"), F.lit("S"))))


@query("crowding_filters", f"WITH {BARS}, {CROWD} {kept('g', CROWDING)}")
def crowding_filters(spark, sf_dir):
    """Eight filters on how crowded either side is, for a long and a short signal at each bar."""
    v, b = F.col("volume"), F.col("buy")
    rows = hourly(spark, sf_dir).withColumns({"oi": F.sum("volume").over(S.W.last(24)), "ls": b / F.nullif(v - b, F.lit(0.0)), "tk": (2 * b - v) / F.nullif(v, F.lit(0.0))})
    found = S.crowding_features(rows.select("symbol", "bar", "oi", "ls", "tk"), "oi", "ls", "tk")
    return D.passed(both_sides(found), S.crowding_filters()).select("symbol", "bar", "side", "filter", "kept")


ORDERS = "CASE WHEN c1 IS NULL OR c2 IS NULL THEN NULL WHEN c2 <= c1 AND c1 <= close THEN 'abc' WHEN c2 <= close AND close < c1 THEN 'acb' WHEN c1 < c2 AND c2 <= close THEN 'bac' WHEN c1 <= close AND close < c2 THEN 'bca' WHEN close < c2 AND c2 <= c1 THEN 'cab' ELSE 'cba' END"
SITUATED = f"""{RACE}, {TR.replace('tr AS (', 'trr AS (', 1)},
 z0 AS (SELECT *, lag(close) OVER {OVER} AS c1, lag(close, 2) OVER {OVER} AS c2, abs(close - lag(close) OVER {OVER}) AS step, abs(close - lag(close, 60) OVER {OVER}) AS net, ln(close / lag(close, 48) OVER {OVER}) AS gain, ln(close / lag(close) OVER {OVER}) AS r1, ln(close / lag(close, 6) OVER {OVER}) AS r6, min(bar) OVER (PARTITION BY symbol) AS listed FROM trr),
 z1 AS (SELECT *, {ORDERS} AS code, CASE WHEN sum(step) OVER {last(60)} > 0 THEN net / sum(step) OVER {last(60)} END AS path, CASE WHEN count(r6) OVER {last(120)} >= 120 AND var_pop(r1) OVER {last(120)} > 0 THEN var_pop(r6) OVER {last(120)} / (6 * var_pop(r1) OVER {last(120)}) END AS vr, CASE WHEN count(*) OVER {last(120)} = 120 THEN avg(tr) OVER {last(14)} / avg(tr) OVER {last(120)} END AS squeeze FROM z0),
 z2 AS (SELECT *, list(code) OVER {last(60)} AS codes FROM z1),
 z3 AS (SELECT *, CASE WHEN len(codes) = 60 THEN (list_sum([-len([x FOR x IN codes IF x = k]) / 60.0::DOUBLE * ln(len([x FOR x IN codes IF x = k]) / 60.0::DOUBLE) FOR k IN list_distinct(codes)]) + (len(list_distinct(codes)) - 1) / 120.0::DOUBLE) / ln(6) END AS disorder FROM (SELECT * REPLACE ([x FOR x IN codes IF x IS NOT NULL] AS codes) FROM z2)),
 ld AS (SELECT bar, path AS leader_path, gain AS leader_gain FROM z3 WHERE symbol = 'view'), z4 AS (SELECT z3.*, leader_path, leader_gain FROM z3 LEFT JOIN ld USING (bar)),
 se AS (SELECT bar, CASE WHEN count(gain > leader_gain) FILTER (symbol <> 'view') >= 3 THEN avg((gain > leader_gain)::INT) FILTER (symbol <> 'view') END AS ahead FROM z4 GROUP BY 1),
 cl AS (SELECT symbol, bar AS entry, bar + INTERVAL 1 hour * coalesce(least(hit, lost), 24) AS bar, r FROM trades), co AS (SELECT *, r < 0 AND lag(r) OVER (PARTITION BY symbol ORDER BY bar, entry) < 0 AS whipsaw, row_number() OVER (PARTITION BY symbol, bar ORDER BY entry DESC) AS newest FROM cl),
 te AS (SELECT bar, CASE WHEN count(*) OVER w = 10 THEN count(*) FILTER (r > 0) OVER w END AS wins, row_number() OVER (ORDER BY bar, symbol, entry) AS i FROM cl WINDOW w AS (ORDER BY bar, symbol, entry ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)), tn AS (SELECT bar, arg_max(wins, i) AS wins FROM te WHERE wins IS NOT NULL GROUP BY 1),
 z5 AS (SELECT z4.*, ahead FROM z4 JOIN se USING (bar)), z6 AS (SELECT z5.*, k.whipsaw FROM z5 ASOF LEFT JOIN (SELECT symbol, bar, whipsaw FROM co WHERE newest = 1) k ON k.symbol = z5.symbol AND z5.bar >= k.bar), z7 AS (SELECT z6.*, tn.wins FROM z6 ASOF LEFT JOIN tn ON z6.bar >= tn.bar), g AS (SELECT z7.*, side FROM z7, {SIDES})"""
EVERY, LONGS, SHORTS = "TRUE", "(symbol <> 'view' AND side = 'L')", "(symbol <> 'view' AND side = 'S')"
SITUATIONS = {"COIN_CHOP": (EVERY, "path < 1 / sqrt(60)"), "BTC_CHOP": (EVERY, "leader_path < 1 / sqrt(60)"), "MEAN_REVERT": (EVERY, "vr < 1"), "DISORDER": (EVERY, "disorder > 0.967"), "SQUEEZE": (EVERY, "squeeze < 0.75"), "COIN_WHIPSAW": (EVERY, "whipsaw"), "SYSTEM_COLD": (EVERY, "wins <= 2"), "RS_LEADER": (LONGS, "NOT gain > leader_gain"), "ALT_SEASON": (LONGS, "NOT ahead > 0.5"), "RS_LAGGARD": (SHORTS, "NOT gain < leader_gain"), "WEEKEND": (EVERY, "isodow(bar) >= 6"), "NEW_LISTING": (EVERY, "bar < listed + INTERVAL 5 days"), "FOMC": (EVERY, "bar::DATE IN (DATE '2024-01-09', DATE '2024-01-10', DATE '2024-01-23', DATE '2024-01-24')")}


@query("situation_catalogue", f"{SITUATED} {kept('g', SITUATIONS)}")
def situation_catalogue(spark, sf_dir):
    """Thirteen filters on situations of market, symbol and calendar, for a long and a short signal at each bar."""
    hours = F.coalesce(F.least("hit", "lost"), F.lit(24)).cast("int")
    trades = race(spark, sf_dir).select("symbol", "bar", (F.col("bar") + F.make_dt_interval(F.lit(0), hours)).alias("exit"), "r")
    found = S.situation_features(hourly(spark, sf_dir), trades, "view")
    return D.passed(both_sides(found), S.situation_filters("view", ["2024-01-10", "2024-01-24"])).select("symbol", "bar", "side", "filter", "kept")
