"""Registered queries of event detectors."""

from __future__ import annotations

from tickframe.operators import events as E
from tickframe.plans.queries import BARS, ORACLE_SQL, OVER, QUERIES, frame, hourly, last, query, rounded

frame("liquidity_sweep", E.sweeps, ["side"], "SELECT symbol, bar, side FROM (SELECT *, CASE WHEN count(*) OVER w = 15 THEN CASE WHEN low < min(low) OVER w AND close > min(low) OVER w THEN 1 WHEN high > max(high) OVER w AND close < max(high) OVER w THEN -1 END END AS side FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 20 PRECEDING AND 6 PRECEDING)) WHERE side IS NOT NULL")
frame(
    "price_gaps",
    E.gaps,
    ["side", "bottom", "top", "filled"],
    f", g AS (SELECT *, lag(high, 2) OVER {OVER} AS oh, lag(low, 2) OVER {OVER} AS ol, min(low) OVER l AS al, max(high) OVER l AS ah FROM bars WINDOW l AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) SELECT symbol, bar, CASE WHEN low > oh THEN 1 ELSE -1 END AS side, round(CASE WHEN low > oh THEN oh ELSE high END, 6) AS bottom, round(CASE WHEN low > oh THEN low ELSE ol END, 6) AS top, coalesce(CASE WHEN low > oh THEN al <= oh ELSE ah >= ol END, FALSE) AS filled FROM g WHERE low > oh OR high < ol",
)
PARTS = " + ".join(f"CASE WHEN sum((code = {k})::INT) OVER w > 0 THEN -(sum((code = {k})::INT) OVER w / count(code) OVER w) * ln(sum((code = {k})::INT) OVER w / count(code) OVER w) ELSE 0 END" for k in (0, 2, 3, 4, 5, 7))
frame("permutation_entropy", E.order_patterns, ["entropy"], f", c AS (SELECT symbol, bar, (lag(close, 2) OVER {OVER} < lag(close) OVER {OVER})::INT * 4 + (lag(close) OVER {OVER} < close)::INT * 2 + (lag(close, 2) OVER {OVER} < close)::INT AS code FROM bars) SELECT symbol, bar, CASE WHEN count(code) OVER w >= 48 THEN round(({PARTS}) / ln(6), 6) END AS entropy FROM c WINDOW w AS {last(48)}")
frame("ordered_states", E.ordered_states, ["rank", "ordered"], f", c AS (SELECT symbol, bar, (lag(close, 2) OVER {OVER} < lag(close) OVER {OVER})::INT * 4 + (lag(close) OVER {OVER} < close)::INT * 2 + (lag(close, 2) OVER {OVER} < close)::INT AS code FROM bars), e AS (SELECT symbol, bar, CASE WHEN count(code) OVER w >= 48 THEN round(({PARTS}) / ln(6), 9) END AS e FROM c WINDOW w AS {last(48)}), l AS (SELECT symbol, bar, e, list(e) FILTER (e IS NOT NULL) OVER v AS v FROM e WINDOW v AS {last(100)}) SELECT symbol, bar, CASE WHEN len(v) = 100 THEN round(len([x FOR x IN v IF x <= e]) / 100.0::DOUBLE, 6) END AS rank, CASE WHEN len(v) = 100 THEN len([x FOR x IN v IF x <= e]) / 100.0::DOUBLE <= 0.2 END AS ordered FROM l")
frame("market_beta", lambda b: E.market_beta(b, "view"), ["beta", "rho"], f", r AS (SELECT symbol, bar, ln(close / lag(close) OVER {OVER}) AS ret FROM bars), j AS (SELECT r.symbol, r.bar, r.ret, m.ret AS mkt FROM r JOIN r m ON m.symbol = 'view' AND m.bar = r.bar WHERE r.symbol <> 'view' AND r.ret IS NOT NULL AND m.ret IS NOT NULL) SELECT symbol, bar, CASE WHEN count(*) OVER w >= 48 THEN round(regr_slope(ret, mkt) OVER w, 6) END AS beta, CASE WHEN count(*) OVER w >= 48 THEN round(corr(ret, mkt) OVER w, 6) END AS rho FROM j WINDOW w AS {last(48)}")


@query("breadth", f"WITH {BARS}, r AS (SELECT *, sign(close - lag(close) OVER {OVER})::DOUBLE AS way FROM bars) SELECT bar, count(*) AS n, round(avg((way > 0)::INT), 6) AS up, round(avg((way < 0)::INT), 6) AS down, CASE WHEN sum(volume) > 0 THEN round(sum(way * volume) / sum(volume), 6) END AS balance FROM r WHERE way IS NOT NULL GROUP BY 1")
def breadth(spark, sf_dir):
    return rounded(E.breadth(hourly(spark, sf_dir)), "bar", "n", "up", "down", "balance")


@query("volume_nodes", ORACLE_SQL["volume_profile"].replace("SELECT symbol, bin, round(sum(v), 6) AS volume FROM x GROUP BY 1, 2", ", p AS (SELECT symbol, bin, round(sum(v), 6) AS volume FROM x GROUP BY 1, 2), m AS (SELECT *, coalesce(lag(volume) OVER n, 0) AS a, coalesce(lead(volume) OVER n, 0) AS b, avg(volume) OVER (PARTITION BY symbol) AS mean FROM p WINDOW n AS (PARTITION BY symbol ORDER BY bin)), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY volume DESC, bin)::INT AS rk FROM m WHERE volume >= a AND volume >= b AND volume >= 1.2::DOUBLE * mean) SELECT symbol, bin, volume, rk FROM k WHERE rk <= 5"))
def volume_nodes(spark, sf_dir):
    return E.volume_nodes(QUERIES["volume_profile"](spark, sf_dir)).select("symbol", "bin", "volume", "rk")
