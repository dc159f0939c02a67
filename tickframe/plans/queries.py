"""Registered queries of the library, each with DuckDB SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickframe.operators import aggregates as A
from tickframe.operators import frames as W
from tickframe.operators import joins as J
from tickframe.operators import recursive as R
from tickframe.sources.tables import hourly, table, ticks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TICKS = """ticks AS (SELECT event_type AS symbol, ts, event_id AS id, value AS price, regexp_extract(props, '(\\d+)', 1)::INT AS size,
 CASE WHEN event_type IN ('purchase', 'click') THEN 1 ELSE -1 END AS side, user_id FROM events)"""
BARS = (
    TICKS
    + """, bars AS (SELECT symbol, date_trunc('hour', ts)::TIMESTAMP AS bar, arg_min(price, (ts, id)) AS open, max(price) AS high, min(price) AS low,
 arg_max(price, (ts, id)) AS close, sum(size::DOUBLE) AS volume, sum(CASE WHEN user_id % 2 = 0 THEN size ELSE 0 END::DOUBLE) AS buy, count(*) AS n FROM ticks GROUP BY 1, 2)"""
)
OVER = "(PARTITION BY symbol ORDER BY bar)"


def last(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY bar ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def before(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY bar ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def rounded(df: DataFrame, *columns: str, to: int = 6) -> DataFrame:
    """Only the named columns, doubles rounded; `a` or `a:b` for a renamed to b."""
    out = []
    for c in columns:
        name, _, alias = c.partition(":")
        kind = df.schema[name].dataType.simpleString()
        value = F.round(name, to) if kind == "double" else F.col(name)
        out.append(value.alias(alias or name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def frame(name: str, f: Callable[[DataFrame], DataFrame], columns: list[str], sql: str, to: int = 6) -> None:
    """A query that applies f to hourly bars."""
    QUERIES[name] = lambda spark, sf_dir: rounded(f(hourly(spark, sf_dir)), "symbol", "bar", *columns, to=to)
    ORACLE_SQL[name] = f"WITH {BARS} {sql}"


# Bars

frame("ohlcv_1h", lambda b: b, ["open", "high", "low", "close", "volume", "buy", "n"], "SELECT symbol, bar, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume, buy, n FROM bars")


@query("ohlcv_rollup_1d", f"WITH {BARS} SELECT symbol, date_trunc('day', bar)::TIMESTAMP AS bar, arg_min(open, bar) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar) AS close, sum(volume) AS volume, count(*) AS parts FROM bars GROUP BY 1, 2 HAVING count(*) >= 12")
def ohlcv_rollup_1d(spark, sf_dir):
    """Days from hours; only days of at least 12 hours that have trades."""
    days = hourly(spark, sf_dir).groupBy("symbol", F.window("bar", "1 day").alias("w"))
    out = days.agg(F.min_by("open", "bar").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("parts"))
    return out.where("parts >= 12").select("symbol", F.col("w.start").alias("bar"), "open", "high", "low", "close", "volume", "parts")


@query("flow_1m", f"WITH {TICKS} SELECT symbol, date_trunc('minute', ts)::TIMESTAMP AS minute, round(sum(CASE WHEN side > 0 THEN price * size ELSE 0 END), 4) AS buy_vol, round(sum(CASE WHEN side < 0 THEN price * size ELSE 0 END), 4) AS sell_vol, count(*) FILTER (side > 0) AS buy_n, count(*) FILTER (side < 0) AS sell_n FROM ticks GROUP BY 1, 2")
def flow_1m(spark, sf_dir):
    buy, value = F.col("side") > 0, F.col("price") * F.col("size")
    out = ticks(spark, sf_dir).groupBy("symbol", F.window("ts", "1 minute").alias("w")).agg(F.sum(F.when(buy, value).otherwise(0.0)).alias("buy_vol"), F.sum(F.when(~buy, value).otherwise(0.0)).alias("sell_vol"), F.count_if(buy).alias("buy_n"), F.count_if(~buy).alias("sell_n"))
    return rounded(out.withColumn("minute", F.col("w.start")), "symbol", "minute", "buy_vol", "sell_vol", "buy_n", "sell_n", to=4)


@query("running_day_bar", f"WITH {BARS} SELECT symbol, bar, first_value(open) OVER d AS open, max(high) OVER d AS high, min(low) OVER d AS low, close FROM bars WINDOW d AS (PARTITION BY symbol, date_trunc('day', bar) ORDER BY bar)")
def running_day_bar(spark, sf_dir):
    """The day's bar as it stands after each hour."""
    d = Window.partitionBy("symbol", F.to_date("bar")).orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    return hourly(spark, sf_dir).select("symbol", "bar", F.first("open").over(d).alias("open"), F.max("high").over(d).alias("high"), F.min("low").over(d).alias("low"), "close")


@query("gap_filled_grid", f"WITH {BARS}, g AS (SELECT symbol, unnest(range(min(bar), max(bar) + INTERVAL 1 hour, INTERVAL 1 hour)) AS bar FROM bars GROUP BY 1) SELECT g.symbol, g.bar, b.close, last_value(b.close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.bar) AS filled FROM g LEFT JOIN bars b ON b.symbol = g.symbol AND b.bar = g.bar")
def gap_filled_grid(spark, sf_dir):
    own = hourly(spark, sf_dir).select("symbol", "bar", "close")
    grid = own.groupBy("symbol").agg(F.explode(F.sequence(F.min("bar"), F.max("bar"), F.expr("interval 1 hour"))).alias("bar"))
    return grid.join(own, ["symbol", "bar"], "left").withColumn("filled", F.last("close", ignorenulls=True).over(W.order()))


# Frames

frame("log_returns", W.returns, ["ret", "simple"], f"SELECT symbol, bar, round(ln(close / lag(close) OVER {OVER}), 6) AS ret, round(close / lag(close) OVER {OVER} - 1, 6) AS simple FROM bars")
TR = f"tr AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER {OVER}), abs(low - lag(close) OVER {OVER})) AS tr FROM bars)"
frame("atr_sma", W.atr, ["tr", "atr"], f", {TR} SELECT symbol, bar, round(tr, 6) AS tr, CASE WHEN count(*) OVER w >= 14 THEN round(avg(tr) OVER w, 6) END AS atr FROM tr WINDOW w AS {last(14)}")
frame("bollinger", W.bollinger, ["mid", "upper", "lower", "width"], f"SELECT symbol, bar, CASE WHEN count(*) OVER w >= 20 THEN round(avg(close) OVER w, 6) END AS mid, CASE WHEN count(*) OVER w >= 20 THEN round(avg(close) OVER w + 2 * stddev_pop(close) OVER w, 6) END AS upper, CASE WHEN count(*) OVER w >= 20 THEN round(avg(close) OVER w - 2 * stddev_pop(close) OVER w, 6) END AS lower, CASE WHEN count(*) OVER w >= 20 THEN round(4 * stddev_pop(close) OVER w / avg(close) OVER w, 6) END AS width FROM bars WINDOW w AS {last(20)}")
frame("donchian_breakout", W.donchian_breakouts, ["top", "floor", "side"], f", m AS (SELECT *, CASE WHEN count(*) OVER w >= 20 THEN max(high) OVER w END AS top, CASE WHEN count(*) OVER w >= 20 THEN min(low) OVER w END AS floor FROM bars WINDOW w AS {before(20)}), s AS (SELECT *, CASE WHEN close > top THEN 1 WHEN close < floor THEN -1 ELSE 0 END AS side FROM m), t AS (SELECT *, lag(side, 1, 0) OVER {OVER} AS old FROM s) SELECT symbol, bar, round(top, 6) AS top, round(floor, 6) AS floor, side FROM t WHERE side <> 0 AND side <> old")
frame("rolling_z_prev", W.z_before, ["z"], f"SELECT symbol, bar, CASE WHEN count(*) OVER w >= 24 AND stddev_pop(volume) OVER w > 0 THEN round((volume - avg(volume) OVER w) / stddev_pop(volume) OVER w, 6) END AS z FROM bars WINDOW w AS {before(24)}")
frame("stochastic", W.stochastic, ["pct_k", "pct_d"], f", k AS (SELECT *, CASE WHEN count(*) OVER w >= 14 AND max(high) OVER w > min(low) OVER w THEN 100 * (close - min(low) OVER w) / (max(high) OVER w - min(low) OVER w) END AS pct_k FROM bars WINDOW w AS {last(14)}) SELECT symbol, bar, round(pct_k, 6) AS pct_k, CASE WHEN count(*) OVER w >= 3 THEN round(avg(pct_k) OVER w, 6) END AS pct_d FROM k WINDOW w AS {last(3)}")
frame("money_flow_index", W.money_flow, ["mfi"], f", t AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), o AS (SELECT *, lag(tp) OVER {OVER} AS old FROM t), f AS (SELECT symbol, bar, count(*) OVER w AS c, sum(CASE WHEN tp > old THEN tp * volume ELSE 0 END) OVER w AS up, sum(CASE WHEN tp < old THEN tp * volume ELSE 0 END) OVER w AS down FROM o WINDOW w AS {last(14)}) SELECT symbol, bar, CASE WHEN c >= 14 AND up + down > 0 THEN round(100 * up / (up + down), 6) END AS mfi FROM f")
frame("cumulative_delta", W.cumulative_delta, ["cvd"], f"SELECT symbol, bar, sum(2 * buy - volume) OVER {OVER} AS cvd FROM bars")
frame("session_vwap", W.session_vwap, ["vwap"], "SELECT symbol, bar, CASE WHEN sum(volume) OVER w > 0 THEN round(sum((high + low + close) / 3 * volume) OVER w / sum(volume) OVER w, 6) END AS vwap FROM bars WINDOW w AS (PARTITION BY symbol, date_trunc('day', bar) ORDER BY bar)")
frame("efficiency_ratio", W.efficiency, ["me"], f", s AS (SELECT *, abs(close - lag(close) OVER {OVER}) AS step, abs(close - lag(close, 14) OVER {OVER}) AS net FROM bars) SELECT symbol, bar, CASE WHEN net IS NOT NULL THEN CASE WHEN sum(step) OVER w > 0 THEN round(net / sum(step) OVER w, 6) ELSE 0.5 END END AS me FROM s WINDOW w AS {last(14)}")
frame("variance_ratio", W.variance_ratio, ["vr"], f", r AS (SELECT *, ln(close / lag(close) OVER {OVER}) AS r1, ln(close / lag(close, 4) OVER {OVER}) AS rq FROM bars) SELECT symbol, bar, CASE WHEN count(rq) OVER w >= 48 AND var_pop(r1) OVER w > 0 THEN round(var_pop(rq) OVER w / (4 * var_pop(r1) OVER w), 6) END AS vr FROM r WINDOW w AS {last(48)}")
frame("jump_ratio", W.jump_ratio, ["jump"], f", r AS (SELECT *, ln(close / lag(close) OVER {OVER}) AS r FROM bars), b AS (SELECT *, abs(r) * abs(lag(r) OVER {OVER}) AS b FROM r) SELECT symbol, bar, CASE WHEN count(b) OVER w >= 24 AND sum(r * r) OVER w > 0 THEN round(greatest(0, 1 - sum(b) OVER w * (pi() / 2) / sum(r * r) OVER w), 6) END AS jump FROM b WINDOW w AS {last(24)}")
frame("rolling_ols", W.rolling_trend, ["slope", "r2"], f", i AS (SELECT *, row_number() OVER {OVER}::DOUBLE AS i FROM bars) SELECT symbol, bar, CASE WHEN count(*) OVER w >= 20 THEN round(regr_slope(close, i) OVER w, 4) END AS slope, CASE WHEN count(*) OVER w >= 20 THEN round(regr_r2(close, i) OVER w, 4) END AS r2 FROM i WINDOW w AS {last(20)}", to=4)
frame("pivots", W.pivots, ["top", "floor", "known"], f", p AS (SELECT *, count(*) OVER l = 3 AND count(*) OVER r = 3 AS ok, max(high) OVER l AS lh, max(high) OVER r AS rh, min(low) OVER l AS ll, min(low) OVER r AS rl, lead(bar, 3) OVER {OVER} AS known FROM bars WINDOW l AS {before(3)}, r AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) SELECT symbol, bar, ok AND high > lh AND high > rh AS top, ok AND low < ll AND low < rl AS floor, known FROM p WHERE ok AND ((high > lh AND high > rh) OR (low < ll AND low < rl))")
frame("run_length", W.run_lengths, ["dir", "run"], f", d AS (SELECT *, sign(close - lag(close) OVER {OVER})::INT AS dir FROM bars), s AS (SELECT *, CASE WHEN dir IS NOT DISTINCT FROM lag(dir) OVER {OVER} THEN 0 ELSE 1 END AS st FROM d), i AS (SELECT *, sum(st) OVER {OVER} AS island FROM s) SELECT symbol, bar, dir, row_number() OVER (PARTITION BY symbol, island ORDER BY bar)::INT AS run FROM i")
frame("forward_returns", W.forward_returns, ["fwd"], f"SELECT symbol, bar, round(lead(close, 4) OVER {OVER} / lead(open) OVER {OVER} - 1, 6) AS fwd FROM bars")
frame("excursions", W.excursions, ["mfe", "mae"], "SELECT symbol, bar, CASE WHEN count(*) OVER w = 12 THEN round(max(high) OVER w / close - 1, 6) END AS mfe, CASE WHEN count(*) OVER w = 12 THEN round(min(low) OVER w / close - 1, 6) END AS mae FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING)")
frame("cross_section_z", W.cross_section_z, ["m", "xz"], f", r AS (SELECT *, ln(close / lag(close) OVER {OVER}) AS ret FROM bars), q AS (SELECT symbol, bar, ret, count(*) OVER w AS c, sum(ret) OVER w AS s, sum(ret * ret) OVER w AS q FROM r WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY bar)), z AS (SELECT *, CASE WHEN c > 1 THEN (s - ret) / (c - 1) END AS m, CASE WHEN c > 1 THEN (q - ret * ret) / (c - 1) END AS e FROM q) SELECT symbol, bar, round(m, 4) AS m, CASE WHEN sqrt(greatest(0, e - m * m)) > 1e-9 THEN round((ret - m) / sqrt(greatest(0, e - m * m)), 4) END AS xz FROM z", to=4)
frame("ema_20", lambda b: R.sliced_ema(b, 20), ["ema20"], ", l AS (SELECT symbol, bar, list(close) OVER (PARTITION BY symbol ORDER BY bar) AS c FROM bars) SELECT symbol, bar, round(list_reduce(c, lambda a, x: a + (x - a) * (2.0::DOUBLE / 21)), 6) AS ema20 FROM l")


# Joins and races

@query("asof_day", f"WITH {BARS}, d AS (SELECT symbol, date_trunc('day', bar)::TIMESTAMP + INTERVAL 1 day AS bar, arg_max(close, bar) AS day_close FROM bars GROUP BY symbol, date_trunc('day', bar)) SELECT b.symbol, b.bar, b.close, d.day_close FROM bars b ASOF LEFT JOIN d ON b.symbol = d.symbol AND b.bar >= d.bar")
def asof_day(spark, sf_dir):
    """Hours with the close of the last complete day."""
    own = hourly(spark, sf_dir).select("symbol", "bar", "close")
    days = own.groupBy("symbol", F.window("bar", "1 day").alias("w")).agg(F.max_by("close", "bar").alias("day_close")).select("symbol", F.col("w.end").alias("bar"), "day_close")
    return J.as_of(own, days, "bar", "symbol", ["day_close"])


@query("interval_sum", f"WITH {BARS}, s AS (SELECT symbol, id AS span, ts AS low, ts + INTERVAL 72 hours AS high FROM ticks WHERE size = 7) SELECT s.symbol, s.span, s.low, s.high, round(coalesce(sum(b.volume), 0), 6) AS total, count(b.volume) AS points FROM s LEFT JOIN bars b ON b.symbol = s.symbol AND b.bar > s.low AND b.bar <= s.high GROUP BY ALL")
def interval_sum(spark, sf_dir):
    """Volume of the bars in the 72 hours after each tick of size 7."""
    spans = ticks(spark, sf_dir).where("size = 7").select("symbol", F.col("id").alias("span"), F.col("ts").alias("low"), (F.col("ts") + F.expr("interval 72 hours")).alias("high"))
    points = hourly(spark, sf_dir).select("symbol", F.col("bar").alias("at"), "volume")
    return rounded(J.interval_sums(spans, points, "symbol", "volume"), "symbol", "span", "low", "high", "total", "points")


RACE = f"""WITH {BARS}, n AS (SELECT *, row_number() OVER {OVER} AS i FROM bars), m AS (SELECT a.symbol, a.bar, a.close AS entry,
 min(CASE WHEN b.high >= a.close * (1 + 0.5::DOUBLE) THEN b.i - a.i END) AS hit, min(CASE WHEN b.low <= a.close * (1 - 0.25::DOUBLE) THEN b.i - a.i END) AS lost
 FROM n a JOIN n b ON a.symbol = b.symbol AND b.i BETWEEN a.i + 1 AND a.i + 24 WHERE a.n >= 4 GROUP BY 1, 2, 3),
 race AS (SELECT *, CASE WHEN lost <= coalesce(hit, 1 << 30) THEN 'LOSS' WHEN hit IS NOT NULL THEN 'WIN' ELSE 'OPEN' END AS result FROM m),
 trades AS (SELECT *, CASE result WHEN 'WIN' THEN 2.0::DOUBLE WHEN 'LOSS' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS r FROM race)"""


def race(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.first_touch(hourly(spark, sf_dir), F.col("n") >= 4, 24, 0.5, 0.25)


@query("first_touch", f"{RACE} SELECT symbol, bar, entry, hit, lost, result, r FROM trades")
def first_touch(spark, sf_dir):
    return race(spark, sf_dir).select("symbol", "bar", "entry", F.col("hit").cast("long").alias("hit"), F.col("lost").cast("long").alias("lost"), "result", "r")


WILSON = "round((k / n + 3.8416 / (2 * n) {} 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6)"


@query("scoreboard", f"{RACE}, s AS (SELECT symbol, count(*)::DOUBLE AS n, count(*) FILTER (r > 0)::DOUBLE AS k, sum(r) AS total, sum(r * r) AS q FROM trades GROUP BY 1) SELECT symbol, n::BIGINT AS n, k::BIGINT AS wins, round(k / n, 6) AS win_rate, {WILSON.format('-')} AS low, {WILSON.format('+')} AS high, round(total / n, 6) AS mean, total, CASE WHEN n > 1 THEN round(sqrt(greatest(0, q - total * total / n) / (n - 1) / n), 6) END AS se FROM s")
def scoreboard(spark, sf_dir):
    return rounded(A.scoreboard(race(spark, sf_dir), "symbol"), "symbol", "n", "wins", "win_rate", "low", "high", "mean", "total", "se")


@query("clustered_t", f"{RACE}, t AS (SELECT symbol, date_trunc('day', bar) AS d, r FROM trades), mm AS (SELECT symbol, avg(r) AS mean, count(*) AS n FROM t GROUP BY 1), p AS (SELECT t.symbol, d, sum(r) AS s, count(*) AS c FROM t GROUP BY 1, 2), q AS (SELECT p.symbol, any_value(mean) AS mean, any_value(n) AS n, count(*) AS clusters, sum(pow(s - c * mean, 2)) AS q FROM p JOIN mm USING (symbol) GROUP BY 1) SELECT symbol, n, clusters, round(mean, 6) AS mean, round(sqrt(q) / n, 6) AS se, CASE WHEN q > 0 THEN round(mean / (sqrt(q) / n), 6) END AS t FROM q")
def clustered_t(spark, sf_dir):
    rows = race(spark, sf_dir).withColumn("day", F.to_date("bar"))
    return rounded(A.clustered_t(rows, "r", "day", "symbol"), "symbol", "n", "clusters", "mean", "se", "t")


@query("auc", f"WITH {BARS}, r AS (SELECT symbol, volume, lead(close) OVER {OVER} AS nxt, close FROM bars), x AS (SELECT symbol, volume, (nxt > close)::INT AS y FROM r WHERE nxt IS NOT NULL), k AS (SELECT symbol, y, rank() OVER (PARTITION BY symbol ORDER BY volume) + (count(*) OVER (PARTITION BY symbol, volume) - 1) / 2.0::DOUBLE AS rk FROM x), s AS (SELECT symbol, sum(CASE WHEN y = 1 THEN rk ELSE 0 END) AS r, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM k GROUP BY 1) SELECT symbol, n1, n0, CASE WHEN n1 > 0 AND n0 > 0 THEN round((r - n1 * (n1 + 1) / 2) / (n1 * n0), 6) END AS auc FROM s")
def auc(spark, sf_dir):
    rows = hourly(spark, sf_dir).withColumn("next", F.lead("close").over(W.order())).where("next is not null")
    return rounded(A.auc(rows.withColumn("y", (F.col("next") > F.col("close")).cast("long")), "volume", "y", "symbol"), "symbol", "n1", "n0", "auc")


@query("transition_matrix", f"WITH {BARS}, d AS (SELECT symbol, bar, CASE WHEN close > open THEN 'up' WHEN close < open THEN 'down' ELSE 'flat' END AS st FROM bars), p AS (SELECT lag(st) OVER {OVER} AS prev, st AS cur FROM d), c AS (SELECT prev, cur, count(*) AS n FROM p WHERE prev IS NOT NULL GROUP BY 1, 2) SELECT prev, cur, n, round(n / sum(n) OVER (PARTITION BY prev), 6) AS share FROM c")
def transition_matrix(spark, sf_dir):
    state = F.when(F.col("close") > F.col("open"), "up").when(F.col("close") < F.col("open"), "down").otherwise("flat")
    return rounded(A.transitions(hourly(spark, sf_dir).withColumn("state", state), "state"), "prev", "cur", "n", "share")


@query("grouping_sets", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderstatus, o_orderpriority))")
def grouping_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumnsRenamed({"o_orderstatus": "status", "o_orderpriority": "priority"})
    return rounded(rows.rollup("status", "priority").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), "status", "priority", "n", "total", to=2)


PNL = "p AS (SELECT o_orderkey, o_orderpriority AS symbol, o_orderdate AS ts, o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS pnl FROM orders)"


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as trades whose result is the price against the mean of their priority."""
    rows = table(spark, sf_dir, "orders")
    mean = rows.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("mean"))
    return rows.join(mean, "o_orderpriority").select("o_orderkey", F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), (F.col("o_totalprice") - F.col("mean")).alias("pnl"))


@query("performance_summary", f"WITH {PNL} SELECT count(*) AS n, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl < 0) AS losses, round(sum(greatest(pnl, 0)), 2) AS gross_profit, round(sum(greatest(-pnl, 0)), 2) AS gross_loss, round(avg(pnl), 2) AS expectancy, round(sum(greatest(pnl, 0)) / sum(greatest(-pnl, 0)), 2) AS profit_factor FROM p")
def performance_summary(spark, sf_dir):
    out = A.performance(ledger(spark, sf_dir))
    out = rounded(out, "n", "wins", "losses", "gross_profit", "gross_loss", "expectancy", "profit_factor", to=2)
    return out.withColumn("expectancy", F.col("expectancy") + 0.0)


@query("daily_pnl", f"WITH {PNL} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(pnl), 2) AS pnl, count(*) FILTER (pnl > 0) AS wins FROM p GROUP BY 1")
def daily_pnl(spark, sf_dir):
    return rounded(ledger(spark, sf_dir).groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"), F.sum("pnl").alias("pnl"), F.count_if(F.col("pnl") > 0).alias("wins")), "day", "n", "pnl", "wins", to=2)


@query("daily_cap", "SELECT day, o_orderkey, rk FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey, row_number() OVER (PARTITION BY date_trunc('day', o_orderdate) ORDER BY o_totalprice DESC, o_orderkey)::INT AS rk FROM orders) WHERE rk <= 3")
def daily_cap(spark, sf_dir):
    """The three largest orders of each day (the top-k is the feature)."""
    day = F.to_date("o_orderdate").cast("string")
    rank = F.row_number().over(Window.partitionBy(day).orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf_dir, "orders").select(day.alias("day"), "o_orderkey", rank.alias("rk")).where("rk <= 3")


@query("herfindahl", f"WITH {TICKS}, u AS (SELECT symbol, user_id, sum(price * size) AS v FROM ticks GROUP BY 1, 2), s AS (SELECT symbol, v / sum(v) OVER (PARTITION BY symbol) AS share FROM u) SELECT symbol, round(sum(share * share), 6) AS hhi FROM s GROUP BY 1")
def herfindahl(spark, sf_dir):
    """Concentration of traded value over users; the sums of shares come from v and v squared alone."""
    own = ticks(spark, sf_dir).groupBy("symbol", "user_id").agg(F.sum(F.col("price") * F.col("size")).alias("v"))
    out = own.groupBy("symbol").agg((F.sum(F.col("v") * F.col("v")) / F.pow(F.sum("v"), 2)).alias("hhi"))
    return rounded(out, "symbol", "hhi")


@query("align_all", f"WITH {BARS} SELECT bar, count(*) AS symbols, round(avg(close), 6) AS mean FROM bars GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM bars)")
def align_all(spark, sf_dir):
    """Bars that all symbols have."""
    own = hourly(spark, sf_dir)
    every = own.agg(F.countDistinct("symbol").alias("m"))
    return rounded(own.groupBy("bar").agg(F.count("*").alias("symbols"), F.avg("close").alias("mean")).join(F.broadcast(every), F.col("symbols") == F.col("m")), "bar", "symbols", "mean")


@query("splice", f"WITH {BARS}, a AS (SELECT symbol, bar, close, 'old' AS part FROM bars WHERE bar < TIMESTAMP '2024-01-15'), b AS (SELECT symbol, bar, close, 'new' AS part FROM bars WHERE bar >= TIMESTAMP '2024-01-10'), e AS (SELECT symbol, max(bar) AS m FROM a GROUP BY 1) SELECT * FROM a UNION ALL SELECT b.* FROM b LEFT JOIN e USING (symbol) WHERE e.m IS NULL OR b.bar > e.m")
def splice(spark, sf_dir):
    own = hourly(spark, sf_dir).select("symbol", "bar", "close")
    old = own.where("bar < timestamp_ntz '2024-01-15 00:00:00'").withColumn("part", F.lit("old"))
    return J.splice(old, own.where("bar >= timestamp_ntz '2024-01-10 00:00:00'").withColumn("part", F.lit("new")), "symbol", "bar")


@query("volume_profile", f"WITH {BARS}, w AS (SELECT symbol, floor(low / 25)::INT AS b0, floor(high / 25)::INT AS b1, volume FROM bars), x AS (SELECT symbol, unnest(range(b0, b1 + 1))::INT AS bin, volume / (b1 - b0 + 1) AS v FROM w) SELECT symbol, bin, round(sum(v), 6) AS volume FROM x GROUP BY 1, 2")
def volume_profile(spark, sf_dir):
    """Volume spread evenly over the price bins (25 wide) that each bar touches."""
    own = hourly(spark, sf_dir).select("symbol", F.floor(F.col("low") / 25).cast("int").alias("b0"), F.floor(F.col("high") / 25).cast("int").alias("b1"), "volume")
    spread = own.select("symbol", F.explode(F.sequence("b0", "b1")).alias("bin"), (F.col("volume") / (F.col("b1") - F.col("b0") + 1)).alias("v"))
    return rounded(spread.groupBy("symbol", "bin").agg(F.sum("v").alias("volume")), "symbol", "bin", "volume")


@query("json_props", "SELECT event_type, regexp_extract(props, '(\\d+)', 1)::INT AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def json_props(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k int")["k"])
    return rounded(rows.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "event_type", "k", "n", "total", to=4)
