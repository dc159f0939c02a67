"""Registered queries of classifiers, gates and filter catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickframe.operators import decisions as D
from tickframe.operators import frames as W
from tickframe.operators import recursive as R
from tickframe.plans.queries import BARS, OVER, before, frame, hourly, last, query, table
from tickframe.plans.recurrences import N, W14, mean, recursion

RATIO = f"volume / nullif(avg(volume) OVER {before(24)}, 0)"
frame(
    "volume_displacement",
    lambda b: b.withColumn("ratio", F.col("volume") / F.nullif(F.avg("volume").over(W.before(24)), F.lit(0.0))).withColumn("disp", F.abs(F.col("close") - F.col("open")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))).withColumn("state", D.volume_displacement(F.coalesce("ratio", F.lit(1.0)), F.coalesce("disp", F.lit(0.0)))),
    ["state"],
    f"SELECT symbol, bar, CASE WHEN ra >= 1.25 AND di >= 0.4 THEN 'momentum' WHEN ra >= 1.25 THEN 'absorption' WHEN di >= 0.4 THEN 'vacuum' ELSE 'chop' END AS state FROM (SELECT symbol, bar, coalesce({RATIO}, 1) AS ra, coalesce(abs(close - open) / nullif(high - low, 0), 0) AS di FROM bars)",
)
frame(
    "market_states",
    D.market_state,
    ["place", "move", "state"],
    f"SELECT symbol, bar, round(place, 6) AS place, round(move, 6) AS move, CASE WHEN place IS NOT NULL AND move IS NOT NULL THEN CASE WHEN place < 1.0::DOUBLE / 3 THEN 'low' WHEN place > 2.0::DOUBLE / 3 THEN 'high' ELSE 'middle' END || '_' || CASE WHEN move < -0.05 THEN 'down' WHEN move > 0.05 THEN 'up' ELSE 'flat' END END AS state FROM (SELECT symbol, bar, CASE WHEN max(high) OVER w > min(low) OVER w THEN (close - min(low) OVER w) / (max(high) OVER w - min(low) OVER w) END AS place, close / lag(close, 24) OVER {OVER} - 1 AS move FROM bars WINDOW w AS {last(48)})",
)
frame(
    "drift_gate",
    lambda b: b.withColumn("old", F.lag("close", 96).over(W.order())).withColumn("long_ok", D.drift_ok(F.col("close"), F.col("old"), F.lit(1), 0.02)).withColumn("short_ok", D.drift_ok(F.col("close"), F.col("old"), F.lit(-1), 0.02)),
    ["long_ok", "short_ok"],
    f"SELECT symbol, bar, coalesce(d >= -0.02, TRUE) AS long_ok, coalesce(-d >= -0.02, TRUE) AS short_ok FROM (SELECT symbol, bar, close / lag(close, 96) OVER {OVER} - 1 AS d FROM bars)",
)
frame("session_phase", lambda b: b.withColumn("phase", D.session(F.hour("bar"))), ["phase"], "SELECT symbol, bar, CASE WHEN hour(bar) < 7 THEN 'asia' WHEN hour(bar) < 13 THEN 'london' WHEN hour(bar) < 21 THEN 'new_york' ELSE 'close' END AS phase FROM bars")

EMAS = {f"e{n}": ("close", mean("n.close", f"(2.0::DOUBLE / {n + 1})", f"e{n}")) for n in (21, 50, 200)}


def with_means(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    for n in (21, 50, 200):
        bars = R.ema(bars, n)
    return bars


ADX = {
    "h": ("high", "n.high"),
    "l": ("low", "n.low"),
    "p": ("0", mean("CASE WHEN n.high - r.h > r.l - n.low AND n.high > r.h THEN n.high - r.h ELSE 0 END", W14, "p")),
    "m": ("0", mean("CASE WHEN r.l - n.low > n.high - r.h AND r.l > n.low THEN r.l - n.low ELSE 0 END", W14, "m")),
    "t": ("tr", mean("n.tr", W14, "t")),
    "adx": ("0", mean("100 * abs(100 * q_p / greatest(q_t, 1e-12) - 100 * q_m / greatest(q_t, 1e-12)) / greatest(100 * q_p / greatest(q_t, 1e-12) + 100 * q_m / greatest(q_t, 1e-12), 1e-12)", W14, "adx")),
}


@query("trend_regime", f"WITH RECURSIVE {BARS}, {recursion(N, {**EMAS, **ADX})} SELECT symbol, bar, CASE WHEN adx < 20 THEN 0 WHEN close > e200 AND e50 > e200 THEN 1 WHEN close < e200 AND e50 < e200 THEN 2 ELSE 3 END AS regime FROM rec JOIN bars USING (symbol, bar)")
def trend_regime(spark, sf_dir):
    bars = R.directional(with_means(spark, sf_dir))
    return bars.select("symbol", "bar", D.regime(F.col("close"), F.col("ema50"), F.col("ema200"), F.col("adx")).alias("regime"))


ROUTE = f"""x AS (SELECT b.*, e21, e50, row_number() OVER {OVER} AS number, (max(high) OVER p - min(low) OVER p) / close AS bw, coalesce(volume / nullif(avg(volume) OVER p, 0), 1) AS ra,
 abs(close - lag(close) OVER {OVER}) AS step, abs(close - lag(close, 14) OVER {OVER}) AS net FROM bars b JOIN rec USING (symbol, bar) WINDOW p AS {before(24)}),
 y AS (SELECT *, CASE WHEN net IS NOT NULL THEN CASE WHEN sum(step) OVER w > 0 THEN net / sum(step) OVER w ELSE 0.5 END END AS me FROM x WINDOW w AS {last(14)})"""


@query("state_router", f"WITH RECURSIVE {BARS}, {recursion(N, EMAS)}, {ROUTE} SELECT symbol, bar, CASE WHEN number <= 48 THEN 'range' WHEN bw <= 1.5 AND ra < 1.3 AND me < 0.5 THEN 'squeeze' WHEN me >= 0.52 AND abs(e21 - e50) / close >= 0.003 AND ((close > e21 AND e21 > e50) OR (close < e21 AND e21 < e50)) THEN 'expansion' ELSE 'range' END AS state FROM y")
def state_router(spark, sf_dir):
    return D.routed(W.efficiency(with_means(spark, sf_dir)), 1.5).select("symbol", "bar", "state")


@query("text_filter", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'er#00000001') OR contains(lower(c_mktsegment), 'er#00000001') OR contains(lower(c_custkey::VARCHAR), 'er#00000001') OR contains(lower(c_mktsegment), 'mach')")
def text_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    return rows.where(D.contains_any(["c_name", "c_mktsegment", "c_custkey"], "ER#00000001") | D.contains_any(["c_mktsegment"], "Mach")).select("c_custkey", "c_name")


GATE = f"""g AS (SELECT symbol, bar, close > lag(close, 24) OVER {OVER} AS up, CASE WHEN n % 5 > 0 THEN (buy / nullif(volume, 0) - 0.4) / 10 END AS rate, close < avg(close) OVER {last(20)} AS weak, lag(close, 24) OVER {OVER} IS NOT NULL AS known FROM bars),
 s AS (SELECT symbol, bar, side, CASE WHEN NOT known THEN 0 WHEN up THEN 1 ELSE -1 END AS trend, rate, weak FROM g, (VALUES ('L'), ('S')) v(side)),
 d AS (SELECT *, CASE WHEN side = 'L' AND trend <> 1 THEN 'trend not up' WHEN side = 'L' AND rate > 0.01 THEN 'overheated' WHEN side = 'L' THEN 'ok' WHEN NOT (trend <= 0 OR weak) THEN 'trend not down' WHEN rate IS NULL THEN 'no history' WHEN rate <= 0 THEN 'rate not positive' ELSE 'ok' END AS reason FROM s)"""


def gate(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    old = F.lag("close", 24).over(W.order())
    rate = F.when(F.col("n") % 5 > 0, (F.col("buy") / F.nullif(F.col("volume"), F.lit(0.0)) - 0.4) / 10)
    trend = D.ladder((old.isNull(), 0), (F.col("close") > old, 1), otherwise=-1)
    marked = bars.select("symbol", "bar", trend.alias("trend"), rate.alias("rate"), (F.col("close") < F.avg("close").over(W.last(20))).alias("weak"))
    return marked.withColumn("side", F.explode(F.array(F.lit("L"), F.lit("S"))))


@query("entry_gate", f"WITH {BARS}, {GATE} SELECT symbol, bar, side, reason = 'ok' AS allowed, reason FROM d")
def entry_gate(spark, sf_dir):
    allowed, reason = D.entry(F.col("side"), F.col("trend"), F.col("rate"), 0.01, F.col("weak"))
    return gate(spark, sf_dir).select("symbol", "bar", "side", allowed.alias("allowed"), reason.alias("reason"))


@query("rule_modes", f"WITH {BARS}, {GATE} SELECT mode, count(*) AS n, count(*) FILTER (CASE mode WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'A|B' THEN a OR b ELSE a AND b END) AS passed FROM (SELECT coalesce(trend = 1, FALSE) AS a, coalesce(rate > 0, FALSE) AS b FROM d), (VALUES ('A'), ('B'), ('A|B'), ('A&B')) m(mode) GROUP BY 1")
def rule_modes(spark, sf_dir):
    modes = ["A", "B", "A|B", "A&B"]
    rows = gate(spark, sf_dir).select(*(D.rule(F.col("trend") == 1, F.col("rate") > 0, m).alias(m) for m in modes))
    counts = rows.agg(F.count("*").alias("n"), *(F.count_if(F.col(f"`{m}`")).alias(f"p{i}") for i, m in enumerate(modes)))
    return counts.select("n", F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.col(f"p{i}").alias("passed")) for i, m in enumerate(modes)))).alias("x")).select("x.mode", "n", "x.passed")


FILTERS = {
    "CROWD_LONG": ("side = 'S'", "rate > 0"),
    "CROWD_SHORT": ("side = 'L'", "rate < 0"),
    "WEAK_LONG": ("side = 'L'", "weak"),
    "STRONG_SHORT": ("side = 'S'", "trend = 1"),
    "WEEKEND": ("TRUE", "isodow(bar) >= 6"),
    "LAGGARD": ("symbol <> 'view'", "trend < 0 AND rate < 0"),
}
LIST = " UNION ALL ".join(f"SELECT symbol, bar, side, '{k}' AS filter, NOT coalesce(({a}) AND ({c}), FALSE) AS kept FROM s" for k, (a, c) in FILTERS.items())


@query("situation_filters", f"WITH {BARS}, {GATE} {LIST}")
def situation_filters(spark, sf_dir):
    """A catalogue of filters with three-valued conditions: an unknown one keeps the row."""
    c = F.col
    return D.passed(
        gate(spark, sf_dir),
        {
            "CROWD_LONG": (c("side") == "S", c("rate") > 0),
            "CROWD_SHORT": (c("side") == "L", c("rate") < 0),
            "WEAK_LONG": (c("side") == "L", c("weak")),
            "STRONG_SHORT": (c("side") == "S", c("trend") == 1),
            "WEEKEND": (F.lit(True), F.weekday("bar") >= 5),
            "LAGGARD": (c("symbol") != "view", (c("trend") < 0) & (c("rate") < 0)),
        },
    ).select("symbol", "bar", "side", "filter", "kept")


@query("segments", "SELECT CASE WHEN o_custkey % 7 = 0 THEN 'UNSEEN' WHEN o_orderdate < TIMESTAMP '1994-01-01' THEN 'OLD' WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'DEV' WHEN o_orderdate < TIMESTAMP '1997-06-01' THEN 'VAL' ELSE 'FINAL' END AS segment, count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY 1")
def segments(spark, sf_dir):
    name = D.segment(F.col("o_orderdate"), [("OLD", "1994-01-01"), ("DEV", "1996-01-01"), ("VAL", "1997-06-01")], F.col("o_custkey") % 7 == 0)
    return table(spark, sf_dir, "orders").groupBy(name.alias("segment")).agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


TOTAL = "a * 0.4::DOUBLE + b * 0.35::DOUBLE + c * 0.25::DOUBLE"


@query("confluence", f"SELECT l_orderkey, l_linenumber, CASE WHEN a = 0 OR b = 0 OR c = 0 THEN 0 ELSE round({TOTAL}, 6) END AS score, CASE WHEN a = 0 OR b = 0 OR c = 0 THEN 'REJECT' WHEN {TOTAL} >= 0.6 THEN 'PASS' WHEN {TOTAL} >= 0.45 THEN 'ADJUST' ELSE 'REJECT' END AS verdict FROM (SELECT l_orderkey, l_linenumber, l_discount * 10 AS a, coalesce(CASE WHEN l_quantity > 5 THEN l_quantity / 50 END, 0.5) AS b, l_tax * 12.5::DOUBLE AS c FROM lineitem)")
def confluence(spark, sf_dir):
    total, verdict = D.confluence({"a": (F.col("l_discount") * 10, 0.4), "b": (F.when(F.col("l_quantity") > 5, F.col("l_quantity") / 50), 0.35), "c": (F.col("l_tax") * 12.5, 0.25)}, 0.6, 0.45)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(total, 6).alias("score"), verdict.alias("verdict"))


@query("clean_settings", "SELECT s_suppkey, greatest(0, least(5000, coalesce(CASE WHEN s_suppkey % 9 > 0 THEN s_acctbal END, 100)))::DOUBLE AS risk FROM supplier")
def clean_settings(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", D.clamped(F.when(F.col("s_suppkey") % 9 > 0, F.col("s_acctbal")), 0.0, 5000.0, 100.0).alias("risk"))


@query("setup_columns", "SELECT l_orderkey, l_linenumber, round((l_extendedprice * 1.1::DOUBLE - l_extendedprice) / (l_extendedprice * l_discount), 6) AS rr, round(l_discount * 100, 4) AS dist_pct, CASE l_returnflag WHEN 'A' THEN 0.2 WHEN 'N' THEN 0.05 END AS exp_r FROM lineitem WHERE l_discount > 0")
def setup_columns(spark, sf_dir):
    """Computed columns of setups: reward over risk, distance in percent, and an expectation looked up in a map."""
    price, stop = F.col("l_extendedprice"), F.col("l_extendedprice") * F.col("l_discount")
    table_ = F.create_map(F.lit("A"), F.lit(0.2), F.lit("N"), F.lit(0.05))
    rows = table(spark, sf_dir, "lineitem").where("l_discount > 0")
    return rows.select("l_orderkey", "l_linenumber", F.round((price * 1.1 - price) / stop, 6).alias("rr"), F.round(F.col("l_discount") * 100, 4).alias("dist_pct"), F.try_element_at(table_, F.col("l_returnflag")).alias("exp_r"))


