"""Registered queries of recurrences; their SQL is a recursive table that takes one bar of each symbol at a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickframe.operators import parallel as P
from tickframe.operators import recursive as R
from tickframe.plans.queries import BARS, ORACLE_SQL, RACE, TICKS, frame, hourly, query, race, rounded, ticks

N = """n AS MATERIALIZED (SELECT *, row_number() OVER o AS i, lag(close) OVER o AS pc, greatest(high - low, abs(high - coalesce(lag(close) OVER o, close)), abs(low - coalesce(lag(close) OVER o, close))) AS tr
 FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY bar))"""


def recursion(source: str, states: dict[str, tuple[str, str]], rec: str = "rec", rows: str = "n") -> str:
    """The table rec: of each state its value at the first row of n (or another table of rows) and at a later one, which may use r (the row before), n and, by name with q_, states above it."""
    first = ", ".join(f"({a})::{'DOUBLE' if not k.startswith('k_') else 'INT'} AS {k}" for k, (a, _) in states.items())
    later = ", ".join(f"({b})::{'DOUBLE' if not k.startswith('k_') else 'INT'} AS q_{k}" for k, (_, b) in states.items())
    names = ", ".join(f"q_{k}" for k in states)
    return f"{source}, {rec} AS (SELECT symbol, bar, i, {first} FROM {rows} WHERE i = 1 UNION ALL SELECT symbol, bar, i, {names} FROM (SELECT n.symbol, n.bar, n.i, {later} FROM {rec} r JOIN {rows} n ON n.symbol = r.symbol AND n.i = r.i + 1))"


def recurrence(name, f, columns, states, select, to=6):
    """A query that applies f to hourly bars, with a recursive table as its SQL."""
    frame(name, f, columns, "", to)
    ORACLE_SQL[name] = f"WITH RECURSIVE {BARS}, {recursion(N, states)} SELECT symbol, bar, {select} FROM rec"


def r(*names, to=6):
    return ", ".join(f"round({n}, {to}) AS {n}" for n in names)


def mean(x, weight, old):
    return f"r.{old} + {weight} * (({x}) - r.{old})"


W14, W10, E14, E20 = "(1.0::DOUBLE / 14)", "(1.0::DOUBLE / 10)", "(2.0::DOUBLE / 15)", "(2.0::DOUBLE / 21)"

recurrence(
    "seeded_ema",
    lambda b: P.seeded_ema(b, 20),
    ["sema20"],
    {"sema20": ("(SELECT avg(m.close) FROM n m WHERE m.symbol = n.symbol AND m.i <= 20)", f"CASE WHEN n.i <= 20 THEN r.sema20 ELSE {mean('n.close', E20, 'sema20')} END")},
    r("sema20"),
)
recurrence(
    "atr_kinds",
    P.atr_kinds,
    ["rma", "wilder", "exp", "lagged", "sma"],
    {
        "sma": ("0", f"CASE WHEN n.i <= 15 THEN r.sma + n.tr / 14 ELSE {mean('n.tr', E14, 'sma')} END"),
        "rma": ("tr", mean("n.tr", W14, "rma")),
        "w": ("NULL", f"coalesce({mean('n.tr', W14, 'w')}, n.tr)"),
        "exp": ("tr", mean("n.tr", E14, "exp")),
        "slow": ("tr", mean("n.tr", E20, "slow")),
        "lagged": ("NULL", "r.slow"),
    },
    r("rma", "exp", "lagged") + ", CASE WHEN i > 14 THEN round(w, 6) END AS wilder, CASE WHEN i > 14 THEN round(sma, 6) END AS sma",
)
recurrence(
    "rsi_seeded",
    P.seeded_rsi,
    ["srsi"],
    {
        "up": ("0", "CASE WHEN n.i <= 15 THEN r.up + greatest(n.close - n.pc, 0) / 14 ELSE (r.up * 13 + greatest(n.close - n.pc, 0)) / 14 END"),
        "down": ("0", "CASE WHEN n.i <= 15 THEN r.down + greatest(n.pc - n.close, 0) / 14 ELSE (r.down * 13 + greatest(n.pc - n.close, 0)) / 14 END"),
    },
    "CASE WHEN i >= 15 AND up + down > 0 THEN round(100 * up / (up + down), 6) END AS srsi",
)
UP, DOWN = "(n.high - r.h)", "(r.l - n.low)"
recurrence(
    "directional_index",
    P.directional,
    ["pdi", "mdi", "adx"],
    {
        "h": ("high", "n.high"),
        "l": ("low", "n.low"),
        "p": ("0", mean(f"CASE WHEN {UP} > {DOWN} AND {UP} > 0 THEN {UP} ELSE 0 END", W14, "p")),
        "m": ("0", mean(f"CASE WHEN {DOWN} > {UP} AND {DOWN} > 0 THEN {DOWN} ELSE 0 END", W14, "m")),
        "t": ("tr", mean("n.tr", W14, "t")),
        "pdi": ("0", "100 * q_p / greatest(q_t, 1e-12)"),
        "mdi": ("0", "100 * q_m / greatest(q_t, 1e-12)"),
        "adx": ("0", mean("100 * abs(q_pdi - q_mdi) / greatest(q_pdi + q_mdi, 1e-12)", W14, "adx")),
    },
    r("pdi", "mdi", "adx"),
)
recurrence(
    "macd",
    P.macd,
    ["macd", "signal", "hist"],
    {
        "a": ("close", mean("n.close", "(2.0::DOUBLE / 13)", "a")),
        "b": ("close", mean("n.close", "(2.0::DOUBLE / 27)", "b")),
        "signal": ("0", mean("q_a - q_b", "(2.0::DOUBLE / 10)", "signal")),
    },
    "round(a - b, 6) AS macd, round(signal, 6) AS signal, round(a - b - signal, 6) AS hist",
)
recurrence(
    "supertrend",
    R.supertrend,
    ["band_top", "band_floor", "trend"],
    {
        "a": ("tr", mean("n.tr", W10, "a")),
        "band_top": ("(high + low) / 2 + 3 * tr", "CASE WHEN (n.high + n.low) / 2 + 3 * q_a < r.band_top OR n.pc > r.band_top THEN (n.high + n.low) / 2 + 3 * q_a ELSE r.band_top END"),
        "band_floor": ("(high + low) / 2 - 3 * tr", "CASE WHEN (n.high + n.low) / 2 - 3 * q_a > r.band_floor OR n.pc < r.band_floor THEN (n.high + n.low) / 2 - 3 * q_a ELSE r.band_floor END"),
        "k_trend": ("1", "CASE WHEN n.close > r.band_top THEN 1 WHEN n.close < r.band_floor THEN -1 ELSE r.k_trend END"),
    },
    r("band_top", "band_floor") + ", k_trend AS trend",
)
LINE = "(r.sar + r.pace * (r.best - r.sar))"
recurrence(
    "parabolic_sar",
    R.parabolic,
    ["sar", "side"],
    {
        "h1": ("high", "n.high"),
        "h2": ("high", "r.h1"),
        "l1": ("low", "n.low"),
        "l2": ("low", "r.l1"),
        "line": ("low", f"CASE WHEN r.k_side > 0 THEN least({LINE}, r.l1, r.l2) ELSE greatest({LINE}, r.h1, r.h2) END"),
        "flip": ("0", "CASE WHEN (r.k_side > 0 AND n.low < q_line) OR (r.k_side < 0 AND n.high > q_line) THEN 1 ELSE 0 END"),
        "sar": ("low", "CASE WHEN q_flip = 1 THEN r.best ELSE q_line END"),
        "ahead": ("0", "CASE WHEN r.k_side > 0 THEN n.high > r.best ELSE n.low < r.best END::INT"),
        "best": ("high", "CASE WHEN q_flip = 1 THEN CASE WHEN r.k_side > 0 THEN n.low ELSE n.high END WHEN q_ahead = 1 THEN CASE WHEN r.k_side > 0 THEN n.high ELSE n.low END ELSE r.best END"),
        "pace": ("0.02", "CASE WHEN q_flip = 1 THEN 0.02 WHEN q_ahead = 1 THEN least(r.pace + 0.02::DOUBLE, 0.2) ELSE r.pace END"),
        "k_side": ("1", "CASE WHEN q_flip = 1 THEN -r.k_side ELSE r.k_side END"),
    },
    r("sar") + ", k_side AS side",
)
recurrence(
    "heikin_ashi",
    P.heikin_ashi,
    ["ha_open", "ha_close"],
    {"ha_open": ("(open + close) / 2", "(r.ha_open + r.ha_close) / 2"), "ha_close": ("(open + high + low + close) / 4", "(n.open + n.high + n.low + n.close) / 4")},
    r("ha_open", "ha_close"),
)
recurrence(
    "kalman_trend",
    P.kalman_trend,
    ["z", "level", "dev"],
    {
        "y": ("ln(close)", "ln(n.close)"),
        "v": ("NULL", "CASE WHEN r.v IS NULL THEN pow(q_y - r.y, 2) ELSE r.v + (2.0::DOUBLE / 101) * (pow(q_y - r.y, 2) - r.v) END"),
        "x": ("ln(close)", "r.x + r.s + (r.a + 2 * r.b + r.d) / (r.a + 2 * r.b + r.d + greatest(q_v, 1e-10)) * (q_y - r.x - r.s)"),
        "s": ("0", "r.s + (r.b + r.d) / (r.a + 2 * r.b + r.d + greatest(q_v, 1e-10)) * (q_y - r.x - r.s)"),
        "a": ("1", "(r.a + 2 * r.b + r.d) * (1 - (r.a + 2 * r.b + r.d) / (r.a + 2 * r.b + r.d + greatest(q_v, 1e-10)))"),
        "b": ("0", "(r.b + r.d) * (1 - (r.a + 2 * r.b + r.d) / (r.a + 2 * r.b + r.d + greatest(q_v, 1e-10)))"),
        "d": ("1", "r.d + 1e-4 * greatest(q_v, 1e-10) - pow(r.b + r.d, 2) / (r.a + 2 * r.b + r.d + greatest(q_v, 1e-10))"),
        "e": ("NULL", "CASE WHEN r.e IS NULL THEN pow(q_y - q_x, 2) ELSE r.e + (2.0::DOUBLE / 101) * (pow(q_y - q_x, 2) - r.e) END"),
    },
    "CASE WHEN i > 101 THEN round(s / sqrt(greatest(d, 1e-18)), 4) END AS z, round(exp(x), 4) AS level, CASE WHEN i > 101 THEN round((y - x) / sqrt(greatest(e, 1e-18)), 4) END AS dev",
    to=4,
)
recurrence(
    "shock_excitation",
    P.excitation,
    ["heat", "heat_way"],
    {
        "a": ("tr", mean("n.tr", W14, "a")),
        "m": ("0", "(n.close - n.pc) / greatest(q_a, 1e-12)"),
        "heat": ("0", "exp(-1.0::DOUBLE / 8) * r.heat + CASE WHEN abs(q_m) > 2 THEN 1 ELSE 0 END"),
        "heat_way": ("0", "exp(-1.0::DOUBLE / 8) * r.heat_way + CASE WHEN abs(q_m) > 2 THEN sign(q_m) ELSE 0 END"),
    },
    r("heat", "heat_way"),
)
recurrence(
    "ew_variance",
    P.spread,
    ["ewvar", "sigma_before"],
    {
        "y": ("ln(close)", "ln(n.close)"),
        "v": ("NULL", "CASE WHEN r.v IS NULL THEN pow(q_y - r.y, 2) ELSE r.v + (2.0::DOUBLE / 101) * (pow(q_y - r.y, 2) - r.v) END"),
        "ewvar": ("1e-10", "greatest(q_v, 1e-10)"),
        "sigma_before": ("NULL", "sqrt(r.ewvar)"),
    },
    r("ewvar", "sigma_before"),
)
ROOT = "exp(-1.414::DOUBLE * pi() / 10)"
TURN = f"(2 * {ROOT} * cos(1.414::DOUBLE * pi() / 10))"
G = "0.7::DOUBLE"
frame("filter_bank", R.smoothers, ["smooth", "kama", "laguerre", "zlema"], "")
FILTERS = {
    "smooth": ("close", f"CASE WHEN n.i = 2 THEN n.close ELSE (1 - {TURN} + {ROOT} * {ROOT}) * (n.close + n.pc) / 2 + {TURN} * r.smooth - {ROOT} * {ROOT} * r.smooth2 END"),
    "smooth2": ("close", "r.smooth"),
    "kama": ("close", "CASE WHEN n.i <= 10 THEN n.close ELSE r.kama + pow(CASE WHEN n.path > 0 THEN n.net / n.path ELSE 0 END * (2.0::DOUBLE / 3 - 2.0::DOUBLE / 31) + 2.0::DOUBLE / 31, 2) * (n.close - r.kama) END"),
    "l0": ("close", f"(1 - {G}) * n.close + {G} * r.l0"),
    "l1": ("close", f"-{G} * q_l0 + r.l0 + {G} * r.l1"),
    "l2": ("close", f"-{G} * q_l1 + r.l1 + {G} * r.l2"),
    "l3": ("close", f"-{G} * q_l2 + r.l2 + {G} * r.l3"),
    "zlema": ("close", "r.zlema + (2.0::DOUBLE / 11) * (CASE WHEN n.i > 4 THEN 2 * n.close - n.back ELSE n.close END - r.zlema)"),
}
PATH = N.replace("FROM bars WINDOW", ", abs(close - lag(close, 10) OVER o) AS net, lag(close, 4) OVER o AS back FROM bars WINDOW").replace("n AS MATERIALIZED", "n0 AS")
PATH += ", n AS MATERIALIZED (SELECT *, sum(abs(close - pc)) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS path FROM n0)"
ORACLE_SQL["filter_bank"] = f"WITH RECURSIVE {BARS}, {recursion(PATH, FILTERS)} SELECT symbol, bar, {r('smooth', 'kama', 'zlema')}, round((l0 + 2 * l1 + 2 * l2 + l3) / 6, 6) AS laguerre FROM rec"


def with_unit(spark, sf_dir):
    return R.atr_kinds(hourly(spark, sf_dir)).withColumnRenamed("rma", "unit")


SWING = {
    "unit": ("tr", mean("n.tr", W14, "unit")),
    "way": ("0", "CASE WHEN q_turn > 0 THEN -1 WHEN q_turn < 0 THEN 1 ELSE r.way END"),
    "turn": ("0", "CASE WHEN r.way >= 0 AND (CASE WHEN r.way = 0 THEN q_ti < n.i ELSE NOT n.high > r.t END) AND q_tt - n.low >= 3 * q_unit THEN 1 WHEN r.way <= 0 AND (CASE WHEN r.way = 0 THEN q_fi < n.i ELSE NOT n.low < r.f END) AND n.high - q_ff >= 3 * q_unit THEN -1 ELSE 0 END"),
    "tt": ("high", "CASE WHEN r.way >= 0 AND n.high > r.t THEN n.high ELSE r.t END"),
    "ti": ("1", "CASE WHEN r.way >= 0 AND n.high > r.t THEN n.i ELSE r.tn END"),
    "ff": ("low", "CASE WHEN r.way <= 0 AND n.low < r.f THEN n.low ELSE r.f END"),
    "fi": ("1", "CASE WHEN r.way <= 0 AND n.low < r.f THEN n.i ELSE r.fn END"),
    "t": ("high", "CASE WHEN q_turn < 0 THEN n.high ELSE q_tt END"),
    "tn": ("1", "CASE WHEN q_turn < 0 THEN n.i ELSE q_ti END"),
    "f": ("low", "CASE WHEN q_turn > 0 THEN n.low ELSE q_ff END"),
    "fn": ("1", "CASE WHEN q_turn > 0 THEN n.i ELSE q_fi END"),
}
SWING = {k: SWING[k] for k in ("unit", "tt", "ti", "ff", "fi", "turn", "way", "t", "tn", "f", "fn")}


@query("swing_turns", f"WITH RECURSIVE {BARS}, {recursion(N, SWING)} SELECT r.symbol, n.bar, round(CASE WHEN r.turn > 0 THEN r.tt ELSE r.ff END, 6) AS price, r.turn::INT AS kind, r.bar AS confirmed FROM rec r JOIN n ON n.symbol = r.symbol AND n.i = CASE WHEN r.turn > 0 THEN r.ti ELSE r.fi END WHERE r.turn <> 0")
def swing_turns(spark, sf_dir):
    return rounded(R.swings(with_unit(spark, sf_dir)), "symbol", "bar", "price", "kind", "confirmed")


@query("zigzag")
def zigzag(spark, sf_dir):
    """Turns that a close confirms, three mean true ranges off the extreme; tested against a search over all bars."""
    return R.zigzag(with_unit(spark, sf_dir))


@query(
    "cooldown",
    f'WITH RECURSIVE {TICKS}, n AS MATERIALIZED (SELECT symbol, epoch_us(ts) / 1e6 AS "at", id, row_number() OVER (PARTITION BY symbol ORDER BY ts, id) AS i FROM ticks), rec AS (SELECT symbol, i, "at", id, TRUE AS keep, "at" + 21600 AS free FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.i, n."at", n.id, n."at" >= r.free, CASE WHEN n."at" >= r.free THEN n."at" + 21600 ELSE r.free END FROM rec r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1) SELECT symbol, "at", id FROM rec WHERE keep',
)
def cooldown(spark, sf_dir):
    """Ticks at least six hours after the last kept one of their symbol."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return R.cooled(ticks(spark, sf_dir).select("symbol", at.alias("at"), "id"), 6 * 3600.0)


@query(
    "non_overlap",
    f"{RACE.replace('WITH ticks', 'WITH RECURSIVE ticks', 1)}, e AS (SELECT symbol, bar AS entry, bar + INTERVAL 1 hour * coalesce(least(hit, lost), 24) AS exit, r FROM trades), q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY entry, exit) AS i FROM e), rec AS (SELECT symbol, i, entry, exit, r, TRUE AS keep, exit AS free FROM q WHERE i = 1 UNION ALL SELECT q.symbol, q.i, q.entry, q.exit, q.r, q.entry >= p.free, CASE WHEN q.entry >= p.free THEN q.exit ELSE p.free END FROM rec p JOIN q ON q.symbol = p.symbol AND q.i = p.i + 1) SELECT symbol, entry, exit, r FROM rec WHERE keep",
)
def non_overlap(spark, sf_dir):
    hours = F.coalesce(F.least("hit", "lost"), F.lit(24)).cast("int")
    trades = race(spark, sf_dir).select("symbol", F.col("bar").alias("entry"), (F.col("bar") + F.make_dt_interval(F.lit(0), hours)).alias("exit"), "r")
    return R.without_overlap(trades)


@query(
    "dollar_bars",
    f"WITH RECURSIVE {TICKS}, v AS (SELECT symbol, ts, id, price, price * size AS value, sum(price * size) OVER (PARTITION BY symbol, date_trunc('day', ts)) / 6 AS cut FROM ticks), n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, id) AS i FROM v), rec AS (SELECT symbol, i, 0::BIGINT AS number, (value >= cut)::BIGINT AS next, CASE WHEN value >= cut THEN 0 ELSE value END AS total FROM n WHERE i = 1 UNION ALL SELECT symbol, i, own, own + full_, CASE WHEN full_ = 1 THEN 0 ELSE sum_ END FROM (SELECT n.symbol, n.i, r.next AS own, r.total + n.value AS sum_, (r.total + n.value >= n.cut)::BIGINT AS full_ FROM rec r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1)) SELECT symbol, number, count(*) AS n, min(ts) AS begins, arg_min(price, (ts, id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, id)) AS close, round(sum(value), 4) AS value FROM rec JOIN n USING (symbol, i) GROUP BY 1, 2",
)
def dollar_bars(spark, sf_dir):
    """Bars that end once their traded value reaches a sixth of their day's."""
    own = ticks(spark, sf_dir).withColumn("value", F.col("price") * F.col("size")).withColumn("day", F.to_date("ts"))
    cuts = own.groupBy("symbol", "day").agg((F.sum("value") / 6).alias("cut"))
    marked = R.threshold_bars(own.join(cuts, ["symbol", "day"]).select("symbol", "ts", "id", "price", "value", "cut"), "cut")
    at = F.struct("ts", "id")
    out = marked.groupBy("symbol", "number").agg(F.count("*").alias("n"), F.min("ts").alias("begins"), F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("value").alias("value"))
    return out.withColumn("value", F.round("value", 4))

