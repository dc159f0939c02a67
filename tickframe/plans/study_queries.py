"""Registered queries of studies: structure, scored rules, masks, and what follows them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickframe.operators import aggregates as A
from tickframe.operators import frames as W
from tickframe.operators import joins as J
from tickframe.operators import parallel as P
from tickframe.operators import profiles as V
from tickframe.operators import quantiles as Q
from tickframe.operators import recursive as R
from tickframe.plans.outcome_queries import ATR, NUMBERED, paths
from tickframe.plans.queries import BARS, ORACLE_SQL, OVER, RACE, before, frame, hourly, last, query, race, rounded, table
from tickframe.plans.recurrences import N, mean, recursion
from tickframe.plans.reports import NEXT, ahead

PIVOTS = f"p AS (SELECT symbol, bar, close, CASE WHEN count(*) OVER l = 3 AND count(*) OVER r = 3 AND high > max(high) OVER l AND high > max(high) OVER r THEN high END AS t, CASE WHEN count(*) OVER l = 3 AND count(*) OVER r = 3 AND low < min(low) OVER l AND low < min(low) OVER r THEN low END AS f FROM bars WINDOW l AS {before(3)}, r AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)), k AS (SELECT symbol, bar, close, lag(t, 3) OVER {OVER} AS t, lag(f, 3) OVER {OVER} AS f FROM p), n AS MATERIALIZED (SELECT symbol, bar, close, last_value(t IGNORE NULLS) OVER {OVER} AS top, last_value(f IGNORE NULLS) OVER {OVER} AS floor_, row_number() OVER {OVER} AS i FROM k)"
WAY = "CASE WHEN n.top IS NOT NULL AND n.top IS DISTINCT FROM r.dt AND n.close > n.top THEN 1 WHEN n.floor_ IS NOT NULL AND n.floor_ IS DISTINCT FROM r.df AND n.close < n.floor_ THEN -1 ELSE 0 END"
STRUCTURE = {
    "way": ("0", WAY),
    "trend": ("0", "CASE WHEN q_way <> 0 THEN q_way ELSE r.trend END"),
    "turn": ("0", "CASE WHEN q_way = 0 THEN 0 WHEN r.trend = -q_way THEN 2 ELSE 1 END"),
    "dt": ("NULL", "CASE WHEN q_way > 0 THEN n.top ELSE r.dt END"),
    "df": ("NULL", "CASE WHEN q_way < 0 THEN n.floor_ ELSE r.df END"),
}


@query("structure_breaks", f"WITH RECURSIVE {BARS}, {recursion(PIVOTS, STRUCTURE)} SELECT rec.symbol, rec.bar, CASE turn WHEN 1 THEN 'BOS' WHEN 2 THEN 'CHOCH' END AS event, trend::INT AS trend, CASE WHEN top > floor_ THEN round((close - floor_) / (top - floor_), 6) END AS place FROM rec JOIN n USING (symbol, bar)")
def structure_breaks(spark, sf_dir):
    return rounded(R.structure(W.last_pivots(hourly(spark, sf_dir))), "symbol", "bar", "event", "trend", "place")


frame(
    "rms_normed",
    lambda b: P.normed(W.returns(b), 50),
    ["normed"],
    "",
)
NORM = {"v": ("NULL", "CASE WHEN r.v IS NULL THEN pow(ln(n.close / n.pc), 2) ELSE r.v + (2.0::DOUBLE / 51) * (pow(ln(n.close / n.pc), 2) - r.v) END")}
ORACLE_SQL["rms_normed"] = f"WITH RECURSIVE {BARS}, {recursion(N, NORM)} SELECT rec.symbol, rec.bar, CASE WHEN v > 0 THEN round(ln(n.close / n.pc) / sqrt(v), 6) END AS normed FROM rec JOIN n USING (symbol, bar)"


@query("level_tests", f"WITH {BARS}, l AS (SELECT symbol, round(median(close), 2) AS level FROM bars GROUP BY 1), t AS (SELECT b.symbol, bar, row_number() OVER {OVER} AS i, low <= level AND high >= level AS hit, level FROM bars b JOIN l USING (symbol)), h AS (SELECT symbol, level, i, CASE WHEN i - lag(i) OVER (PARTITION BY symbol ORDER BY i) <= 3 THEN 0 ELSE 1 END AS st FROM t WHERE hit) SELECT symbol, level, count(*) AS touches, sum(st)::BIGINT AS waves FROM h GROUP BY 1, 2")
def level_tests(spark, sf_dir):
    """How often a level is touched, and in how many waves: touches more than two bars apart."""
    rows = hourly(spark, sf_dir)
    level = Q.percentiles(rows, ["symbol"], "close", [0.5]).select("symbol", F.round("value", 2).alias("level"))
    hit = rows.withColumn("i", F.row_number().over(W.order())).join(level, "symbol").where("low <= level and high >= level")
    new = F.coalesce(F.col("i") - F.lag("i").over(Window.partitionBy("symbol").orderBy("i")) > 3, F.lit(True))
    return hit.withColumn("st", new.cast("long")).groupBy("symbol", "level").agg(F.count("*").alias("touches"), F.sum("st").alias("waves"))


LENGTHS = (5, 10, 20, 50, 100)
frame(
    "resonance",
    lambda b: b.withColumn("agree", sum((F.signum(F.col("close") - F.avg("close").over(W.last(n))) for n in LENGTHS), F.lit(0.0)).cast("int")),
    ["agree"],
    "SELECT symbol, bar, (" + " + ".join(f"sign(close - avg(close) OVER {last(n)})" for n in LENGTHS) + ")::INT AS agree FROM bars",
)
frame(
    "base_series",
    lambda b: b.withColumns(
        {
            "mom": F.log(F.col("close") / F.lag("close", 6).over(W.order())),
            "speed": F.col("close") - 2 * F.lag("close", 3).over(W.order()) + F.lag("close", 6).over(W.order()),
            "body": (F.col("close") - F.col("open")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)),
            "upper_wick": (F.col("high") - F.greatest("open", "close")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)),
            "displacement": F.abs(F.col("close") - F.col("open")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * F.col("volume") / F.nullif(F.avg("volume").over(W.before(24)), F.lit(0.0)),
            "imbalance": (2 * F.col("buy") - F.col("volume")) / F.nullif(F.col("volume"), F.lit(0.0)),
        }
    ),
    ["mom", "speed", "body", "upper_wick", "displacement", "imbalance"],
    f"SELECT symbol, bar, round(ln(close / lag(close, 6) OVER {OVER}), 6) AS mom, round(close - 2 * lag(close, 3) OVER {OVER} + lag(close, 6) OVER {OVER}, 6) AS speed, round((close - open) / nullif(high - low, 0), 6) AS body, round((high - greatest(open, close)) / nullif(high - low, 0), 6) AS upper_wick, round(abs(close - open) / nullif(high - low, 0) * volume / nullif(avg(volume) OVER {before(24)}, 0), 6) AS displacement, round((2 * buy - volume) / nullif(volume, 0), 6) AS imbalance FROM bars",
)

SCORES = {
    "narrow": ("(max(high) OVER w - min(low) OVER w) / avg(close) OVER w", "v < 2 THEN 20 WHEN v < 4 THEN 10"),
    "quiet": ("volume / nullif(avg(volume) OVER w, 0)", "v < 0.5 THEN 20 WHEN v < 1 THEN 10"),
    "flat": ("abs(close / lag(close, 24) OVER o - 1)", "v < 0.2 THEN 20 WHEN v < 0.5 THEN 10"),
    "centred": ("abs(close - (max(high) OVER w + min(low) OVER w) / 2) / nullif(max(high) OVER w - min(low) OVER w, 0)", "v < 0.15 THEN 20 WHEN v < 0.3 THEN 10"),
    "balanced": ("abs(2 * sum(buy) OVER w - sum(volume) OVER w) / nullif(sum(volume) OVER w, 0)", "v < 0.1 THEN 20 WHEN v < 0.25 THEN 10"),
}


@query("phase_scores", f"WITH {BARS}, v AS (SELECT symbol, bar, " + ", ".join(f"{e} AS {k}" for k, (e, _) in SCORES.items()) + f" FROM bars WINDOW w AS {last(24)}, o AS {OVER}) SELECT symbol, bar, (" + " + ".join(f"CASE WHEN {t.replace('v <', f'{k} <')} ELSE 0 END" for k, (_, t) in SCORES.items()) + ")::INT AS score FROM v")
def phase_scores(spark, sf_dir):
    """Accumulation score of 0 to 100 from five components."""
    rows, w, o = hourly(spark, sf_dir), W.last(24), W.order()
    high, low = F.max("high").over(w), F.min("low").over(w)
    v = rows.withColumns(
        {
            "narrow": (high - low) / F.avg("close").over(w),
            "quiet": F.col("volume") / F.nullif(F.avg("volume").over(w), F.lit(0.0)),
            "flat": F.abs(F.col("close") / F.lag("close", 24).over(o) - 1),
            "centred": F.abs(F.col("close") - (high + low) / 2) / F.nullif(high - low, F.lit(0.0)),
            "balanced": F.abs(2 * F.sum("buy").over(w) - F.sum("volume").over(w)) / F.nullif(F.sum("volume").over(w), F.lit(0.0)),
        }
    )
    cuts = {"narrow": (2, 4), "quiet": (0.5, 1), "flat": (0.2, 0.5), "centred": (0.15, 0.3), "balanced": (0.1, 0.25)}
    score = sum((F.when(F.col(k) < a, 20).when(F.col(k) < b, 10).otherwise(0) for k, (a, b) in cuts.items()), F.lit(0))
    return v.select("symbol", "bar", score.cast("int").alias("score"))


DAYS = "g AS (SELECT symbol, date_trunc('day', bar)::TIMESTAMP AS day, max(high) AS h, min(low) AS l, arg_max(close, bar) AS c FROM bars GROUP BY 1, 2)"


@query("level_confluence", f"WITH {BARS}, {DAYS}, {NUMBERED}, {ATR}, j AS (SELECT u.symbol, u.bar, u.close, u.atr, g.h, g.l, g.c, avg(u.close) OVER (PARTITION BY u.symbol ORDER BY u.bar ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m FROM u LEFT JOIN g ON g.symbol = u.symbol AND g.day = date_trunc('day', u.bar) - INTERVAL 1 day) SELECT symbol, bar, (coalesce(abs(close - h) <= 0.25 * atr, FALSE)::INT + coalesce(abs(close - l) <= 0.25 * atr, FALSE)::INT + coalesce(abs(close - c) <= 0.25 * atr, FALSE)::INT + coalesce(abs(close - m) <= 0.25 * atr, FALSE)::INT + coalesce(abs(close - round(close / 10) * 10) <= 0.25 * atr, FALSE)::INT)::INT AS near FROM j WHERE atr IS NOT NULL")
def level_confluence(spark, sf_dir):
    """How many of five levels (yesterday's high, low and close, a mean, a round price) lie within a quarter of the mean range."""
    rows = W.atr(hourly(spark, sf_dir)).withColumn("m", F.avg("close").over(W.last(20)))
    days = rows.groupBy("symbol", F.date_trunc("day", "bar").alias("day")).agg(F.max("high").alias("h"), F.min("low").alias("l"), F.max_by("close", "bar").alias("c"))
    both = rows.withColumn("day", F.date_trunc("day", "bar") - F.expr("interval 1 day")).join(days, ["symbol", "day"], "left").where("atr is not null")
    c, reach = F.col("close"), 0.25 * F.col("atr")
    near = sum((F.coalesce(F.abs(c - x) <= reach, F.lit(False)).cast("int") for x in (F.col("h"), F.col("l"), F.col("c"), F.col("m"), F.round(c / 10) * 10)), F.lit(0))
    return both.select("symbol", "bar", near.alias("near"))


E20 = {"e": ("close", mean("n.close", "(2.0::DOUBLE / 21)", "e")), "a": ("tr", mean("n.tr", "(1.0::DOUBLE / 14)", "a"))}
STRETCH = "(n.close - e) / nullif(a, 0)"


@query("snap_back", f"WITH RECURSIVE {BARS}, {recursion(N, E20)}, s AS (SELECT rec.symbol, rec.bar, {STRETCH} AS s FROM rec JOIN n USING (symbol, bar)), o AS (SELECT *, lag(s) OVER {OVER} AS old FROM s) SELECT symbol, bar, CASE WHEN s > 1.5 THEN -1 ELSE 1 END AS side, round(s, 6) AS stretch FROM o WHERE (s > 1.5 AND coalesce(old, 0) <= 1.5) OR (s < -1.5 AND coalesce(old, 0) >= -1.5)")
def snap_back(spark, sf_dir):
    """Bars that freshly stretch 1.5 mean ranges off their exponential mean."""
    rows = R.atr_kinds(R.ema(hourly(spark, sf_dir), 20)).withColumn("stretch", (F.col("close") - F.col("ema20")) / F.nullif(F.col("rma"), F.lit(0.0)))
    rows = rows.withColumn("old", F.coalesce(F.lag("stretch").over(W.order()), F.lit(0.0)))
    s, old = F.col("stretch"), F.col("old")
    side = F.when((s > 1.5) & (old <= 1.5), -1).when((s < -1.5) & (old >= -1.5), 1)
    return rounded(rows.withColumn("side", side).where("side is not null"), "symbol", "bar", "side", "stretch")


def families(b):
    b = W.session_range(W.vwap(b))
    b = b.withColumns({"width": F.stddev_pop("close").over(W.last(20)) / F.avg("close").over(W.last(20)), "top": F.max("high").over(W.before(20)), "floor": F.min("low").over(W.before(20))})
    b = b.withColumn("tight", F.avg("width").over(W.before(40)))
    c = F.col("close")
    kinds = {
        "range_break": F.when(c > F.col("range_high"), 1).when(c < F.col("range_low"), -1),
        "vwap_fade": F.when(c > F.col("day_vwap") + 1.5 * F.col("day_sd"), -1).when(c < F.col("day_vwap") - 1.5 * F.col("day_sd"), 1),
        "squeeze_break": F.when(F.col("width") < 0.8 * F.col("tight"), F.when(c > F.col("top"), 1).when(c < F.col("floor"), -1)),
    }
    found = F.filter(F.array(*(F.struct(F.lit(k).alias("family"), v.alias("side")) for k, v in kinds.items())), lambda x: x["side"].isNotNull())
    return b.select("symbol", "bar", F.explode(found).alias("x")).select("symbol", "bar", "x.*")


frame(
    "trigger_families",
    families,
    ["family", "side"],
    f", a AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), b AS (SELECT *, CASE WHEN hour(bar) >= 7 THEN max(high) FILTER (hour(bar) < 7) OVER y END AS rh, CASE WHEN hour(bar) >= 7 THEN min(low) FILTER (hour(bar) < 7) OVER y END AS rl, sum(tp * volume) OVER d / nullif(sum(volume) OVER d, 0) AS mu, sum(tp * tp * volume) OVER d / nullif(sum(volume) OVER d, 0) AS sq, stddev_pop(close) OVER w / avg(close) OVER w AS width, max(high) OVER p AS top, min(low) OVER p AS fl FROM a WINDOW y AS (PARTITION BY symbol, date_trunc('day', bar)), d AS (PARTITION BY symbol, date_trunc('day', bar) ORDER BY bar), w AS {last(20)}, p AS {before(20)}), c AS (SELECT *, avg(width) OVER {before(40)} AS tight, sqrt(greatest(0, sq - mu * mu)) AS sd FROM b), k AS (SELECT symbol, bar, 'range_break' AS family, CASE WHEN close > rh THEN 1 WHEN close < rl THEN -1 END AS side FROM c UNION ALL SELECT symbol, bar, 'vwap_fade', CASE WHEN close > mu + 1.5 * sd THEN -1 WHEN close < mu - 1.5 * sd THEN 1 END FROM c UNION ALL SELECT symbol, bar, 'squeeze_break', CASE WHEN width < 0.8 * tight THEN CASE WHEN close > top THEN 1 WHEN close < fl THEN -1 END END FROM c) SELECT * FROM k WHERE side IS NOT NULL",
)

SLICES = {
    "hour_0_8": "hour(bar) < 8",
    "weekend": "isodow >= 6",
    "overreaction": "abs(z) > 2",
    "heavy": "rel > 2",
    "near_high": "place > 0.9",
    "near_low": "place < 0.1",
}
SLICED = f"s AS (SELECT *, isodow(bar) AS isodow, (close / lag(close) OVER {OVER} - 1) / nullif(stddev_pop(close / open - 1) OVER {before(48)}, 0) AS z, volume / nullif(avg(volume) OVER {before(48)}, 0) AS rel, CASE WHEN max(high) OVER {last(48)} > min(low) OVER {last(48)} THEN (close - min(low) OVER {last(48)}) / (max(high) OVER {last(48)} - min(low) OVER {last(48)}) END AS place FROM r)"


@query("anomaly_slices", f"WITH {BARS}, {NEXT}, {SLICED} " + " UNION ALL ".join(f"SELECT symbol, '{k}' AS slice, count(*) AS n, round(avg(fwd), 6) AS mean FROM s WHERE ({c}) AND fwd IS NOT NULL GROUP BY 1" for k, c in SLICES.items()))
def anomaly_slices(spark, sf_dir):
    """The next return in slices of a catalogue: a bar opens a row for each slice it is in."""
    rows = hourly(spark, sf_dir)
    rows = rows.withColumn("body", F.col("close") / F.col("open") - 1).withColumns({"isodow": F.weekday("bar") + 1, "z": (F.col("close") / F.lag("close").over(W.order()) - 1) / F.nullif(F.stddev_pop("body").over(W.before(48)), F.lit(0.0)), "rel": F.col("volume") / F.nullif(F.avg("volume").over(W.before(48)), F.lit(0.0)), "fwd": F.lead("close").over(W.order()) / F.col("close") - 1})
    low, high = F.min("low").over(W.last(48)), F.max("high").over(W.last(48))
    rows = rows.withColumn("place", F.when(high > low, (F.col("close") - low) / (high - low))).where("fwd is not null")
    found = F.array_compact(F.array(*(F.when(F.expr(c), F.lit(k)) for k, c in SLICES.items())))
    return rounded(rows.withColumn("slice", F.explode(found)).groupBy("symbol", "slice").agg(F.count("*").alias("n"), F.avg("fwd").alias("mean")), "symbol", "slice", "n", "mean")


@query("cascade_signature", f"WITH {BARS}, {NUMBERED}, {ATR} SELECT symbol, bar, CASE WHEN close < open THEN 1 ELSE -1 END AS side FROM (SELECT *, avg(volume) OVER {before(24)} AS vm FROM u) WHERE atr > 0 AND high - low >= 1.5 * atr AND volume >= 1.5 * vm AND abs(close - open) >= 0.6 * (high - low) AND (CASE WHEN close < open THEN (close - low) ELSE (high - close) END) <= 0.25 * (high - low)")
def cascade_signature(spark, sf_dir):
    """Forced flow: a wide, heavy, one-way bar that ends at its extreme."""
    rows = W.atr(hourly(spark, sf_dir)).withColumn("vm", F.avg("volume").over(W.before(24)))
    span, down = F.col("high") - F.col("low"), F.col("close") < F.col("open")
    left = F.when(down, F.col("close") - F.col("low")).otherwise(F.col("high") - F.col("close"))
    hit = (F.col("atr") > 0) & (span >= 1.5 * F.col("atr")) & (F.col("volume") >= 1.5 * F.col("vm")) & (F.abs(F.col("close") - F.col("open")) >= 0.6 * span) & (left <= 0.25 * span)
    return rows.where(hit).select("symbol", "bar", F.when(down, 1).otherwise(-1).alias("side"))


MASK = "CASE WHEN buy * 2 > volume THEN 'bought' ELSE 'sold' END"


@query("masked_rates", f"WITH {BARS}, {NEXT}, h AS (SELECT symbol, {MASK} AS mask, fwd, ntile(2) OVER (PARTITION BY symbol ORDER BY bar) AS half FROM x) SELECT symbol, mask, count(*) AS n, round(avg((fwd > 0)::INT), 6) AS win, round(avg((fwd > 0)::INT) FILTER (half = 1), 6) AS first, round(avg((fwd > 0)::INT) FILTER (half = 2), 6) AS second, round(avg(fwd), 6) AS expectancy, round(avg(fwd) * 10000 / 2, 2) AS break_even FROM h GROUP BY 1, 2")
def masked_rates(spark, sf_dir):
    """Win rate under a mask, in both halves of time, with the expectancy and the cost a side may have."""
    rows = ahead(spark, sf_dir).withColumn("mask", F.when(F.col("buy") * 2 > F.col("volume"), "bought").otherwise("sold"))
    rows = rows.withColumn("half", F.ntile(2).over(Window.partitionBy("symbol").orderBy("bar")))
    up = F.when(F.col("fwd") > 0, 1.0).otherwise(0.0)
    g = rows.groupBy("symbol", "mask").agg(F.count("*").alias("n"), F.avg(up).alias("win"), F.avg(F.when(F.col("half") == 1, up)).alias("first"), F.avg(F.when(F.col("half") == 2, up)).alias("second"), F.avg("fwd").alias("expectancy"))
    return rounded(g, "symbol", "mask", "n", "win", "first", "second", "expectancy").join(g.select("symbol", "mask", F.round(F.col("expectancy") * 10000 / 2, 2).alias("break_even")), ["symbol", "mask"])


SIG = f"rr AS (SELECT *, ln(close / lag(close) OVER {OVER}) AS ret FROM n), v AS (SELECT *, CASE WHEN count(ret) OVER w >= 24 THEN stddev_samp(ret) OVER w END AS sg FROM rr WINDOW w AS {last(24)})"
WIDE = paths("close * exp(sg * 2) AS up, close * exp(-sg * 2) AS dn, close * exp(sg) AS us, close * exp(-sg) AS ds", {"lw": "b.high >= a.up", "ll": "b.low <= a.ds", "sw": "b.low <= a.dn", "sl": "b.high >= a.us"}, 12, "sg > 0", "v")


@query("two_way_labels", f"WITH {BARS}, {NUMBERED}, {SIG}, {WIDE} SELECT symbol, bar, CASE WHEN lw = ll THEN NULL WHEN coalesce(lw, 99) < coalesce(ll, 99) THEN 1 WHEN ll IS NOT NULL THEN 0 END AS long, CASE WHEN sw = sl THEN NULL WHEN coalesce(sw, 99) < coalesce(sl, 99) THEN 1 WHEN sl IS NOT NULL THEN 0 END AS short FROM m WHERE seen = 12")
def two_way_labels(spark, sf_dir):
    """Long and short labels with a target of two deviations against a stop of one; null where both or neither is met."""
    rows = W.realised(hourly(spark, sf_dir)).withColumn("_p", J.ahead(12, "high", "low")).where("vol > 0").where(F.size("_p") == 12)
    c, s = F.col("close"), F.col("vol")
    rows = rows.withColumns({"up": c * F.exp(s * 2), "dn": c * F.exp(-s * 2), "us": c * F.exp(s), "ds": c * F.exp(-s)})
    tests = {"lw": lambda x: x["high"] >= F.col("up"), "ll": lambda x: x["low"] <= F.col("ds"), "sw": lambda x: x["low"] <= F.col("dn"), "sl": lambda x: x["high"] >= F.col("us")}
    rows = rows.withColumns({k: J.first_at(F.col("_p"), t) for k, t in tests.items()})

    def label(won, lost):
        a, b = (F.coalesce(F.col(k), F.lit(99).cast("long")) for k in (won, lost))
        return F.when(a < b, 1).when(b < a, 0)

    return rows.select("symbol", "bar", label("lw", "ll").alias("long"), label("sw", "sl").alias("short"))


CHANNEL = f"{N.replace('n AS MATERIALIZED (SELECT *,', 'n AS MATERIALIZED (SELECT *, max(high) OVER (o ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS top, min(low) OVER (o ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS fl,')}"
HELD = {"held": ("0", "CASE WHEN n.close > n.top THEN 1 WHEN n.close < n.fl THEN -1 ELSE r.held END")}


@query("channel_portfolio", f"WITH RECURSIVE {BARS}, {recursion(CHANNEL, HELD)}, p AS (SELECT rec.symbol, rec.bar, held, lag(held) OVER w AS old, n.close / n.pc - 1 AS ret, stddev_pop(ln(n.close / n.pc)) OVER (PARTITION BY rec.symbol ORDER BY rec.bar ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS sd FROM rec JOIN n USING (symbol, bar) WINDOW w AS (PARTITION BY rec.symbol ORDER BY rec.bar)) SELECT date_trunc('day', bar)::TIMESTAMP AS day, round(avg(old / greatest(sd, 0.1) * ln(1 + ret)), 6) AS r, count(*) AS n FROM p WHERE old IS NOT NULL AND sd IS NOT NULL GROUP BY 1")
def channel_portfolio(spark, sf_dir):
    """A channel rule's positions scaled by volatility: mean return of all symbols by day."""
    rows = hourly(spark, sf_dir).withColumns({"top": F.max("high").over(W.before(20)), "floor": F.min("low").over(W.before(20))})
    rows = W.returns(R.positions(rows)).withColumn("sd", F.stddev_pop("ret").over(W.before(24)))
    rows = rows.withColumn("old", F.lag("held").over(W.order())).where("old is not null and sd is not null")
    r = F.col("old") / F.greatest("sd", F.lit(0.1)) * F.col("ret")
    return rows.groupBy(F.date_trunc("day", "bar").alias("day")).agg(F.round(F.avg(r), 6).alias("r"), F.count("*").alias("n"))


@query("open_marks", f"{RACE}, l AS (SELECT symbol, arg_max(close, bar) AS price FROM bars GROUP BY 1) SELECT t.symbol, t.bar, round((l.price - t.entry) / (t.entry * 0.25::DOUBLE), 6) AS r_now FROM trades t JOIN l USING (symbol) WHERE result <> 'WIN'")
def open_marks(spark, sf_dir):
    """Trades that have not won, marked at the last price, in risks."""
    prices = hourly(spark, sf_dir).groupBy("symbol").agg(F.max_by("close", "bar").alias("price"))
    rows = race(spark, sf_dir).where("result <> 'WIN'").join(prices, "symbol")
    return rows.select("symbol", "bar", F.round((F.col("price") - F.col("entry")) / (F.col("entry") * 0.25), 6).alias("r_now"))


@query("learned_rules", f"{RACE}, j AS (SELECT t.symbol, hour(t.bar) // 6 AS part, CASE WHEN b.close > b.open THEN 'up' ELSE 'down' END AS body, r FROM trades t JOIN bars b USING (symbol, bar)) SELECT symbol, part, body, count(*) AS n, round(avg((r > 0)::INT), 6) AS win, round(avg(r), 6) AS mean FROM j GROUP BY 1, 2, 3 HAVING count(*) >= 15 AND avg(r) > 0")
def learned_rules(spark, sf_dir):
    """Groups of trades that are large enough and pay: rules made from them."""
    rows = race(spark, sf_dir).select("symbol", "bar", "r").join(hourly(spark, sf_dir).select("symbol", "bar", "open", "close"), ["symbol", "bar"])
    body = F.when(F.col("close") > F.col("open"), "up").otherwise("down")
    g = rows.groupBy("symbol", F.call_function("div", F.hour("bar"), F.lit(6)).alias("part"), body.alias("body")).agg(F.count("*").alias("n"), A.share(F.col("r") > 0).alias("win"), F.avg("r").alias("mean"))
    return rounded(g.where("n >= 15 and mean > 0"), "symbol", "part", "body", "n", "win", "mean")


@query("fill_rates", f"WITH {BARS}, {NUMBERED}, c(cut) AS (VALUES (0.99::DOUBLE), (0.9::DOUBLE), (0.7::DOUBLE)), f AS (SELECT a.symbol, a.bar, cut, count(b.i) FILTER (b.low <= a.close * cut) > 0 AS hit, count(b.i) AS seen FROM n a CROSS JOIN c LEFT JOIN n b ON b.symbol = a.symbol AND b.i BETWEEN a.i + 1 AND a.i + 6 GROUP BY 1, 2, 3) SELECT symbol, cut, count(*) AS n, round(avg(hit::INT), 6) AS filled FROM f WHERE seen = 6 GROUP BY 1, 2")
def fill_rates(spark, sf_dir):
    """How often a limit under the close is reached within six bars, by its distance."""
    after = W.order().rowsBetween(1, 6)
    rows = hourly(spark, sf_dir).withColumns({"least": F.min("low").over(after), "seen": F.count("*").over(after)}).where("seen = 6")
    rows = rows.withColumn("cut", F.explode(F.array(F.lit(0.99), F.lit(0.9), F.lit(0.7))))
    return rows.groupBy("symbol", "cut").agg(F.count("*").alias("n"), F.round(A.share(F.col("least") <= F.col("close") * F.col("cut")), 6).alias("filled"))


@query("recosted_trades", f"{RACE}, f AS (SELECT symbol, bar, close / open - 1 AS rate FROM bars WHERE hour(bar) % 8 = 0 AND n > 2), p AS (SELECT t.symbol, t.bar, any_value(t.r) AS r, sum(f.rate) AS paid FROM trades t LEFT JOIN f ON f.symbol = t.symbol AND f.bar > t.bar AND f.bar <= t.bar + INTERVAL 24 hours GROUP BY 1, 2) SELECT symbol, bar, round(r - coalesce(paid, 0.01::DOUBLE), 6) AS net FROM p")
def recosted_trades(spark, sf_dir):
    """Results less the payments of their day, or less a flat cost where none is known."""
    paid = hourly(spark, sf_dir).where((F.hour("bar") % 8 == 0) & (F.col("n") > 2)).select("symbol", F.col("bar").alias("at"), (F.col("close") / F.col("open") - 1).alias("rate"))
    spans = race(spark, sf_dir).select("symbol", "bar", "r", F.xxhash64("symbol", "bar").alias("span"), F.col("bar").alias("low"), (F.col("bar") + F.expr("interval 24 hours")).alias("high"))
    sums = J.interval_sums(spans, paid, "symbol", "rate")
    cost = F.when(F.col("points") > 0, F.col("total")).otherwise(0.01)
    return sums.select("symbol", "bar", F.round(F.col("r") - cost, 6).alias("net"))


@query("round_ranks", "WITH g AS (SELECT o_clerk_ AS config, o_orderpriority AS p, avg(o_totalprice) FILTER (o_orderkey % 2 = 0) AS a, avg(o_totalprice) FILTER (o_orderkey % 2 = 1) AS b FROM (SELECT *, o_custkey % 40 AS o_clerk_ FROM orders) GROUP BY 1, 2), k AS (SELECT p, rank() OVER (PARTITION BY p ORDER BY a) AS ra, rank() OVER (PARTITION BY p ORDER BY b) AS rb FROM g WHERE a IS NOT NULL AND b IS NOT NULL) SELECT p, count(*) AS n, round(corr(ra, rb), 6) AS spearman FROM k GROUP BY 1")
def round_ranks(spark, sf_dir):
    """Rank correlation of configurations between two rounds."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("config"), F.col("o_orderpriority").alias("p"), "o_totalprice", "o_orderkey")
    g = rows.groupBy("config", "p").agg(F.avg(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice"))).alias("a"), F.avg(F.when(F.col("o_orderkey") % 2 == 1, F.col("o_totalprice"))).alias("b")).where("a is not null and b is not null")
    ranks = g.select("p", *(F.rank().over(Window.partitionBy("p").orderBy(c)).alias(f"r{c}") for c in "ab"))
    return ranks.groupBy("p").agg(F.count("*").alias("n"), F.round(F.corr("ra", "rb"), 6).alias("spearman"))


@query("market_overview", f"WITH {BARS}, d AS (SELECT symbol, arg_max(close, bar) AS last, arg_min(close, bar) AS first FROM bars WHERE bar >= (SELECT max(bar) FROM bars) - INTERVAL 72 hours GROUP BY 1) SELECT count(*) AS symbols, round(avg(last / first - 1), 6) AS change, avg(last / first - 1) <= -0.03 AS risk_off FROM d")
def market_overview(spark, sf_dir):
    """One row: the mean change of three days and whether it is a fall of three percent."""
    rows = hourly(spark, sf_dir)
    end = rows.agg(F.max("bar").alias("end"))  # one row
    late = rows.join(F.broadcast(end), F.lit(True)).where(F.col("bar") >= F.col("end") - F.expr("interval 72 hours"))
    d = late.groupBy("symbol").agg((F.max_by("close", "bar") / F.min_by("close", "bar") - 1).alias("c"))
    return d.agg(F.count("*").alias("symbols"), F.round(F.avg("c"), 6).alias("change"), (F.avg("c") <= -0.03).alias("risk_off"))


CONTEXT = f"c AS (SELECT symbol, bar, lag(close) OVER {OVER} AS hour_close, lag(volume) OVER {OVER} AS hour_volume FROM bars)"


@query("event_context", f"{RACE}, {CONTEXT}, {DAYS} SELECT t.symbol, t.bar, c.hour_close, c.hour_volume, g.c AS day_close, round(g.h - g.l, 6) AS day_span, hour(t.bar)::INT AS hour FROM trades t LEFT JOIN c USING (symbol, bar) LEFT JOIN g ON g.symbol = t.symbol AND g.day = date_trunc('day', t.bar) - INTERVAL 1 day")
def event_context(spark, sf_dir):
    """What was known at each event: the hour before and the day before."""
    rows = hourly(spark, sf_dir)
    hours = rows.select("symbol", "bar", F.lag("close").over(W.order()).alias("hour_close"), F.lag("volume").over(W.order()).alias("hour_volume"))
    days = rows.groupBy("symbol", F.date_trunc("day", "bar").alias("day")).agg(F.max_by("close", "bar").alias("day_close"), F.round(F.max("high") - F.min("low"), 6).alias("day_span"))
    events = race(spark, sf_dir).select("symbol", "bar", (F.date_trunc("day", "bar") - F.expr("interval 1 day")).alias("day"))
    both = events.join(hours, ["symbol", "bar"], "left").join(days, ["symbol", "day"], "left")
    return both.select("symbol", "bar", "hour_close", "hour_volume", "day_close", "day_span", F.hour("bar").alias("hour"))


SHUFFLED = "k AS (SELECT symbol, buy * 2 > volume AS pred, fwd > 0 AS y, row_number() OVER (PARTITION BY symbol ORDER BY bar) AS i, row_number() OVER (PARTITION BY symbol ORDER BY md5(symbol || strftime(bar, '%Y-%m-%d %H:%M:%S'))) AS j FROM x)"


@query("shuffle_control", f"WITH {BARS}, {NEXT}, {SHUFFLED} SELECT a.symbol, count(*) AS n, round(avg((a.pred = a.y)::INT), 6) AS hit, round(avg((a.pred = b.y)::INT), 6) AS control FROM k a JOIN k b ON a.symbol = b.symbol AND a.i = b.j GROUP BY 1")
def shuffle_control(spark, sf_dir):
    """Hit rate of a rule against that with labels shuffled within the symbol (by a hash, so runs agree)."""
    turn = F.md5(F.concat("symbol", F.date_format("bar", "yyyy-MM-dd HH:mm:ss")).cast("binary"))
    k = ahead(spark, sf_dir).select("symbol", (F.col("buy") * 2 > F.col("volume")).alias("pred"), (F.col("fwd") > 0).alias("y"), F.row_number().over(W.order()).alias("i"), F.row_number().over(Window.partitionBy("symbol").orderBy(turn)).alias("j"))
    both = k.select("symbol", "i", "pred", "y").join(k.select("symbol", F.col("j").alias("i"), F.col("y").alias("other")), ["symbol", "i"])
    return rounded(both.groupBy("symbol").agg(F.count("*").alias("n"), A.share(F.col("pred") == F.col("y")).alias("hit"), A.share(F.col("pred") == F.col("other")).alias("control")), "symbol", "n", "hit", "control")


@query("triple_conjunctions", f"WITH {BARS}, {NEXT}, i AS (SELECT symbol, bar, fwd, unnest([CASE WHEN hour(bar) < 8 THEN 'asia' ELSE 'day' END, CASE WHEN close > open THEN 'up' ELSE 'down' END, CASE WHEN n >= 4 THEN 'busy' ELSE 'calm' END, CASE WHEN buy * 2 > volume THEN 'bought' ELSE 'sold' END]) AS item FROM x) SELECT a.item AS a, b.item AS b, c.item AS c, count(*) AS n, round(avg(a.fwd), 6) AS mean FROM i a JOIN i b ON a.symbol = b.symbol AND a.bar = b.bar AND a.item < b.item JOIN i c ON a.symbol = c.symbol AND a.bar = c.bar AND b.item < c.item GROUP BY 1, 2, 3 HAVING count(*) >= 100")
def triple_conjunctions(spark, sf_dir):
    """Sets of three items that hold together in 100 bars at least."""
    c = F.col
    items = F.sort_array(F.array(F.when(F.hour("bar") < 8, "asia").otherwise("day"), F.when(c("close") > c("open"), "up").otherwise("down"), F.when(c("n") >= 4, "busy").otherwise("calm"), F.when(c("buy") * 2 > c("volume"), "bought").otherwise("sold")))
    choices = [(i, j, k) for i in range(4) for j in range(i + 1, 4) for k in range(j + 1, 4)]
    rows = ahead(spark, sf_dir).withColumn("i", items)
    sets = F.array(*(F.struct(*(F.get("i", F.lit(p)).alias(x) for p, x in zip(t, "abc"))) for t in choices))
    g = rows.select("fwd", F.explode(sets).alias("s")).groupBy("s.a", "s.b", "s.c").agg(F.count("*").alias("n"), F.round(F.avg("fwd"), 6).alias("mean"))
    return g.where("n >= 100")


WHATIF = paths("close AS e", {"early": "b.i <= a.i + 6 AND (b.high >= a.e * 6::DOUBLE OR b.low <= a.e * 0.08::DOUBLE)", "hit": "b.i > a.i + 6 AND b.high >= a.e * 6::DOUBLE", "lost": "b.i > a.i + 6 AND b.low <= a.e * 0.08::DOUBLE"}, 24)


@query("after_exit", f"WITH {BARS}, {NUMBERED}, {WHATIF}, o AS (SELECT symbol, bar, lead(close, 6) OVER {OVER} / close - 1 AS made FROM bars) SELECT symbol, bar, CASE WHEN lost IS NOT NULL AND lost <= coalesce(hit, 99) THEN 'STOP' WHEN hit IS NOT NULL THEN 'TARGET' ELSE 'PENDING' END AS later, round(made / 0.25::DOUBLE, 6) AS r FROM m JOIN o USING (symbol, bar) WHERE early IS NULL AND made IS NOT NULL")
def after_exit(spark, sf_dir):
    """Trades forced out after six bars: their result then, and what they would have met later."""
    c = F.col("close")
    rows = hourly(spark, sf_dir).withColumn("_p", J.ahead(24, "high", "low")).withColumn("made", F.lead("close", 6).over(W.order()) / c - 1).where("made is not null")
    rows = rows.withColumns({"hit": J.first_at(F.col("_p"), lambda x: x["high"] >= c * 6), "lost": J.first_at(F.col("_p"), lambda x: x["low"] <= c * 0.08)})
    rows = rows.where((F.coalesce("hit", F.lit(99)) > 6) & (F.coalesce("lost", F.lit(99)) > 6))
    later = F.when(F.col("lost").isNotNull() & (F.col("lost") <= F.coalesce("hit", F.lit(99))), "STOP").when(F.col("hit").isNotNull(), "TARGET").otherwise("PENDING")
    return rows.select("symbol", "bar", later.alias("later"), F.round(F.col("made") / 0.25, 6).alias("r"))


@query("leader_against", f"{RACE}, lead_ AS (SELECT bar, close FROM bars WHERE symbol = 'view'), z AS (SELECT arg_max(close, bar) AS now FROM lead_) SELECT t.symbol, t.bar, round((z.now / lead_.close - 1) / 0.25::DOUBLE, 6) AS against FROM trades t JOIN lead_ USING (bar), z WHERE t.symbol <> 'view'")
def leader_against(spark, sf_dir):
    """The leading symbol's move since each entry, in risks of the trade."""
    lead = hourly(spark, sf_dir).where("symbol = 'view'").select("bar", F.col("close").alias("then"))
    now = lead.agg(F.max_by("then", "bar").alias("now"))  # one row
    rows = race(spark, sf_dir).where("symbol <> 'view'").join(lead, "bar").join(F.broadcast(now), F.lit(True))
    return rows.select("symbol", "bar", F.round((F.col("now") / F.col("then") - 1) / 0.25, 6).alias("against"))


@query("evidence", f"{RACE}, e AS (SELECT *, 'symbol' AS section, symbol AS key FROM trades UNION ALL SELECT *, 'session', CASE WHEN hour(bar) < 8 THEN 'asia' WHEN hour(bar) < 16 THEN 'europe' ELSE 'america' END FROM trades UNION ALL SELECT *, 'weekday', strftime(bar, '%a') FROM trades) SELECT section, key, count(*) AS n, round(avg((r > 0)::INT), 6) AS win, round(avg(r), 6) AS mean, arg_max(result, (bar, symbol)) AS last FROM e GROUP BY 1, 2")
def evidence(spark, sf_dir):
    """What is known for a candidate by section (symbol, session, weekday), in one pass: each trade opens a row for each section."""
    rows = race(spark, sf_dir)
    phase = F.when(F.hour("bar") < 8, "asia").when(F.hour("bar") < 16, "europe").otherwise("america")
    parts = F.array(*(F.struct(F.lit(s).alias("section"), k.alias("key")) for s, k in (("symbol", F.col("symbol")), ("session", phase), ("weekday", F.date_format("bar", "EEE")))))
    g = rows.withColumn("x", F.explode(parts)).groupBy("x.section", "x.key")
    return rounded(g.agg(F.count("*").alias("n"), A.share(F.col("r") > 0).alias("win"), F.avg("r").alias("mean"), F.max_by("result", F.struct("bar", "symbol")).alias("last")), "section", "key", "n", "win", "mean", "last")


@query("post_mortem", f"{RACE}, n2 AS (SELECT symbol, bar, max(high) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING) / close - 1 AS mfe FROM bars) SELECT symbol, CASE WHEN lost <= 3 THEN 'stopped_at_once' WHEN mfe < 0.1 THEN 'no_progress' WHEN mfe >= 0.25 THEN 'gave_back' ELSE 'drifted' END AS cause, count(*) AS n, round(avg(mfe), 6) AS mfe FROM trades JOIN n2 USING (symbol, bar) WHERE result = 'LOSS' GROUP BY 1, 2")
def post_mortem(spark, sf_dir):
    """Losses by cause."""
    after = W.order().rowsBetween(1, 24)
    best = hourly(spark, sf_dir).select("symbol", "bar", (F.max("high").over(after) / F.col("close") - 1).alias("mfe"))
    rows = race(spark, sf_dir).where("result = 'LOSS'").join(best, ["symbol", "bar"])
    cause = F.when(F.col("lost") <= 3, "stopped_at_once").when(F.col("mfe") < 0.1, "no_progress").when(F.col("mfe") >= 0.25, "gave_back").otherwise("drifted")
    return rows.groupBy("symbol", cause.alias("cause")).agg(F.count("*").alias("n"), F.round(F.avg("mfe"), 6).alias("mfe"))


@query("derivative_z", f"WITH {BARS}, d AS (SELECT symbol, date_trunc('day', bar)::TIMESTAMP + INTERVAL 1 day AS bar, sum(buy) / sum(volume) AS share FROM bars GROUP BY symbol, date_trunc('day', bar)), j AS (SELECT b.symbol, b.bar, d.share FROM bars b ASOF LEFT JOIN d ON b.symbol = d.symbol AND b.bar >= d.bar) SELECT symbol, bar, CASE WHEN count(share) OVER w >= 60 AND stddev_pop(share) OVER w > 1e-9 THEN round((share - avg(share) OVER w) / stddev_pop(share) OVER w, 4) END AS z FROM j WINDOW w AS {before(120)}")
def derivative_z(spark, sf_dir):
    """A daily series brought to hours as of its end, and its z against the 120 hours before."""
    own = hourly(spark, sf_dir)
    days = own.groupBy("symbol", F.date_trunc("day", "bar").alias("day")).agg((F.sum("buy") / F.sum("volume")).alias("share"))
    days = days.select("symbol", (F.col("day") + F.expr("interval 1 day")).alias("bar"), "share")
    rows = J.as_of(own.select("symbol", "bar"), days, "bar", "symbol", ["share"])
    mean, sd = F.avg("share").over(W.before(120)), F.stddev_pop("share").over(W.before(120))
    z = F.when((F.count("share").over(W.before(120)) >= 60) & (sd > 1e-9), (F.col("share") - mean) / sd)
    return rounded(rows.withColumn("z", z), "symbol", "bar", "z", to=4)


@query("settled_suggestions", f"{RACE}, e AS (SELECT max(bar) AS now FROM bars) SELECT symbol, bar, result FROM trades, e WHERE bar <= now - INTERVAL 2 hours AND result <> 'OPEN'")
def settled_suggestions(spark, sf_dir):
    """Suggestions that are two hours old and resolved."""
    now = hourly(spark, sf_dir).agg(F.max("bar").alias("now"))  # one row
    rows = race(spark, sf_dir).where("result <> 'OPEN'").join(F.broadcast(now), F.lit(True))
    return rows.where(F.col("bar") <= F.col("now") - F.expr("interval 2 hours")).select("symbol", "bar", "result")


@query("leave_one_out", f"WITH {BARS}, s AS (SELECT symbol, count(*)::DOUBLE AS n, sum(ln(1 + volume)) AS s, sum(pow(ln(1 + volume), 2)) AS q FROM bars GROUP BY 1), t AS (SELECT sum(n) AS n, sum(s) AS s, sum(q) AS q FROM s), o AS (SELECT symbol, (t.s - s.s) / (t.n - s.n) AS m, sqrt(greatest(0, (t.q - s.q) / (t.n - s.n) - pow((t.s - s.s) / (t.n - s.n), 2))) AS sd FROM s, t) SELECT symbol, bar, round((ln(1 + volume) - m) / sd, 6) AS z FROM bars JOIN o USING (symbol) WHERE sd > 0")
def leave_one_out(spark, sf_dir):
    """A feature scaled by the mean and deviation of all other symbols: the whole sums less the symbol's own."""
    rows = hourly(spark, sf_dir).withColumn("x", F.log1p("volume"))
    own = rows.groupBy("symbol").agg(F.count("*").cast("double").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    whole = own.agg(*(F.sum(c).alias(f"t{c}") for c in "nsq"))  # one row
    rest = own.join(F.broadcast(whole), F.lit(True)).select("symbol", ((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))).alias("m"), ((F.col("tq") - F.col("q")) / (F.col("tn") - F.col("n"))).alias("e"))
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("e") - F.col("m") * F.col("m")))
    return rows.join(rest.withColumn("sd", sd).where("sd > 0"), "symbol").select("symbol", "bar", F.round((F.col("x") - F.col("m")) / F.col("sd"), 6).alias("z"))


@query("trailing_control", f"WITH {BARS}, w AS (SELECT symbol, bar, close, list({{'p': (high + low + close) / 3, 'v': volume}}) OVER {last(60)} AS w FROM bars), r AS (SELECT *, list_min([x.p FOR x IN w]) AS lo, list_max([x.p FOR x IN w]) AS hi FROM w WHERE len(w) = 60), b AS (SELECT *, [coalesce(list_sum([x.v FOR x IN w IF least(9, greatest(0, floor((x.p - lo) / nullif(hi - lo, 0) * 10)))::INT = k]), 0) FOR k IN range(10)] AS v FROM r) SELECT symbol, bar, round(lo + (list_position(v, list_max(v)) - 0.5) * (hi - lo) / 10, 5) AS poc, round(list_max(v) / nullif(list_sum(v), 0), 6) AS share FROM b")
def trailing_control(spark, sf_dir):
    """Point of control of the last 60 bars by typical price, and the share of volume in its bin."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    rows = hourly(spark, sf_dir).withColumn("tp", typical).withColumn("_w", F.collect_list(F.struct(F.col("tp").alias("p"), F.col("volume").alias("v"))).over(W.last(60))).where(F.size("_w") == 60)
    return rounded(V.trailing_control(rows, "_w", 10), "symbol", "bar", "poc", "share").select("symbol", "bar", F.round("poc", 5).alias("poc"), "share")

LASTS = PIVOTS.split(", n AS MATERIALIZED")[0] + f", z AS (SELECT symbol, bar, close, last_value(t IGNORE NULLS) OVER {OVER} AS top, last_value(f IGNORE NULLS) OVER {OVER} AS fl FROM k)"
frame("fib_zone", W.fib_zone, ["depth"], f", {LASTS}, d AS (SELECT symbol, bar, CASE WHEN top > fl THEN (top - close) / (top - fl) END AS depth FROM z) SELECT symbol, bar, round(depth, 6) AS depth FROM d WHERE depth BETWEEN 0.5 AND 0.618::DOUBLE")
frame("anchored_vwap", W.anchored_vwap, ["anchor", "avwap"], f", {LASTS}, g AS (SELECT z.symbol, z.bar, coalesce(fl <> lag(fl) OVER w, fl IS NOT NULL)::INT AS new FROM z WINDOW w AS (PARTITION BY z.symbol ORDER BY z.bar)), a AS (SELECT symbol, bar, sum(new) OVER {OVER} AS anchor FROM g) SELECT symbol, bar, anchor::BIGINT AS anchor, CASE WHEN anchor > 0 THEN round(sum((high + low + close) / 3 * volume) OVER s / nullif(sum(volume) OVER s, 0), 6) END AS avwap FROM a JOIN bars USING (symbol, bar) WINDOW s AS (PARTITION BY symbol, anchor ORDER BY bar)")
STRENGTH = {"up": ("NULL", "coalesce(r.up + (1.0::DOUBLE / 14) * (greatest(n.close - n.pc, 0) - r.up), greatest(n.close - n.pc, 0))"), "down": ("NULL", "coalesce(r.down + (1.0::DOUBLE / 14) * (greatest(n.pc - n.close, 0) - r.down), greatest(n.pc - n.close, 0))")}


@query("rsi_divergence", f"WITH RECURSIVE {BARS}, {recursion(N, STRENGTH)}, v AS (SELECT b.*, CASE WHEN up + down > 0 THEN 100 * up / (up + down) END AS rsi FROM bars b JOIN rec USING (symbol, bar)), p AS (SELECT *, count(*) OVER l = 3 AND count(*) OVER r = 3 AS ok, high > max(high) OVER l AND high > max(high) OVER r AS t, low < min(low) OVER l AND low < min(low) OVER r AS f FROM v WINDOW l AS {before(3)}, r AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)), e AS (SELECT symbol, bar, 1 AS side, low AS p, rsi FROM p WHERE ok AND f UNION ALL SELECT symbol, bar, -1, high, rsi FROM p WHERE ok AND t), o AS (SELECT *, lag(p) OVER w AS op, lag(rsi) OVER w AS ov FROM e WINDOW w AS (PARTITION BY symbol, side ORDER BY bar)) SELECT symbol, bar, side, round(p, 6) AS p, round(rsi, 6) AS v FROM o WHERE side * (p - op) < 0 AND side * (rsi - ov) > 0")
def rsi_divergence(spark, sf_dir):
    return rounded(W.divergences(R.wilder_rsi(hourly(spark, sf_dir)), "rsi"), "symbol", "bar", "side", "p", "v")


def line_sql(name: str, side: int, column: str) -> str:
    """SQL of one fitted line over 24 bars: p the bar furthest off the fit, d the distances from it."""
    return f"""{name}p AS (SELECT symbol, t, arg_min(x, ({side} * ({column} - f), x)) AS px, arg_min({side} * {column}, ({side} * ({column} - f), x)) AS py FROM g GROUP BY 1, 2),
 {name}d AS (SELECT symbol, t, px, py, x - px AS dx, {side} * {column} - py AS dy FROM g JOIN {name}p USING (symbol, t)),
 {name}s AS (SELECT symbol, t, any_value(px) AS px, any_value(py) AS py, sum(dx * dy) / sum(dx * dx) AS s, max(dy / dx) FILTER (dx < 0) AS lo, min(dy / dx) FILTER (dx > 0) AS hi FROM {name}d GROUP BY 1, 2),
 {name} AS (SELECT symbol, t, {side} * (py + CASE WHEN lo > hi THEN lo ELSE least(greatest(s, lo), hi) END * (24 - px)) AS v FROM {name}s)"""


frame(
    "fitted_lines",
    W.fitted_lines,
    ["support", "resistance"],
    f", {NUMBERED}, w AS (SELECT a.symbol, a.bar AS t, (b.i - a.i + 24)::DOUBLE AS x, b.close, b.low, b.high FROM n a JOIN n b ON a.symbol = b.symbol AND b.i BETWEEN a.i - 24 AND a.i - 1 WHERE a.i > 24), r AS (SELECT symbol, t, regr_slope(close, x) AS sl, avg(close) AS mc FROM w GROUP BY 1, 2), g AS (SELECT w.*, mc + sl * (x - 11.5) AS f FROM w JOIN r USING (symbol, t)), {line_sql('su', 1, 'low')}, {line_sql('re', -1, 'high')} SELECT b.symbol, b.bar, round(su.v, 7) AS support, round(re.v, 7) AS resistance FROM bars b LEFT JOIN su ON su.symbol = b.symbol AND su.t = b.bar LEFT JOIN re ON re.symbol = b.symbol AND re.t = b.bar",
    to=7,
)
