"""Registered queries of trigger families."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickframe.operators import families as T
from tickframe.operators import joins as J
from tickframe.operators import parallel as P
from tickframe.plans.queries import BARS, OVER, RACE, TR, before, hourly, last, query, race, rounded


def out(x: str, window: str, n: int, centred: bool) -> str:
    value = f"({x} - avg({x}) OVER {window})" if centred else x
    return f"CASE WHEN count({x}) OVER {window} >= {n} AND stddev_pop({x}) OVER {window} > 0 THEN {value} / stddev_pop({x}) OVER {window} END"


PARTS = f"""WITH RECURSIVE {BARS}, {TR},
 a0 AS (SELECT *, CASE WHEN count(*) OVER {last(14)} >= 14 THEN avg(tr) OVER {last(14)} END AS atr, ln(close / lag(close, 3) OVER {OVER}) AS mv, sum(buy) OVER {last(10)} AS bt, sum(volume) OVER {last(10)} AS td, sum(volume) OVER {last(24)} AS oi, sum(close * volume) OVER {last(24)} AS pv, lag(close) OVER {OVER} AS pc, hour(bar) AS hr FROM tr),
 a1 AS (SELECT *, CASE WHEN td > 0 THEN (2 * bt - td) / td END AS imb, CASE WHEN lag(oi) OVER {OVER} > 0 THEN oi / lag(oi) OVER {OVER} - 1 END AS doi, CASE WHEN oi > 0 THEN close * oi / pv - 1 END AS dev FROM a0),
 a2 AS (SELECT *, {out('mv', before(60), 60, False)} AS mz, {out('imb', before(120), 120, True)} AS iz, {out('dev', before(120), 120, False)} AS dz, avg(td) OVER {before(120)} AS usual, max(close) OVER {last(10)} AS tc, min(close) OVER {last(10)} AS lc, max(high) OVER {before(6)} AS h6, min(low) OVER {before(6)} AS l6, max(CASE WHEN hr IN (8, 9) THEN high END) OVER (PARTITION BY symbol, date_trunc('day', bar)) AS ot, min(CASE WHEN hr IN (8, 9) THEN low END) OVER (PARTITION BY symbol, date_trunc('day', bar)) AS ol, lag((2 * buy - volume) / nullif(volume, 0), 8) OVER {OVER} AS rate FROM a1),
 ds AS (SELECT DISTINCT symbol, date_trunc('day', bar) AS day FROM a1), qs AS (SELECT ds.symbol, ds.day, quantile_cont(b.doi, 0.1) AS ql, quantile_cont(b.doi, 0.9) AS qh FROM ds JOIN a1 b ON b.symbol = ds.symbol AND b.bar >= ds.day - INTERVAL 5 days AND b.bar < ds.day GROUP BY 1, 2),
 ld AS (SELECT bar, mv AS lm, mz AS lz FROM a2 WHERE symbol = 'view'), a3 AS (SELECT a2.*, lm, lz, ql, qh FROM a2 LEFT JOIN ld USING (bar) LEFT JOIN qs ON qs.symbol = a2.symbol AND qs.day = date_trunc('day', a2.bar)),
 f AS (SELECT symbol, bar, row_number() OVER {OVER} AS n_,
  coalesce(CASE WHEN symbol <> 'view' AND abs(lz) >= 2 AND sign(lm) * mv < sign(lm) * lm THEN sign(lm) END, 0)::INT AS lead,
  coalesce(CASE WHEN abs(iz) >= 2 THEN sign(imb) END, 0)::INT AS flow,
  coalesce(CASE WHEN abs(iz) >= 2 AND ((imb > 0 AND close >= tc) OR (imb < 0 AND close <= lc)) AND td >= 1.2 * usual THEN -sign(imb) END, 0)::INT AS spent,
  coalesce(CASE WHEN doi <= ql AND abs(close - pc) >= atr THEN -sign(close - pc) END, 0)::INT AS flush,
  CASE WHEN doi >= qh AND close > h6 THEN 1 WHEN doi >= qh AND close < l6 THEN -1 ELSE 0 END AS build,
  coalesce(CASE WHEN abs(dz) >= 2 THEN -sign(dev) END, 0)::INT AS fade,
  CASE WHEN hr BETWEEN 10 AND 15 AND close > ot THEN 1 WHEN hr BETWEEN 10 AND 15 AND close < ol THEN -1 ELSE 0 END AS open,
  coalesce(CASE WHEN hr % 8 = 0 AND abs(rate) >= 0.5 THEN -sign(rate) END, 0)::INT AS settle FROM a3)"""


@query("family_sides", f"{PARTS} SELECT symbol, bar, {', '.join(T.FAMILIES)} FROM f")
def family_sides(spark, sf_dir):
    """The side of eight trigger families at each bar."""
    return T.trigger_sides(hourly(spark, sf_dir), "view").select("symbol", "bar", *T.FAMILIES)


EVENTS = " UNION ALL ".join(f"SELECT symbol, '{f}' AS family, bar, n_, {f} AS side FROM (SELECT *, coalesce(lag({f}) OVER {OVER}, 0) AS was FROM f) WHERE {f} <> 0 AND {f} <> was" for f in T.FAMILIES)


@query(
    "family_triggers",
    f"{PARTS}, e AS ({EVENTS}), g AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol, family ORDER BY n_) AS k FROM e), rec AS (SELECT symbol, family, bar, side, k, n_ + 6 AS free, TRUE AS keep FROM g WHERE k = 1 UNION ALL SELECT g.symbol, g.family, g.bar, g.side, g.k, CASE WHEN g.n_ >= r.free THEN g.n_ + 6 ELSE r.free END, g.n_ >= r.free FROM rec r JOIN g ON g.symbol = r.symbol AND g.family = r.family AND g.k = r.k + 1) SELECT symbol, family, bar, side FROM rec WHERE keep",
)
def family_triggers(spark, sf_dir):
    """Where a family newly fires, six bars at least after its last one kept."""
    return T.triggers(T.trigger_sides(hourly(spark, sf_dir), "view"), 6)


@query("family_edges", f"{PARTS}, e AS ({EVENTS}), w AS (SELECT symbol, bar, lead(close, 8) OVER {OVER} / lead(open) OVER {OVER} - 1 AS fwd FROM bars) SELECT family, count(*) AS n, round(avg(side * fwd), 6) AS edge, round(avg((side * fwd > 0)::INT), 6) AS hit FROM e JOIN w USING (symbol, bar) WHERE fwd IS NOT NULL GROUP BY 1")
def family_edges(spark, sf_dir):
    """Mean result of each family's new signals over the next eight bars."""
    bars = hourly(spark, sf_dir)
    ahead = bars.select("symbol", "bar", (F.lead("close", 8).over(T.W.order()) / F.lead("open").over(T.W.order()) - 1).alias("fwd"))
    found = T.triggers(T.trigger_sides(bars, "view"), 0).join(ahead, ["symbol", "bar"]).where("fwd is not null")
    gain = F.col("side") * F.col("fwd")
    return found.groupBy("family").agg(F.count("*").alias("n"), F.round(F.avg(gain), 6).alias("edge"), F.round(F.avg((gain > 0).cast("double")), 6).alias("hit"))


def scan(x: str, weight: str) -> str:
    """SQL of an exponential mean over a list of all values so far."""
    return f"list_reduce(list({x}) OVER (PARTITION BY symbol ORDER BY day), lambda a, v: a + (v - a) * {weight})"


KNOWN = f"""{RACE}, h AS (SELECT *, hour(bar) AS hr, close / lag(close, 24) OVER {OVER} - 1 AS r24, close / lag(close, 4) OVER {OVER} - 1 AS r4, avg(volume) OVER {last(4)} / nullif(avg(volume) OVER {last(48)}, 0) AS rv, (2 * buy - volume) / nullif(volume, 0) AS rate, stddev_pop(close / open - 1) OVER {last(24)} / nullif(stddev_pop(close / open - 1) OVER {last(96)}, 0) AS volr, avg(close) OVER {last(20)} AS m20, avg(close) OVER {last(50)} AS m50, sum((high + low + close) / 3 * volume) OVER d / nullif(sum(volume) OVER d, 0) AS vwap FROM bars WINDOW d AS (PARTITION BY symbol, date_trunc('day', bar) ORDER BY bar)),
 dy AS (SELECT symbol, date_trunc('day', bar)::TIMESTAMP AS day, max(high) AS h, min(low) AS l, arg_max(close, bar) AS c FROM bars GROUP BY 1, 2), dt AS (SELECT *, greatest(h - l, abs(h - coalesce(lag(c) OVER w, c)), abs(l - coalesce(lag(c) OVER w, c))) AS tr FROM dy WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 de AS (SELECT symbol, day + INTERVAL 1 day AS bar, c AS dc, {scan('c', '(2.0::DOUBLE / 21)')} AS e20, {scan('c', '(2.0::DOUBLE / 51)')} AS e50, {scan('tr', '(1.0::DOUBLE / 14)')} AS da FROM dt),
 ld AS (SELECT bar, r24 AS lead24 FROM h WHERE symbol = 'view'), ev AS (SELECT t.symbol, t.bar, CASE WHEN t.result = 'LOSS' THEN -1 ELSE 1 END AS side, h.* EXCLUDE (symbol, bar), lead24 FROM trades t JOIN h USING (symbol, bar) LEFT JOIN ld USING (bar)),
 j AS (SELECT ev.*, dc, e20, e50, da FROM ev ASOF LEFT JOIN de ON de.symbol = ev.symbol AND ev.bar >= de.bar)"""


@query("event_features", f"WITH {KNOWN.removeprefix('WITH ')} SELECT symbol, bar, side, round(da / close, 6) AS d_pct, CASE WHEN close > m20 AND m20 > m50 THEN 1 WHEN close < m20 AND m20 < m50 THEN -1 ELSE 0 END AS regime, round(volr, 6) AS volr, hr::INT AS hour, (isodow(bar) - 1)::INT AS weekday, round(side * r24, 6) AS own_day, round(side * lead24, 6) AS lead_day, round(side * r4, 6) AS own_four, round(side * rate, 6) AS paid, round(rv, 6) AS rv, round(side * (close - vwap) / da, 6) AS off_vwap, round(side * (close - e50) / da, 6) AS off_mean, side * CASE WHEN dc > e50 AND e20 > e50 THEN 1 WHEN dc < e50 AND e20 < e50 THEN -1 ELSE 0 END AS day_trend FROM j")
def event_features(spark, sf_dir):
    """Thirteen features of each event, of the last closed hour and of the last complete day; a lost one is taken as short, so that both sides occur."""
    w, c = T.W.order(), F.col
    rows = T.W.vwap(hourly(spark, sf_dir)).withColumn("body", c("close") / c("open") - 1)
    day = F.date_trunc("day", "bar")
    days = rows.groupBy("symbol", day.alias("bar")).agg(F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar").alias("close"))
    days = P.smoothed(P.ranged(days, "month"), "month", e20=("close", 2 / 21), e50=("close", 2 / 51), da=("first_", 1 / 14))
    known = days.select("symbol", (c("bar") + F.expr("interval 1 day")).alias("bar"), c("close").alias("dc"), "e20", "e50", "da")

    def mean(x, n):
        return F.avg(x).over(T.W.last(n))

    rows = rows.withColumns({"r24": c("close") / F.lag("close", 24).over(w) - 1, "r4": c("close") / F.lag("close", 4).over(w) - 1, "rv": mean("volume", 4) / F.nullif(mean("volume", 48), F.lit(0.0)), "rate": (2 * c("buy") - c("volume")) / F.nullif(c("volume"), F.lit(0.0)), "volr": F.stddev_pop("body").over(T.W.last(24)) / F.nullif(F.stddev_pop("body").over(T.W.last(96)), F.lit(0.0)), "m20": mean("close", 20), "m50": mean("close", 50)})
    lead = rows.where("symbol = 'view'").select("bar", c("r24").alias("lead24"))
    events = race(spark, sf_dir).select("symbol", "bar", F.when(c("result") == "LOSS", -1).otherwise(1).alias("side"))
    met = J.as_of(events.join(rows.drop("n"), ["symbol", "bar"]).join(lead, "bar", "left"), known, "bar", "symbol", ["dc", "e20", "e50", "da"])
    side = c("side")
    features = {
        "d_pct": c("da") / c("close"),
        "regime": F.when((c("close") > c("m20")) & (c("m20") > c("m50")), 1).when((c("close") < c("m20")) & (c("m20") < c("m50")), -1).otherwise(0),
        "volr": c("volr"),
        "hour": F.hour("bar"),
        "weekday": F.weekday("bar"),
        "own_day": side * c("r24"),
        "lead_day": side * c("lead24"),
        "own_four": side * c("r4"),
        "paid": side * c("rate"),
        "rv": c("rv"),
        "off_vwap": side * (c("close") - c("day_vwap")) / c("da"),
        "off_mean": side * (c("close") - c("e50")) / c("da"),
        "day_trend": side * F.when((c("dc") > c("e50")) & (c("e20") > c("e50")), 1).when((c("dc") < c("e50")) & (c("e20") < c("e50")), -1).otherwise(0),
    }
    return rounded(met.select("symbol", "bar", "side", *(x.alias(n) for n, x in features.items())), "symbol", "bar", "side", *features)
