"""Registered queries of trade outcomes: what the bounded path of a bar meets first."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickframe.operators import frames as W
from tickframe.operators import joins as J
from tickframe.plans.queries import BARS, OVER, hourly, last, query, rounded

NUMBERED = f"n AS (SELECT *, row_number() OVER {OVER} AS i FROM bars)"


def paths(levels: str, tests: dict[str, str], horizon: int, where: str = "TRUE", source: str = "n") -> str:
    """SQL of a race: of each bar (as a, with the columns `levels`) the first later bar b that passes each test."""
    firsts = ", ".join(f"min(CASE WHEN {t} THEN b.i - a.i END) AS {k}" for k, t in tests.items())
    return f"l AS (SELECT *, {levels} FROM {source} WHERE {where}), m AS (SELECT a.symbol, a.bar, {firsts}, count(b.i) AS seen FROM l a LEFT JOIN n b ON a.symbol = b.symbol AND b.i BETWEEN a.i + 1 AND a.i + {horizon} GROUP BY 1, 2)"


RESULT = "CASE WHEN lost IS NOT NULL AND lost <= coalesce(hit, 1 << 30) AND lost <= coalesce(gone, 1 << 30) THEN 'LOSS' WHEN hit IS NOT NULL AND hit <= coalesce(gone, 1 << 30) THEN 'WIN' WHEN gone IS NOT NULL THEN 'GONE' ELSE 'OPEN' END"
SIDED = "s AS (SELECT n.*, side FROM n, (VALUES (1), (-1)) v(side))"
TWO = paths(
    "close * (1 + side * 0.5::DOUBLE) AS target, close * (1 - side * 0.25::DOUBLE) AS stop, close * (1 - side * 0.1::DOUBLE) AS inval",
    {
        "hit": "CASE WHEN a.side > 0 THEN b.high >= a.target ELSE b.low <= a.target END",
        "lost": "CASE WHEN a.side > 0 THEN b.low <= a.stop ELSE b.high >= a.stop END",
        "gone": "CASE WHEN a.side > 0 THEN b.close < a.inval ELSE b.close > a.inval END",
    },
    24,
    source="s",
).replace("SELECT a.symbol, a.bar, min", "SELECT a.symbol, a.bar, a.side, min").replace("GROUP BY 1, 2", "GROUP BY 1, 2, 3")


@query("sided_race", f"WITH {BARS}, {NUMBERED}, {SIDED}, {TWO} SELECT symbol, bar, side, {RESULT} AS result FROM m")
def sided_race(spark, sf_dir):
    """Target, stop or invalidation by close, whichever comes first, of a long and a short entry at each close."""
    # Both sides of a bar see the same path: the frame is taken before the rows are doubled.
    path = hourly(spark, sf_dir).withColumn("_p", J.ahead(24, "high", "low", "close")).withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    up, c = F.col("side") > 0, F.col("close")
    target, stop, void = c * (1 + F.col("side") * 0.5), c * (1 - F.col("side") * 0.25), c * (1 - F.col("side") * 0.1)
    out = path.withColumns({"target": target, "stop": stop, "inval": void})
    out = out.withColumns(
        {
            "hit": J.first_at(F.col("_p"), lambda x: F.when(up, x["high"] >= F.col("target")).otherwise(x["low"] <= F.col("target"))),
            "lost": J.first_at(F.col("_p"), lambda x: F.when(up, x["low"] <= F.col("stop")).otherwise(x["high"] >= F.col("stop"))),
            "gone": J.first_at(F.col("_p"), lambda x: F.when(up, x["close"] < F.col("inval")).otherwise(x["close"] > F.col("inval"))),
        }
    )
    return out.select("symbol", "bar", "side", J.outcome().alias("result"))


def simple(hit: str, lost: str) -> str:
    return f"CASE WHEN {lost} IS NOT NULL AND {lost} <= coalesce({hit}, 1 << 30) THEN 'LOSS' WHEN {hit} IS NOT NULL THEN 'WIN' ELSE 'OPEN' END"


@query(
    "mirror_settlement",
    f"WITH {BARS}, {NUMBERED}, {paths('close AS e', {'hit': 'b.high >= a.e * 1.4::DOUBLE', 'lost': 'b.low <= a.e * 0.8::DOUBLE', 'mhit': 'b.low <= a.e * 0.6::DOUBLE', 'mlost': 'b.high >= a.e * 1.2::DOUBLE'}, 24)} SELECT symbol, bar, {simple('hit', 'lost')} AS own, {simple('mhit', 'mlost')} AS mirror FROM m",
)
def mirror_settlement(spark, sf_dir):
    """A long trade and the opposite one with its levels reflected at the entry, on one path."""
    out = hourly(spark, sf_dir).withColumn("_p", J.ahead(24, "high", "low"))
    c = F.col("close")
    out = out.withColumns({k: J.first_at(F.col("_p"), t) for k, t in {"hit": lambda x: x["high"] >= c * 1.4, "lost": lambda x: x["low"] <= c * 0.8, "mhit": lambda x: x["low"] <= c * 0.6, "mlost": lambda x: x["high"] >= c * 1.2}.items()})
    return out.select("symbol", "bar", J.outcome_of("hit", "lost").alias("own"), J.outcome_of("mhit", "mlost").alias("mirror"))


ATR = f"t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER {OVER}), abs(low - lag(close) OVER {OVER})) AS tr, lead(open) OVER {OVER} AS e, lead(close, 24) OVER {OVER} AS ce FROM n), u AS (SELECT *, CASE WHEN count(*) OVER w >= 14 THEN avg(tr) OVER w END AS atr FROM t WINDOW w AS {last(14)})"


def entries(spark, sf_dir, horizon=24):
    """Bars with their ATR, the next open, the path and the last close of the horizon."""
    rows = W.atr(hourly(spark, sf_dir)).withColumns({"e": F.lead("open").over(W.order()), "ce": F.lead("close", horizon).over(W.order()), "_p": J.ahead(horizon, "high", "low")})
    return rows.where("atr is not null and e is not null")


UNIT = paths("1 AS one", {"hit": "b.high >= a.e + a.atr", "lost": "b.low <= a.e - a.atr"}, 24, "atr IS NOT NULL AND e IS NOT NULL", "u")


@query("unit_race", f"WITH {BARS}, {NUMBERED}, {ATR}, {UNIT} SELECT l.symbol, l.bar, round(CASE WHEN lost IS NOT NULL AND lost <= coalesce(hit, 1 << 30) THEN -1 WHEN hit IS NOT NULL THEN 1 ELSE greatest(-1, least(1, (ce - e) / atr)) END - 0.0012::DOUBLE * e / atr, 6) AS r FROM m JOIN l USING (symbol, bar) WHERE lost IS NOT NULL OR hit IS NOT NULL OR ce IS NOT NULL")
def unit_race(spark, sf_dir):
    """One mean range up or down from the next open within 24 bars, else the clipped rest, less costs."""
    e, a = F.col("e"), F.col("atr")
    rows = entries(spark, sf_dir).withColumns({"hit": J.first_at(F.col("_p"), lambda x: x["high"] >= e + a), "lost": J.first_at(F.col("_p"), lambda x: x["low"] <= e - a)})
    rest = F.when(F.col("ce").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("ce") - e) / a)))
    result = J.outcome_of("hit", "lost")
    gross = F.when(result == "LOSS", -1.0).when(result == "WIN", 1.0).otherwise(rest)
    return rows.withColumn("r", F.round(gross - 0.0012 * e / a, 6)).where("r is not null").select("symbol", "bar", "r")


@query("barrier_race", f"WITH {BARS}, {NUMBERED}, {paths('close AS e', {'up': 'b.high >= a.e * 1.3::DOUBLE', 'down': 'b.low <= a.e * 0.7::DOUBLE'}, 12)} SELECT symbol, bar, CASE WHEN up = down THEN NULL WHEN coalesce(up, 1 << 30) < coalesce(down, 1 << 30) THEN 1 WHEN down IS NOT NULL THEN 0 END AS y FROM m WHERE seen = 12")
def barrier_race(spark, sf_dir):
    """Which of two even barriers is met first within 12 bars: 1, 0, or null (neither, or both in one bar)."""
    c = F.col("close")
    out = hourly(spark, sf_dir).withColumn("_p", J.ahead(12, "high", "low")).where(F.size("_p") == 12)
    out = out.withColumns({"up": J.first_at(F.col("_p"), lambda x: x["high"] >= c * 1.3), "down": J.first_at(F.col("_p"), lambda x: x["low"] <= c * 0.7)})
    never = F.lit(1 << 30).cast("long")
    y = F.when(F.coalesce("up", never) < F.coalesce("down", never), 1).when(F.coalesce("down", never) < F.coalesce("up", never), 0)
    return out.select("symbol", "bar", y.alias("y"))


SIGMA = f"r AS (SELECT *, ln(close / lag(close) OVER {OVER}) AS ret FROM n), v AS (SELECT *, CASE WHEN count(ret) OVER w >= 24 THEN stddev_samp(ret) OVER w END AS sg FROM r WINDOW w AS {last(24)})"
VOL = paths("close * (1 + 0.5::DOUBLE * sg * sqrt(12)) AS hi, close * (1 - 0.5::DOUBLE * sg * sqrt(12)) AS lo", {"hit": "b.high >= a.hi", "lost": "b.low <= a.lo"}, 12, "sg > 0", "v").replace("count(b.i) AS seen", "count(b.i) AS seen, max(b.high) AS best, min(b.low) AS worst")


@query("scaled_barriers", f"WITH {BARS}, {NUMBERED}, {SIGMA}, {VOL} SELECT m.symbol, m.bar, CASE WHEN lost IS NOT NULL AND lost <= coalesce(hit, 1 << 30) THEN 'LOSS' WHEN hit IS NOT NULL THEN 'WIN' ELSE 'EXPIRED' END AS result, round(best / close - 1, 6) AS mfe, round(worst / close - 1, 6) AS mae FROM m JOIN l USING (symbol, bar) WHERE seen = 12")
def scaled_barriers(spark, sf_dir):
    """Barriers at half a deviation times the root of the horizon, with the best and worst move in it."""
    out = W.realised(hourly(spark, sf_dir)).withColumn("_p", J.ahead(12, "high", "low")).where("vol > 0").where(F.size("_p") == 12)
    reach, c = 0.5 * F.col("vol") * F.sqrt(F.lit(12.0)), F.col("close")
    out = out.withColumns({"hi": c * (1 + reach), "lo": c * (1 - reach)})
    out = out.withColumns({"hit": J.first_at(F.col("_p"), lambda x: x["high"] >= F.col("hi")), "lost": J.first_at(F.col("_p"), lambda x: x["low"] <= F.col("lo"))})
    result = F.regexp_replace(J.outcome_of("hit", "lost"), "OPEN", "EXPIRED")
    best, worst = F.array_max(F.transform("_p", lambda x: x["high"])), F.array_min(F.transform("_p", lambda x: x["low"]))
    return rounded(out.withColumns({"result": result, "mfe": best / c - 1, "mae": worst / c - 1}), "symbol", "bar", "result", "mfe", "mae")


GEOMETRY = paths("greatest(1.2::DOUBLE * atr, 0.01::DOUBLE * e) AS risk", {"hit": "b.high >= a.e + 2 * a.risk", "lost": "b.low <= a.e - a.risk"}, 24, "atr IS NOT NULL AND e IS NOT NULL AND ce IS NOT NULL", "u")


@query("fixed_geometry", f"WITH {BARS}, {NUMBERED}, {ATR}, {GEOMETRY} SELECT m.symbol, m.bar, coalesce(CASE WHEN lost IS NOT NULL AND lost <= coalesce(hit, 1 << 30) THEN lost ELSE hit END, 24) AS bars, round(CASE WHEN lost IS NOT NULL AND lost <= coalesce(hit, 1 << 30) THEN -1 WHEN hit IS NOT NULL THEN 2 ELSE (ce - e) / risk END - 0.001::DOUBLE * e / risk, 6) AS r FROM m JOIN l USING (symbol, bar)")
def fixed_geometry(spark, sf_dir):
    """Label of a long entry at the next open: stop at one risk, target at two, else the close after 24 bars, less costs."""
    e = F.col("e")
    rows = entries(spark, sf_dir).where("ce is not null").withColumn("risk", F.greatest(1.2 * F.col("atr"), 0.01 * e))
    rows = rows.withColumns({"hit": J.first_at(F.col("_p"), lambda x: x["high"] >= e + 2 * F.col("risk")), "lost": J.first_at(F.col("_p"), lambda x: x["low"] <= e - F.col("risk"))})
    result = J.outcome_of("hit", "lost")
    gross = F.when(result == "LOSS", -1.0).when(result == "WIN", 2.0).otherwise((F.col("ce") - e) / F.col("risk"))
    bars = F.coalesce(F.when(result == "LOSS", F.col("lost")).otherwise(F.col("hit")), F.lit(24))
    return rows.select("symbol", "bar", bars.alias("bars"), F.round(gross - 0.001 * e / F.col("risk"), 6).alias("r"))


@query(
    "entry_methods",
    f"WITH {BARS}, {NUMBERED}, {paths('close AS e', {'lim': 'b.low <= a.e * 0.99::DOUBLE', 'pull': 'b.low <= a.close - 0.5::DOUBLE * (a.close - a.low)'}, 6)}, o AS (SELECT *, lead(open) OVER {OVER} AS o1, lead(open, 3) OVER {OVER} AS o3 FROM bars) SELECT symbol, bar, o1 AS instant, o3 AS delayed, CASE WHEN lim IS NOT NULL THEN round(close * 0.99::DOUBLE, 6) END AS limit_price, CASE WHEN pull IS NOT NULL THEN round(close - 0.5::DOUBLE * (close - low), 6) END AS pullback FROM m JOIN o USING (symbol, bar)",
)
def entry_methods(spark, sf_dir):
    """Entry prices by method: the next open, the third, a limit one percent lower, half of the bar's fall back; the last two only if the next six bars reach them."""
    out = hourly(spark, sf_dir).withColumn("_p", J.ahead(6, "low"))
    limit, back = F.col("close") * 0.99, F.col("close") - 0.5 * (F.col("close") - F.col("low"))
    reached = {"limit_price": limit, "pullback": back}
    fills = {k: F.when(J.first_at(F.col("_p"), lambda x, v=v: x["low"] <= v).isNotNull(), F.round(v, 6)) for k, v in reached.items()}
    return out.withColumns({"instant": F.lead("open", 1).over(W.order()), "delayed": F.lead("open", 3).over(W.order()), **fills}).select("symbol", "bar", "instant", "delayed", "limit_price", "pullback")


@query("resolved_trade", f"WITH {BARS}, {NUMBERED}, {ATR}, {paths('1 AS one', {'hit': 'b.high >= a.close + 1.5::DOUBLE * a.atr', 'lost': 'b.low <= a.close - a.atr'}, 24, 'atr IS NOT NULL', 'u')} SELECT m.symbol, m.bar, CASE WHEN lost IS NOT NULL AND lost <= coalesce(hit, 1 << 30) THEN round(-1 - 0.0008::DOUBLE * close / atr, 6) WHEN hit IS NOT NULL THEN round(1.5::DOUBLE - 0.0008::DOUBLE * close / atr, 6) END AS r FROM m JOIN l USING (symbol, bar)")
def resolved_trade(spark, sf_dir):
    """Result in risks with costs in risks; null while unresolved."""
    c, a = F.col("close"), F.col("atr")
    rows = W.atr(hourly(spark, sf_dir)).withColumn("_p", J.ahead(24, "high", "low")).where("atr is not null")
    rows = rows.withColumns({"hit": J.first_at(F.col("_p"), lambda x: x["high"] >= c + 1.5 * a), "lost": J.first_at(F.col("_p"), lambda x: x["low"] <= c - a)})
    result, cost = J.outcome_of("hit", "lost"), 0.0008 * c / a
    return rows.select("symbol", "bar", F.when(result == "LOSS", F.round(-1 - cost, 6)).when(result == "WIN", F.round(1.5 - cost, 6)).alias("r"))


JUDGE = f"""{NUMBERED}, e AS (SELECT a.symbol, a.bar, a.i, any_value(a.close) AS c, min(CASE WHEN b.high >= a.close * 1.05::DOUBLE THEN b.i - a.i END) AS ent, min(CASE WHEN b.low <= a.close * 0.7::DOUBLE THEN b.i - a.i END) AS void, count(b.i) AS seen FROM n a LEFT JOIN n b ON a.symbol = b.symbol AND b.i BETWEEN a.i + 1 AND a.i + 24 WHERE a.n >= 4 GROUP BY 1, 2, 3),
 f AS (SELECT *, ent IS NOT NULL AND ent <= coalesce(void, 99) AS ok FROM e),
 g AS (SELECT f.symbol, f.bar, min(CASE WHEN b.low <= c * 0.9::DOUBLE THEN b.i - f.i END) AS s, min(CASE WHEN b.high >= c * 1.2::DOUBLE THEN b.i - f.i END) AS t FROM f JOIN n b ON f.symbol = b.symbol AND b.i BETWEEN f.i + ent AND f.i + 24 WHERE ok GROUP BY 1, 2),
 h AS (SELECT f.*, s, t, (SELECT min(b.i - f.i) FROM n b WHERE b.symbol = f.symbol AND b.i BETWEEN f.i + t + 1 AND f.i + 24 AND b.low <= c * 0.9::DOUBLE) AS s2, (SELECT min(b.i - f.i) FROM n b WHERE b.symbol = f.symbol AND b.i BETWEEN f.i + t AND f.i + 24 AND b.high >= c * 1.5::DOUBLE) AS u FROM f LEFT JOIN g USING (symbol, bar)),
 k AS (SELECT *, CASE WHEN NOT ok THEN CASE WHEN void IS NOT NULL THEN 'INVALIDATED' WHEN seen = 24 THEN 'EXPIRED' ELSE 'WAITING' END WHEN s IS NOT NULL AND s <= coalesce(t, 99) THEN 'STOPPED' WHEN t IS NOT NULL AND u IS NOT NULL AND (u = t OR u < coalesce(s2, 99)) THEN 'TP2 HIT' WHEN t IS NOT NULL AND s2 IS NOT NULL THEN 'STOPPED AFTER TP1' WHEN t IS NOT NULL THEN 'TP1 HIT' ELSE 'ENTERED' END AS status FROM h)
 SELECT symbol, bar, status, CASE WHEN ok THEN round(greatest(0, ((SELECT max(b.high) FROM n b WHERE b.symbol = k.symbol AND b.i BETWEEN k.i + k.ent AND k.i + CASE k.status WHEN 'STOPPED' THEN k.s WHEN 'TP2 HIT' THEN k.u WHEN 'STOPPED AFTER TP1' THEN k.s2 ELSE 24 END) - c * 1.05::DOUBLE) / (c * 1.05::DOUBLE - c * 0.9::DOUBLE)), 6) END AS best_r FROM k"""


@query("setup_judge", f"WITH {BARS}, {JUDGE}")
def setup_judge(spark, sf_dir):
    c = F.col("close")
    out = J.judged(hourly(spark, sf_dir), 24, c * 1.05, c * 0.9, c * 1.2, c * 1.5, c * 0.7).where("n >= 4")
    return rounded(out, "symbol", "bar", "status", "best_r")


@query("run_starts", f"WITH {BARS}, d AS (SELECT symbol, bar, sign(close - lag(close) OVER {OVER})::INT AS dir FROM bars), s AS (SELECT *, CASE WHEN dir IS DISTINCT FROM lag(dir) OVER {OVER} OR lag(bar) OVER {OVER} IS NULL THEN bar END AS st FROM d) SELECT symbol, bar, last_value(st IGNORE NULLS) OVER {OVER} AS start FROM s")
def run_starts(spark, sf_dir):
    """Where the current run of closes in one direction began."""
    out = hourly(spark, sf_dir).withColumn("dir", F.signum(F.col("close") - F.lag("close").over(W.order())).cast("int"))
    new = ~F.col("dir").eqNullSafe(F.lag("dir").over(W.order())) | F.lag("bar").over(W.order()).isNull()
    seen = W.order().rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("st", F.when(new, F.col("bar"))).select("symbol", "bar", F.last("st", ignorenulls=True).over(seen).alias("start"))
