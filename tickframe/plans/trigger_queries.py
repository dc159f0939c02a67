"""Registered queries of volume profiles and of rules that trigger on bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickframe.operators import events as events_of
from tickframe.operators import frames as W
from tickframe.operators import profiles as V
from tickframe.operators import recursive as R
from tickframe.plans.queries import BARS, OVER, before, frame, hourly, last, query, rounded
from tickframe.plans.recurrences import N, SWING, mean, recursion

B = 24
BINS = f"g AS (SELECT symbol, min(low) AS base, (max(high) - min(low)) / {B} AS width FROM bars GROUP BY 1 HAVING max(high) > min(low)), x AS (SELECT b.*, base, width, greatest(0, least({B - 1}, floor((low - base) / width)))::INT AS b0, greatest(0, least({B - 1}, floor((high - base) / width)))::INT AS b1 FROM bars b JOIN g USING (symbol))"
OVERLAP = f"{BINS}, e AS (SELECT *, unnest(range(b0, b1 + 1)) AS bin FROM x), o AS (SELECT *, least(high, base + bin * width + width) - greatest(low, base + bin * width) AS ov FROM e), p AS (SELECT symbol, base, width, bin, sum(CASE WHEN ov > 0 THEN volume * ov / greatest(high - low, 1e-8) ELSE 0 END) AS v FROM o GROUP BY 1, 2, 3, 4)"
AREA = f"""d AS (SELECT symbol, i AS bin FROM (SELECT DISTINCT symbol FROM p), (SELECT unnest(range({B})) AS i)), l AS (SELECT d.symbol, list(coalesce(p.v, 0) ORDER BY d.bin) AS v FROM d LEFT JOIN p ON p.symbol = d.symbol AND p.bin = d.bin GROUP BY 1),
 rec AS (SELECT symbol, v, list_position(v, list_max(v))::INT AS poc, list_position(v, list_max(v))::INT AS lo, list_position(v, list_max(v))::INT AS hi, list_max(v) AS acc, 0 AS k FROM l UNION ALL
 SELECT symbol, v, poc, CASE WHEN up < down THEN lo - 1 ELSE lo END, CASE WHEN up >= down THEN hi + 1 ELSE hi END, acc + greatest(up, down), k + 1 FROM (SELECT *, CASE WHEN hi < {B} THEN v[hi + 1] ELSE -1 END AS up, CASE WHEN lo > 1 THEN v[lo - 1] ELSE -1 END AS down FROM rec) WHERE acc < 0.7::DOUBLE * list_sum(v) AND (hi < {B} OR lo > 1))"""


@query("overlap_profile", f"WITH {BARS}, {OVERLAP} SELECT symbol, bin::INT AS bin, round(v, 4) AS v FROM p")
def overlap_profile(spark, sf_dir):
    return V.overlap_profile(hourly(spark, sf_dir), B, "symbol").select("symbol", "bin", F.round("v", 4).alias("v"))


@query("value_area", f"WITH RECURSIVE {BARS}, {OVERLAP}, {AREA} SELECT symbol, round(base + (poc - 0.5) * width, 4) AS poc, round(base + hi * width, 4) AS vah, round(base + (lo - 1) * width, 4) AS val FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY k DESC) AS rn FROM rec) JOIN g USING (symbol) WHERE rn = 1")
def value_area(spark, sf_dir):
    """Point of control and 70 % value area of each symbol."""
    return rounded(V.value_area(V.overlap_profile(hourly(spark, sf_dir), B, "symbol"), B, 0.7, "symbol"), "symbol", "poc", "vah", "val", to=4)


PAIRED = f"""c AS (SELECT symbol, v, list_max(v) AS top FROM l), z AS (SELECT symbol, v, [i FOR i IN range(1, {B + 1}) IF v[i] >= top * (1 - 1e-12)] AS ps FROM c), s AS (SELECT symbol, v, list_sort([{{'d': abs(i - 1 - {(B - 1) / 2}), 'i': i}} FOR i IN ps])[1].i::INT AS poc FROM z),
 rec AS (SELECT symbol, v, poc AS lo, poc AS hi, v[poc] AS acc, 0 AS k FROM s UNION ALL SELECT symbol, v, CASE WHEN rise THEN lo ELSE greatest(lo - 2, 1) END, CASE WHEN rise THEN least(hi + 2, {B}) ELSE hi END, acc + CASE WHEN rise THEN up ELSE down END, k + 1 FROM (SELECT *, (up >= down AND hi < {B}) OR lo <= 1 AS rise FROM (SELECT *, coalesce(v[hi + 1], 0) + coalesce(v[hi + 2], 0) AS up, CASE WHEN lo > 1 THEN v[lo - 1] ELSE 0 END + CASE WHEN lo > 2 THEN v[lo - 2] ELSE 0 END AS down FROM rec)) WHERE acc < 0.7::DOUBLE * list_sum(v) - 1e-12 AND (hi < {B} OR lo > 1))"""


@query("paired_value_area", f"WITH RECURSIVE {BARS}, {OVERLAP}, {AREA.split(', rec AS')[0].split(' rec AS')[0].rstrip().rstrip(',')}, {PAIRED} SELECT symbol, round(base + hi * width, 4) AS vah, round(base + (lo - 1) * width, 4) AS val FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY k DESC) AS rn FROM rec) JOIN g USING (symbol) WHERE rn = 1")
def paired_value_area(spark, sf_dir):
    return rounded(V.paired_area(V.overlap_profile(hourly(spark, sf_dir), B, "symbol"), B, 0.7, "symbol"), "symbol", "vah", "val", to=4)


def dense(b):
    out = b.withColumn("_w", F.collect_list(F.struct(F.col("close").alias("p"), F.col("volume").alias("v"))).over(W.last(48))).where(F.size("_w") == 48)
    return V.density(out, "_w", "close", 12)


frame(
    "volume_density",
    dense,
    ["slope", "curve", "away"],
    f", w AS (SELECT symbol, bar, close, list({{'p': close, 'v': volume}}) OVER {last(48)} AS w FROM bars), r AS (SELECT *, list_min([x.p FOR x IN w]) AS lo, list_max([x.p FOR x IN w]) AS hi FROM w WHERE len(w) = 48), b AS (SELECT symbol, bar, least(11, greatest(0, floor((close - lo) / nullif(hi - lo, 0) * 12)))::INT AS b, [coalesce(list_sum([x.v FOR x IN w IF least(11, greatest(0, floor((x.p - lo) / nullif(hi - lo, 0) * 12)))::INT = k]), 0) FOR k IN range(12)] AS v FROM r) SELECT symbol, bar, (coalesce(v[b + 2], 0) - CASE WHEN b > 0 THEN v[b] ELSE 0 END)::DOUBLE AS slope, (coalesce(v[b + 2], 0) - 2 * v[b + 1] + CASE WHEN b > 0 THEN v[b] ELSE 0 END)::DOUBLE AS curve, (b - (list_position(v, list_max(v)) - 1))::INT AS away FROM b",
)

DAILY = "dx AS (SELECT *, date_trunc('day', bar)::TIMESTAMP AS day FROM bars), dg AS (SELECT symbol, day, count(*) AS n, max(high) AS h, min(low) AS l, arg_max(close, bar) AS c, max(high) FILTER (hour(bar) < 8) AS ah, min(low) FILTER (hour(bar) < 8) AS al, min(low) AS base, (max(high) - min(low)) / 12 AS width FROM dx GROUP BY 1, 2), db AS (SELECT symbol, day, base, width, greatest(0, least(11, floor(((dx.high + dx.low) / 2 - base) / width)))::INT AS bin, sum(volume) AS v FROM dx JOIN dg USING (symbol, day) WHERE width > 0 GROUP BY 1, 2, 3, 4, 5), dp AS (SELECT symbol, day, any_value(base) + (arg_max(bin, (v, -bin)) + 0.5) * any_value(width) AS poc FROM db GROUP BY 1, 2)"


@query("daily_levels", f"WITH {BARS}, {DAILY} SELECT symbol, day, CASE WHEN n >= 22 THEN round(h, 4) END AS high, CASE WHEN n >= 22 THEN round(l, 4) END AS low, CASE WHEN n >= 22 THEN round(c, 4) END AS close, CASE WHEN n >= 22 THEN round(poc, 6) END AS poc, round(ah, 4) AS early_high, round(al, 4) AS early_low FROM dg LEFT JOIN dp USING (symbol, day)")
def daily_levels(spark, sf_dir):
    """Levels of each day (null under 22 hours with trades) and of its first eight hours."""
    rows = hourly(spark, sf_dir).withColumn("day", F.date_trunc("day", "bar"))
    early = F.hour("bar") < 8
    days = rows.groupBy("symbol", "day").agg(F.count("*").alias("n"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar").alias("close"), F.max(F.when(early, F.col("high"))).alias("early_high"), F.min(F.when(early, F.col("low"))).alias("early_low"))
    poc = V.control_point(rows, 12, (F.col("high") + F.col("low")) / 2, "symbol", "day")
    full = days.join(poc, ["symbol", "day"], "left")
    return full.select("symbol", "day", *(F.round(F.when(F.col("n") >= 22, F.col(c)), 6).alias(c) for c in ("high", "low", "close", "poc")), F.round("early_high", 4).alias("early_high"), F.round("early_low", 4).alias("early_low"))


@query("typical_histogram", f"WITH {BARS}, {BINS} SELECT symbol, greatest(0, least({B - 1}, floor(((high + low + close) / 3 - base) / width)))::INT AS bin, round(sum(volume), 4) AS v FROM x GROUP BY 1, 2")
def typical_histogram(spark, sf_dir):
    """Volume by the bin of the typical price."""
    rows = V.ranged(hourly(spark, sf_dir), B, "symbol")
    return rows.groupBy("symbol", V.place((F.col("high") + F.col("low") + F.col("close")) / 3, B).alias("bin")).agg(F.round(F.sum("volume"), 4).alias("v"))


def gravity(b):
    out = b.withColumns({"_w": F.collect_list(F.struct(F.col("close").alias("p"), F.col("volume").alias("v"))).over(W.before(48)), "reach": F.lit(20.0)})
    above, below, pull = V.around(F.col("_w"), F.col("close"), F.col("reach"))
    return out.withColumns({"above": above, "below": below, "pull": pull, "lighter": F.when(above < below, 1).when(above > below, -1).otherwise(0)}).where(F.size("_w") == 48)


frame(
    "price_gravity",
    gravity,
    ["above", "below", "pull", "lighter"],
    f", w AS (SELECT symbol, bar, close, list({{'p': close, 'v': volume}}) OVER {before(48)} AS w FROM bars), s AS (SELECT symbol, bar, coalesce(list_sum([x.v FOR x IN w IF x.p > close AND x.p <= close + 20]), 0) AS above, coalesce(list_sum([x.v FOR x IN w IF x.p < close AND x.p >= close - 20]), 0) AS below, coalesce(list_sum([sign(x.p - close) * x.v / pow(abs(x.p - close) + 20, 2) FOR x IN w]), 0) AS pull FROM w WHERE len(w) = 48) SELECT symbol, bar, round(above, 6)::DOUBLE AS above, round(below, 6)::DOUBLE AS below, round(pull, 6) AS pull, CASE WHEN above < below THEN 1 WHEN above > below THEN -1 ELSE 0 END AS lighter FROM s",
)

# Rules

E = {f"e{n}": ("close", mean("n.close", f"(2.0::DOUBLE / {n + 1})", f"e{n}")) for n in (20, 50, 200)}
PULL = f"j AS (SELECT b.*, e20, e50, e200, lag(b.low) OVER w AS ol, lag(b.high) OVER w AS oh, lag(e20) OVER w AS oe FROM bars b JOIN rec USING (symbol, bar) WINDOW w AS (PARTITION BY b.symbol ORDER BY b.bar))"


@query("pullback_signal", f"WITH RECURSIVE {BARS}, {recursion(N, E)}, {PULL} SELECT symbol, bar, CASE WHEN e50 > e200 AND ol <= oe AND close > oh AND close > e20 THEN 1 ELSE -1 END AS side FROM j WHERE (e50 > e200 AND ol <= oe AND close > oh AND close > e20) OR (e50 < e200 AND oh >= oe AND close < ol AND close < e20)")
def pullback_signal(spark, sf_dir):
    """A bar that closes beyond the one before, which touched the short mean against the trend of the long ones."""
    b = hourly(spark, sf_dir)
    for n in (20, 50, 200):
        b = R.ema(b, n)
    old = {k: F.lag(c).over(W.order()) for k, c in {"ol": "low", "oh": "high", "oe": "ema20"}.items()}
    c, e20, up = F.col("close"), F.col("ema20"), F.col("ema50") > F.col("ema200")
    long = up & (F.col("ol") <= F.col("oe")) & (c > F.col("oh")) & (c > e20)
    short = (F.col("ema50") < F.col("ema200")) & (F.col("oh") >= F.col("oe")) & (c < F.col("ol")) & (c < e20)
    return b.withColumns(old).withColumn("side", F.when(long, 1).when(short, -1)).where("side is not null").select("symbol", "bar", "side")


def events(b):
    b = W.atr(b).withColumns({"a": F.lag("atr").over(W.order()), "vm": F.avg("volume").over(W.before(30)), "c4": F.lag("close", 4).over(W.order()), "v4": F.lag("volume", 4).over(W.order())})
    up, down = F.lit(True), F.lit(True)
    for k in range(5):
        now, old = F.lag("close", k).over(W.order()), F.lag("close", k + 1).over(W.order())
        up, down = up & (now > old), down & (now < old)
    b = b.withColumns({"up5": up, "down5": down, "z": (F.col("close") - F.col("open")) / F.col("a"), "rel": F.col("volume") / F.col("vm"), "rr": (F.col("high") - F.col("low")) / F.col("a")}).where("a > 0 and vm > 0")
    z, rel, rr = F.col("z"), F.col("rel"), F.col("rr")
    kinds = {
        "shock": (F.abs(z) >= 1) & (rel >= 1.5),
        "thin": (rr >= 1.2) & (rel <= 0.7),
        "absorbed": (rel >= 1.6) & (rr <= 0.6),
        "run": (F.col("up5") | F.col("down5")) & (F.col("volume") < F.col("v4")),
    }
    found = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in kinds.items())))
    return b.withColumn("kind", F.explode(found)).withColumn("side", F.signum(-z).cast("int"))


frame(
    "bar_events",
    events,
    ["kind", "side"],
    f", t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER {OVER}), abs(low - lag(close) OVER {OVER})) AS tr FROM bars), a AS (SELECT *, CASE WHEN count(*) OVER w >= 14 THEN avg(tr) OVER w END AS atr FROM t WINDOW w AS {last(14)}), b AS (SELECT *, lag(atr) OVER {OVER} AS a, avg(volume) OVER {before(30)} AS vm, lag(volume, 4) OVER {OVER} AS v4, {' AND '.join(f'lag(close, {k}) OVER {OVER} > lag(close, {k + 1}) OVER {OVER}' for k in range(5))} AS up5, {' AND '.join(f'lag(close, {k}) OVER {OVER} < lag(close, {k + 1}) OVER {OVER}' for k in range(5))} AS down5 FROM a), z AS (SELECT *, (close - open) / a AS z, volume / vm AS rel, (high - low) / a AS rr FROM b WHERE a > 0 AND vm > 0), k AS (SELECT symbol, bar, z, unnest([CASE WHEN abs(z) >= 1 AND rel >= 1.5 THEN 'shock' END, CASE WHEN rr >= 1.2 AND rel <= 0.7 THEN 'thin' END, CASE WHEN rel >= 1.6 AND rr <= 0.6 THEN 'absorbed' END, CASE WHEN (up5 OR down5) AND volume < v4 THEN 'run' END]) AS kind FROM z) SELECT symbol, bar, kind, sign(-z)::INT AS side FROM k WHERE kind IS NOT NULL",
)


def letters(b):
    b = W.atr(b).withColumns({"z": (F.col("close") - F.col("open")) / F.lag("atr").over(W.order()), "cl": (F.col("close") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-12))})
    code = F.concat(F.when(F.col("z") < -0.6, "0").when(F.col("z") < 0, "1").when(F.col("z") < 0.6, "2").otherwise("3"), F.when(F.col("cl") < 0.33, "0").when(F.col("cl") < 0.67, "1").otherwise("2"))
    return b.withColumn("code", F.when(F.col("z").isNotNull(), code))


@query("candle_ngrams", f"WITH {BARS}, t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER {OVER}), abs(low - lag(close) OVER {OVER})) AS tr FROM bars), a AS (SELECT *, CASE WHEN count(*) OVER w >= 14 THEN avg(tr) OVER w END AS atr FROM t WINDOW w AS {last(14)}), z AS (SELECT *, (close - open) / lag(atr) OVER {OVER} AS z, (close - low) / greatest(high - low, 1e-12) AS cl, lead(close, 4) OVER {OVER} / close - 1 AS fwd FROM a), c AS (SELECT *, CASE WHEN z IS NOT NULL THEN CASE WHEN z < -0.6 THEN '0' WHEN z < 0 THEN '1' WHEN z < 0.6 THEN '2' ELSE '3' END || CASE WHEN cl < 0.33 THEN '0' WHEN cl < 0.67 THEN '1' ELSE '2' END END AS code FROM z), g AS (SELECT lag(code, 2) OVER {OVER} || '-' || lag(code) OVER {OVER} || '-' || code AS gram, fwd FROM c) SELECT gram, count(*) AS n, round(avg(fwd), 6) AS mean FROM g WHERE gram IS NOT NULL AND fwd IS NOT NULL GROUP BY 1")
def candle_ngrams(spark, sf_dir):
    """Patterns of three bars (body in ranges, place of the close) with the mean return of four bars."""
    b = letters(hourly(spark, sf_dir)).withColumn("fwd", F.lead("close", 4).over(W.order()) / F.col("close") - 1)
    gram = F.concat(F.lag("code", 2).over(W.order()), F.lit("-"), F.lag("code").over(W.order()), F.lit("-"), F.col("code"))
    return b.withColumn("gram", gram).where("gram is not null and fwd is not null").groupBy("gram").agg(F.count("*").alias("n"), F.round(F.avg("fwd"), 6).alias("mean"))


@query("market_shocks", f"WITH {BARS}, r AS (SELECT symbol, bar, ln(close / lag(close) OVER {OVER}) AS ret FROM bars), z AS (SELECT symbol, bar, ret / nullif(stddev_pop(ret) OVER {before(48)}, 0) AS z FROM r) SELECT bar, count(*) AS n, count(*) FILTER (z > 1) AS up, count(*) FILTER (z < -1) AS down FROM z WHERE z IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (z > 1) >= 3 OR count(*) FILTER (z < -1) >= 3")
def market_shocks(spark, sf_dir):
    """Bars at which three symbols or more move by over a deviation in one direction."""
    r = W.returns(hourly(spark, sf_dir)).withColumn("z", F.col("ret") / F.nullif(F.stddev_pop("ret").over(W.before(48)), F.lit(0.0))).where("z is not null")
    return r.groupBy("bar").agg(F.count("*").alias("n"), F.count_if(F.col("z") > 1).alias("up"), F.count_if(F.col("z") < -1).alias("down")).where("up >= 3 or down >= 3")


@query("pair_spread", f"WITH {BARS}, p AS (SELECT a.symbol AS a, b.symbol AS b, a.bar, ln(a.close) - ln(b.close) AS s FROM bars a JOIN bars b ON a.bar = b.bar AND a.symbol < b.symbol), z AS (SELECT a, b, bar, CASE WHEN count(*) OVER w >= 48 THEN (s - avg(s) OVER w) / nullif(stddev_pop(s) OVER w, 0) END AS z FROM p WINDOW w AS (PARTITION BY a, b ORDER BY bar ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING)), o AS (SELECT *, lag(z) OVER (PARTITION BY a, b ORDER BY bar) AS old FROM z) SELECT a, b, bar, CASE WHEN z > 2 AND old <= 2 THEN -1 WHEN z < -2 AND old >= -2 THEN 1 ELSE 0 END AS act FROM o WHERE (z > 2 AND old <= 2) OR (z < -2 AND old >= -2) OR (sign(z) <> sign(old))")
def pair_spread(spark, sf_dir):
    """Entries (1, -1) where the spread of a pair leaves two deviations, exits (0) where it crosses its mean."""
    rows = hourly(spark, sf_dir)
    a, b = (rows.select(F.col("symbol").alias(n), "bar", F.log("close").alias(v)) for n, v in (("a", "x"), ("b", "y")))
    pair = Window.partitionBy("a", "b").orderBy("bar")
    w = pair.rowsBetween(-48, -1)
    s = a.join(b, "bar").where("a < b").withColumn("s", F.col("x") - F.col("y"))
    s = s.withColumn("z", F.when(F.count("*").over(w) >= 48, (F.col("s") - F.avg("s").over(w)) / F.nullif(F.stddev_pop("s").over(w), F.lit(0.0))))
    s = s.withColumn("old", F.lag("z").over(pair))
    z, old = F.col("z"), F.col("old")
    act = F.when((z > 2) & (old <= 2), -1).when((z < -2) & (old >= -2), 1).when(F.signum(z) != F.signum(old), 0)
    return s.withColumn("act", act).where("act is not null").select("a", "b", "bar", "act")


BOOK = {
    "golden": ("e20 > e50 AND le20 <= le50", "e20 < e50 AND le20 >= le50"),
    "band_fade": ("close < mid - 2 * sd AND close > open", "close > mid + 2 * sd AND close < open"),
    "breakout": ("close > top", "close < floor_"),
    "engulfing": ("close > lo AND open < lc AND lc < lo", "close < lo AND open > lc AND lc > lo"),
    "outside": ("high > lh AND low < ll AND close > open", "high > lh AND low < ll AND close < open"),
    "pin": ("(least(open, close) - low) > 2 * abs(close - open) AND (high - greatest(open, close)) < abs(close - open)", "(high - greatest(open, close)) > 2 * abs(close - open) AND (least(open, close) - low) < abs(close - open)"),
    "momentum": ("close / c12 - 1 > 1", "close / c12 - 1 < -0.5"),
    "volume_push": ("volume > 2 * vm AND close > open", "volume > 2 * vm AND close < open"),
    "inside_break": ("high < lh AND low > ll AND close > (lh + ll) / 2", "high < lh AND low > ll AND close < (lh + ll) / 2"),
    "failed_break": ("low < floor_ AND close > floor_", "high > top AND close < top"),
    "mean_pullback": ("e20 > e50 AND low <= e20 AND close > e20", "e20 < e50 AND high >= e20 AND close < e20"),
    "three_in_row": ("close > open AND lc > lo AND c2 > o2", "close < open AND lc < lo AND c2 < o2"),
    "gap_away": ("low > lh", "high < ll"),
    "doji_turn": ("abs(lc - lo) < 0.1 * (lh - ll) AND close > lh", "abs(lc - lo) < 0.1 * (lh - ll) AND close < ll"),
    "wide_close": ("close > low + 0.9 * (high - low) AND high - low > 2 * (lh - ll)", "close < low + 0.1 * (high - low) AND high - low > 2 * (lh - ll)"),
    "band_walk": ("close > mid + sd AND lc > mid", "close < mid - sd AND lc < mid"),
    "spring": ("low < floor_ AND close > floor_ AND volume > vm", "high > top AND close < top AND volume > vm"),
    "climax": ("volume > 3 * vm AND close < mid - 2 * sd", "volume > 3 * vm AND close > mid + 2 * sd"),
    "vacuum": ("volume < 0.5 * vm AND close > top", "volume < 0.5 * vm AND close < floor_"),
    "retest": ("lc > top AND low <= top AND close > top", "lc < floor_ AND high >= floor_ AND close < floor_"),
}
INPUTS = f"i AS (SELECT b.*, e20, e50, lag(e20) OVER w AS le20, lag(e50) OVER w AS le50, avg(b.close) OVER v AS mid, stddev_pop(b.close) OVER v AS sd, max(b.high) OVER p AS top, min(b.low) OVER p AS floor_, lag(b.open) OVER w AS lo, lag(b.close) OVER w AS lc, lag(b.high) OVER w AS lh, lag(b.low) OVER w AS ll, lag(b.close, 12) OVER w AS c12, lag(b.close, 2) OVER w AS c2, lag(b.open, 2) OVER w AS o2, avg(b.volume) OVER p AS vm FROM bars b JOIN rec USING (symbol, bar) WINDOW w AS (PARTITION BY b.symbol ORDER BY b.bar), v AS (PARTITION BY b.symbol ORDER BY b.bar ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), p AS (PARTITION BY b.symbol ORDER BY b.bar ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"


@query("rule_book", f"WITH RECURSIVE {BARS}, {recursion(N, {k: E[k] for k in ('e20', 'e50')})}, {INPUTS} " + " UNION ALL ".join(f"SELECT symbol, '{k}' AS rule, count(*) FILTER ({a}) AS longs, count(*) FILTER ({b}) AS shorts FROM i GROUP BY 1" for k, (a, b) in BOOK.items()))
def rule_book(spark, sf_dir):
    """A book of textbook rules, each a long and a short condition on shared columns; their signals by symbol, in one pass."""
    b = R.ema(R.ema(hourly(spark, sf_dir), 20), 50).withColumnsRenamed({"ema20": "e20", "ema50": "e50"})
    w = W.order()
    columns = {"le20": F.lag("e20").over(w), "le50": F.lag("e50").over(w), "mid": F.avg("close").over(W.last(20)), "sd": F.stddev_pop("close").over(W.last(20)), "top": F.max("high").over(W.before(20)), "floor_": F.min("low").over(W.before(20)), "lo": F.lag("open").over(w), "lc": F.lag("close").over(w), "lh": F.lag("high").over(w), "ll": F.lag("low").over(w), "c12": F.lag("close", 12).over(w), "c2": F.lag("close", 2).over(w), "o2": F.lag("open", 2).over(w), "vm": F.avg("volume").over(W.before(20))}
    sums = b.withColumns(columns).groupBy("symbol").agg(*(F.count_if(F.expr(c)).alias(f"{k}_{s}") for k, sides in BOOK.items() for s, c in zip("ls", sides)))
    return sums.select("symbol", F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(f"{k}_l").alias("longs"), F.col(f"{k}_s").alias("shorts")) for k in BOOK))).alias("x")).select("symbol", "x.*")


@query("estimator_votes", f"WITH RECURSIVE {BARS}, {recursion(N, {k: E[k] for k in ('e20', 'e50')})} SELECT symbol, bar, (sign(close - e20) + sign(close - e50) + sign(e20 - e50) + coalesce(sign(close - lag(close, 12) OVER {OVER}), 0) + coalesce(sign(close - lag(close, 24) OVER {OVER}), 0))::INT AS votes FROM rec JOIN bars USING (symbol, bar)")
def estimator_votes(spark, sf_dir):
    """Votes of five estimators of direction."""
    b = R.ema(R.ema(hourly(spark, sf_dir), 20), 50)
    c = F.col("close")
    signs = [F.signum(c - F.col("ema20")), F.signum(c - F.col("ema50")), F.signum(F.col("ema20") - F.col("ema50")), *(F.coalesce(F.signum(c - F.lag("close", k).over(W.order())), F.lit(0.0)) for k in (12, 24))]
    return b.select("symbol", "bar", sum(signs[1:], signs[0]).cast("int").alias("votes"))


LEGS = "tu AS (SELECT r.symbol, n.bar, CASE WHEN r.turn > 0 THEN r.tt ELSE r.ff END AS price, r.turn::INT AS kind FROM rec r JOIN n ON n.symbol = r.symbol AND n.i = CASE WHEN r.turn > 0 THEN r.ti ELSE r.fi END WHERE r.turn <> 0), lg AS (SELECT t.*, x.unit, lead(t.bar) OVER w AS until, lead(t.price) OVER w AS goal FROM tu t JOIN rec x ON x.symbol = t.symbol AND x.bar = t.bar WINDOW w AS (PARTITION BY t.symbol ORDER BY t.bar))"


@query("market_legs", f"WITH RECURSIVE {BARS}, {recursion(N, SWING)}, {LEGS} SELECT symbol, kind, count(*) AS n, round(avg(date_diff('hour', bar, until)), 6) AS hours, round(avg(goal / price - 1), 6) AS move, round(avg(abs(goal - price) / unit), 6) AS units FROM lg WHERE until IS NOT NULL GROUP BY 1, 2")
def market_legs(spark, sf_dir):
    """Legs between confirmed turns: how long they last, how far they go in percent and in units, by symbol and direction."""
    from tickframe.plans.recurrences import with_unit

    rows = with_unit(spark, sf_dir)
    turns = R.swings(rows).join(rows.select("symbol", "bar", "unit"), ["symbol", "bar"])
    w = Window.partitionBy("symbol").orderBy("bar")
    legs = turns.withColumns({"until": F.lead("bar").over(w), "to": F.lead("price").over(w)}).where("until is not null")
    hours = F.timestamp_diff("HOUR", F.col("bar"), F.col("until"))
    return legs.groupBy("symbol", "kind").agg(F.count("*").alias("n"), F.round(F.avg(hours.cast("double")), 6).alias("hours"), F.round(F.avg(F.col("to") / F.col("price") - 1), 6).alias("move"), F.round(F.avg(F.abs(F.col("to") - F.col("price")) / F.col("unit")), 6).alias("units"))


@query("bar_ladder", f"WITH {BARS}, k(k) AS (VALUES (1), (2), (4), (8)), l AS (SELECT symbol, k, time_bucket(INTERVAL 1 hour * k, bar) AS at, arg_min(open, bar) AS o, arg_max(close, bar) AS c, count(*) AS n FROM bars, k GROUP BY 1, 2, 3) SELECT symbol, k::INT AS k, count(*) AS n, round(avg((c > o)::INT), 6) AS up, round(avg(c / o - 1), 6) AS mean FROM l WHERE n = k GROUP BY 1, 2")
def bar_ladder(spark, sf_dir):
    """One rule on bars of several lengths, whole ones only: each hour counts once for each length."""
    rows = hourly(spark, sf_dir).withColumn("k", F.explode(F.array(*(F.lit(k) for k in (1, 2, 4, 8)))))
    hours = F.unix_seconds(F.col("bar").cast("timestamp")) / 3600
    bars = rows.groupBy("symbol", "k", F.floor(hours / F.col("k")).alias("at")).agg(F.min_by("open", "bar").alias("o"), F.max_by("close", "bar").alias("c"), F.count("*").alias("n")).where("n = k")
    return rounded(bars.groupBy("symbol", "k").agg(F.count("*").alias("n"), F.avg((F.col("c") > F.col("o")).cast("double")).alias("up"), F.avg(F.col("c") / F.col("o") - 1).alias("mean")), "symbol", "k", "n", "up", "mean")


FORMULAS = {
    "f1": "tanh((close - open) / nullif(high - low, 0))",
    "f2": "tanh(close / c4 - 1)",
    "f3": "tanh((2 * buy - volume) / nullif(volume, 0))",
    "f4": "tanh((close - mid) / nullif(sd, 0)) * -1",
    "f5": "tanh(ln(volume / nullif(vm, 0)))",
}


@query("formula_library", f"WITH {BARS}, i AS (SELECT *, lag(close, 4) OVER {OVER} AS c4, avg(close) OVER {last(24)} AS mid, stddev_pop(close) OVER {last(24)} AS sd, nullif(avg(nullif(volume, 0)) OVER {before(24)}, 0) AS vm FROM bars WHERE volume > 0), f AS (SELECT symbol, bar, " + ", ".join(f"{e} AS {k}" for k, e in FORMULAS.items()) + " FROM i) SELECT symbol, bar, " + ", ".join(f"round({k}, 6) AS {k}" for k in FORMULAS) + ", round((f1 + f2 + f3 + f4 + f5) / 5, 6) AS ensemble FROM f")
def formula_library(spark, sf_dir):
    """A library of formulas as SQL expressions on shared columns, and the mean of them."""
    rows = hourly(spark, sf_dir).where("volume > 0")
    rows = rows.withColumns({"c4": F.lag("close", 4).over(W.order()), "mid": F.avg("close").over(W.last(24)), "sd": F.stddev_pop("close").over(W.last(24)), "vm": F.avg("volume").over(W.before(24))})
    out = rows.select("symbol", "bar", *(F.expr(e).alias(k) for k, e in FORMULAS.items())).withColumn("ensemble", F.expr("(f1 + f2 + f3 + f4 + f5) / 5"))
    return rounded(out, "symbol", "bar", *FORMULAS, "ensemble")



THIRD = {
    "y": ("ln(close)", "ln(n.close)"),
    "v": ("NULL", "CASE WHEN r.v IS NULL THEN pow(q_y - r.y, 2) ELSE r.v + (2.0::DOUBLE / 101) * (pow(q_y - r.y, 2) - r.v) END"),
    "o": ("0", "greatest(q_v, 1e-10)"),
    "h00": ("0", "r.p00 + r.p11 + 0.25 * r.p22 + 2 * r.p01 + r.p02 + r.p12"),
    "h01": ("0", "r.p01 + r.p02 + r.p11 + 1.5 * r.p12 + 0.5 * r.p22"),
    "h02": ("0", "r.p02 + r.p12 + 0.5 * r.p22"),
    "h11": ("0", "r.p11 + 2 * r.p12 + r.p22"),
    "h12": ("0", "r.p12 + r.p22"),
    "h22": ("0", "r.p22 + 1e-6 * q_o"),
    "w": ("0", "q_h00 + q_o"),
    "e": ("0", "q_y - r.x - r.s - 0.5 * r.a"),
    "x": ("ln(close)", "r.x + r.s + 0.5 * r.a + q_h00 / q_w * q_e"),
    "s": ("0", "r.s + r.a + q_h01 / q_w * q_e"),
    "a": ("0", "r.a + q_h02 / q_w * q_e"),
    "p00": ("1", "q_h00 - q_h00 * q_h00 / q_w"),
    "p01": ("0", "q_h01 - q_h00 * q_h01 / q_w"),
    "p02": ("0", "q_h02 - q_h00 * q_h02 / q_w"),
    "p11": ("1", "q_h11 - q_h01 * q_h01 / q_w"),
    "p12": ("0", "q_h12 - q_h01 * q_h02 / q_w"),
    "p22": ("1", "q_h22 - q_h02 * q_h02 / q_w"),
}


@query("kalman_acceleration", f"WITH RECURSIVE {BARS}, {recursion(N, THIRD)} SELECT symbol, bar, CASE WHEN i > 101 THEN round(s / sqrt(greatest(p11, 1e-18)), 4) END AS slope_z, CASE WHEN i > 101 THEN round(a / sqrt(greatest(p22, 1e-18)), 4) END AS accel_z FROM rec")
def kalman_acceleration(spark, sf_dir):
    """Slope and acceleration of log close over their standard errors."""
    return rounded(R.kalman_acceleration(hourly(spark, sf_dir)), "symbol", "bar", "slope_z", "accel_z", to=4)


def lined(kind: int, name: str) -> str:
    return f"""{name}0 AS (SELECT symbol, bar, price, confirmed, epoch(bar) / 3600 AS h, lag(price) OVER w AS op, lag(epoch(bar) / 3600) OVER w AS oh FROM turns WHERE kind = {kind} WINDOW w AS (PARTITION BY symbol ORDER BY bar)), {name}1 AS (SELECT symbol, confirmed, price, h, (price - op) / (h - oh) AS slope FROM {name}0 WHERE op IS NOT NULL)"""


TURNS = "turns AS (SELECT r.symbol, n.bar, CASE WHEN r.turn > 0 THEN r.tt ELSE r.ff END AS price, r.turn::INT AS kind, r.bar AS confirmed FROM rec r JOIN n ON n.symbol = r.symbol AND n.i = CASE WHEN r.turn > 0 THEN r.ti ELSE r.fi END WHERE r.turn <> 0)"
LINES = f"{TURNS}, {lined(1, 't')}, {lined(-1, 'f')}, a AS (SELECT b.symbol, b.bar, b.close, t1.price + t1.slope * (epoch(b.bar) / 3600 - t1.h) AS top_line FROM bars b ASOF LEFT JOIN t1 ON b.symbol = t1.symbol AND b.bar >= t1.confirmed), c AS (SELECT a.*, f1.price + f1.slope * (epoch(a.bar) / 3600 - f1.h) AS floor_line FROM a ASOF LEFT JOIN f1 ON a.symbol = f1.symbol AND a.bar >= f1.confirmed), d AS (SELECT *, lag(close) OVER w AS oc, lag(top_line) OVER w AS ot, lag(floor_line) OVER w AS ofl FROM c WINDOW w AS (PARTITION BY symbol ORDER BY bar))"


@query("trend_lines", f"WITH RECURSIVE {BARS}, {recursion(N, SWING)}, {LINES} SELECT symbol, bar, round(top_line, 7) AS top_line, round(floor_line, 7) AS floor_line, CASE WHEN close > top_line AND oc <= ot THEN 1 WHEN close < floor_line AND oc >= ofl THEN -1 END AS \"cross\" FROM d")
def trend_lines(spark, sf_dir):
    from tickframe.plans.recurrences import with_unit

    turns = R.swings(with_unit(spark, sf_dir))
    return rounded(events_of.trend_lines(hourly(spark, sf_dir).select("symbol", "bar", "close"), turns), "symbol", "bar", "top_line", "floor_line", "cross", to=7)


frame("double_bottoms", lambda b: events_of.double_bottoms(b), ["low", "first_low", "apart"], f", i AS (SELECT *, row_number() OVER {OVER} AS i, count(*) OVER l = 3 AND count(*) OVER r = 3 AND low < min(low) OVER l AND low < min(low) OVER r AS ok FROM bars WINDOW l AS {before(3)}, r AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)), f AS (SELECT symbol, bar, low, lag(low) OVER {OVER} AS first_low, (i - lag(i) OVER {OVER})::INT AS apart FROM i WHERE ok) SELECT symbol, bar, round(low, 6) AS low, round(first_low, 6) AS first_low, apart FROM f WHERE apart >= 5 AND abs(low / first_low - 1) <= 0.1::DOUBLE")
WIDE = f"(high - low > 1.5::DOUBLE * avg(high - low) OVER {before(20)})"
frame(
    "setup_flags",
    lambda b: events_of.setup_flags(b),
    ["wick", "gap", "reclaim", "block"],
    f", m AS (SELECT *, avg(close) OVER {last(20)} AS m, lag(close) OVER {OVER} AS lc, lag(open) OVER {OVER} AS lo, {WIDE} AS wide, lag(high, 2) OVER {OVER} AS h2, lag(low, 2) OVER {OVER} AS l2 FROM bars), k AS (SELECT *, lag(m) OVER {OVER} AS lm FROM m) SELECT symbol, bar, CASE WHEN (least(open, close) - low) / nullif(high - low, 0) > 0.6 THEN 1 WHEN (high - greatest(open, close)) / nullif(high - low, 0) > 0.6 THEN -1 ELSE 0 END AS wick, CASE WHEN low > h2 THEN 1 WHEN high < l2 THEN -1 ELSE 0 END AS gap, CASE WHEN lc < lm AND close > m THEN 1 WHEN lc > lm AND close < m THEN -1 ELSE 0 END AS reclaim, CASE WHEN wide AND close > open AND lc < lo THEN 1 WHEN wide AND close < open AND lc > lo THEN -1 ELSE 0 END AS block FROM k",
)


RANGES = {"rma": ("tr", mean("n.tr", "(1.0::DOUBLE / 14)", "rma"))}
ABSORBED = f"""m AS (SELECT b.symbol, b.bar, b.close, rma, volume, quantile_cont(volume, 0.5) OVER p AS med, count(*) OVER p AS c, 2 * buy - volume AS delta, CASE WHEN rec.i >= 14 AND rma > 0 THEN (b.close - b.open) / rma END AS progress, list({{'l': b.low, 'h': b.high, 'v': volume}}) OVER q AS w FROM bars b JOIN rec USING (symbol, bar) WINDOW p AS (PARTITION BY b.symbol ORDER BY b.bar ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), q AS (PARTITION BY b.symbol ORDER BY b.bar ROWS BETWEEN 300 PRECEDING AND 1 PRECEDING)),
 e AS (SELECT *, list_min([x.l FOR x IN w]) AS lo, (list_max([x.h FOR x IN w]) - list_min([x.l FOR x IN w])) / 60 AS step FROM m WHERE c >= 50 AND volume > 0 AND med > 0 AND volume >= 1.8::DOUBLE * med AND abs(delta) >= 0.25::DOUBLE * volume AND sign(delta) * progress <= 0.35::DOUBLE),
 x AS (SELECT *, [{{'a': least(59, floor((x.l - lo) / step))::INT, 'b': least(59, floor((x.h - lo) / step))::INT, 'v': x.v}} FOR x IN w] AS xs FROM e),
 v AS (SELECT *, [coalesce(list_sum([x.v / (x.b - x.a + 1) FOR x IN xs IF x.a <= k AND x.b >= k]), 0) FOR k IN range(60)] AS vs FROM x),
 k AS (SELECT *, list_sort([{{'v': -vs[k + 1], 'i': k}} FOR k IN range(60) IF vs[k + 1] >= 1.5::DOUBLE * list_sum(vs) / 60 AND vs[k + 1] >= CASE WHEN k > 0 THEN vs[k] ELSE 0 END AND vs[k + 1] >= coalesce(vs[k + 2], 0)])[1:6] AS top FROM v)"""


@query("absorption", f"WITH RECURSIVE {BARS}, {recursion(N, RANGES)}, {ABSORBED} SELECT symbol, bar, round(med, 6) AS usual, delta, round(progress, 6) AS progress, CASE WHEN delta > 0 THEN -1 ELSE 1 END AS side, coalesce(len([t FOR t IN top IF abs(close - (lo + (t.i + 0.5) * step)) <= 0.5 * rma]) > 0, FALSE) AS node FROM k")
def absorption(spark, sf_dir):
    return rounded(events_of.absorption(hourly(spark, sf_dir)), "symbol", "bar", "usual", "delta", "progress", "side", "node")
