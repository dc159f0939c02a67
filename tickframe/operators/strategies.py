"""Forty-two textbook strategies as the side that each bar's close signals: 1 long, -1 short, 0 none.

Indicators are columns made in few passes: window frames, two scans for all
exponential means, and the two line systems that flip. A strategy is then a
pair of conditions on a bar and the one before; unknown values signal nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.operators import frames as W
from tickframe.operators import parallel as P
from tickframe.operators import recursive as R
from tickframe.operators.joins import first_at

c = F.col
TINY = 1e-12


def old(name: str, k: int = 1) -> Column:
    return F.lag(name, k).over(W.order())


def highest(name: str, n: int) -> Column:
    return W.full(F.max(name).over(W.last(n)), n, W.last(n), name)


def lowest(name: str, n: int) -> Column:
    return W.full(F.min(name).over(W.last(n)), n, W.last(n), name)


def mean(name: str, n: int) -> Column:
    return W.full(F.avg(name).over(W.last(n)), n, W.last(n), name)


def over(a: str, b: str) -> Column:
    """a crosses over b."""
    return (c(a) > c(b)) & (old(a) <= old(b))


def under(a: str, b: str) -> Column:
    return (c(a) < c(b)) & (old(a) >= old(b))


def passes(a: str, level: float, up: bool) -> Column:
    return ((c(a) > level) & (old(a) <= level)) if up else ((c(a) < level) & (old(a) >= level))


def sided(long: Column, short: Column) -> Column:
    return F.when(long, 1).when(short, -1).otherwise(0)


#: Exponential means that a family reads.
MEANS = {
    "trend": ("e9", "e20", "e21", "e50", "e200", "e12", "e26", "p_", "m_", "atr14"),
    "breakout": ("e20", "atr14"),
    "reversion": ("e200", "up14_", "dn14_", "up2_", "dn2_"),
    "action": ("e50", "atr14"),
    "flow": ("e50", "e200", "e12", "e26", "up14_", "dn14_"),
}


def with_indicators(bars: DataFrame, family: str) -> DataFrame:
    """bars with the columns that a family of strategies reads; scans run for its own means alone."""
    change = F.coalesce(c("close") - old("close"), F.lit(0.0))
    up, down = F.coalesce(c("high") - old("high"), F.lit(0.0)), F.coalesce(old("low") - c("low"), F.lit(0.0))
    span = F.greatest(c("high") - c("low"), F.abs(c("high") - F.coalesce(old("close"), c("close"))), F.abs(c("low") - F.coalesce(old("close"), c("close"))))
    rows = bars.withColumns({"up_": F.greatest(change, F.lit(0.0)), "dn_": F.greatest(-change, F.lit(0.0)), "plus_": F.when((up > down) & (up > 0), up).otherwise(0.0), "minus_": F.when((down > up) & (down > 0), down).otherwise(0.0), "span_": span, "flow_": F.signum(change) * c("volume")})
    means = {f"e{n}": ("close", 2 / (n + 1)) for n in (9, 20, 21, 50, 200, 12, 26)}
    means |= {f"{x}{n}_": (f"{x}_", 1 / n) for x in ("up", "dn") for n in (14, 2)} | {"p_": ("plus_", 1 / 14), "m_": ("minus_", 1 / 14), "atr14": ("span_", 1 / 14)}
    rows = P.smoothed(rows, **{k: means[k] for k in MEANS[family]})
    if family in ("trend", "flow"):
        rows = rows.withColumn("line", c("e12") - c("e26"))
        second = {"signal": ("line", 0.2)}
        if family == "trend":
            t = F.greatest("atr14", F.lit(TINY))
            rows = rows.withColumns({"pdi": 100 * c("p_") / t, "mdi": 100 * c("m_") / t})
            second["adx"] = (100 * F.abs(c("pdi") - c("mdi")) / F.greatest(c("pdi") + c("mdi"), F.lit(TINY)), 1 / 14)
        rows = P.smoothed(rows, **second).withColumn("hist", c("line") - c("signal"))
    if family == "trend":
        rows = R.parabolic(R.supertrend(P.heikin_ashi(rows))).withColumn("green", (c("ha_close") > c("ha_open")).cast("int"))
    for n in (14, 2):
        if f"up{n}_" in MEANS[family]:
            rows = rows.withColumn(f"rsi{n}", 100 - 100 / (1 + c(f"up{n}_") / F.greatest(f"dn{n}_", F.lit(TINY))))
    rows = W.session_range(rows, 0, 7).withColumnsRenamed({"range_high": "asia_top", "range_low": "asia_floor"})
    rows = W.session_range(rows, 13, 14).withColumnsRenamed({"range_high": "open_top", "range_low": "open_floor"})
    rows = rows.withColumns({"mid": mean("close", 20), "sd": W.full(F.stddev_pop("close").over(W.last(20)), 20, W.last(20)), "tp": (c("high") + c("low") + c("close")) / 3, "size": F.greatest(c("high") - c("low"), F.lit(TINY)), "body": F.abs(c("close") - c("open")), "mid50": mean("close", 50), "sd50": W.full(F.stddev_pop("close").over(W.last(50)), 50, W.last(50)), "hour": F.hour("bar")})
    rows = rows.withColumns({"top": c("mid") + 2 * c("sd"), "floor": c("mid") - 2 * c("sd"), "width": 4 * c("sd") / F.greatest("mid", F.lit(TINY)), "z50": (c("close") - c("mid50")) / F.greatest("sd50", F.lit(TINY))})
    rows = rows.withColumns({f"top{n}": highest("high", n) for n in (3, 9, 14, 20, 26, 52, 55)} | {f"low{n}": lowest("low", n) for n in (3, 9, 14, 20, 26, 52, 55)})
    raw = F.coalesce(100 * (c("close") - c("low14")) / F.greatest(c("top14") - c("low14"), F.lit(TINY)), F.lit(50.0))
    day = Window.partitionBy("symbol", F.to_date("bar")).orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    vwap = F.sum(c("tp") * c("volume")).over(day) / F.greatest(F.sum("volume").over(day), F.lit(TINY))
    square = F.sum(c("tp") * c("tp") * c("volume")).over(day) / F.greatest(F.sum("volume").over(day), F.lit(TINY))
    money = c("tp") * c("volume")
    rows = rows.withColumns({"raw": raw, "turn": (c("top9") + c("low9")) / 2, "base": (c("top26") + c("low26")) / 2, "wide": (c("top52") + c("low52")) / 2, "vwap": vwap, "square": square, "in_": F.when(c("tp") > old("tp"), money).otherwise(0.0), "out_": F.when(c("tp") < old("tp"), money).otherwise(0.0), "obv": F.sum("flow_").over(W.order().rowsBetween(Window.unboundedPreceding, 0))})
    rows = W.channel_index(rows)
    inner = 1 + W.full(F.sum("in_").over(W.last(14)), 14, W.last(14)) / F.greatest(F.sum("out_").over(W.last(14)), F.lit(TINY))
    rows = rows.withColumns({"k": mean("raw", 3), "wr": F.when(c("top14").isNotNull(), c("raw") - 100), "vwap_sd": F.sqrt(F.greatest(c("square") - c("vwap") * c("vwap"), F.lit(0.0))), "mfi": 100 - 100 / inner, "cloud_a": F.lag((c("turn") + c("base")) / 2, 26).over(W.order()), "cloud_b": F.lag("wide", 26).over(W.order()), "tight": F.when(c("width") <= lowest("width", 120) * 1.1, 1).otherwise(0), "narrow": F.when(c("size") <= lowest("size", 7), 1).otherwise(0), "usual": mean("volume", 20)})
    return rows.withColumn("d", mean("k", 3))


def trend_rules() -> dict[str, Column]:
    above, below = c("close") > c("e200"), c("close") < c("e200")
    flip, sar = (c("trend") - old("trend")) / 2, (c("side") - old("side")) / 2
    cloud_top, cloud_floor = F.greatest("cloud_a", "cloud_b"), F.least("cloud_a", "cloud_b")
    stacked = (c("e20") > c("e50")) & (c("e50") > c("e200"))
    fallen = (c("e20") < c("e50")) & (c("e50") < c("e200"))
    return {
        "t01": sided(over("e9", "e21"), under("e9", "e21")),
        "t02": sided(over("e20", "e50") & above, under("e20", "e50") & below),
        "t03": sided(over("line", "signal") & (c("line") > 0), under("line", "signal") & (c("line") < 0)),
        "t04": sided(over("line", "signal") & above, under("line", "signal") & below),
        "t05": sided(flip == 1, flip == -1),
        "t06": sided((flip == 1) & above, (flip == -1) & below),
        "t07": sided((sar == 1) & above, (sar == -1) & below),
        "t08": sided(over("pdi", "mdi") & (c("adx") > 25), under("pdi", "mdi") & (c("adx") > 25)),
        "t09": sided(over("turn", "base") & (c("close") > cloud_top), under("turn", "base") & (c("close") < cloud_floor)),
        "t10": sided((c("green") == 1) & (old("green") == 0) & (c("close") > c("e50")), (c("green") == 0) & (old("green") == 1) & (c("close") < c("e50"))),
        "t11": sided(stacked & (c("low") <= c("e20")) & (c("close") > c("e20")) & (c("close") > c("open")), fallen & (c("high") >= c("e20")) & (c("close") < c("e20")) & (c("close") < c("open"))),
    }


def breakout_rules() -> dict[str, Column]:
    inside = (old("high") < old("high", 2)) & (old("low") > old("low", 2))
    tight, narrow = old("tight") == 1, old("narrow") == 1
    london, york = c("hour").between(7, 10), c("hour").between(14, 17)
    return {
        "b01": sided(c("close") > old("top20"), c("close") < old("low20")),
        "b02": sided(c("close") > old("top55"), c("close") < old("low55")),
        "b03": sided(tight & (c("close") > c("top")), tight & (c("close") < c("floor"))),
        "b04": sided(over("close", "keltner_top"), under("close", "keltner_floor")),
        "b05": sided(inside & (c("close") > old("high")), inside & (c("close") < old("low"))),
        "b06": sided(narrow & (c("close") > old("high")), narrow & (c("close") < old("low"))),
        "b07": sided(london & over("close", "asia_top"), london & under("close", "asia_floor")),
        "b08": sided(york & over("close", "open_top"), york & under("close", "open_floor")),
    }


def reversion_rules() -> dict[str, Column]:
    above, below = c("close") > c("e200"), c("close") < c("e200")
    return {
        "m01": sided((c("rsi2") < 10) & above, (c("rsi2") > 90) & below),
        "m02": sided(passes("rsi14", 30, True), passes("rsi14", 70, False)),
        "m03": sided((old("close") < old("floor")) & (c("close") > c("floor")), (old("close") > old("top")) & (c("close") < c("top"))),
        "m04": sided(over("k", "d") & (c("k") < 20) & above, under("k", "d") & (c("k") > 80) & below),
        "m05": sided((c("close") < c("vwap") - 2 * c("vwap_sd")) & (c("close") > c("open")), (c("close") > c("vwap") + 2 * c("vwap_sd")) & (c("close") < c("open"))),
        "m06": sided(passes("z50", -2, True), passes("z50", 2, False)),
        "m07": sided(passes("wr", -80, True), passes("wr", -20, False)),
        "m08": sided(passes("cci", -100, True), passes("cci", 100, False)),
        "m09": sided(passes("mfi", 20, True), passes("mfi", 80, False)),
    }


def action_rules() -> dict[str, Column]:
    o, h, l, x = c("open"), c("high"), c("low"), c("close")
    small = c("body") / c("size") <= 0.3
    pin_up, pin_down = ((F.least(o, x) - l) / c("size") >= 0.6) & small, ((h - F.greatest(o, x)) / c("size") >= 0.6) & small
    at_low, at_top = l <= c("low20"), h >= c("top20")
    eats_up = (old("close") < old("open")) & (x > o) & (x >= old("open")) & (o <= old("close"))
    eats_down = (old("close") > old("open")) & (x < o) & (x <= old("open")) & (o >= old("close"))
    three_up = (x > o) & (old("close") > old("open")) & (old("close", 2) > old("open", 2)) & (x > old("close")) & (old("close") > old("close", 2))
    three_down = (x < o) & (old("close") < old("open")) & (old("close", 2) < old("open", 2)) & (x < old("close")) & (old("close") < old("close", 2))
    pause, half = old("body") <= 0.3 * old("size"), (old("open", 2) + old("close", 2)) / 2
    return {
        "p01": sided(pin_up & at_low, pin_down & at_top),
        "p02": sided(eats_up & (c("low3") <= c("low20")), eats_down & (c("top3") >= c("top20"))),
        "p03": sided(three_up, three_down),
        "p04": sided((old("close", 2) < old("open", 2)) & pause & (x > o) & (x > half), (old("close", 2) > old("open", 2)) & pause & (x < o) & (x < half)),
        "p05": sided((l < old("low20")) & (x > old("low20")), (h > old("top20")) & (x < old("top20"))),
        "p06": sided(over("close", "fractal_top") & (x > c("e50")), under("close", "fractal_floor") & (x < c("e50"))),
        "p07": sided(c("neck") == 1, c("neck") == -1),
    }


def flow_rules() -> dict[str, Column]:
    x, o = c("close"), c("open")
    burst = c("volume") >= 2 * old("usual")
    low, top = c("low") <= c("low20"), c("high") >= c("top20")
    return {
        "v01": sided(burst & (x > o) & ((x - c("low")) / c("size") >= 0.75), burst & (x < o) & ((c("high") - x) / c("size") >= 0.75)),
        "v02": sided((c("obv") >= c("obv_top")) & (x < old("top20")) & (x > c("e50")), (c("obv") <= c("obv_low")) & (x > old("low20")) & (x < c("e50"))),
        "v03": sided(over("close", "vwap") & (x > c("e200")), under("close", "vwap") & (x < c("e200"))),
        "d01": sided(low & (c("rsi14") > old("rsi_low", 10) + 5) & (c("low") < old("low20", 10)) & (x > o), top & (c("rsi14") < old("rsi_top", 10) - 5) & (c("high") > old("top20", 10)) & (x < o)),
        "d02": sided(low & (c("hist") > old("hist_low", 10)) & (c("hist") < 0) & (c("hist") > old("hist")), top & (c("hist") < old("hist_top", 10)) & (c("hist") > 0) & (c("hist") < old("hist"))),
        "s01": sided((c("hour") == 8) & (x > c("asia_top")), (c("hour") == 8) & (x < c("asia_floor"))),
        "s02": sided((c("hour") == 14) & (x < c("day_open") * 0.99), (c("hour") == 14) & (x > c("day_open") * 1.01)),
    }


def _with_shapes(rows: DataFrame) -> DataFrame:
    """rows with the latest fractals (known two bars later) and the breaks of a neckline between two like extremes."""
    w, so_far = W.order(), W.order().rowsBetween(Window.unboundedPreceding, 0)
    left, right = w.rowsBetween(-2, -1), w.rowsBetween(1, 2)
    whole = (F.count(F.lit(1)).over(left) == 2) & (F.count(F.lit(1)).over(right) == 2)
    peak = F.when(whole & (c("high") > F.max("high").over(left)) & (c("high") > F.max("high").over(right)), c("high"))
    dip = F.when(whole & (c("low") < F.min("low").over(left)) & (c("low") < F.min("low").over(right)), c("low"))
    rows = rows.withColumns({"_p": peak, "_d": dip}).withColumns({"_p": F.lag("_p", 2).over(w), "_d": F.lag("_d", 2).over(w)})
    rows = rows.withColumns({"fractal_top": F.last("_p", ignorenulls=True).over(so_far), "fractal_floor": F.last("_d", ignorenulls=True).over(so_far)})
    necks = _necklines(rows)
    return rows.join(necks, ["symbol", "bar"], "left").drop("_p", "_d")


def _necklines(rows: DataFrame, near: float = 0.3, reach: int = 27) -> DataFrame:
    """(symbol, bar, neck): bars that close beyond the extreme between two lows (neck 1) or highs (-1) within `near`
    ranges, 10 to 60 bars apart and the next of their kind, three bars after the second one at the earliest and before the pair is passed."""
    found = None
    for way in (1, -1):
        low, high = (c("low"), c("high")) if way > 0 else (-c("high"), -c("low"))
        own = rows.select("symbol", "bar", low.alias("l"), high.alias("h"), (way * c("close")).alias("x"), c("atr14").alias("a"), F.row_number().over(W.order()).alias("i"))
        left, right = W.order().rowsBetween(-3, -1), W.order().rowsBetween(1, 3)
        whole = (F.count(F.lit(1)).over(left) == 3) & (F.count(F.lit(1)).over(right) == 3)
        # The path before a low holds the neckline, at most 60 bars back; the one after it, what becomes of it.
        own = own.withColumns({"ok": whole & (c("l") < F.min("l").over(left)) & (c("l") < F.min("l").over(right)), "back": F.collect_list(F.struct("i", "h")).over(W.order().rowsBetween(-60, 0)), "path": F.collect_list(F.struct("bar", "x", "l")).over(W.order().rowsBetween(3, 2 + reach))})
        lows = own.where("ok").withColumns({"first": F.lag("i").over(W.order()), "other": F.lag("l").over(W.order())})
        lows = lows.where((c("i") - c("first")).between(10, 60) & (F.abs(c("l") - c("other")) <= near * c("a")))
        lows = lows.withColumns({"line": F.array_max(F.transform(F.filter("back", lambda e: e["i"] >= c("first")), lambda e: e["h"])), "least": F.least("l", "other")})
        # A bar that closes over the line counts even if its low is under the pair: the close is looked at first.
        lows = lows.withColumns({"hit": first_at(c("path"), lambda e: e["x"] > c("line")), "gone": first_at(c("path"), lambda e: e["l"] < c("least"))})
        lows = lows.where("hit is not null and (gone is null or hit <= gone)")
        marks = lows.select("symbol", F.get("path", c("hit").cast("int") - 1)["bar"].alias("bar"), F.lit(way).alias("neck"))
        found = marks if found is None else found.unionByName(marks)
    return found.groupBy("symbol", "bar").agg(F.max("neck").alias("neck"))


def signals(bars: DataFrame, family: str) -> DataFrame:
    """symbol, bar and a column for each strategy of a family: trend, breakout, reversion, action or flow."""
    rows = with_indicators(bars, family)
    if family == "breakout":
        rows = rows.withColumns({"keltner_top": c("e20") + 2 * c("atr14"), "keltner_floor": c("e20") - 2 * c("atr14")})
    if family == "action":
        rows = _with_shapes(rows)
    if family == "flow":
        day = Window.partitionBy("symbol").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
        opened = F.last(F.when(c("hour") == 0, c("open")), ignorenulls=True).over(day)
        rows = rows.withColumns({"obv_top": highest("obv", 20), "obv_low": lowest("obv", 20), "rsi_low": lowest("rsi14", 20), "rsi_top": highest("rsi14", 20), "hist_low": lowest("hist", 20), "hist_top": highest("hist", 20), "day_open": F.coalesce(opened, F.first("close").over(day))})
    rules = {"trend": trend_rules, "breakout": breakout_rules, "reversion": reversion_rules, "action": action_rules, "flow": flow_rules}[family]()
    return rows.select("symbol", "bar", *(x.alias(n) for n, x in rules.items()))
