"""Event detectors on bars, per symbol in time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.operators.frames import before, full, last, order
from tickframe.operators.joins import as_of
from tickframe.operators.recursive import atr_kinds


def sweeps(bars: DataFrame, far: int = 20, near: int = 6) -> DataFrame:
    """Bars whose wick passes the extreme of the bars `far` to `near` before and that close back inside."""
    window = order().rowsBetween(-far, -near)
    low, high = F.min("low").over(window), F.max("high").over(window)
    side = F.when((F.col("low") < low) & (F.col("close") > low), 1).when((F.col("high") > high) & (F.col("close") < high), -1)
    return bars.withColumn("side", F.when(F.count(F.lit(1)).over(window) == far - near + 1, side)).where("side is not null")


def gaps(bars: DataFrame) -> DataFrame:
    """Three-bar price gaps with their bounds; filled: a later bar reaches into the gap's far side."""
    old_high, old_low = F.lag("high", 2).over(order()), F.lag("low", 2).over(order())
    later = Window.partitionBy("symbol").orderBy(F.desc("bar")).rowsBetween(Window.unboundedPreceding, -1)  # a frame that only grows
    out = bars.withColumns(
        {
            "side": F.when(F.col("low") > old_high, 1).when(F.col("high") < old_low, -1),
            "bottom": F.when(F.col("low") > old_high, old_high).otherwise(F.col("high")),
            "top": F.when(F.col("low") > old_high, F.col("low")).otherwise(old_low),
            "after_low": F.min("low").over(later),
            "after_high": F.max("high").over(later),
        }
    ).where("side is not null")
    filled = F.when(F.col("side") == 1, F.col("after_low") <= F.col("bottom")).otherwise(F.col("after_high") >= F.col("top"))
    return out.withColumn("filled", F.coalesce(filled, F.lit(False)))


# Fixed values of the absorption rule: volume against its median, share of one side, progress in ranges, nearness of a
# node in ranges, bars and bins of the profile, and what a node holds against the mean bin.
VOLUME, SHARE, PROGRESS, NEAR, PROFILE_BARS, PROFILE_BINS, NODE = 1.8, 0.25, 0.35, 0.5, 300, 60, 1.5


def absorption(bars: DataFrame, n: int = 50) -> DataFrame:
    """Heavy one-sided volume that does not move price its own way: the other side follows. `node` says whether the close
    lies near one of the six largest volume nodes of the bars before.

    The profile is made for the bars that pass the rule alone, of a bounded array.
    """
    ranged = atr_kinds(bars).withColumn("i", F.row_number().over(order()))
    middle = F.percentile("volume", F.lit(0.5)).over(before(n))
    marked = ranged.withColumns(
        {
            "usual": full(middle, n, before(n)),
            "delta": 2 * F.col("buy") - F.col("volume"),
            "progress": F.when((F.col("i") >= 14) & (F.col("rma") > 0), (F.col("close") - F.col("open")) / F.col("rma")),
            "_w": F.collect_list(F.struct("low", "high", "volume")).over(before(PROFILE_BARS)),
        }
    )
    heavy = (F.col("volume") > 0) & (F.col("usual") > 0) & (F.col("volume") >= VOLUME * F.col("usual")) & (F.abs("delta") >= SHARE * F.col("volume"))
    found = marked.where(heavy & (F.signum("delta") * F.col("progress") <= PROGRESS)).withColumn("side", F.when(F.col("delta") > 0, -1).otherwise(1))
    return near_node(found, "_w").drop("_w", "i")


def near_node(rows: DataFrame, window: str) -> DataFrame:
    """rows with `node`: whether close lies within NEAR mean ranges (rma) of one of the six largest nodes of an array of (low, high, volume)."""
    bounds = rows.withColumns({"_lo": F.array_min(F.transform(window, lambda x: x["low"])), "_hi": F.array_max(F.transform(window, lambda x: x["high"]))})
    step = (F.col("_hi") - F.col("_lo")) / PROFILE_BINS

    def at(price: Column) -> Column:
        return F.least(F.lit(PROFILE_BINS - 1), F.floor((price - F.col("_lo")) / F.nullif(F.col("_step"), F.lit(0.0)))).cast("int")

    spread = bounds.withColumn("_step", step).withColumn("_x", F.transform(window, lambda x: F.struct(at(x["low"]).alias("a"), at(x["high"]).alias("b"), (x["volume"] / (at(x["high"]) - at(x["low"]) + 1)).alias("v"))))
    sums = F.transform(F.sequence(F.lit(0), F.lit(PROFILE_BINS - 1)), lambda i: F.aggregate("_x", F.lit(0.0), lambda s, x: s + F.when((x["a"] <= i) & (x["b"] >= i), x["v"]).otherwise(0.0)))
    profile = spread.withColumn("_v", sums).withColumn("_mean", F.aggregate("_v", F.lit(0.0), lambda s, x: s + x) / PROFILE_BINS)
    peak = F.filter(F.sequence(F.lit(0), F.lit(PROFILE_BINS - 1)), lambda i: (F.get("_v", i) >= NODE * F.col("_mean")) & (F.get("_v", i) >= F.coalesce(F.when(i > 0, F.get("_v", i - 1)), F.lit(0.0))) & (F.get("_v", i) >= F.coalesce(F.get("_v", i + 1), F.lit(0.0))))
    largest = F.slice(F.array_sort(F.transform(peak, lambda i: F.struct(F.negate(F.get("_v", i)).alias("v"), i.alias("i")))), 1, 6)
    node = F.exists(largest, lambda x: F.abs(F.col("close") - (F.col("_lo") + (x["i"] + 0.5) * F.col("_step"))) <= NEAR * F.col("rma"))
    return profile.withColumn("node", F.coalesce((F.col("_step") > 0) & node, F.lit(False))).drop("_lo", "_hi", "_step", "_x", "_v", "_mean")


def order_patterns(bars: DataFrame, n: int = 48) -> DataFrame:
    """Permutation entropy of the orders of three closes over the last n bars, as a share of its maximum."""
    a, b, c = (F.lag("close", k).over(order()) for k in (2, 1, 0))
    code = (a < b).cast("int") * 4 + (b < c).cast("int") * 2 + (a < c).cast("int")
    out = bars.withColumn("code", code)
    total = F.count("code").over(last(n))
    parts = [F.sum((F.col("code") == k).cast("int")).over(last(n)) / total for k in (0, 2, 3, 4, 5, 7)]
    entropy = sum((F.when(p > 0, -p * F.log(p)).otherwise(0.0) for p in parts), F.lit(0.0)) / F.log(F.lit(6.0))
    return out.withColumn("entropy", F.when(total >= n, entropy))


def ordered_states(bars: DataFrame, n: int = 48, ref: int = 100, share: float = 0.2) -> DataFrame:
    """Permutation entropy with its rank among the last `ref` values, and whether that is in the lowest part: an ordered state."""
    out = order_patterns(bars, n).withColumn("entropy", F.round("entropy", 9))  # so that equal patterns are equal
    out = out.withColumn("_e", F.collect_list("entropy").over(last(ref)))
    rank = F.size(F.filter("_e", lambda x: x <= F.col("entropy"))) / F.size("_e")
    out = out.withColumn("rank", F.when(F.size("_e") == ref, rank))
    return out.withColumn("ordered", F.col("rank") <= share).drop("_e")


def market_beta(bars: DataFrame, market: str, n: int = 48) -> DataFrame:
    """Rolling slope and correlation of returns on one symbol's returns at the same bar.

    The market's rows are one symbol's, joined by bar: an equality, so that
    Spark picks a broadcast only if they are small.
    """
    r = bars.withColumn("ret", F.log(F.col("close") / F.lag("close").over(order()))).where("ret is not null")
    other = r.where(F.col("symbol") == market).select("bar", F.col("ret").alias("mkt"))
    both = r.where(F.col("symbol") != market).join(other, "bar")
    return both.withColumns({"beta": full(F.regr_slope("ret", "mkt").over(last(n)), n, last(n)), "rho": full(F.corr("ret", "mkt").over(last(n)), n, last(n))})


def breadth(bars: DataFrame) -> DataFrame:
    """Of each bar: symbols, shares of rises and falls, and the volume-weighted balance."""
    r = bars.withColumn("way", F.signum(F.col("close") - F.lag("close").over(order()))).where("way is not null")
    return r.groupBy("bar").agg(F.count("*").alias("n"), F.avg((F.col("way") > 0).cast("double")).alias("up"), F.avg((F.col("way") < 0).cast("double")).alias("down"), F.when(F.sum("volume") > 0, F.sum(F.col("way") * F.col("volume")) / F.sum("volume")).alias("balance"))


def volume_nodes(profile: DataFrame, times: float = 1.2, most: int = 5) -> DataFrame:
    """Local maxima of a profile (symbol, bin, volume) above `times` its mean, the largest `most` of each symbol."""
    near = Window.partitionBy("symbol").orderBy("bin")
    marked = profile.withColumns({"a": F.coalesce(F.lag("volume").over(near), F.lit(0.0)), "b": F.coalesce(F.lead("volume").over(near), F.lit(0.0)), "mean": F.avg("volume").over(Window.partitionBy("symbol"))})
    peaks = marked.where((F.col("volume") >= F.col("a")) & (F.col("volume") >= F.col("b")) & (F.col("volume") >= times * F.col("mean")))
    return peaks.withColumn("rk", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("volume"), "bin"))).where(F.col("rk") <= most)


def breadth_entropy(bars: DataFrame, k: int = 16) -> DataFrame:
    """Of each bar: entropy of the shares of rises, falls and flats over its maximum, and the change of the share of rises in k bars.

    The window runs over one row for each bar, whatever the number of symbols.
    """
    r = bars.withColumn("way", F.signum(F.col("close") - F.lag("close").over(order()))).where("way is not null")
    shares = r.groupBy("bar").agg(F.count("*").alias("n"), F.avg((F.col("way") > 0).cast("double")).alias("u"), F.avg((F.col("way") < 0).cast("double")).alias("d"))
    parts = [F.when(p > 1e-12, p * F.log(p)).otherwise(0.0) for p in (F.col("u"), F.col("d"), 1 - F.col("u") - F.col("d"))]
    return shares.withColumns({"entropy": -(parts[0] + parts[1] + parts[2]) / F.log(F.lit(3.0)), "shift": F.col("u") - F.lag("u", k).over(Window.orderBy("bar"))})


def _met(bars: DataFrame) -> DataFrame:
    r = bars.withColumn("ret", F.log(F.col("close") / F.lag("close").over(order()))).where("ret is not null")
    a, b = (r.select(F.col("symbol").alias(n), "bar", F.col("ret").alias(v)) for n, v in (("a", "x"), ("b", "y")))
    return a.join(b, "bar").where("a < b")


def pairs(bars: DataFrame, n: int = 64) -> DataFrame:
    """Rolling correlation of returns of each pair of symbols over n common bars."""
    frame = Window.partitionBy("a", "b").orderBy("bar").rowsBetween(-(n - 1), 0)
    return _met(bars).withColumn("rho", F.when(F.count(F.lit(1)).over(frame) >= n, F.corr("x", "y").over(frame)))


def daily_beta(bars: DataFrame, days: int = 10) -> DataFrame:
    """Slope of a on b over the last days, from each day's sums."""
    x, y = F.col("x"), F.col("y")
    sums = _met(bars).groupBy("a", "b", F.to_date("bar").alias("day")).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"))
    frame = Window.partitionBy("a", "b").orderBy("day").rowsBetween(-(days - 1), 0)
    over = sums.select("a", "b", F.col("day").cast("string").alias("day"), F.count("*").over(frame).alias("days"), *(F.sum(c).over(frame).alias(c) for c in ("n", "sx", "sy", "sxy", "syy")))
    spread = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return over.where((F.col("days") == days) & (spread > 1e-12)).withColumn("beta", (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / spread)


def trend_lines(bars: DataFrame, turns: DataFrame) -> DataFrame:
    """bars with the lines through the last two confirmed tops and floors, as they are known at each bar, and the bars that close through one (cross 1 over the top line, -1 under the floor line)."""
    hours = F.unix_seconds(F.col("bar").cast("timestamp")) / 3600
    out = bars
    for kind, name in ((1, "top"), (-1, "floor")):
        own = Window.partitionBy("symbol").orderBy("bar")
        ends = turns.where(F.col("kind") == kind).withColumn("h", hours)
        ends = ends.withColumns({"old_p": F.lag("price").over(own), "old_h": F.lag("h").over(own)}).where("old_p is not null")
        known = ends.select("symbol", F.col("confirmed").alias("bar"), F.struct("price", "h", ((F.col("price") - F.col("old_p")) / (F.col("h") - F.col("old_h"))).alias("slope")).alias(name))
        out = as_of(out, known, "bar", "symbol", [name])
        out = out.withColumn(f"{name}_line", F.col(f"{name}.price") + F.col(f"{name}.slope") * (hours - F.col(f"{name}.h"))).drop(name)
    old = {c: F.lag(c).over(order()) for c in ("close", "top_line", "floor_line")}
    up = (F.col("close") > F.col("top_line")) & (old["close"] <= old["top_line"])
    down = (F.col("close") < F.col("floor_line")) & (old["close"] >= old["floor_line"])
    return out.withColumn("cross", F.when(up, 1).when(down, -1))


def double_bottoms(bars: DataFrame, tolerance: float = 0.1, least: int = 5, k: int = 3) -> DataFrame:
    """Floors (lowest of k bars on both sides) within the tolerance of the floor before, `least` bars after it at least; none is within a share of a floor at 0."""
    numbered = bars.withColumn("i", F.row_number().over(order()))
    left, right = order().rowsBetween(-k, -1), order().rowsBetween(1, k)
    whole = (F.count(F.lit(1)).over(left) == k) & (F.count(F.lit(1)).over(right) == k)
    floors = numbered.withColumn("ok", whole & (F.col("low") < F.min("low").over(left)) & (F.col("low") < F.min("low").over(right))).where("ok")
    floors = floors.withColumns({"first_low": F.lag("low").over(order()), "apart": F.col("i") - F.lag("i").over(order())})
    return floors.where((F.col("apart") >= least) & (F.abs(F.try_divide("low", "first_low") - 1) <= tolerance))


def setup_flags(bars: DataFrame) -> DataFrame:
    """Flags of a bar: a wick of over 60 % of its range, a gap left by three bars, a close back over the mean it fell under, and a block (the last opposite bar before a wide one)."""
    o = order()
    span = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    lower, upper = F.least("open", "close") - F.col("low"), F.col("high") - F.greatest("open", "close")
    wide = (F.col("high") - F.col("low")) > 1.5 * F.avg(F.col("high") - F.col("low")).over(before(20))
    mean = F.avg("close").over(last(20))
    marked = bars.withColumn("mean20", mean)
    return marked.withColumns(
        {
            "wick": F.when(lower / span > 0.6, 1).when(upper / span > 0.6, -1).otherwise(0),
            "gap": F.when(F.col("low") > F.lag("high", 2).over(o), 1).when(F.col("high") < F.lag("low", 2).over(o), -1).otherwise(0),
            "reclaim": F.when((F.lag("close").over(o) < F.lag("mean20").over(o)) & (F.col("close") > F.col("mean20")), 1).when((F.lag("close").over(o) > F.lag("mean20").over(o)) & (F.col("close") < F.col("mean20")), -1).otherwise(0),
            "block": F.when(wide & (F.col("close") > F.col("open")) & (F.lag("close").over(o) < F.lag("open").over(o)), 1).when(wide & (F.col("close") < F.col("open")) & (F.lag("close").over(o) > F.lag("open").over(o)), -1).otherwise(0),
        }
    )
