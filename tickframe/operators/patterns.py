"""Setups with memory: a first bar, and what the bars after it do within a limit.

A pattern starts at bars where a condition holds. Its next bars are a bounded
ordered path, an array of one window frame, over which an automaton runs as
array functions: it holds what the first bar fixed and what the path has
added, and ends by expiry, by failure or where a newer start takes its place.
Nothing is joined, and no state lives longer than the path. All run on both
sides at once: seen from the short side prices are negated, so that one rule
serves both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.operators import frames as W
from tickframe.operators.joins import first_at

Test = Callable[[Column], Column]
KEYS = ("symbol", "side")


def by_side() -> Window:
    return Window.partitionBy(*KEYS).orderBy("bar")


def sided(bars: DataFrame, usual: int = 20) -> DataFrame:
    """bars once as they are (side 1) and once mirrored (side -1): o, h, l, c, v, atr, volume over the mean of the `usual` bars before (rel) and number i."""
    rows = W.atr(W.relative_volume(bars, usual))
    long = F.struct(F.lit(1).alias("side"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"))
    short = F.struct(F.lit(-1).alias("side"), (-F.col("open")).alias("o"), (-F.col("low")).alias("h"), (-F.col("high")).alias("l"), (-F.col("close")).alias("c"))
    both = rows.select("symbol", "bar", "atr", "rel", F.col("volume").alias("v"), F.explode(F.array(long, short)).alias("x")).select("symbol", "x.side", "bar", "x.o", "x.h", "x.l", "x.c", "atr", "rel", "v")
    return both.withColumn("i", F.row_number().over(by_side()))


def followed(rows: DataFrame, when: Column, horizon: int, *inputs: str, own: bool = False) -> DataFrame:
    """Rows where `when` holds, with the `path` of the next bars (from the row's own on, if own), at most `horizon` of them."""
    frame = by_side().rowsBetween(0 if own else 1, horizon - 1 if own else horizon)
    return rows.withColumns({"path": F.collect_list(F.struct("bar", *inputs)).over(frame), "_when": when}).where("_when").drop("_when")


def confirmed(rows: DataFrame, test: Test, fail: Test | None = None) -> DataFrame:
    """Rows whose path meets the test before it fails (a bar that does both fails), with `at`, the element that did."""
    out = rows.withColumn("_k", first_at(F.col("path"), test))
    if fail is not None:
        out = out.withColumn("_f", first_at(F.col("path"), fail)).where("_f is null or _k < _f").drop("_f")
    return out.where("_k is not null").withColumn("at", F.get("path", F.col("_k").cast("int") - 1))


def lowest(rows: DataFrame) -> Column:
    """The lowest low of a confirmed row and of its path up to the element that confirmed it."""
    return F.array_min(F.concat(F.array("l"), F.transform(F.slice("path", F.lit(1), F.col("_k").cast("int")), lambda x: x["l"])))


def real(value: Column) -> Column:
    """A mirrored price in the market's own sign."""
    return F.col("side") * value


def before(n: int) -> Window:
    return by_side().rowsBetween(-n, -1)


def ranges(rows: DataFrame, n: int) -> DataFrame:
    """rows with the extremes top and floor of the n bars before; null where there are fewer."""
    whole = F.count(F.lit(1)).over(before(n)) == n
    return rows.withColumns({"top": F.when(whole, F.max("h").over(before(n))), "floor": F.when(whole, F.min("l").over(before(n)))})


def break_retests(rows: DataFrame, n: int = 20, horizon: int = 12, fake: int = 3, near: float = 0.1) -> DataFrame:
    """What becomes of closes that newly break the top of the n bars before: `retest`, a bar that comes back to within
    `near` ranges of the level while all closes hold it, and `fake`, a close back under it within `fake` bars, which trades
    the other way. The pattern ends at the first close under the level, after `horizon` bars, or with a new break."""
    rows = ranges(rows, n)
    new = (F.col("c") > F.col("top")) & (F.lag("c").over(by_side()) <= F.lag("top").over(by_side()))
    rows = rows.withColumn("new", F.coalesce(new, F.lit(False)))
    found = followed(rows, F.col("new"), horizon, "h", "l", "c", "atr", "new")
    nothing = F.lit(None).cast("struct<bar: timestamp_ntz, stop: double>")

    def step(s: Column, x: Column) -> Column:
        k, under, ext = s["k"] + 1, x["c"] < F.col("top"), F.greatest(s["ext"], x["h"])
        reach = near * x["atr"]
        falls = s["live"] & under & (k <= fake)
        returns = s["live"] & ~under & s["retest"].isNull() & (x["l"] <= F.col("top") + reach)
        return F.struct(
            k.alias("k"),
            (s["live"] & ~under & ~x["new"]).alias("live"),
            ext.alias("ext"),
            F.when(returns, F.struct(x["bar"].alias("bar"), (x["l"] - reach).alias("stop"))).otherwise(s["retest"]).alias("retest"),
            F.when(falls, F.struct(x["bar"].alias("bar"), (ext + reach).alias("stop"))).otherwise(s["fake"]).alias("fake"),
        )

    start = F.struct(F.lit(0).alias("k"), F.lit(True).alias("live"), F.col("h").alias("ext"), nothing.alias("retest"), nothing.alias("fake"))
    found = found.withColumn("s", F.aggregate("path", start, step))
    kinds = F.array(
        F.struct(F.lit("retest").alias("setup"), F.lit(1).alias("way"), F.col("s.retest").alias("at"), (2 * F.col("top") - F.col("floor")).alias("goal")),
        F.struct(F.lit("fake").alias("setup"), F.lit(-1).alias("way"), F.col("s.fake").alias("at"), ((F.col("top") + F.col("floor")) / 2).alias("goal")),
    )
    out = found.withColumn("e", F.explode(F.filter(kinds, lambda e: e["at"].isNotNull())))
    return out.select("symbol", "e.at.bar", (F.col("side") * F.col("e.way")).alias("side"), "e.setup", F.col("bar").alias("began"), real(F.col("top")).alias("level"), real(F.col("e.at.stop")).alias("stop"), real(F.col("e.goal")).alias("target"))


def peaks(rows: DataFrame, k: int = 3) -> DataFrame:
    """rows with `peak` and `dip`: whether h (l) is the strict extreme of k bars on both sides, which is known k bars later."""
    after = by_side().rowsBetween(1, k)
    whole = (F.count(F.lit(1)).over(before(k)) == k) & (F.count(F.lit(1)).over(after) == k)
    peak = whole & (F.col("h") > F.max("h").over(before(k))) & (F.col("h") > F.max("h").over(after))
    dip = whole & (F.col("l") < F.min("l").over(before(k))) & (F.col("l") < F.min("l").over(after))
    return rows.withColumns({"peak": peak, "dip": dip})


def pool_sweeps(rows: DataFrame, back: int = 48, most: int = 8, near: float = 0.1, heavy: float = 1.5, k: int = 3) -> DataFrame:
    """Heavy bars that pierce a pool of equal peaks and close back under it: of the newest `most` known peaks of the last
    `back` bars two within `near` ranges of each other, not passed since the later one. The oldest such pair counts; the
    trade goes against the pierced side, back to the lowest price since the first peak."""
    rows = peaks(rows, k).withColumn("path", F.collect_list(F.struct("i", "h", "l", "peak")).over(before(back))).where((F.col("rel") >= heavy) & F.col("atr").isNotNull())
    known = F.filter("path", lambda x: x["peak"] & (x["i"] <= F.col("i") - k))
    rows = rows.withColumn("tops", F.slice(known, F.greatest(F.size(known) - most, F.lit(0)) + 1, F.lit(most)))

    def mates(a: Column) -> Column:
        like = F.filter("tops", lambda b: (b["i"] > a["i"]) & (F.abs(a["h"] - b["h"]) <= near * F.col("atr")))
        return F.transform(like, lambda b: F.struct(F.greatest(a["h"], b["h"]).alias("pool"), a["i"].alias("first"), b["i"].alias("last")))

    rows = rows.withColumn("pairs", F.flatten(F.transform("tops", mates)))

    def holds(p: Column) -> Column:
        passed = F.exists("path", lambda x: (x["i"] > p["last"]) & (x["h"] > p["pool"]))
        return (F.col("o") <= p["pool"]) & (F.col("h") > p["pool"]) & (F.col("c") < p["pool"]) & ~passed

    rows = rows.withColumn("p", F.get(F.filter("pairs", holds), F.lit(0))).where("p is not null")
    low = F.array_min(F.transform(F.filter("path", lambda x: x["i"] >= F.col("p.first")), lambda x: x["l"]))
    return rows.select("symbol", "bar", (-F.col("side")).alias("side"), real(F.col("p.pool")).alias("level"), real(F.col("h") + near * F.col("atr")).alias("stop"), real(low).alias("target"))


def structure_turns(rows: DataFrame, k: int = 3, near: float = 0.1) -> DataFrame:
    """Closes above the latest known peak after lower peaks and lower dips, once for each peak: a change of character."""
    rows = peaks(rows, k)
    so_far, w = by_side().rowsBetween(Window.unboundedPreceding, 0), by_side()
    earlier = by_side().rowsBetween(Window.unboundedPreceding, -1)
    for flag, price, name in (("peak", "h", "p"), ("dip", "l", "d")):
        mark = F.when(F.lag(flag, k).over(w), F.struct(F.lag(price, k).over(w).alias("price"), F.lag("i", k).over(w).alias("i")))
        rows = rows.withColumn("_m", mark)
        rows = rows.withColumn("_two", F.when(F.col("_m").isNotNull(), F.struct(F.col("_m").alias("new"), F.last("_m", ignorenulls=True).over(earlier).alias("old"))))
        rows = rows.withColumn(name, F.last("_two", ignorenulls=True).over(so_far))
    lower = (F.col("p.new.price") < F.col("p.old.price")) & (F.col("d.new.price") < F.col("d.old.price"))
    crosses = (F.col("c") > F.col("p.new.price")) & (F.lag("c").over(w) <= F.col("p.new.price"))
    found = rows.withColumn("_hit", lower & crosses).where("_hit and atr is not null")
    first = F.row_number().over(Window.partitionBy(*KEYS, "p.new.i").orderBy("bar"))
    found = found.withColumn("_n", first).where("_n = 1")
    return found.select("symbol", "bar", "side", real(F.col("p.new.price")).alias("level"), real(F.col("d.new.price") - near * F.col("atr")).alias("stop"), real(F.col("p.old.price")).alias("target"))


def springs(rows: DataFrame, n: int = 24, within: int = 3, wide: float = 8.0, deep: float = 0.1, heavy: float = 1.0) -> DataFrame:
    """Heavy bars that pierce the floor of a tight range by `deep` ranges, and the first bar of the next (itself among
    `within`) that closes rising above that floor. Of piercings with one confirming bar the latest counts."""
    rows = ranges(rows, n)
    tight = (F.col("top") - F.col("floor")) / F.col("atr") <= wide
    start = tight & (F.col("l") < F.col("floor") - deep * F.col("atr")) & (F.col("rel") >= heavy)
    found = confirmed(followed(rows, start, within, "o", "c", "l", "atr", own=True), lambda x: (x["c"] > F.col("floor")) & (x["c"] > x["o"]))
    return _latest(found, "spring", F.col("floor"), F.col("top"))


def climaxes(rows: DataFrame, within: int = 3, heavy: float = 1.5, move: float = 1.0) -> DataFrame:
    """Heavy falls of `move` ranges in a bar, and the first of the next bars that closes rising above the middle of its body."""
    middle = (F.col("o") + F.col("c")) / 2
    start = (F.col("rel") >= heavy) & (F.col("c") - F.col("o") <= -move * F.col("atr"))
    found = confirmed(followed(rows, start, within, "o", "c", "l", "atr"), lambda x: (x["c"] > middle) & (x["c"] > x["o"]))
    return _latest(found, "climax", middle, F.greatest("h", "o"))


def absorptions(rows: DataFrame, within: int = 3, heavy: float = 1.5, narrow: float = 1.0) -> DataFrame:
    """Heavy bars of at most `narrow` ranges, and the first of the next bars that closes rising above their high."""
    start = (F.col("rel") >= heavy) & (F.col("h") - F.col("l") <= narrow * F.col("atr"))
    found = confirmed(followed(rows, start, within, "o", "c", "l", "atr"), lambda x: (x["c"] > F.col("h")) & (x["c"] > x["o"]))
    return _latest(found, "absorb", F.col("h"), F.lit(None).cast("double"))


def gap_fills(rows: DataFrame, horizon: int = 12, move: float = 0.5, heavy: float = 1.0, past: float = 0.05) -> DataFrame:
    """Gaps that a heavy rising bar leaves between the bars around it, and the first later bar whose low reaches the gap's
    centre (and `past` ranges more) before a close under the gap."""
    w = by_side()
    rows = rows.withColumns({"base": F.lag("h", 2).over(w), "thrust": F.lag(F.col("c") - F.col("o")).over(w), "span": F.lag("atr").over(w), "push": F.lag("rel").over(w)})
    start = (F.col("l") > F.col("base")) & (F.col("thrust") >= move * F.col("span")) & (F.col("push") >= heavy)
    centre = (F.col("base") + F.col("l")) / 2
    found = confirmed(followed(rows, start, horizon, "o", "c", "l", "atr"), lambda x: x["l"] <= centre - past * F.col("atr"), lambda x: x["c"] < F.col("base"))
    return found.select("symbol", "at.bar", "side", F.col("bar").alias("began"), real(centre).alias("level"), real(F.col("base")).alias("base"))


def _latest(found: DataFrame, setup: str, level: Column, goal: Column) -> DataFrame:
    """Confirmed rows as signals, one for each side and confirming bar: the latest start."""
    stop = real(lowest(found) - 0.2 * F.col("at.atr"))
    out = found.select("symbol", "at.bar", "side", F.lit(setup).alias("setup"), F.struct(F.col("bar").alias("began"), real(level).alias("level"), stop.alias("stop"), real(goal).alias("target")).alias("x"))
    return out.groupBy("symbol", "bar", "side", "setup").agg(F.max_by("x", "x.began").alias("x")).select("symbol", "bar", "side", "setup", "x.*")


def range_setups(rows: DataFrame, n: int = 48) -> DataFrame:
    """Setups in a range of the n bars before that is two to eight ranges high: `fade` (a low in its lowest fifth, closing
    inside its lower half), `break` (a heavy close over it), and a sweep of its floor that closes back, which is a `spring`
    after a fall of six ranges and with fading volume, and without such a fall a `reclaim`."""
    w, half = by_side(), n // 2
    rows = ranges(rows, n)
    back = by_side().rowsBetween(-3 * n, -n - 1)
    recent, older = F.avg("v").over(before(half)), F.avg("v").over(by_side().rowsBetween(-2 * half, -half - 1))
    fell = F.lag("c", n).over(w) - F.max("h").over(back) <= -6 * F.col("atr")
    rows = rows.withColumns({"fell": F.when(F.count(F.lit(1)).over(back) == 2 * n, fell), "fades": recent < older, "tall": F.col("top") - F.col("floor")})
    a, tall = F.col("atr"), F.col("tall")
    inside, middle = tall.between(2 * a, 8 * a), (F.col("floor") + F.col("top")) / 2
    sweep = (F.col("l") < F.col("floor") - 0.1 * a) & (F.col("c") > F.col("floor"))
    kinds = {
        "fade": ((F.col("l") <= F.col("floor") + 0.2 * tall) & (F.col("c") > F.col("floor")) & (F.col("c") < middle), F.col("floor") - 0.3 * a, F.col("top") - 0.1 * tall),
        "break": ((F.col("c") > F.col("top")) & (F.col("rel") >= 1.5), middle, F.col("top") + tall),
        "spring": (F.col("fell") & F.col("fades") & sweep, F.col("l") - 0.1 * a, F.col("top")),
        "reclaim": (~F.col("fell") & sweep, F.col("l") - 0.1 * a, F.col("top")),
    }
    found = F.array(*(F.struct(F.lit(k).alias("setup"), test.alias("ok"), real(stop).alias("stop"), real(goal).alias("target")) for k, (test, stop, goal) in kinds.items()))
    out = rows.where(inside).withColumn("e", F.explode(F.filter(found, lambda e: e["ok"])))
    return out.select("symbol", "bar", "side", "e.setup", "e.stop", "e.target")


def body_fakeouts(rows: DataFrame, k: int = 3) -> DataFrame:
    """Closes back over the latest known dip after a close under it (later than the bar that made it known)."""
    rows, w = peaks(rows, k), by_side()
    known = F.when(F.lag("dip", k).over(w), F.struct(F.lag("l", k).over(w).alias("price"), F.lag("i", k).over(w).alias("i")))
    rows = rows.withColumn("_k", known).withColumn("d", F.last("_k", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"old_c": F.lag("c").over(w), "old_l": F.lag("l").over(w)})
    found = rows.where((F.col("old_c") < F.col("d.price")) & (F.col("c") > F.col("d.price")) & (F.col("i") - 1 > F.col("d.i") + k) & F.col("atr").isNotNull())
    return found.select("symbol", "bar", "side", real(F.col("d.price")).alias("level"), real(F.least("l", "old_l") - 0.1 * F.col("atr")).alias("stop"))


def stop_hunts(rows: DataFrame, back: int = 120, k: int = 3, deep: float = 0.1, near: float = 0.25) -> DataFrame:
    """Bars that sweep a known dip of the last `back` bars by `deep` ranges and close over it, where another dip lies within
    `near` ranges of it; the newest such dip is the level."""
    rows = peaks(rows, k).withColumn("path", F.collect_list(F.struct("i", "l", "dip")).over(before(back))).where("atr is not null")
    lows = F.filter("path", lambda x: x["dip"] & (x["i"] <= F.col("i") - k))
    rows = rows.withColumn("lows", lows)
    swept = F.filter("lows", lambda p: (F.col("l") < p["l"] - deep * F.col("atr")) & (F.col("c") > p["l"]) & (F.size(F.filter("lows", lambda q: F.abs(q["l"] - p["l"]) <= near * F.col("atr"))) >= 2))
    rows = rows.withColumn("p", F.try_element_at(swept, F.lit(-1))).where("p is not null")
    return rows.select("symbol", "bar", "side", real(F.col("p.l")).alias("level"), real(F.col("l") - 0.1 * F.col("atr")).alias("stop"))


def impulse_pullbacks(rows: DataFrame, parts: tuple[float, ...] = (0.382, 0.5, 0.618, 0.705, 0.786), back: int = 96, expiry: int = 48, k: int = 3, tall: float = 4.0, deep: float = 0.05) -> DataFrame:
    """Limit entries into an impulse, when its peak becomes known: from the latest dip before the peak (within `back` bars
    of now), `tall` ranges high, with no lower low on the way and no higher high since. Levels are parts of the leg off the
    peak under the close, and the volume-weighted price since the dip. at is the first bar of the next `expiry` whose low is
    `deep` ranges under the level, before a high over the peak or a close under the stop; null if it is not filled."""
    rows, w = peaks(rows, k), by_side()
    rows = rows.withColumns({"new": F.lag("peak", k).over(w), "path": F.collect_list(F.struct("i", "h", "l", "c", "v", "dip")).over(w.rowsBetween(-back, 0)), "next": F.collect_list(F.struct("bar", "h", "l", "c")).over(w.rowsBetween(1, expiry))})
    rows = rows.where("new and atr is not null").withColumn("peak_i", F.col("i") - k)
    rows = rows.withColumn("top", F.get(F.filter("path", lambda x: x["i"] == F.col("peak_i")), F.lit(0))["h"])
    dips = F.filter("path", lambda x: x["dip"] & (x["i"] < F.col("peak_i")))
    rows = rows.withColumn("d", F.try_element_at(dips, F.lit(-1))).where("d is not null")
    since = F.filter("path", lambda x: x["i"] >= F.col("d.i"))
    rows = rows.withColumn("leg", since)
    lower = F.exists("leg", lambda x: (x["i"] <= F.col("peak_i")) & (x["l"] < F.col("d.l")))
    higher = F.exists("leg", lambda x: x["h"] > F.col("top"))
    rows = rows.where((F.col("top") - F.col("d.l") >= tall * F.col("atr")) & ~lower & ~higher)
    traded = F.aggregate("leg", F.lit(0.0), lambda s, x: s + x["v"])
    mean = F.aggregate("leg", F.lit(0.0), lambda s, x: s + (x["h"] + x["l"] + x["c"]) / 3 * x["v"]) / F.greatest(traded, F.lit(1e-12))
    height = F.col("top") - F.col("d.l")
    levels = F.array(*(F.struct(F.lit(f"fib_{p}").alias("setup"), (F.col("top") - p * height).alias("level")) for p in parts), F.struct(F.lit("vwap").alias("setup"), mean.alias("level")))
    rows = rows.withColumn("e", F.explode(levels)).where((F.col("e.level") < F.col("c")) & (F.col("e.level") > F.col("d.l")))
    stop = F.col("d.l") - 0.1 * F.col("atr")
    hit = first_at(F.col("next"), lambda x: x["l"] <= F.col("e.level") - deep * F.col("atr"))
    gone = first_at(F.col("next"), lambda x: (x["h"] > F.col("top")) | (x["c"] < stop))
    rows = rows.withColumns({"hit": hit, "gone": gone, "stop": stop})
    at = F.when(F.col("gone").isNull() | (F.col("hit") < F.col("gone")), F.get("next", F.col("hit").cast("int") - 1)["bar"])
    return rows.select("symbol", "bar", "side", "e.setup", real(F.col("e.level")).alias("level"), real(F.col("stop")).alias("stop"), real(F.col("top")).alias("target"), at.alias("at"))
