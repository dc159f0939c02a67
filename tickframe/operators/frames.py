"""Window-frame features of bars, per symbol in time order; all use bars up to the current one only."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order() -> Window:
    return Window.partitionBy("symbol").orderBy("bar")


def last(n: int) -> Window:
    """The current bar and the n - 1 before it."""
    return order().rowsBetween(-(n - 1), 0)


def before(n: int) -> Window:
    """The n bars before the current one."""
    return order().rowsBetween(-n, -1)


def full(value: Column, n: int, frame: Window, of: str | None = None) -> Column:
    """value where the frame has n rows (or n known values of a column), else null."""
    return F.when(F.count(F.lit(1) if of is None else of).over(frame) >= n, value)


def returns(bars: DataFrame, k: int = 1) -> DataFrame:
    return bars.withColumns({"ret": F.log(F.col("close") / F.lag("close", k).over(order())), "simple": F.col("close") / F.lag("close", k).over(order()) - 1})


def true_range(bars: DataFrame) -> DataFrame:
    old = F.lag("close").over(order())
    return bars.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - old), F.abs(F.col("low") - old)))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """Simple mean of the last n true ranges; null until there are n."""
    return true_range(bars).withColumn("atr", full(F.avg("tr").over(last(n)), n, last(n)))


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    mid, sd = F.avg("close").over(last(n)), F.stddev_pop("close").over(last(n))
    return bars.withColumns({"mid": full(mid, n, last(n)), "upper": full(mid + k * sd, n, last(n)), "lower": full(mid - k * sd, n, last(n)), "width": full(2 * k * sd / mid, n, last(n))})


def donchian_breakouts(bars: DataFrame, n: int = 20) -> DataFrame:
    """Bars that first close beyond the extremes of the n bars before them."""
    top, floor = F.max("high").over(before(n)), F.min("low").over(before(n))
    marked = bars.withColumns({"top": full(top, n, before(n)), "floor": full(floor, n, before(n))})
    state = F.when(F.col("close") > F.col("top"), 1).when(F.col("close") < F.col("floor"), -1).otherwise(0)
    marked = marked.withColumn("side", state)
    return marked.withColumn("old", F.lag("side", 1, 0).over(order())).where("side <> 0 and side <> old").drop("old")


def z_before(bars: DataFrame, column: str = "volume", n: int = 24) -> DataFrame:
    """Deviation of a column from its mean over the n bars before, in their standard deviations."""
    mean, sd = F.avg(column).over(before(n)), F.stddev_pop(column).over(before(n))
    return bars.withColumn("z", full(F.when(sd > 0, (F.col(column) - mean) / sd), n, before(n)))


def stochastic(bars: DataFrame, n: int = 14, d: int = 3) -> DataFrame:
    low, high = F.min("low").over(last(n)), F.max("high").over(last(n))
    out = bars.withColumn("pct_k", full(F.when(high > low, 100 * (F.col("close") - low) / (high - low)), n, last(n)))
    return out.withColumn("pct_d", full(F.avg("pct_k").over(last(d)), d, last(d)))


def money_flow(bars: DataFrame, n: int = 14) -> DataFrame:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    flow = bars.withColumn("tp", typical).withColumn("old", F.lag("tp").over(order()))
    up = F.sum(F.when(F.col("tp") > F.col("old"), F.col("tp") * F.col("volume")).otherwise(0.0)).over(last(n))
    down = F.sum(F.when(F.col("tp") < F.col("old"), F.col("tp") * F.col("volume")).otherwise(0.0)).over(last(n))
    return flow.withColumn("mfi", full(F.when(up + down > 0, 100 * up / (up + down)), n, last(n)))


def cumulative_delta(bars: DataFrame) -> DataFrame:
    """Running sum of bought minus sold volume."""
    return bars.withColumn("cvd", F.sum(2 * F.col("buy") - F.col("volume")).over(order().rowsBetween(Window.unboundedPreceding, 0)))


def session_vwap(bars: DataFrame) -> DataFrame:
    """Volume-weighted price since the start of the day."""
    day = Window.partitionBy("symbol", F.to_date("bar")).orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    volume = F.sum("volume").over(day)
    return bars.withColumn("vwap", F.when(volume > 0, F.sum(typical * F.col("volume")).over(day) / volume))


def efficiency(bars: DataFrame, n: int = 14) -> DataFrame:
    """Net move over path length; 0.5 where there is no path."""
    step = bars.withColumn("step", F.abs(F.col("close") - F.lag("close").over(order())))
    path, net = F.sum("step").over(last(n)), F.abs(F.col("close") - F.lag("close", n).over(order()))
    return step.withColumn("me", F.when(net.isNotNull(), F.when(path > 0, net / path).otherwise(0.5)))


def variance_ratio(bars: DataFrame, q: int = 4, n: int = 48) -> DataFrame:
    out = bars.withColumns({"r1": F.log(F.col("close") / F.lag("close").over(order())), "rq": F.log(F.col("close") / F.lag("close", q).over(order()))})
    one, many = F.var_pop("r1").over(last(n)), F.var_pop("rq").over(last(n))
    return out.withColumn("vr", F.when((F.count("rq").over(last(n)) >= n) & (one > 0), many / (q * one)))


def jump_ratio(bars: DataFrame, n: int = 24) -> DataFrame:
    """Share of squared returns beyond the bipower variation, 0 at least."""
    out = bars.withColumn("r", F.log(F.col("close") / F.lag("close").over(order())))
    out = out.withColumn("b", F.abs("r") * F.abs(F.lag("r").over(order())))
    real, smooth = F.sum(F.col("r") * F.col("r")).over(last(n)), F.sum("b").over(last(n)) * (3.141592653589793 / 2)
    return out.withColumn("jump", F.when((F.count("b").over(last(n)) >= n) & (real > 0), F.greatest(F.lit(0.0), 1 - smooth / real)))


def rolling_trend(bars: DataFrame, n: int = 20) -> DataFrame:
    """Slope and R2 of the regression of close on the bar's number."""
    out = bars.withColumn("i", F.row_number().over(order()).cast("double"))
    return out.withColumns({"slope": full(F.regr_slope("close", "i").over(last(n)), n, last(n)), "r2": full(F.regr_r2("close", "i").over(last(n)), n, last(n))})


def pivots(bars: DataFrame, k: int = 3) -> DataFrame:
    """Bars whose high (low) is the strict extreme of k bars on both sides; known k bars later."""
    left, right = order().rowsBetween(-k, -1), order().rowsBetween(1, k)
    complete = (F.count(F.lit(1)).over(left) == k) & (F.count(F.lit(1)).over(right) == k)
    top = complete & (F.col("high") > F.max("high").over(left)) & (F.col("high") > F.max("high").over(right))
    floor = complete & (F.col("low") < F.min("low").over(left)) & (F.col("low") < F.min("low").over(right))
    return bars.withColumns({"top": top, "floor": floor, "known": F.lead("bar", k).over(order())}).where("top or floor")


def run_lengths(bars: DataFrame) -> DataFrame:
    """Length so far of the run of closes in one direction."""
    out = bars.withColumn("dir", F.signum(F.col("close") - F.lag("close").over(order())).cast("int"))
    out = out.withColumn("start", F.when(F.col("dir").eqNullSafe(F.lag("dir").over(order())), 0).otherwise(1))
    out = out.withColumn("island", F.sum("start").over(order().rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("run", F.row_number().over(Window.partitionBy("symbol", "island").orderBy("bar")))


def forward_returns(bars: DataFrame, h: int = 4) -> DataFrame:
    """Return from the next open to the close h bars on."""
    return bars.withColumn("fwd", F.lead("close", h).over(order()) / F.lead("open", 1).over(order()) - 1)


def excursions(bars: DataFrame, h: int = 12) -> DataFrame:
    """Most favourable and adverse move of a long entry at the close over the next h bars."""
    ahead = order().rowsBetween(1, h)
    done = F.count(F.lit(1)).over(ahead) == h
    return bars.withColumns({"mfe": F.when(done, F.max("high").over(ahead) / F.col("close") - 1), "mae": F.when(done, F.min("low").over(ahead) / F.col("close") - 1)})


def cross_section_z(bars: DataFrame) -> DataFrame:
    """z of the return among the other symbols of the same bar; the own value is left out by algebra, without a self-join."""
    r = returns(bars).where("ret is not null")
    same = Window.partitionBy("bar")
    n, s, q = F.count("*").over(same), F.sum("ret").over(same), F.sum(F.col("ret") * F.col("ret")).over(same)
    out = r.withColumns({"m": F.when(n > 1, (s - F.col("ret")) / (n - 1)), "q": F.when(n > 1, (q - F.col("ret") * F.col("ret")) / (n - 1))})
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("q") - F.col("m") * F.col("m")))
    return out.withColumn("xz", F.when(spread > 1e-9, (F.col("ret") - F.col("m")) / spread))


# Frames over arrays: the window is bounded, so the array is.


def middle(values: Column) -> Column:
    """Median of an array; null if it is empty."""
    ordered, n = F.array_sort(values), F.size(values)
    at = F.call_function("div", n, F.lit(2)).cast("int")
    return F.when(n > 0, F.when(n % 2 == 1, F.get(ordered, at)).otherwise((F.get(ordered, at - 1) + F.get(ordered, at)) / 2))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def windowed(column: str, n: int) -> Column:
    """The known values of the last n rows, in order."""
    return F.collect_list(column).over(last(n))


def rolling(bars: DataFrame, column: str, n: int, least: int) -> DataFrame:
    """Mean and deviation over the last n rows, where at least `least` values are known."""
    return bars.withColumns({"mean": full(F.avg(column).over(last(n)), least, last(n), column), "sd": full(F.stddev_pop(column).over(last(n)), least, last(n), column)})


def relative_volume(bars: DataFrame, n: int = 100) -> DataFrame:
    """Volume against the mean of the n bars before, as many as there are."""
    return bars.withColumn("rel", F.col("volume") / F.nullif(F.avg("volume").over(before(n)), F.lit(0.0)))


def robust_z(bars: DataFrame, column: str = "close", n: int = 48) -> DataFrame:
    """Distance from the median of the last n in units of 1.4826 median absolute deviations."""
    out = bars.withColumn("_v", windowed(column, n)).withColumn("med", middle(F.col("_v")))
    out = out.withColumn("_mad", middle(F.transform("_v", lambda x: F.abs(x - F.col("med")))))
    return out.withColumn("rz", full(F.when(F.col("_mad") > 0, (F.col(column) - F.col("med")) / (1.4826 * F.col("_mad"))), n, last(n))).drop("_v", "_mad")


def vwap(bars: DataFrame, n: int = 24) -> DataFrame:
    """Volume-weighted price of the last n bars, and of the day so far with its weighted deviation."""
    day = Window.partitionBy("symbol", F.to_date("bar")).orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    v = F.col("volume")
    out = bars.withColumn("tp", typical)
    mean = F.sum(F.col("tp") * v).over(day) / F.nullif(F.sum(v).over(day), F.lit(0.0))
    square = F.sum(F.col("tp") * F.col("tp") * v).over(day) / F.nullif(F.sum(v).over(day), F.lit(0.0))
    rolled = F.sum(F.col("close") * v).over(last(n)) / F.nullif(F.sum(v).over(last(n)), F.lit(0.0))
    return out.withColumns({"day_vwap": mean, "day_sd": F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)), "vwap_n": full(rolled, n, last(n))})


def williams(bars: DataFrame, n: int = 14) -> DataFrame:
    out = stochastic(bars, n)
    return out.withColumn("wr", F.col("pct_k") - 100)


def channel_index(bars: DataFrame, n: int = 20) -> DataFrame:
    """Typical price's distance from its mean in 0.015 mean absolute deviations."""
    out = bars.withColumn("tp", (F.col("high") + F.col("low") + F.col("close")) / 3).withColumn("_v", windowed("tp", n)).withColumn("_m", F.avg("tp").over(last(n)))
    apart = total(F.transform("_v", lambda x: F.abs(x - F.col("_m")))) / F.size("_v")
    return out.withColumn("cci", full((F.col("tp") - F.col("_m")) / F.greatest(0.015 * apart, F.lit(1e-12)), n, last(n))).drop("_v", "_m")


def ichimoku(bars: DataFrame, short: int = 9, mid: int = 26, long: int = 52) -> DataFrame:
    """Conversion and base lines, and the cloud's bounds shifted by `mid` bars."""

    def centre(n: int) -> Column:
        return full((F.max("high").over(last(n)) + F.min("low").over(last(n))) / 2, n, last(n))

    out = bars.withColumns({"turn": centre(short), "base": centre(mid), "_long": centre(long)})
    out = out.withColumns({"_a": F.lag((F.col("turn") + F.col("base")) / 2, mid).over(order()), "_b": F.lag("_long", mid).over(order())})
    return out.withColumns({"cloud_top": F.greatest("_a", "_b"), "cloud_floor": F.least("_a", "_b")}).drop("_a", "_b", "_long")


def trend_residual(bars: DataFrame, n: int = 20) -> DataFrame:
    """Where close lies against the regression on the bar's number over the last n: residual in residual deviations, and the channel's width."""
    out = bars.withColumn("i", F.row_number().over(order()).cast("double"))
    slope, base = F.regr_slope("close", "i").over(last(n)), F.regr_intercept("close", "i").over(last(n))
    left = F.sqrt(F.greatest(F.lit(0.0), (F.regr_syy("close", "i").over(last(n)) - slope * F.regr_sxy("close", "i").over(last(n))) / n))
    fitted = base + slope * F.col("i")
    return out.withColumns({"resid_z": full(F.when(left > 1e-9, (F.col("close") - fitted) / left), n, last(n)), "channel": full(4 * left / F.abs(fitted), n, last(n))})


def tail_index(bars: DataFrame, n: int = 100, k: int = 10) -> DataFrame:
    """Hill estimate from the k largest moves of the last n."""
    out = returns(bars).withColumn("_r", F.abs("ret")).withColumn("_v", F.slice(F.sort_array(windowed("_r", n), False), 1, k + 1))
    least = F.get("_v", F.lit(k))
    mean = total(F.transform(F.slice("_v", 1, k), lambda x: F.log(x / least))) / k
    return out.withColumn("hill", F.when((F.count("_r").over(last(n)) >= n) & (least > 0) & (mean > 0), 1 / mean)).drop("_r", "_v")


def fractal_dimension(bars: DataFrame, n: int = 48) -> DataFrame:
    """Katz dimension of the path of the last n closes."""
    out = bars.withColumn("_s", F.abs(F.col("close") - F.lag("close", 1).over(order()))).withColumn("_first", F.first("close").over(last(n))).withColumn("_v", windowed("close", n))
    path, reach = F.sum("_s").over(order().rowsBetween(-(n - 2), 0)), F.array_max(F.transform("_v", lambda x: F.abs(x - F.col("_first"))))
    steps = F.log(F.lit(float(n - 1)))
    return out.withColumns({"_path": path, "_reach": reach}).withColumn("katz", full(F.when((F.col("_path") > 0) & (F.col("_reach") > 0), steps / (steps + F.log(F.col("_reach") / F.col("_path")))), n, last(n))).drop("_s", "_first", "_v", "_path", "_reach")


def reversion(bars: DataFrame, n: int = 60) -> DataFrame:
    """First-order autoregression of close over the last n: speed of return, half-life in bars, and distance from the mean it returns to in deviations of the window."""
    out = bars.withColumn("_old", F.lag("close").over(order()))
    b, a = F.regr_slope("close", "_old").over(last(n)), F.regr_intercept("close", "_old").over(last(n))
    out = out.withColumns({"_b": F.when(F.count("_old").over(last(n)) >= n, b), "_a": a, "_sd": F.stddev_pop("close").over(last(n))})
    kappa = F.when((F.col("_b") > 0) & (F.col("_b") < 1), -F.log("_b"))
    away = (F.col("close") - F.col("_a") / (1 - F.col("_b"))) / F.col("_sd")
    return out.withColumns({"kappa": kappa, "half_life": F.log(F.lit(2.0)) / kappa, "ou_z": F.when(kappa.isNotNull() & (F.col("_sd") > 0), away)}).drop("_old", "_b", "_a", "_sd")


def end_weights(n: int, degree: int, derivative: int) -> list[float]:
    """Weights of the last n values that give a derivative, at the last one, of their least-squares polynomial."""
    at = np.arange(-(n - 1), 1.0)[:, None] ** np.arange(degree + 1)
    return [float(w) for w in np.linalg.pinv(at)[derivative] * math.factorial(derivative)]


def motion(bars: DataFrame, n: int = 11, degree: int = 3) -> DataFrame:
    """Velocity, acceleration and jerk of close at its end: fixed weights of the last n closes."""

    def weighted(derivative: int) -> Column:
        terms = [F.lag("close", n - 1 - i).over(order()) * w for i, w in enumerate(end_weights(n, degree, derivative))]
        return sum(terms[1:], terms[0])

    return bars.withColumns({"velocity": weighted(1), "acceleration": weighted(2), "jerk": weighted(3)})


def autocorrelation(bars: DataFrame, k: int = 1, n: int = 60) -> DataFrame:
    out = returns(bars).withColumn("_old", F.lag("ret", k).over(order()))
    return out.withColumn("acf", F.when(F.count("_old").over(last(n)) >= n, F.corr("ret", "_old").over(last(n)))).drop("_old")


def place_in_range(bars: DataFrame, n: int = 48) -> DataFrame:
    low, high = F.min("low").over(last(n)), F.max("high").over(last(n))
    return bars.withColumn("place", full(F.when(high > low, (F.col("close") - low) / (high - low)), n, last(n)))


def last_pivots(bars: DataFrame, k: int = 3) -> DataFrame:
    """The latest top and floor that are confirmed, k bars after they stand, carried forward."""
    left, right = order().rowsBetween(-k, -1), order().rowsBetween(1, k)
    done = (F.count(F.lit(1)).over(left) == k) & (F.count(F.lit(1)).over(right) == k)
    top = F.when(done & (F.col("high") > F.max("high").over(left)) & (F.col("high") > F.max("high").over(right)), F.col("high"))
    floor = F.when(done & (F.col("low") < F.min("low").over(left)) & (F.col("low") < F.min("low").over(right)), F.col("low"))
    seen = order().rowsBetween(Window.unboundedPreceding, 0)
    out = bars.withColumns({"_t": top, "_f": floor}).withColumns({"_t": F.lag("_t", k).over(order()), "_f": F.lag("_f", k).over(order())})
    return out.withColumns({"last_top": F.last("_t", ignorenulls=True).over(seen), "last_floor": F.last("_f", ignorenulls=True).over(seen)}).drop("_t", "_f")


def session_range(bars: DataFrame, begin: int = 0, end: int = 7) -> DataFrame:
    """High and low of the day's hours from begin to end, known from end on."""
    day = Window.partitionBy("symbol", F.to_date("bar"))
    inside = (F.hour("bar") >= begin) & (F.hour("bar") < end)
    after = F.hour("bar") >= end
    return bars.withColumns({"range_high": F.when(after, F.max(F.when(inside, F.col("high"))).over(day)), "range_low": F.when(after, F.min(F.when(inside, F.col("low"))).over(day))})


def crossings(bars: DataFrame, a: Column, b: Column) -> DataFrame:
    """Bars where a passes b: cross 1 upwards, -1 downwards."""
    out = bars.withColumns({"_a": a, "_b": b}).withColumns({"_oa": F.lag("_a").over(order()), "_ob": F.lag("_b").over(order())})
    cross = F.when((F.col("_a") > F.col("_b")) & (F.col("_oa") <= F.col("_ob")), 1).when((F.col("_a") < F.col("_b")) & (F.col("_oa") >= F.col("_ob")), -1)
    return out.withColumn("cross", cross).where("cross is not null").drop("_a", "_b", "_oa", "_ob")


def momentum_field(bars: DataFrame, scales: tuple[int, ...] = (2, 4, 8, 16), n: int = 48) -> DataFrame:
    """Mean of tanh(return / deviation) over several scales, and how far the scales agree."""
    out = bars
    for k in scales:
        out = out.withColumn(f"_r{k}", F.log(F.col("close") / F.lag("close", k).over(order())))
        out = out.withColumn(f"_s{k}", F.when(F.count(f"_r{k}").over(last(n)) >= n, F.stddev_pop(f"_r{k}").over(last(n))))
    parts = [F.when(F.col(f"_s{k}") > 0, F.tanh(F.col(f"_r{k}") / F.col(f"_s{k}"))) for k in scales]
    field = sum(parts[1:], parts[0]) / len(parts)
    signs = [F.signum(p) for p in parts]
    out = out.withColumns({"field": field, "coherence": F.abs(sum(signs[1:], signs[0])) / len(signs)})
    return out.drop(*(f"_{c}{k}" for k in scales for c in "rs"))


def realised(bars: DataFrame, n: int = 24) -> DataFrame:
    return returns(bars).withColumn("vol", F.when(F.count("ret").over(last(n)) >= n, F.stddev_samp("ret").over(last(n))))


def weighted_means(bars: DataFrame, n: int = 10) -> DataFrame:
    """Linearly weighted mean of n, and the lag-reduced one made of three of them."""

    def wma(column: str, m: int) -> Column:
        terms = [F.lag(column, k).over(order()) * (m - k) for k in range(m)]
        return sum(terms[1:], terms[0]) / (m * (m + 1) / 2)

    out = bars.withColumns({"wma": wma("close", n), "_d": 2 * wma("close", n // 2) - wma("close", n)})
    return out.withColumn("hma", wma("_d", round(math.sqrt(n)))).drop("_d")


def spectral(bars: DataFrame, n: int = 32) -> DataFrame:
    """Entropy of the power spectrum of the last n returns, as a share of its maximum, and the period of the strongest frequency."""
    out = returns(bars).withColumn("_v", windowed("ret", n)).withColumn("_m", total(F.col("_v")) / F.size("_v"))
    half = range(1, n // 2 + 1)

    def part(k: int, wave: Callable[[float], float]) -> Column:
        weights = F.array(*(F.lit(wave(2 * math.pi * k * t / n)) for t in range(n)))
        return total(F.zip_with("_v", weights, lambda x, w: (x - F.col("_m")) * w))

    powers = out.where(F.size("_v") == n).withColumn("_p", F.array(*(part(k, math.cos) ** 2 + part(k, math.sin) ** 2 for k in half)))
    powers = powers.withColumn("_sum", total(F.col("_p"))).where("_sum > 0")
    entropy = -total(F.transform("_p", lambda p: F.when(p > 0, p / F.col("_sum") * F.log(p / F.col("_sum"))).otherwise(0.0))) / math.log(len(half))
    return powers.withColumns({"spectral_entropy": entropy, "period": F.lit(float(n)) / F.array_position("_p", F.array_max("_p"))}).drop("_v", "_m", "_p", "_sum")


def fib_zone(bars: DataFrame, low: float = 0.5, high: float = 0.618) -> DataFrame:
    """Bars whose close lies in the part of the latest confirmed swing that a pullback should hold: depth is how far it came back from the top."""
    out = last_pivots(bars)
    depth = F.when(F.col("last_top") > F.col("last_floor"), (F.col("last_top") - F.col("close")) / (F.col("last_top") - F.col("last_floor")))
    return out.withColumn("depth", depth).where((F.col("depth") >= low) & (F.col("depth") <= high))


def anchored_vwap(bars: DataFrame, k: int = 3) -> DataFrame:
    """Volume-weighted price since the latest confirmed floor; null before there is one. Each anchor is a group of its own."""
    out = last_pivots(bars, k)
    new = F.coalesce(F.col("last_floor") != F.lag("last_floor").over(order()), F.col("last_floor").isNotNull())
    out = out.withColumn("_new", new.cast("int")).withColumn("anchor", F.sum("_new").over(order().rowsBetween(Window.unboundedPreceding, 0)))
    since = Window.partitionBy("symbol", "anchor").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    price = F.sum(typical * F.col("volume")).over(since) / F.nullif(F.sum("volume").over(since), F.lit(0.0))
    return out.withColumn("avwap", F.when(F.col("anchor") > 0, price)).drop("_new")


def divergences(bars: DataFrame, column: str, k: int = 3) -> DataFrame:
    """Floors that lie lower than the floor before while the column stands higher (side 1), and tops the other way round (side -1)."""
    left, right = order().rowsBetween(-k, -1), order().rowsBetween(1, k)
    whole = (F.count(F.lit(1)).over(left) == k) & (F.count(F.lit(1)).over(right) == k)
    top = whole & (F.col("high") > F.max("high").over(left)) & (F.col("high") > F.max("high").over(right))
    floor = whole & (F.col("low") < F.min("low").over(left)) & (F.col("low") < F.min("low").over(right))
    marked = bars.withColumns({"_t": top, "_f": floor})
    ends = marked.withColumn("_e", F.filter(F.array(F.struct(F.lit(1).alias("side"), F.col("_f").alias("ok"), F.col("low").alias("p")), F.struct(F.lit(-1).alias("side"), F.col("_t").alias("ok"), F.col("high").alias("p"))), lambda x: x["ok"]))
    rows = ends.select("symbol", "bar", F.col(column).alias("v"), F.explode("_e").alias("e")).select("symbol", "bar", "v", "e.side", "e.p")
    own = Window.partitionBy("symbol", "side").orderBy("bar")
    rows = rows.withColumns({"old_p": F.lag("p").over(own), "old_v": F.lag("v").over(own)})
    return rows.where((F.col("side") * (F.col("p") - F.col("old_p")) < 0) & (F.col("side") * (F.col("v") - F.col("old_v")) > 0)).select("symbol", "bar", "side", "p", "v")


def fitted_lines(bars: DataFrame, n: int = 24) -> DataFrame:
    """Support and resistance lines over the n bars before, as they stand at the bar: through the bar that lies furthest
    off the regression of close, with the least-squares slope, held to slopes that no bar of the window violates."""
    numbered = bars.withColumn("_i", F.row_number().over(order()).cast("double"))
    middle_x = (n - 1) / 2
    out = numbered.withColumns({"_b": F.regr_slope("close", "_i").over(before(n)), "_m": F.avg("close").over(before(n)), "_n": F.count("*").over(before(n))})
    for side, column, name in ((1, "low", "support"), (-1, "high", "resistance")):
        # Seen from below, a resistance is the support of the negated highs.
        fit = lambda k: side * (F.col("_m") + F.col("_b") * (k - middle_x))  # noqa: B023, E731
        out = out.withColumn("_y", F.transform(F.collect_list(column).over(before(n)), lambda v: side * v))  # noqa: B023
        out = out.withColumn("_p", F.array_min(F.transform("_y", lambda v, k: F.struct((v - fit(k)).alias("d"), k.alias("k"))))["k"])  # noqa: B023
        out = out.withColumn("_d", F.transform("_y", lambda v, k: F.struct((k - F.col("_p")).cast("double").alias("x"), (v - F.get("_y", F.col("_p"))).alias("y"))))
        top = F.aggregate("_d", F.lit(0.0), lambda s, e: s + e["x"] * e["y"])
        base = F.aggregate("_d", F.lit(0.0), lambda s, e: s + e["x"] * e["x"])
        least = F.array_max(F.transform(F.filter("_d", lambda e: e["x"] < 0), lambda e: e["y"] / e["x"]))
        most = F.array_min(F.transform(F.filter("_d", lambda e: e["x"] > 0), lambda e: e["y"] / e["x"]))
        out = out.withColumns({"_s": F.try_divide(top, base), "_least": least, "_most": most})
        clamped = F.least(F.greatest("_s", "_least"), F.col("_most"))
        slope = F.when(F.col("_least").isNotNull() & (F.col("_least") > F.col("_most")), F.col("_least")).otherwise(clamped)
        out = out.withColumn(name, F.when(F.col("_n") == n, side * (F.get("_y", F.col("_p")) + slope * (n - F.col("_p")))))
    return out.drop("_i", "_b", "_m", "_n", "_y", "_p", "_d", "_s", "_least", "_most")
