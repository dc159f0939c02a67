"""Estimators of trend whose state is no linear map: mixed filters, a clock of volume, an adaptive cycle."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.operators import frames as W
from tickframe.operators.recursive import Step, scanned

Trend = tuple[float, float, float, float, float]  # level, slope, and the covariance's three numbers


def _blended(w: float, a: Trend, b: Trend) -> Trend:
    """Mean and covariance of a mixture of two trends, the first with weight w."""
    v, apart = 1 - w, (a[0] - b[0], a[1] - b[1])
    return (
        w * a[0] + v * b[0],
        w * a[1] + v * b[1],
        w * a[2] + v * b[2] + w * v * apart[0] * apart[0],
        w * a[3] + v * b[3] + w * v * apart[0] * apart[1],
        w * a[4] + v * b[4] + w * v * apart[1] * apart[1],
    )


def _observed(s: Trend, y: float, time: float, drift: float, noise: float) -> tuple[Trend, float, float]:
    """A trend after `time` and an observation; with its surprise and the surprise's variance."""
    level, slope, p, q, r = s
    level, p, q, r = level + time * slope, p + 2 * time * q + time * time * r, q + time * r, r + drift
    wide, off = p + noise, y - level
    return (level + p / wide * off, slope + q / wide * off, p * noise / wide, q * noise / wide, r - q * q / wide), off, wide


def _score(s: Trend) -> float:
    return s[1] / math.sqrt(max(s[4], 1e-18))


def mixed_trend(bars: DataFrame, drifts: tuple[float, float] = (3e-5, 3e-4), stay: float = 0.98, span: int = 100) -> DataFrame:
    """Two local linear trends of log close, a calm and a quick one, mixed by how likely each made the bars seen so far
    (interacting multiple models): `imm_z`, the mixed slope over its standard error, and `calm`, the calm one's weight.

    Each bar keeps its model with probability `stay`. An observation's noise is
    the exponentially weighted variance of log returns, 1e-10 at least; both
    outputs are null for the first `span` bars.
    """

    def start() -> Step:
        count, old, var = -1, 0.0, None
        calm, models = 0.5, None

        def step(close):
            nonlocal count, old, var, calm, models
            y, count = math.log(close), count + 1
            if models is None:
                old, models = y, [(y, 0.0, 1.0, 0.0, 1.0)] * 2
                return None, None
            square = (y - old) ** 2
            old, var = y, square if var is None else var + 2 / (span + 1) * (square - var)
            noise = max(var, 1e-10)
            ahead = stay * calm + (1 - stay) * (1 - calm)
            mixes = (stay * calm / ahead, (1 - stay) * calm / (1 - ahead))
            seen = [_observed(_blended(w, *models), y, 1.0, d * noise, noise) for w, d in zip(mixes, drifts)]
            models = [s for s, _, _ in seen]
            a, b = (p * math.exp(-off * off / wide / 2) / math.sqrt(wide) for p, (_, off, wide) in zip((ahead, 1 - ahead), seen))
            calm = a / (a + b) if a + b > 0 else 0.5
            return (_score(_blended(calm, *models)), calm) if count > span else (None, None)

        return step

    return scanned(bars, start, ["close"], "imm_z double, calm double")


def clocked_trend(bars: DataFrame, drift: float = 1e-4, span: int = 100, window: int = 180) -> DataFrame:
    """A local linear trend of log close whose time runs with volume: `clock_z`, the slope over its standard error
    (null for the first `span` bars), and `pace`, the volume over its mean of the window before, held to 0.2 .. 5."""
    mean = F.avg("volume").over(W.before(window))
    paced = bars.withColumn("pace", F.when(mean > 0, F.least(F.lit(5.0), F.greatest(F.lit(0.2), F.col("volume") / mean))).otherwise(1.0))

    def start() -> Step:
        count, old, var, state = -1, 0.0, None, None

        def step(close, pace):
            nonlocal count, old, var, state
            y, count = math.log(close), count + 1
            if state is None:
                old, state = y, (y, 0.0, 1.0, 0.0, 1.0)
                return (None,)
            square = (y - old) ** 2 / pace
            old, var = y, max(square if var is None else var + 2 / (span + 1) * (square - var), 1e-10)
            state, _, _ = _observed(state, y, pace, drift * var * pace, var * pace)
            return (_score(state) if count > span else None,)

        return step

    return scanned(paced, start, ["close", "pace"], "clock_z double")


def volume_bars(bars: DataFrame, part: float = 0.01) -> DataFrame:
    """Bars re-indexed by volume: each share `part` of a symbol's volume is one bar of the clock (a bar of time belongs to
    where its volume ends), with its bounds in time, first open, last close and extremes."""
    whole = bars.groupBy("symbol").agg((F.sum("volume") * part).alias("unit_")).where("unit_ > 0")
    day = F.date_trunc("day", "bar")
    days = bars.groupBy("symbol", day.alias("day_")).agg(F.sum("volume").alias("v_"))
    before = F.coalesce(F.sum("v_").over(Window.partitionBy("symbol").orderBy("day_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # a row a day
    inner = F.sum("volume").over(Window.partitionBy("symbol", "day_").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0))
    rows = bars.withColumn("day_", day).join(days.select("symbol", "day_", before.alias("before_")), ["symbol", "day_"]).join(whole, "symbol")
    tick = F.greatest(F.ceil((F.col("before_") + inner) / F.col("unit_")) - 1, F.lit(0)).cast("long")
    out = rows.withColumn("tick", tick).groupBy("symbol", "tick")
    return out.agg(F.min("bar").alias("begins"), F.max("bar").alias("ends"), F.min_by("open", "bar").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar").alias("close"), F.sum("volume").alias("volume"))


# Fixed values of the Hilbert transformer and of the four-bar smoother (Ehlers).
HILBERT = {0: 0.0962, 2: 0.5769, 4: -0.5769, 6: -0.0962}
SMOOTHER = (4, 3, 2, 1)


def adaptive_means(bars: DataFrame, fast: float = 0.5, slow: float = 0.05) -> DataFrame:
    """Mean of log close whose weight follows the change of phase of its cycle (`mama`), and the slower one that follows
    it (`fama`): in-phase and quadrature parts by the Hilbert transform, with an adaptive period of 6 to 50 bars as state."""

    def start() -> Step:
        prices: list[float] = []
        smooth, detrended, quadrature, inphase = ([0.0] * 7 for _ in range(4))  # newest first
        i2 = q2 = real = imaginary = period = phase = mama = fama = 0.0
        count = -1

        def hilbert(line: list[float]) -> float:
            return sum(w * line[k] for k, w in HILBERT.items())

        def step(close):
            nonlocal i2, q2, real, imaginary, period, phase, mama, fama, count
            y, count = math.log(close), count + 1
            prices.insert(0, y)
            del prices[4:]
            for line in (smooth, detrended, quadrature, inphase):
                line.insert(0, 0.0)
                line.pop()
            if count < 6:
                mama = fama = y
                return mama, fama
            turn = 0.075 * period + 0.54
            smooth[0] = sum(w * p for w, p in zip(SMOOTHER, prices)) / 10
            detrended[0] = hilbert(smooth) * turn
            quadrature[0] = hilbert(detrended) * turn
            inphase[0] = detrended[3]
            old = i2, q2
            i2 = 0.2 * (inphase[0] - hilbert(quadrature) * turn) + 0.8 * i2
            q2 = 0.2 * (quadrature[0] + hilbert(inphase) * turn) + 0.8 * q2
            real = 0.2 * (i2 * old[0] + q2 * old[1]) + 0.8 * real
            imaginary = 0.2 * (i2 * old[1] - q2 * old[0]) + 0.8 * imaginary
            cycle = 2 * math.pi / math.atan(imaginary / real) if imaginary != 0 and real != 0 else period
            if period > 0:
                cycle = min(max(cycle, 0.67 * period), 1.5 * period)
            period = 0.2 * min(max(cycle, 6.0), 50.0) + 0.8 * period
            before = phase
            if inphase[0] != 0:
                phase = math.degrees(math.atan(quadrature[0] / inphase[0]))
            weight = min(max(fast / max(before - phase, 1.0), slow), fast)
            mama = weight * y + (1 - weight) * mama
            fama = weight / 2 * mama + (1 - weight / 2) * fama
            return mama, fama

        return step

    return scanned(bars, start, ["close"], "mama double, fama double")


def fisher(bars: DataFrame, n: int = 10) -> DataFrame:
    """Fisher transform of log close's smoothed place in its last n bars; 0 for the first n."""
    log = F.log("close")
    placed = bars.withColumns({"n_": F.row_number().over(W.order()), "y_": log}).withColumns({"top_": F.max("y_").over(W.last(n)), "floor_": F.min("y_").over(W.last(n))})
    place = F.when(F.col("n_") > n, F.when(F.col("top_") > F.col("floor_"), 0.66 * ((F.col("y_") - F.col("floor_")) / (F.col("top_") - F.col("floor_")) - 0.5)).otherwise(0.0))

    def start() -> Step:
        held = out = 0.0

        def step(x):
            nonlocal held, out
            if x is not None:
                held = min(max(x + 0.67 * held, -0.999), 0.999)
                out = math.log((1 + held) / (1 - held)) / 2 + out / 2
            return (out,)

        return step

    return scanned(placed.withColumn("place_", place), start, ["place_"], "fisher double").drop("n_", "y_", "top_", "floor_", "place_")


def simple_rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """RSI from the plain sums of the last n gains and losses; null before."""
    change = F.col("close") - F.lag("close").over(W.order())
    rows = bars.withColumn("change_", change)
    up, down = F.sum(F.greatest("change_", F.lit(0.0))).over(W.last(n)), F.sum(F.greatest(-F.col("change_"), F.lit(0.0))).over(W.last(n))
    known = F.count("change_").over(W.last(n)) == n
    return rows.withColumn("rsi_simple", F.when(known & (up + down > 0), 100 * up / (up + down))).drop("change_")
