"""Features of several bar sizes on one time axis, and the state of the market they show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.functions.scalars import ratio
from tickframe.operators import frames as W
from tickframe.operators.joins import as_of


def slopes(bars: DataFrame, n: int) -> DataFrame:
    """Slope of close over the last n bars as a share of the close, infinite or NaN at 0; null until there are n."""
    numbered = bars.withColumn("n_", F.row_number().over(W.order()).cast("double"))
    return numbered.withColumn("slope", W.full(ratio(F.regr_slope("close", "n_").over(W.last(n)), F.col("close")), n, W.last(n))).drop("n_")


def aligned(axis: DataFrame, sizes: dict[str, tuple[DataFrame, str]], n: int) -> DataFrame:
    """axis with, under each name, the slope of the last bar of that size that had ended by the axis bar's end.

    sizes give a frame of bars and its width as an interval's text; the axis
    is one of hours, whose bars end an hour on.
    """
    out = axis.withColumn("start_", F.col("bar")).withColumn("bar", F.col("bar") + F.expr("interval 1 hour"))
    for name, (bars, width) in sizes.items():
        known = slopes(bars, n).select("symbol", (F.col("bar") + F.expr(f"interval {width}")).alias("bar"), F.col("slope").alias(name))
        out = as_of(out, known, "bar", "symbol", [name])
    return out.withColumn("bar", F.col("start_")).drop("start_")


def coherence(rows: DataFrame, weights: dict[str, float], slow: str, fast: str) -> DataFrame:
    """rows with what the named slopes agree on: `coherence` (weighted mean of signs), `agreement` (share of the larger
    sign), `magnitude` (mean over mean of sizes) and `regime`; null where a slope is unknown. NaN has the sign 0 and is over 0, as in SQL."""
    signs = {k: F.when(F.isnan(k), 0.0).otherwise(F.signum(k)) for k in weights}
    known = F.lit(True)
    for k in weights:
        known = known & F.col(k).isNotNull()

    def added(parts: list[Column]) -> Column:
        return sum(parts[1:], parts[0])

    weighted = added([signs[k] * w for k, w in weights.items()]) / sum(weights.values())
    ups, downs = added([(F.col(k) > 0).cast("int") for k in weights]), added([(F.col(k) < 0).cast("int") for k in weights])
    sizes = added([F.abs(k) for k in weights])
    magnitude = F.when(sizes > 0, F.abs(added([F.col(k) for k in weights])) / sizes).otherwise(0.0)
    out = rows.withColumns({"coherence": F.when(known, weighted), "agreement": F.when(known, F.greatest(ups, downs) / len(weights)), "magnitude": F.when(known, magnitude)})
    regime = (
        F.when(F.col("agreement") == 1.0, F.when(F.col("coherence") > 0, "ALL_BULLISH").otherwise("ALL_BEARISH"))
        .when((F.col(slow) > 0) & (F.col(fast) < 0), "BULL_PULLBACK")
        .when((F.col(slow) < 0) & (F.col(fast) > 0), "BEAR_RALLY")
        .otherwise("MIXED")
    )
    return out.withColumn("regime", F.when(known, regime))


def nine_states(bars: DataFrame) -> DataFrame:
    """One of nine states of each bar from ranges, volume, path and fit of the last 20 bars; RANGE for the first 20.

    The range ratio is the mean of the last 19 true ranges (of highs against
    the close before) over that of 60 bars' spans, 1 until there are as many.
    """
    w = W.order()
    old, numbered = F.lag("close").over(w), F.row_number().over(w)
    rows = W.efficiency(W.trend_residual(bars.withColumn("n_", numbered).drop("i"), 20), 14)
    short = F.avg(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("old_")))).over(W.last(19))
    rows = rows.withColumn("old_", old).withColumns({"short_": short, "long_": F.avg(F.col("high") - F.col("low")).over(W.last(60)), "fit_": F.regr_r2("close", "i").over(W.last(20)), "bend_": F.col("close") - 2 * old + F.lag("close", 2).over(w)})
    ratio = F.when(F.col("n_") > 60, F.col("short_") / F.nullif(F.col("long_"), F.lit(0.0))).otherwise(1.0)
    usual = F.avg("volume").over(W.last(20))
    rows = rows.withColumns({"range_ratio": ratio, "push": F.when(usual > 0, F.col("volume") / usual).otherwise(F.col("volume"))})
    r, v, fit, path = (F.col(c) for c in ("range_ratio", "push", "fit_", "me"))
    state = (
        F.when(F.col("n_") <= 20, "RANGE")
        .when((r < 0.65) & (v < 0.80), "COMPRESSION")
        .when((r > 1.50) & (v > 1.50), "EXPANSION")
        .when((fit > 0.65) & (path > 0.50), "TREND")
        .when((fit > 0.50) & (v > 1.80) & (path < 0.25), "EXHAUSTION")
        .when((F.abs("resid_z") > 2.2) & (F.abs("bend_") > 0), "REVERSAL")
        .when(r > 1.30, "HIGH_VOLATILITY")
        .when(r < 0.75, "LOW_VOLATILITY")
        .when(path < 0.20, "CHOP")
        .otherwise("RANGE")
    )
    return rows.withColumn("state", state)
