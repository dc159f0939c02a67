"""Volume by price: profiles of bars over bins, their value area, and what lies around a price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranged(bars: DataFrame, bins: int, *by: str) -> DataFrame:
    """bars with the lowest price and the width of a bin of their group, a row for each group joined back."""
    bounds = bars.groupBy(*by).agg(F.min("low").alias("base"), ((F.max("high") - F.min("low")) / bins).alias("width"))
    return bars.join(bounds.where("width > 0"), list(by))


def place(price: Column, bins: int) -> Column:
    at = F.floor((price - F.col("base")) / F.col("width"))
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), at)).cast("int")


def overlap_profile(bars: DataFrame, bins: int, *by: str) -> DataFrame:
    """Volume of each bin: a bar's volume is shared over the bins in proportion to its overlap with them.

    A bin's volumes are added in the order of time, as a running sum. Bins that
    the same bars cover hold the same volume, and the last digit, on which the
    order acts, would tell at random which of them is the largest.
    """
    rows = ranged(bars, bins, *by).withColumn("bin", F.explode(F.sequence(place(F.col("low"), bins), place(F.col("high"), bins))))
    low = F.col("base") + F.col("bin") * F.col("width")
    overlap = F.least(F.col("high"), low + F.col("width")) - F.greatest(F.col("low"), low)
    part = F.when(overlap > 0, F.col("volume") * overlap / F.greatest(F.col("high") - F.col("low"), F.lit(1e-8))).otherwise(0.0)
    so_far = F.sum(part).over(Window.partitionBy(*by, "bin").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("v", so_far).groupBy(*by, "base", "width", "bin").agg(F.max_by("v", "bar").alias("v"))


def value_area(profile: DataFrame, bins: int, share: float, *by: str) -> DataFrame:
    """Point of control and the bounds of the area around it that holds `share` of the volume, grown by the larger
    neighbour at a time (the upper one on a tie). A group's bins, `bins` at most, are one array."""
    filled = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i.cast("int")), F.lit(0.0)))
    rows = profile.groupBy(*by, "base", "width").agg(F.map_from_entries(F.collect_list(F.struct("bin", "v"))).alias("m")).withColumn("v", filled)
    rows = rows.withColumn("poc", (F.array_position("v", F.array_max("v")) - 1).cast("int")).withColumn("goal", F.aggregate("v", F.lit(0.0), lambda s, x: s + x) * share)

    def grown(s: Column, _: Column) -> Column:
        up = F.when(s["hi"] < bins - 1, F.get("v", s["hi"] + 1)).otherwise(F.lit(-1.0))
        down = F.when(s["lo"] > 0, F.get("v", s["lo"] - 1)).otherwise(F.lit(-1.0))
        done = (s["acc"] >= F.col("goal")) | ((s["hi"] >= bins - 1) & (s["lo"] <= 0))
        rise = ~done & (up >= down)
        fall = ~done & (up < down)
        return F.struct((s["lo"] - fall.cast("int")).alias("lo"), (s["hi"] + rise.cast("int")).alias("hi"), (s["acc"] + F.when(rise, up).when(fall, down).otherwise(0.0)).alias("acc"))

    start = F.struct(F.col("poc").alias("lo"), F.col("poc").alias("hi"), F.get("v", F.col("poc")).alias("acc"))
    area = rows.withColumn("a", F.aggregate(F.sequence(F.lit(1), F.lit(bins)), start, grown))
    price = F.col("base")
    return area.select(*by, (price + (F.col("poc") + 0.5) * F.col("width")).alias("poc"), (price + (F.col("a.hi") + 1) * F.col("width")).alias("vah"), (price + F.col("a.lo") * F.col("width")).alias("val"))


def paired_area(profile: DataFrame, bins: int, share: float, *by: str) -> DataFrame:
    """The same area grown by two bins at a time on the side whose two hold more; of equal controls the one nearest the middle."""
    filled = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i.cast("int")), F.lit(0.0)))
    rows = profile.groupBy(*by, "base", "width").agg(F.map_from_entries(F.collect_list(F.struct("bin", "v"))).alias("m")).withColumn("v", filled)
    top = F.array_max("v")
    peaks = F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.get("v", i) >= top * (1 - 1e-12))
    nearest = F.get(F.array_sort(F.transform(peaks, lambda i: F.struct(F.abs(i - (bins - 1) / 2).alias("d"), i.alias("i")))), 0)["i"]
    rows = rows.withColumn("poc", nearest).withColumn("goal", F.aggregate("v", F.lit(0.0), lambda s, x: s + x) * share - 1e-12)

    def at(i: Column) -> Column:
        return F.when((i >= 0) & (i < bins), F.get("v", i)).otherwise(0.0)

    def grown(s: Column, _: Column) -> Column:
        up, down = at(s["hi"] + 1) + at(s["hi"] + 2), at(s["lo"] - 1) + at(s["lo"] - 2)
        done = (s["acc"] >= F.col("goal")) | ((s["hi"] + 1 >= bins) & (s["lo"] <= 0))
        rise = ~done & (((up >= down) & (s["hi"] + 1 < bins)) | (s["lo"] <= 0))
        fall = ~done & ~rise
        return F.struct(F.when(fall, F.greatest(s["lo"] - 2, F.lit(0))).otherwise(s["lo"]).alias("lo"), F.when(rise, F.least(s["hi"] + 2, F.lit(bins - 1))).otherwise(s["hi"]).alias("hi"), (s["acc"] + F.when(rise, up).when(fall, down).otherwise(0.0)).alias("acc"))

    start = F.struct(F.col("poc").alias("lo"), F.col("poc").alias("hi"), F.get("v", F.col("poc")).alias("acc"))
    area = rows.withColumn("a", F.aggregate(F.sequence(F.lit(1), F.lit(bins)), start, grown))
    return area.select(*by, (F.col("base") + (F.col("a.hi") + 1) * F.col("width")).alias("vah"), (F.col("base") + F.col("a.lo") * F.col("width")).alias("val"))


def _binned(rows: DataFrame, window: str, bins: int) -> DataFrame:
    """rows with the bounds of an array column of (p, v) and its volume by bin; each is a column, so computed once."""
    bounds = rows.withColumns({"_lo": F.array_min(F.transform(window, lambda x: x["p"])), "_hi": F.array_max(F.transform(window, lambda x: x["p"]))})
    binned = bounds.withColumn("_x", F.transform(window, lambda x: F.struct(_bin(x["p"], bins).alias("b"), x["v"].alias("v"))))
    sums = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.aggregate("_x", F.lit(0.0), lambda s, x: s + F.when(x["b"] == b, x["v"]).otherwise(0.0)))
    return binned.withColumn("_v", sums)


def _bin(p: Column, bins: int) -> Column:
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((p - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins))).cast("int")


def trailing_control(rows: DataFrame, window: str, bins: int) -> DataFrame:
    """rows with the fullest bin's middle of an array column of (p, v), and its share of the volume."""
    out = _binned(rows, window, bins).withColumn("_sum", F.aggregate("_v", F.lit(0.0), lambda s, x: s + x))
    at = F.array_position("_v", F.array_max("_v")) - 0.5
    return out.withColumns({"poc": F.col("_lo") + at * (F.col("_hi") - F.col("_lo")) / bins, "share": F.array_max("_v") / F.nullif(F.col("_sum"), F.lit(0.0))}).drop("_lo", "_hi", "_x", "_v", "_sum")


def density(rows: DataFrame, window: str, price: str, bins: int) -> DataFrame:
    """rows with, of an array column of (p, v) binned evenly over its range: slope and curvature of volume at the
    price's bin, and away, the distance in bins to the fullest one."""
    out = _binned(rows, window, bins).withColumn("_b", _bin(F.col(price), bins))
    up, own = F.coalesce(F.get("_v", F.col("_b") + 1), F.lit(0.0)), F.get("_v", F.col("_b"))
    down = F.when(F.col("_b") > 0, F.get("_v", F.col("_b") - 1)).otherwise(0.0)
    away = (F.col("_b") - (F.array_position("_v", F.array_max("_v")) - 1)).cast("int")
    return out.withColumns({"slope": up - down, "curve": up - 2 * own + down, "away": away}).drop("_lo", "_hi", "_b", "_x", "_v")


def control_point(bars: DataFrame, bins: int, price: Column, *by: str) -> DataFrame:
    """The bin with the most volume when each bar counts at one price (its middle, say); the lowest on a tie."""
    sums = ranged(bars, bins, *by).groupBy(*by, "base", "width", place(price, bins).alias("bin")).agg(F.sum("volume").alias("v"))
    best = sums.groupBy(*by, "base", "width").agg(F.max_by("bin", F.struct("v", F.negate("bin"))).alias("bin"))
    return best.select(*by, (F.col("base") + (F.col("bin") + 0.5) * F.col("width")).alias("poc"))


def around(window: Column, price: Column, reach: Column) -> tuple[Column, Column, Column]:
    """Of an array of (price, volume): volume above and below the price within reach, and the signed pull sum(volume / (distance + reach)^2)."""

    def total(test, value):
        return F.aggregate(window, F.lit(0.0), lambda s, x: s + F.when(test(x), value(x)).otherwise(0.0))

    above = total(lambda x: (x["p"] > price) & (x["p"] <= price + reach), lambda x: x["v"])
    below = total(lambda x: (x["p"] < price) & (x["p"] >= price - reach), lambda x: x["v"])
    pull = total(lambda x: x["p"] != price, lambda x: F.signum(x["p"] - price) * x["v"] / F.pow(F.abs(x["p"] - price) + reach, 2))
    return above, below, pull
