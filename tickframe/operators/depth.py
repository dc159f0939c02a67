"""Order-book depth: snapshots as arrays of levels, their imbalance against earlier bins, and events with a cooldown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.operators.recursive import cooled


def up_to(levels: Column, count: int) -> Column:
    """The sum of an array's first levels."""
    return F.aggregate(F.slice(levels, 1, count), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def binned(snapshots: DataFrame, at: str, order: str) -> DataFrame:
    """The last snapshot (by order) of each symbol and bin, whose number is the column `at`."""
    last = F.max_by(F.struct("bids", "asks"), order)
    return snapshots.groupBy("symbol", F.col(at).cast("long").alias("bin")).agg(last.alias("s")).select("symbol", "bin", "s.bids", "s.asks")


def imbalances(snapshots: DataFrame, depths: list[int], window: int, least: int) -> DataFrame:
    """symbol, bin, depth, imbalance, z and thin for each number of levels.

    snapshots have one row for a symbol and bin, with the values of their bid
    and ask levels as arrays, nearest first. imbalance is (bid - ask) / (bid +
    ask) over the first `depth` levels; z is it over its deviation in the
    `window` bins before (bins without a snapshot stay empty), of which
    `least` at least must be known; thin is the depth over its mean there.
    """
    sums = F.array(*(F.struct(F.lit(d).alias("depth"), up_to(F.col("bids"), d).alias("bid"), up_to(F.col("asks"), d).alias("ask")) for d in depths))
    rows = snapshots.select("symbol", "bin", F.explode(sums).alias("x")).select("symbol", "bin", "x.*")
    total = F.col("bid") + F.col("ask")
    rows = rows.withColumns({"imbalance": F.when(total > 0, (F.col("bid") - F.col("ask")) / total), "total": F.when(total > 0, total)})
    before = Window.partitionBy("symbol", "depth").orderBy("bin").rangeBetween(-window, -1)
    known = F.count("imbalance").over(before) >= least
    spread, usual = F.stddev_samp("imbalance").over(before), F.avg("total").over(before)
    return rows.select("symbol", "bin", "depth", "imbalance", F.when(known & (spread > 0), F.col("imbalance") / spread).alias("z"), F.when(known, F.col("total") / usual).alias("thin"))


def imbalance_events(found: DataFrame, bound: float, pause: int, along: bool = True) -> DataFrame:
    """Bins whose z reaches the bound, `pause` bins at least after the last one kept of their symbol and depth, with the
    side (1 or -1) of a trade along the imbalance or against it."""
    side = F.signum("z").cast("int")
    rows = found.where(F.abs("z") >= bound).select(F.concat_ws("|", "symbol", "depth").alias("symbol"), F.col("bin").cast("double").alias("at"), F.col("bin").alias("id"), F.struct("symbol", "depth", "bin", (side if along else -side).alias("side"), "z").alias("x"))
    return cooled(rows, float(pause)).select("x.*")
