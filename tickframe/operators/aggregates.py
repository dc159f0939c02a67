"""Grouped reports, scoreboards and statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of k of n."""
    p, square = k / n, z * z
    middle, half = p + square / (2 * n), z * F.sqrt(p * (1 - p) / n + square / (4 * n * n))
    return (middle - half) / (1 + square / n), (middle + half) / (1 + square / n)


def scoreboard(trades: DataFrame, by: str, r: str = "r") -> DataFrame:
    """Count, wins, win rate with its interval, mean, total and standard error of results by a key."""
    sums = trades.groupBy(by).agg(F.count("*").alias("n"), F.sum((F.col(r) > 0).cast("long")).alias("wins"), F.sum(r).alias("total"), F.sum(F.col(r) * F.col(r)).alias("squares"))
    low, high = wilson(F.col("wins").cast("double"), F.col("n").cast("double"))
    mean = F.col("total") / F.col("n")
    se = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), F.col("squares") - F.col("total") * mean) / (F.col("n") - 1) / F.col("n")))
    return sums.select(by, "n", "wins", (F.col("wins") / F.col("n")).alias("win_rate"), low.alias("low"), high.alias("high"), mean.alias("mean"), "total", se.alias("se"))


def performance(trades: DataFrame, pnl: str = "pnl") -> DataFrame:
    """Wins, losses, gross sums, profit factor (99.9 without a loss) and expectancy."""
    gain, loss = F.sum(F.when(F.col(pnl) > 0, F.col(pnl)).otherwise(0.0)), F.sum(F.when(F.col(pnl) < 0, -F.col(pnl)).otherwise(0.0))
    out = trades.agg(F.count("*").alias("n"), F.sum((F.col(pnl) > 0).cast("long")).alias("wins"), F.sum((F.col(pnl) < 0).cast("long")).alias("losses"), gain.alias("gross_profit"), loss.alias("gross_loss"), F.avg(pnl).alias("expectancy"))
    return out.withColumn("profit_factor", F.when(F.col("gross_loss") > 0, F.col("gross_profit") / F.col("gross_loss")).otherwise(99.9))


def clustered_t(rows: DataFrame, value: str, cluster: str, by: str) -> DataFrame:
    """Mean, its standard error with clustered errors, and t."""
    mean = rows.groupBy(by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    parts = rows.groupBy(by, cluster).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    out = parts.join(mean, by).groupBy(by).agg(F.first("mean").alias("mean"), F.first("n").alias("n"), F.count("*").alias("clusters"), F.sum(F.pow(F.col("s") - F.col("c") * F.col("mean"), 2)).alias("q"))
    se = F.sqrt("q") / F.col("n")
    return out.select(by, "n", "clusters", "mean", se.alias("se"), F.when(se > 0, F.col("mean") / se).alias("t"))


def auc(rows: DataFrame, score: str, label: str, by: str) -> DataFrame:
    """Area under the ROC curve by average ranks.

    Ranks come from counts of distinct scores, so ties cost one row and the
    window runs over distinct scores.
    """
    parts = rows.groupBy(by, score).agg(F.count("*").alias("c"), F.sum(label).alias("p"))
    order = Window.partitionBy(by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = parts.withColumn("rank", F.coalesce(F.sum("c").over(order), F.lit(0)) + (F.col("c") + 1) / 2)
    sums = ranked.groupBy(by).agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("n1"), F.sum(F.col("c") - F.col("p")).alias("n0"))
    return sums.select(by, "n1", "n0", F.when((F.col("n1") > 0) & (F.col("n0") > 0), (F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))).alias("auc"))


def false_discovery(tests: DataFrame, p: str = "p", q: float = 0.1, parts: int = 1024) -> DataFrame:
    """Benjamini-Hochberg: tests (one row for each hypothesis) with rank, limit and verdict.

    p falls into `parts` even intervals, the first of which is parted again by
    the logarithm of p, as small p are many; ranks are counted within an
    interval and start after the tests of the intervals before, a table of a
    bounded number of rows, so no task sorts all tests.
    """
    small = F.when(F.col(p) > 0, -F.least(F.floor(-F.log2(F.col(p) * parts)), F.lit(1074))).otherwise(-1075)
    placed = tests.withColumn("_part", F.when(F.col(p) * parts < 1, small).otherwise(F.least(F.floor(F.col(p) * parts), F.lit(parts - 1))).cast("int"))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    below = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_start"), F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("m"))
    ranked = placed.join(F.broadcast(starts), "_part").withColumn("rank", F.col("_start") + F.row_number().over(Window.partitionBy("_part").orderBy(p, "test")))
    ranked = ranked.withColumn("limit", F.col("rank") / F.col("m") * q)
    best = ranked.agg(F.max(F.when(F.col(p) <= F.col("limit"), F.col("rank"))).alias("_best"))  # one row
    return ranked.join(F.broadcast(best), F.lit(True)).withColumn("passes", F.coalesce(F.col("rank") <= F.col("_best"), F.lit(False))).drop("_part", "_start", "_best")


def transitions(bars: DataFrame, state: str) -> DataFrame:
    """Counts of neighbouring states and their shares of the first state's row."""
    step = bars.withColumn("prev", F.lag(state).over(Window.partitionBy("symbol").orderBy("bar"))).where("prev is not null")
    counts = step.groupBy("prev", F.col(state).alias("cur")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("prev")))


def two_sided_p(t: Column) -> Column:
    """Two-sided p-value of a normal t by the usual five-term polynomial."""
    # Fixed values of the approximation (Abramowitz and Stegun 26.2.17).
    z, k = F.abs(t), 1 / (1 + 0.2316419 * F.abs(t))
    terms = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]
    poly = sum((F.lit(b) * F.pow(k, F.lit(i + 1)) for i, b in enumerate(terms)), F.lit(0.0))
    return 2 * F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def verdict(t: Column, mean: Column, first: Column, second: Column, cost: float) -> Column:
    """One word: insufficient, not_significant, inconsistent (the halves differ in sign), under_cost or survives."""
    steady = (F.signum(first) == F.signum(second)) & (F.signum(first) == F.signum(mean))
    return (
        F.when(t.isNull(), "insufficient")
        .when(F.abs(t) < 2, "not_significant")
        .when(~F.coalesce(steady, F.lit(False)), "inconsistent")
        .when(F.abs(mean) <= cost, "under_cost")
        .otherwise("survives")
    )


def block_bootstrap(rows: DataFrame, by: str, order: str, value: str, block: int, rounds: int) -> DataFrame:
    """p of the mean of each key against its own spread over resampled blocks of consecutive rows.

    Starts come from a fixed linear congruence, so runs agree. Block sums are
    differences of prefix sums, looked up by row number: a resample costs a
    row for each block, not for each value.
    """
    number = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    prefix = rows.select(by, number.alias("i"), (F.sum(value).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)).alias("s"), F.col(value).alias("v"))
    whole = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).where(F.col("n") > 2 * block)
    blocks = whole.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), (F.col("n") / block).cast("int") - 1)))
    seed = (F.col("round").cast("long") * 7919 + F.col("j") * 104729 + 12345) % 2147483647 * 48271 % 2147483647
    starts = blocks.withColumn("i", (seed % (F.col("n") - block)).cast("int"))
    low = starts.join(prefix.select(by, "i", F.col("s").alias("low")), [by, "i"]).withColumn("i", F.col("i") + block)
    sums = low.join(prefix.select(by, "i", F.col("s").alias("high")), [by, "i"])
    means = sums.groupBy(by, "round", "mean").agg((F.sum(F.col("high") - F.col("low")) / (F.count("*") * block)).alias("m"))
    return means.groupBy(by, "mean").agg(((F.count_if(F.abs(F.col("m") - F.col("mean")) >= F.abs("mean")) + 1) / (rounds + 1)).alias("p"))
