"""Permutation nulls and bootstrap intervals: all rounds in one aggregation.

A round's permutation is an index map computed from the index and a key, so
no round is sorted: with a * b just over n, the index is split into two
halves that change in turn by keyed hashes of each other, and indices of n and
more are mapped on until they are below n. A round costs a row for each value,
which is looked up by its index; statistics come from sums by round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.operators import quantiles as Q

PRIME = 2147483647
TURNS, STEPS = 4, 64


def index_map(index: Column, n: Column, key: Column) -> Column:
    """Where the permutation of 0 .. n-1 that key names takes the index (long).

    At most sqrt(n) + 1 numbers lie outside, so that a step more is needed with
    a probability of about 1 / sqrt(n); STEPS are enough for certain up to
    n = 4000, and beyond it but for a probability under 1e-100.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.call_function("div", n + a - 1, a)

    def turned(s: Column, k: Column) -> Column:
        even = k % 2 == 0
        seed = (F.when(even, s["r"]).otherwise(s["l"]) + key * 7919 + (k + 1) * 104729) % PRIME
        hashed = seed * 48271 % PRIME * 16807 % PRIME
        return F.struct(F.when(even, (s["l"] + hashed) % a).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise((s["r"] + hashed) % b).alias("r"))

    def mapped(x: Column) -> Column:
        start = F.struct(F.call_function("div", x, b).alias("l"), (x % b).alias("r"))
        turns = F.sequence(F.lit(0).cast("long"), F.lit(TURNS - 1).cast("long"))
        return F.aggregate(turns, start, turned, lambda s: s["l"] * b + s["r"])

    once = mapped(index.cast("long"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), once, lambda x, _: F.when(x < n, x).otherwise(mapped(x)))
    return F.when(once < n, once).otherwise(walked)


def shuffled(rows: DataFrame, by: list[str], index: str, value: str, rounds: int) -> DataFrame:
    """rows once for each round from 0 on, with the value of another row of the same `by` in the value's place: its own in round 0,
    else that of the row at the mapped index. index counts a group's rows from 0."""
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_"))
    many = rows.drop(value).join(sizes, by) if by else rows.drop(value).join(F.broadcast(sizes), F.lit(True))  # one row without by
    many = many.withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rounds).cast("long"))))
    place = F.when(F.col("round") == 0, F.col(index)).otherwise(index_map(F.col(index), F.col("n_"), F.col("round")))
    own = rows.select(*by, F.col(index).alias("at_"), value)
    return many.withColumn("at_", place).join(own, [*by, "at_"]).drop("at_", "n_")


def against_null(rounds: DataFrame, by: list[str], statistic: str) -> DataFrame:
    """Of a statistic by round: that of round 0, the mean and deviation of the others, its distance in deviations, and the
    share (with itself counted in) of rounds that reach it."""
    null = F.when(F.col("round") > 0, F.col(statistic))
    first = rounds.where("round = 0").select(*by, F.col(statistic).alias("observed"))
    both = rounds.join(first, by) if by else rounds.join(F.broadcast(first), F.lit(True))
    reached = F.count_if((F.col("round") > 0) & (F.col(statistic) >= F.col("observed") - 1e-12))
    sums = both.groupBy(*by).agg(F.first("observed").alias("observed"), F.avg(null).alias("null_mean"), F.stddev_samp(null).alias("null_sd"), ((reached + 1) / (F.count(null) + 1)).alias("p"))
    return sums.withColumn("z", F.when(F.col("null_sd") > 0, (F.col("observed") - F.col("null_mean")) / F.col("null_sd")))


def transfer_entropy(rows: DataFrame, by: list[str]) -> DataFrame:
    """What `other` says about `now` beyond `own`, in nats, for each by: from the counts of their values, few rows a group."""
    n = F.col("n")
    counts = rows.groupBy(*by, "now", "own", "other").agg(F.count(F.lit(1)).cast("double").alias("n"))
    totals = {"no": ("own", "other"), "nn": ("now", "own"), "o": ("own",), "t": ()}
    counts = counts.withColumns({k: F.sum("n").over(Window.partitionBy(*by, *some)) for k, some in totals.items()})
    return counts.groupBy(*by).agg(F.sum(n / F.col("t") * F.log((n / F.col("no")) / (F.col("nn") / F.col("o")))).alias("te"))


def welch(rows: DataFrame, by: list[str], part: str, value: str) -> DataFrame:
    """For each by Welch's t between the parts of the greatest and the smallest mean, and these parts: best, worst."""
    sums = rows.groupBy(*by, part).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    ends = sums.groupBy(*by).agg(*(f(F.struct("m", F.negate(part).alias("p"), "n", "v")).alias(n) for n, f in (("hi", F.max), ("lo", F.min))))
    se = F.sqrt(F.col("hi.v") / F.col("hi.n") + F.col("lo.v") / F.col("lo.n"))
    t = F.when(se > 0, (F.col("hi.m") - F.col("lo.m")) / se).otherwise(0.0)
    return ends.select(*by, t.alias("t"), (-F.col("hi.p")).alias("best"), (-F.col("lo.p")).alias("worst"))


def block_sums(rows: DataFrame, by: str, order: str, values: dict[str, Column], block: int, rounds: int) -> DataFrame:
    """For each key and round the means of the values over resampled blocks of consecutive rows, as many as fit the key.

    Starts come from a fixed linear congruence, so runs agree. Block sums are
    differences of running sums, looked up by row number: a round costs a row
    for each block. Keys of at most two blocks have no row.
    """
    past = Window.partitionBy(by).orderBy(order)
    number = F.row_number().over(past) - 1
    running = {n: F.sum(v).over(past.rowsBetween(Window.unboundedPreceding, 0)) - v for n, v in values.items()}
    prefix = rows.select(by, number.alias("i"), *(c.alias(n) for n, c in running.items()))
    whole = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * block)
    blocks = whole.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / block).cast("int") - 1)))
    seed = (F.col("round").cast("long") * 7919 + F.col("j") * 104729 + 12345) % PRIME * 48271 % PRIME
    starts = blocks.withColumn("i", (seed % (F.col("n") - block)).cast("int"))
    low = starts.join(prefix.select(by, "i", *(F.col(n).alias(f"{n}_low") for n in values)), [by, "i"]).withColumn("i", F.col("i") + block)
    sums = low.join(prefix, [by, "i"])
    return sums.groupBy(by, "round").agg(*((F.sum(F.col(n) - F.col(f"{n}_low")) / (F.count(F.lit(1)) * block)).alias(n) for n in values))


def interval(rounds: DataFrame, by: str, statistic: str, share: float = 0.95) -> DataFrame:
    """by with the bounds low and high between which the middle share of the rounds' statistic lies; exact."""
    return Q.percentile_columns(rounds, [by], statistic, {"low": (1 - share) / 2, "high": (1 + share) / 2})
