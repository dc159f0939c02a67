"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0 .. n-1 in the order of the given columns. The number is
split as left * b + right with a * b just over n, and passes rounds that add
a keyed hash of one half to the other, modulo a or b: a permutation of
0 .. a*b-1. Numbers of n and more walk their cycle until they are below n.
At most a*b - n < sqrt(n) + 1 numbers lie outside, so a walk has a known
bound and few rows walk at all. With p the permuted number, shard is p mod
count and slot is p div count: shards differ by one row at most, and a row's
place can be computed from its number alone, without a shuffle of the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.llm.shared import bare, cut, fresh

ROUNDS = 6


def numbered(df: DataFrame, by: list[str], name: str = "row_number") -> DataFrame:
    """df with gapless row numbers from 0 in the order of the columns `by`.

    Rows that agree in all of them may swap numbers. Range partitions are
    sorted on their own; a partition's offset is the sum of the counts
    before it, a row for each shuffle partition, which is joined by broadcast.
    """
    tie, part, offset = (fresh(df.columns, x) for x in ("tie", "part", "offset"))
    rows = df.withColumn(tie, F.monotonically_increasing_id())
    columns = [F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()]
    order = [F.col(f"`{c}`") for c in by]
    rows = cut(rows.repartitionByRange(*order, tie).sortWithinPartitions(*order, tie).drop(tie))
    placed = rows.withColumns({part: F.spark_partition_id(), tie: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    before = F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).select(F.col("p").alias(part), F.coalesce(before, F.lit(0)).alias(offset))
    return placed.join(F.broadcast(starts), part).select(*columns, (F.col(offset) + F.col(tie)).cast("long").alias(name))


def permuted(number: Column, n: int, key: int) -> Column:
    """The place of a row number in the permutation of 0 .. n-1 that key names."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    b = max(1, -(-n // a))

    def feistel(x: Column) -> Column:
        left, right = F.call_function("div", x, F.lit(b)), F.pmod(x, F.lit(b))
        for k in range(ROUNDS):
            if k % 2:
                right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(key), F.lit(k)), F.lit(b)), F.lit(b))
            else:
                left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(key), F.lit(k)), F.lit(a)), F.lit(a))
        return left * F.lit(b) + right

    once = feistel(number)
    if a * b == n or n == 0:
        return once
    steps = F.sequence(F.lit(1), F.lit(a * b - n))
    walked = F.aggregate(steps, once, lambda x, _: F.when(x < n, x).otherwise(feistel(x)))
    return F.when(once < n, once).otherwise(walked)


def shards(df: DataFrame, count: int, by: list[str], key: int = 1) -> DataFrame:
    """df with row_number, place, shard (int) and slot (long).

    Defined cases: an empty table stays empty; rows with nulls in `by` are
    numbered first; repeated rows each get a place of their own; columns of df
    named as an output (in any case of letters) may be in `by` and give way to
    the output; texts are not read unless they are in `by`.
    """
    number = fresh(df.columns, "row_number")
    rows = numbered(df, by, number)
    n = rows.count()
    place = permuted(F.col(number), n, key)
    kept = bare(df, "row_number", "place", "shard", "slot").columns
    out = rows.select(*(F.col(f"`{c}`") for c in kept), F.col(number).alias("row_number"), place.alias("place"))
    return out.withColumns({"shard": F.pmod("place", F.lit(count)).cast("int"), "slot": F.expr(f"place div {count}")})
