"""What lies in a trade's way: levels between entry and target that were known at the time, and the control point.

Counting levels inside a rectangle of time and price is done without a range
join: a stretch of time is the union of few dyadic blocks, and within a block
sorted by price a running sum at both prices gives the count between them, and
the neighbour in the order the nearest level. A level is in one block of each
size, a stretch in two of each size at most, and no block is longer than the
longest stretch, so groups stay bounded however long a symbol's history is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.operators.frames import order
from tickframe.operators.joins import first_at


def swing_levels(bars: DataFrame, k: int) -> DataFrame:
    """Highs (kind 1) and lows (-1) that k bars on both sides do not pass: symbol, price, kind, strength (how many of the
    next 2k - 1 bars hold strictly before one does not) and seen, the bar of the last of these, from whose end on it is known."""
    left, right = order().rowsBetween(-k, -1), order().rowsBetween(1, k)
    ahead = order().rowsBetween(1, 2 * k - 1)
    whole = (F.count(F.lit(1)).over(left) == k) & (F.count(F.lit(1)).over(right) == k)
    kinds = (F.lit(1), F.max("high").over(left) <= F.col("high"), F.max("high").over(right) <= F.col("high"), "high"), (F.lit(-1), F.min("low").over(left) >= F.col("low"), F.min("low").over(right) >= F.col("low"), "low")
    found = F.array(*(F.struct(kind.alias("kind"), (whole & a & b).alias("ok"), F.col(c).alias("price")) for kind, a, b, c in kinds))
    rows = bars.withColumns({"path": F.collect_list(F.struct("bar", "high", "low")).over(ahead), "_e": found}).where(F.size("path") == 2 * k - 1)
    rows = rows.withColumn("e", F.explode(F.filter("_e", lambda e: e["ok"])))
    passed = first_at(F.col("path"), lambda x: F.when(F.col("e.kind") > 0, x["high"] >= F.col("e.price")).otherwise(x["low"] <= F.col("e.price")))
    return rows.select("symbol", "e.price", "e.kind", F.coalesce(passed - 1, F.lit(2 * k - 1)).cast("int").alias("strength"), F.get("path", F.lit(2 * k - 2))["bar"].alias("seen"))


def between(levels: DataFrame, spans: DataFrame, by: list[str], sums: list[str], of: str) -> DataFrame:
    """spans with, of the levels of the same `by` with first <= at <= last and low < price < high: the sum of each column
    of sums, and of those where the flag `of` holds the price nearest above low (above) and nearest below high (below).

    levels: by, at (long, not negative), price, sums and of. spans: by, id, first, last, low, high, more than one of an
    id being added up; a price bound may be infinite.
    """
    longest = spans.agg(F.max(F.col("last") - F.greatest("first", F.lit(0)) + 1)).first()[0]
    sizes = F.sequence(F.lit(0), F.lit(max(1, int(longest or 1)).bit_length()))
    placed = levels.withColumn("k", F.explode(sizes)).withColumn("block", F.call_function("shiftright", F.col("at"), F.col("k")))
    cut = spans.withColumns({"a_": F.greatest("first", F.lit(0).cast("long")), "b_": F.col("last") + 1}).withColumn("k", F.explode(sizes))
    begin = F.expr("shiftright(a_ + shiftleft(bigint(1), k) - 1, k)")
    cut = cut.withColumns({"l_": begin, "r_": F.expr("shiftright(b_, k)")}).where("l_ < r_")
    parts = F.array_compact(F.array(F.when(F.col("l_") % 2 == 1, F.col("l_")), F.when(F.col("r_") % 2 == 1, F.col("r_") - 1)))
    cut = cut.withColumn("block", F.explode(parts))
    zero, none = F.lit(0.0), F.lit(None)
    rows = placed.select(*by, "k", "block", "price", F.lit(1).alias("turn"), *(F.col(s).cast("double").alias(s) for s in sums), F.when(F.col(of), F.col("price")).alias("mark_"), none.cast("long").alias("id"))
    ends = F.explode(F.array(F.struct(F.col("low").alias("price"), F.lit(2).alias("turn")), F.struct(F.col("high").alias("price"), F.lit(0).alias("turn"))))
    asked = cut.select(*by, "k", "block", "id", ends.alias("e")).select(*by, "k", "block", "e.price", "e.turn", *(zero.alias(s) for s in sums), none.cast("double").alias("mark_"), "id")
    key = Window.partitionBy(*by, "k", "block")
    up = key.orderBy("price", "turn").rowsBetween(Window.unboundedPreceding, 0)
    down = key.orderBy(F.desc("price"), F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(asked).withColumns({**{s: F.sum(s).over(up) for s in sums}, "under_": F.last("mark_", ignorenulls=True).over(up)}).withColumn("over_", F.last("mark_", ignorenulls=True).over(down))
    sign = F.when(F.col("turn") == 0, 1.0).otherwise(-1.0)
    out = both.where("id is not null").groupBy("id").agg(*(F.sum(sign * F.col(s)).alias(s) for s in sums), F.min(F.when(F.col("turn") == 2, F.col("over_"))).alias("above"), F.max(F.when(F.col("turn") == 0, F.col("under_"))).alias("below"))
    return out


def level_score(side: Column, entry: Column, stop: Column, target: Column, near: Column, seen: Column, major: Column, minor: Column, nearest: Column, margin: float = 0.002) -> tuple[Column, Column]:
    """Score from 0 to 1 of a trade's way past levels, and its target, pulled to just before the nearest major one.

    0 with a major opposing level at the entry, or where the pulled target gives
    less than the risk; 0.85 where no level is known, 1 for a free way, less
    0.05 from 0.85 for each minor level (0.2 at most); else by the reward left.
    """
    pulled = nearest * (1 - side * margin)
    reward, risk = F.abs(pulled - entry), F.abs(entry - stop)
    viable = F.least(F.lit(0.65), 0.3 + reward / risk * 0.15)
    score = F.when(seen == 0, 0.85).when(near > 0, 0.0).when((major == 0) & (minor == 0), 1.0).when(major == 0, 0.85 - F.least(F.lit(0.2), minor * 0.05)).when(reward < risk, 0.0).otherwise(viable)
    return score, F.when((near == 0) & (major > 0) & (reward >= risk), pulled).otherwise(target)


def control_score(side: Column, entry: Column, stop: Column, target: Column, poc: Column, low: Column, high: Column, margin: float = 0.002) -> tuple[Column, Column]:
    """Score from 0 to 1 of a trade's way past the control point of a profile with the value area low..high, and its target.

    An entry 2 % (1 %) beyond the control point scores 0 (0.25), as price tends
    back; one with the point before the target by the reward up to it; one
    right on it (0.5 %) scores 1, one beyond it 0.9; inside the area 0.65, else
    0.85; without a profile 0.8.
    """
    away = side * (entry - poc) / poc
    pulled = poc * (1 - side * margin)
    reward, risk = F.abs(pulled - entry), F.abs(entry - stop)
    inside = (side * poc > side * entry) & (side * poc < side * target)
    score = (
        F.when(poc.isNull(), 0.8)
        .when(away >= 0.02, 0.0)
        .when(away >= 0.01, 0.25)
        .when(inside, F.when(reward < risk * 0.8, 0.15).otherwise(F.least(F.lit(0.55), 0.25 + reward / risk * 0.15)))
        .when(side * poc <= side * entry, F.when(F.abs(entry - poc) / entry < 0.005, 1.0).otherwise(0.9))
        .when((low <= entry) & (entry <= high), 0.65)
        .otherwise(0.85)
    )
    return score, F.when(inside & (away < 0.01) & (reward >= risk * 0.8), pulled).otherwise(target)
