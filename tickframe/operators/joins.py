"""As-of, interval and band joins and event races."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, on: str, by: str, values: list[str], unit: str = "day") -> DataFrame:
    """left with the values of the last right row of `by` at or before its time.

    Both sides fall into buckets of time, so that a hot key is many groups: a
    union and one ordered window in each bucket, and for rows before its first
    right row what the last bucket that has one ends with, carried over the
    few rows of buckets. No range join.
    """
    bucket = F.date_trunc(unit, F.col(on))
    keyed = left.withColumns({v: F.lit(None).cast(right.schema[v].dataType) for v in values} | {"_side": F.lit(1)})
    other = right.select(by, on, *values).withColumn("_side", F.lit(0))
    both = keyed.unionByName(other, allowMissingColumns=True).withColumn("_bucket", bucket)
    seen = Window.partitionBy(by, "_bucket").orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    row = F.when(F.col("_side") == 0, F.struct(*values))
    held = F.last(row, ignorenulls=True).over(seen)
    ends = both.groupBy(by, "_bucket").agg(F.max_by(row, F.when(F.col("_side") == 0, F.col(on))).alias("_end"))
    earlier = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(by, "_bucket", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    out = both.withColumn("_held", held).where("_side = 1").join(carried, [by, "_bucket"])
    found = F.coalesce("_held", "_carried")
    return out.select(*(c for c in left.columns), *(found[v].alias(v) for v in values))


def interval_sums(spans: DataFrame, points: DataFrame, by: str, value: str, unit: str = "day") -> DataFrame:
    """spans (by, span, low, high) with the sum and count of values at times in (low, high].

    Prefix sums at both ends: linear in the rows, whatever the spans' lengths.
    Running sums stay within buckets of time, to which the sums of the buckets
    before are added, so that a hot key is many groups.
    """
    ends = spans.select(by, "span", F.explode(F.array(F.struct(F.col("low").alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("high").alias("at"), F.lit(1).alias("sign")))).alias("e")).select(by, "span", "e.*")
    both = ends.withColumn("_value", F.lit(None).cast("double")).unionByName(points.select(by, "at", F.col(value).cast("double").alias("_value")), allowMissingColumns=True)
    both = both.withColumn("_bucket", F.date_trunc(unit, "at"))
    within = Window.partitionBy(by, "_bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = both.groupBy(by, "_bucket").agg(F.sum("_value").alias("s"), F.count("_value").alias("c"))
    before = buckets.select(by, "_bucket", F.sum("s").over(earlier).alias("s"), F.sum("c").over(earlier).alias("c"))
    running = both.withColumns({"_s": F.sum("_value").over(within), "_c": F.count("_value").over(within)}).where("span is not null")
    at_ends = running.join(before, [by, "_bucket"])
    zero = F.lit(0)
    total = F.sum(F.col("sign") * (F.coalesce("_s", F.lit(0.0)) + F.coalesce("s", F.lit(0.0))))
    count = F.sum(F.col("sign") * (F.col("_c") + F.coalesce("c", zero))).cast("long")
    return spans.join(at_ends.groupBy("span").agg(total.alias("total"), count.alias("points")), "span")


def ahead(n: int, *columns: str) -> Column:
    """The next n bars of the symbol as an array of structs of the columns."""
    return F.collect_list(F.struct(*columns)).over(Window.partitionBy("symbol").orderBy("bar").rowsBetween(1, n))


def first_at(path: Column, test: Callable[[Column], Column]) -> Column:
    """The place (from 1) of the first element that passes the test, null if none does."""
    return F.nullif(F.array_position(F.transform(path, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(True)), F.lit(0).cast("long"))


def raced(bars: DataFrame, horizon: int, target: Column, stop: Column, side: Column | None = None, invalid: Column | None = None) -> DataFrame:
    """bars with hit, lost and gone: the bar (from 1) of the next `horizon` that first reaches the target price, the
    stop price, or closes beyond the invalidation price, for a long (side 1) or a short (-1) entry. One ordered frame
    and array functions: the path of a bar is bounded by the horizon, so there is no join."""
    way = F.lit(1) if side is None else side
    path = bars.withColumn("_path", ahead(horizon, "high", "low", "close"))
    with_levels = path.withColumns({"_way": way, "_target": target, "_stop": stop, "_invalid": F.lit(None).cast("double") if invalid is None else invalid})
    up = F.col("_way") > 0
    out = with_levels.withColumns(
        {
            "hit": first_at(F.col("_path"), lambda x: F.when(up, x["high"] >= F.col("_target")).otherwise(x["low"] <= F.col("_target"))),
            "lost": first_at(F.col("_path"), lambda x: F.when(up, x["low"] <= F.col("_stop")).otherwise(x["high"] >= F.col("_stop"))),
            "gone": first_at(F.col("_path"), lambda x: F.when(up, x["close"] < F.col("_invalid")).otherwise(x["close"] > F.col("_invalid"))),
            "seen": F.size("_path"),
        }
    )
    return out.drop("_path", "_way", "_target", "_stop", "_invalid")


def outcome() -> Column:
    """WIN, LOSS or OPEN of a race: a bar that reaches both is a LOSS, one that only closes beyond the invalidation is GONE."""
    never = F.lit(1 << 30)
    hit, lost, gone = (F.coalesce(F.col(c), never) for c in ("hit", "lost", "gone"))
    return F.when((lost < never) & (lost <= hit) & (lost <= gone), "LOSS").when((hit < never) & (hit <= gone), "WIN").when(gone < never, "GONE").otherwise("OPEN")


def judged(bars: DataFrame, horizon: int, entry: Column, stop: Column, first: Column, second: Column, invalid: Column) -> DataFrame:
    """Status of a long setup over the next bars: it enters when a high reaches the entry, is void if a low reaches the
    invalidation before, and then meets its stop, its first or its second target, in which a stop wins ties."""
    out = bars.withColumn("_path", ahead(horizon, "high", "low"))
    out = out.withColumns({"_entry": entry, "_stop": stop, "_one": first, "_two": second, "_void": invalid})
    out = out.withColumns({"entered": first_at(F.col("_path"), lambda x: x["high"] >= F.col("_entry")), "void": first_at(F.col("_path"), lambda x: x["low"] <= F.col("_void"))})
    never = F.lit(1 << 30).cast("long")
    begins = F.coalesce("entered", never)
    out = out.withColumn("_in", (begins < never) & (begins <= F.coalesce("void", never)))
    rest = F.when(F.col("_in"), F.slice("_path", F.col("entered").cast("int"), F.lit(horizon)))
    out = out.withColumn("_rest", rest)
    out = out.withColumns({"_s": F.coalesce(first_at(F.col("_rest"), lambda x: x["low"] <= F.col("_stop")), never), "_t": F.coalesce(first_at(F.col("_rest"), lambda x: x["high"] >= F.col("_one")), never), "_u": F.coalesce(first_at(F.col("_rest"), lambda x: x["high"] >= F.col("_two")), never)})
    after = F.when(F.col("_t") < never, F.slice("_rest", F.col("_t").cast("int") + 1, F.lit(horizon)))
    out = out.withColumn("_after", after).withColumn("_s2", F.coalesce(first_at(F.col("_after"), lambda x: x["low"] <= F.col("_stop")), never))
    won = (F.col("_t") < F.col("_s")) & (F.col("_u") < never) & ((F.col("_u") <= F.col("_t")) | (F.col("_u") - F.col("_t") < F.col("_s2")))
    status = (
        F.when(~F.col("_in") & F.col("void").isNotNull(), "INVALIDATED")
        .when(~F.col("_in"), F.when(F.size("_path") == horizon, "EXPIRED").otherwise("WAITING"))
        .when((F.col("_s") < never) & (F.col("_s") <= F.col("_t")), "STOPPED")
        .when(won, "TP2 HIT")
        .when((F.col("_t") < never) & (F.col("_s2") < never), "STOPPED AFTER TP1")
        .when(F.col("_t") < never, "TP1 HIT")
        .otherwise("ENTERED")
    )
    ends = F.when(F.col("_s") <= F.col("_t"), F.col("_s")).when(won, F.greatest("_u", "_t")).otherwise(F.col("_t") + F.col("_s2"))
    best = F.array_max(F.transform(F.slice("_rest", F.lit(1), F.least(ends, F.lit(horizon)).cast("int")), lambda x: x["high"]))
    out = out.withColumns({"status": status, "best_r": F.when(F.col("_in"), F.greatest(F.lit(0.0), (best - F.col("_entry")) / (F.col("_entry") - F.col("_stop"))))})
    return out.drop("_path", "_entry", "_stop", "_one", "_two", "_void", "_in", "_rest", "_after", "_s", "_t", "_u", "_s2")


def first_touch(bars: DataFrame, signals: Column, horizon: int, target: float, stop: float) -> DataFrame:
    """WIN, LOSS or OPEN for long entries at the close of bars where `signals` holds: whichever of target and stop,
    shares of the entry, is met first in the next bars; a bar that meets both is a LOSS."""
    raced_ = raced(bars, horizon, F.col("close") * (1 + target), F.col("close") * (1 - stop)).where(signals)
    met = raced_.where("seen > 0").select("symbol", "bar", F.col("close").alias("entry"), "hit", "lost", outcome_of("hit", "lost").alias("result"))
    return met.withColumn("r", F.when(F.col("result") == "WIN", target / stop).when(F.col("result") == "LOSS", -1.0).otherwise(0.0))


def outcome_of(hit: str, lost: str) -> Column:
    return F.when(F.col(lost).isNotNull() & (F.col(lost) <= F.coalesce(hit, F.lit(1 << 30))), "LOSS").when(F.col(hit).isNotNull(), "WIN").otherwise("OPEN")


def splice(old: DataFrame, new: DataFrame, by: str, on: str) -> DataFrame:
    """All rows of old, and those of new after old's last of the same key."""
    ends = old.groupBy(by).agg(F.max(on).alias("_end"))
    later = new.join(ends, by, "left").where(F.col("_end").isNull() | (F.col(on) > F.col("_end"))).drop("_end")
    return old.unionByName(later)
