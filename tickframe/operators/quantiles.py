"""Exact order statistics of groups and of stretches of time, without all values of a group in one place.

`percentiles` narrows, for all groups and shares at once, the interval that
holds a rank by counts of even buckets (combined before the shuffle) until few
different values are left; `in_blocks` answers ranks within any stretch of a
key's time: buckets of values are told apart by counts for each block of time,
and the rank is then looked up inside its one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.sources.tables import cut

#: Even buckets of a round, and values that one task puts in order.
BUCKETS, FEW = 1024, 1 << 20
#: Groups up to so many are sent to all tasks; more of them are joined.
FEW_GROUPS = 10_000


def percentiles(rows: DataFrame, by: list[str], value: str, shares: list[float], few: int = FEW) -> DataFrame:
    """(by, share, value): exact percentiles, between two values by distance, as F.percentile gives them.

    Null, NaN and infinite values are passed over; a group without any other
    has no row. rows is read once for the bounds and once for each round, of
    which a group has about log(n / few) / log(BUCKETS) and one more.
    """
    v = F.col(f"`{value}`").cast("double")
    own = rows.select(*by, v.alias("v_")).where("v_ is not null and not isnan(v_) and abs(v_) < double('infinity')")
    whole = own.groupBy(*by).agg(F.count(F.lit(1)).alias("n_"), F.min("v_").alias("lo_"), F.max("v_").alias("hi_"))
    if not by:
        whole = whole.where("n_ > 0")
    at = F.col("share") * (F.col("n_") - 1)
    asked = whole.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("part_", at - F.floor(at))
    asked = cut(asked.withColumn("rank_", F.explode(F.array(F.floor(at), F.ceil(at)))).distinct())
    open_ = (F.col("n_") > few) & (F.col("lo_") < F.col("hi_"))
    while (groups := asked.where(open_).agg(F.count(F.lit(1))).first()[0]):
        inside = _inside(own, asked.where(open_), by, groups)
        place = (F.col("v_") / 2 - F.col("lo_") / 2) / (F.col("hi_") / 2 - F.col("lo_") / 2)
        digit = F.least(F.floor(place * BUCKETS), F.lit(BUCKETS - 1)).alias("digit_")
        counts = inside.groupBy(*by, "lo_", "hi_", digit).agg(F.count(F.lit(1)).alias("in_"), F.min("v_").alias("least_"), F.max("v_").alias("most_"))
        found = _at_rank(counts, asked.where(open_), by, "digit_")
        narrow = found.select(*by, F.col("in_").alias("n_"), F.col("least_").alias("lo_"), F.col("most_").alias("hi_"), "share", "part_", (F.col("rank_") - F.col("before_")).alias("rank_"))
        asked = cut(asked.where(~open_).unionByName(narrow))
    spread = asked.where("lo_ < hi_")
    counts = _inside(own, spread, by, asked.count()).groupBy(*by, "lo_", "hi_", "v_").agg(F.count(F.lit(1)).alias("in_"))
    found = _at_rank(counts, spread, by, "v_").select(*by, "share", "part_", F.col("v_").alias("lo_"))
    ends = asked.where("lo_ = hi_").select(*by, "share", "part_", "lo_").unionByName(found)
    low, high = F.min("lo_"), F.max("lo_")
    return ends.groupBy(*by, "share").agg((low + (high - low) * F.max("part_")).alias("value"))


def _same(a: str, b: str, by: list[str]) -> Column:
    return F.expr(" and ".join([f"{a}.`{k}` <=> {b}.`{k}`" for k in by] or ["true"]))


def _inside(own: DataFrame, asked: DataFrame, by: list[str], groups: int) -> DataFrame:
    """Values with the asked interval of their group that holds them; the intervals of a group are apart."""
    lists = asked.groupBy(*by).agg(F.collect_set(F.struct("lo_", "hi_")).alias("all_"))
    lists = F.broadcast(lists) if groups <= FEW_GROUPS else lists
    met = own.alias("a").join(lists.alias("b"), _same("a", "b", by)).select("a.*", F.expr("filter(all_, x -> x.lo_ <= v_ and v_ <= x.hi_)").alias("mine_"))
    return met.where("size(mine_) > 0").select(*by, "v_", F.col("mine_")[0]["lo_"].alias("lo_"), F.col("mine_")[0]["hi_"].alias("hi_"))


def _at_rank(counts: DataFrame, asked: DataFrame, by: list[str], order: str) -> DataFrame:
    """asked with the row of counts (in_ values each, in the given order) that its rank falls into, and how many come before_ it."""
    past = Window.partitionBy(*by, "lo_", "hi_").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("before_", F.sum("in_").over(past) - F.col("in_"))
    asked = asked.select(*by, "lo_", "hi_", "share", "part_", "rank_")
    same = _same("c", "a", [*by, "lo_", "hi_"]) & F.expr("a.rank_ >= c.before_ and a.rank_ < c.before_ + c.in_")
    kept = [c for c in counts.columns if c not in (*by, "lo_", "hi_")]
    return counts.alias("c").join(asked.alias("a"), same).select("a.*", *(f"c.{c}" for c in kept))


def percentile_columns(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by and one column for each named share."""
    found = percentiles(rows, by, value, list(shares.values()))
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("share") == s, F.col("value"))).alias(n) for n, s in shares.items()))


def ordinals(rows: DataFrame, name: str, unit: str = "day", order: str = "bar") -> DataFrame:
    """rows with their number (long, from 0) in the time of their symbol (by `order`, which rises with bar): numbered within slices of time, which start after the counts before them."""
    slice_ = F.date_trunc(unit, "bar")
    before = Window.partitionBy("symbol").orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
    starts = rows.groupBy("symbol", slice_.alias("slice_")).agg(F.count(F.lit(1)).alias("n_")).select("symbol", "slice_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    inner = F.row_number().over(Window.partitionBy("symbol", "slice_").orderBy(order)) - 1
    out = rows.withColumn("slice_", slice_).join(starts, ["symbol", "slice_"])
    return out.withColumn(name, (F.col("start_") + inner).cast("long")).drop("slice_", "start_")


def kth(block: np.ndarray, value: np.ndarray, weight: np.ndarray, first: np.ndarray, last: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each query the value of the given rank (from 0) among those of blocks first to last; a wavelet matrix over the values' ranks."""
    order = np.argsort(block, kind="stable")
    levels, code = np.unique(value[order], return_inverse=True)
    weight, block = weight[order], block[order]
    a, b = np.searchsorted(block, first, "left"), np.searchsorted(block, last, "right")
    rank, found = rank.copy(), np.zeros(len(rank), np.int64)
    for bit in range(max(1, len(levels) - 1).bit_length() - 1, -1, -1):
        zero = (code >> bit & 1) == 0
        number = np.concatenate([[0], np.cumsum(zero)])
        heavy = np.concatenate([[0], np.cumsum(np.where(zero, weight, 0))])
        low = heavy[b] - heavy[a]
        up = rank >= low
        found |= up.astype(np.int64) << bit
        rank = np.where(up, rank - low, rank)
        a, b = (np.where(up, number[-1] + x - number[x], number[x]) for x in (a, b))
        turn = np.argsort(~zero, kind="stable")
        code, weight = code[turn], weight[turn]
    return levels[found]


def in_blocks(values: DataFrame, queries: DataFrame, few: int = FEW) -> DataFrame:
    """queries (symbol, id, first, last, rank) with the value of that rank (from 0) among the values of blocks first to last.

    values are (symbol, block, v). Equal values of a block are one row with a
    count, so a value that many rows have is no burden. Where a symbol has
    more rows than `few`, its values fall into buckets: running counts by block
    tell each query's bucket, and a task orders the rows of one bucket.
    """
    values = cut(values.groupBy("symbol", "block", "v").agg(F.count(F.lit(1)).alias("w")))
    most = values.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = -(-most // few)
    queries = queries.select("symbol", "id", "first", "last", "rank")
    if parts > 1:
        steps = F.array(*(F.lit(k / parts) for k in range(1, parts)))
        bounds = values.groupBy("symbol").agg(F.percentile_approx("v", steps).alias("bounds_"))
        values = values.join(bounds, "symbol").withColumn("bucket", F.size(F.filter("bounds_", lambda x: x < F.col("v")))).drop("bounds_")
        queries = cut(_bucketed(values, queries, parts))
    else:
        values, queries = values.withColumn("bucket", F.lit(0)), queries.withColumns({"bucket": F.lit(0), "inner": F.col("rank")})
    none = F.lit(None).cast("long")
    some = values.select("symbol", "bucket", "block", "v", "w", *(none.alias(c) for c in ("id", "last", "rank", "inner")))
    asked = queries.select("symbol", "bucket", F.col("first").alias("block"), F.lit(None).cast("double").alias("v"), none.alias("w"), "id", "last", "rank", "inner")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        is_value = table.column("v").is_valid().to_numpy()
        block = table.column("block").to_numpy()
        v, w = (table.column(c).filter(pa.array(is_value)).to_numpy() for c in ("v", "w"))
        mine = table.filter(pa.array(~is_value))
        last, inner = (mine.column(c).to_numpy() for c in ("last", "inner"))
        found = kth(block[is_value], v, w, block[~is_value], last, inner) if len(inner) else np.zeros(0)
        return pa.table({"symbol": mine.column("symbol"), "id": mine.column("id"), "rank": mine.column("rank"), "value": pa.array(found, pa.float64())})

    kind = values.schema["symbol"].dataType.simpleString()
    return some.unionByName(asked).groupBy("symbol", "bucket").applyInArrow(run, f"symbol {kind}, id long, rank long, value double")


def _bucketed(values: DataFrame, queries: DataFrame, parts: int) -> DataFrame:
    """queries with the bucket that holds the rank, and the rank within it: from running counts of the buckets at both ends."""
    zero = F.array_repeat(F.lit(0).cast("long"), parts)
    counts = values.groupBy("symbol", "block").agg(F.array(*(F.coalesce(F.sum(F.when(F.col("bucket") == k, F.col("w"))), F.lit(0)) for k in range(parts))).alias("by_"))
    ends = queries.select("symbol", (F.col("first") - 1).alias("block"), "id", "rank", F.lit(0).alias("end_")).unionByName(queries.select("symbol", F.col("last").alias("block"), "id", "rank", F.lit(1).alias("end_")))
    none = F.lit(None).cast("long")
    rows = counts.select("symbol", "block", "by_", none.alias("id"), none.alias("rank"), F.lit(-1).alias("end_")).unionByName(ends.withColumn("by_", zero).select("symbol", "block", "by_", "id", "rank", "end_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, np.zeros(parts, np.int64)
        for batch in batches:
            names, by = batch.column("symbol").to_pylist(), batch.column("by_").flatten().to_numpy().reshape(-1, parts)
            out = np.zeros_like(by)
            for i, name in enumerate(names):
                if name != key:
                    key, total = name, np.zeros(parts, np.int64)
                total = total + by[i]
                out[i] = total
            at = pa.array(np.arange(len(out) + 1) * parts, pa.int32())
            sums = pa.ListArray.from_arrays(at, pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("symbol"), batch.column("id"), batch.column("rank"), batch.column("end_"), sums], ["symbol", "id", "rank", "end_", "by_"])

    kind = values.schema["symbol"].dataType.simpleString()
    summed = rows.repartition("symbol").sortWithinPartitions("symbol", "block", "end_").mapInArrow(run, f"symbol {kind}, id long, rank long, end_ int, by_ array<long>").where("id is not null")
    both = summed.groupBy("symbol", "id", "rank").agg(F.max(F.when(F.col("end_") == 1, F.col("by_"))).alias("hi_"), F.max(F.when(F.col("end_") == 0, F.col("by_"))).alias("lo_"))
    start = F.struct(F.lit(0).alias("bucket"), F.col("rank").alias("left"), F.lit(False).alias("done"))

    def step(s: Column, n: Column) -> Column:
        here = s["done"] | (s["left"] < n)
        return F.struct(F.when(here, s["bucket"]).otherwise(s["bucket"] + 1).alias("bucket"), F.when(here, s["left"]).otherwise(s["left"] - n).alias("left"), here.alias("done"))

    found = both.withColumn("s_", F.aggregate(F.zip_with("hi_", "lo_", lambda a, b: a - b), start, step))
    found = found.select("symbol", "id", "rank", F.col("s_.bucket").alias("bucket"), F.col("s_.left").alias("inner"))
    return queries.join(found, ["symbol", "id", "rank"])


def expanding_mask(rows: DataFrame, column: str, share: float = 0.1, least: int = 100, every: int = 200) -> DataFrame:
    """Rows with a known value, marked where it is in the top or bottom share of the values before it.

    The bounds `high` and `low` are the values at floor(m (1 - share)) and
    floor(m share) of the first m in order, for m = least, least + every, ...:
    a row uses the latest m that lies before it, and none before `least`.
    Columns of rows named high, low, top or bottom give way to these.
    """
    rows = rows.withColumn("v_", F.col(column).cast("double")).drop("high", "low", "top", "bottom")
    own = ordinals(rows.where("v_ is not null"), "i_")
    after = F.call_function("div", F.col("i_") - least, F.lit(every))
    own = cut(own.withColumn("k_", F.when(F.col("i_") >= least, after)))
    values = own.select("symbol", F.coalesce(F.col("k_") + 1, F.lit(0)).cast("long").alias("block"), F.col("v_").alias("v"))
    marks = own.groupBy("symbol").agg(F.max("k_").alias("top_")).where("top_ is not null")
    marks = marks.select("symbol", F.explode(F.sequence(F.lit(0).cast("long"), "top_")).alias("id")).withColumn("m_", F.col("id") * every + least)
    both = F.array(F.floor(F.col("m_") * (1 - share)), F.floor(F.col("m_") * share))
    asked = marks.select("symbol", "id", F.lit(0).cast("long").alias("first"), F.col("id").alias("last"), "m_", F.explode(both).alias("rank"))
    found = in_blocks(values, asked.drop("m_").distinct())
    bounds = found.join(asked.select("symbol", "id", "m_").distinct(), ["symbol", "id"]).groupBy("symbol", F.col("id").alias("k_"))
    is_high, is_low = F.col("rank") == F.floor(F.col("m_") * (1 - share)), F.col("rank") == F.floor(F.col("m_") * share)
    bounds = bounds.agg(F.max(F.when(is_high, F.col("value"))).alias("high"), F.max(F.when(is_low, F.col("value"))).alias("low"))
    v = F.col("v_")
    out = own.join(bounds, ["symbol", "k_"], "left")
    return out.withColumns({"top": F.coalesce(v >= F.col("high"), F.lit(False)), "bottom": F.coalesce(v <= F.col("low"), F.lit(False))}).drop("k_", "i_", "v_")


def trailing_quantile(rows: DataFrame, column: str, days: int, share: float) -> DataFrame:
    """rows with `cut`: the exact quantile of the values of the days before a row's own, the same for all rows of a day; null without any."""
    day = F.datediff(F.to_date("bar"), F.lit("1970-01-01").cast("date")).cast("long")
    own = rows.withColumn("day_", day).drop("cut")
    known = own.where(F.col(column).isNotNull())
    counts = known.groupBy("symbol", "day_").agg(F.count(F.lit(1)).alias("n_"))
    some = own.select("symbol", "day_").distinct().join(counts, ["symbol", "day_"], "left")
    past = Window.partitionBy("symbol").orderBy("day_").rangeBetween(-days, -1)  # a row a day
    at = F.lit(share) * (F.col("m_") - 1)
    asked = some.withColumn("m_", F.sum("n_").over(past)).where("m_ > 0").withColumn("part_", at - F.floor(at))
    asked = cut(asked.select("symbol", F.col("day_").alias("id"), (F.col("day_") - days).alias("first"), (F.col("day_") - 1).alias("last"), "part_", F.explode(F.array(F.floor(at), F.ceil(at))).alias("rank")).distinct())
    found = in_blocks(known.select("symbol", F.col("day_").alias("block"), F.col(column).cast("double").alias("v")), asked.drop("part_"))
    low, high = F.min("value"), F.max("value")
    cuts = found.join(asked, ["symbol", "id", "rank"]).groupBy("symbol", F.col("id").alias("day_")).agg((low + (high - low) * F.max("part_")).alias("cut"))
    return own.join(cuts, ["symbol", "day_"], "left").drop("day_")
