"""Joins beyond equality, keyed writes, ranks and reconciliations."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def without(rows: DataFrame, taken: DataFrame, *keys: str) -> DataFrame:
    """rows whose keys are not in taken."""
    return rows.join(taken.select(*keys).distinct(), list(keys), "left_anti")


def among(rows: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """rows whose keys are in known; each once."""
    return rows.join(known.select(*keys).distinct(), list(keys), "left_semi")


def reconciled(own: DataFrame, other: DataFrame, keys: list[str], values: list[str], tolerance: float) -> DataFrame:
    """Full outer comparison by key: only_own, only_other, changed (a value differs by more than the tolerance) or same."""
    a = own.select(*keys, F.struct(*values).alias("own"))
    b = other.select(*keys, F.struct(*values).alias("other"))
    moved = reduce(lambda x, y: x | y, (F.abs(F.col("own")[v] - F.col("other")[v]) > tolerance for v in values))
    state = F.when(F.col("other").isNull(), "only_own").when(F.col("own").isNull(), "only_other").when(moved, "changed").otherwise("same")
    return a.join(b, keys, "full").withColumn("state", state)


def on_fine_grid(fine: DataFrame, coarse: DataFrame, by: str, unit: str, values: list[str]) -> DataFrame:
    """fine with the values of the last complete coarse bar: an equality on the bar's number, shifted by one."""
    before = F.date_trunc(unit, "bar") - F.expr(f"interval 1 {unit}")
    return fine.withColumn("_block", before).join(coarse.select(by, F.col("bar").alias("_block"), *values), [by, "_block"], "left").drop("_block")


def bucketed(rows: DataFrame, table: DataFrame, value: Column, edges: list[float], on: list[str]) -> DataFrame:
    """rows with the columns of a lookup table by `on` and the bucket of a value: bucket k holds values from edge k on."""
    place = reduce(lambda out, k: out + (value >= edges[k]).cast("int"), range(len(edges)), F.lit(-1))
    return rows.withColumn("bucket", place).join(table, [*on, "bucket"], "left")


def nearest_levels(rows: DataFrame, levels: DataFrame, by: str, price: str) -> DataFrame:
    """rows with the nearest level at or under the price and the nearest one above it.

    Rows and levels of a key are put in one order of price; the last level
    before and the next one after are window values, so no pair is formed.
    """
    both = rows.withColumn("_level", F.lit(None).cast("double")).withColumn("_at", F.col(price)).unionByName(levels.select(by, F.col("level").alias("_level"), F.col("level").alias("_at")), allowMissingColumns=True)
    order = Window.partitionBy(by).orderBy("_at", F.col("_level").isNull())
    below = F.last("_level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    falling = Window.partitionBy(by).orderBy(F.desc("_at"), F.col("_level").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    above = F.last("_level", ignorenulls=True).over(falling)
    return both.withColumns({"below": below, "above": above}).where("_level is null").drop("_level", "_at")


def nearest_rows(queries: DataFrame, points: DataFrame, k: int, block: int = 16_384, part: int = 25_000) -> DataFrame:
    """The k nearest points (id, vector) of each query (id, vector) by Euclidean distance, ties by id; vectors are of one length, null ones are left out.

    A stated query set against all points, in blocks: queries are dealt to
    blocks of about `block` rows and points to parts of about `part` (16 at
    least), as many as the counts ask for, and each pair of a block and a part
    is a group of its own, so no task holds more than one of both. A task keeps k a query; only
    these lists are written and merged by query.

    All pairs are compared, by a product of matrices; its error has a bound,
    and the pairs within that bound of a query's k best so far get their
    distance from the differences, added in order. The lists are exact.
    """
    queries, points = queries.where("vector is not null"), points.where("vector is not null")
    asked, parts = max(1, -(-queries.count() // block)), max(16, -(-points.count() // part))
    own = queries.select(F.pmod(F.xxhash64("id"), F.lit(asked)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "id", "vector")
    some = points.select(F.explode(F.sequence(F.lit(0), F.lit(asked - 1))).alias("block"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id", "vector")

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return pc.list_flatten(column).to_numpy().reshape(len(column), -1).astype(float)

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if len(left) and len(right):
            ids, others = left.column("id").to_numpy(), right.column("id").to_numpy()
            q, p = matrix(left.column("vector")), matrix(right.column("vector"))
            found = [_nearest(ids[at : at + 1024], q[at : at + 1024], others, p, k) for at in range(0, len(ids), 1024)]
        query, near, apart = (np.concatenate([np.zeros(0, t), *(f[c] for f in found)]) for c, t in enumerate((np.int64, np.int64, float)))
        return pa.table({"query": pa.array(query), "near": pa.array(near), "distance": pa.array(apart)})

    found = own.groupBy("block", "part").cogroup(some.groupBy("block", "part")).applyInArrow(met, "query long, near long, distance double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "near"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _nearest(ids: np.ndarray, q: np.ndarray, others: np.ndarray, p: np.ndarray, k: int, width: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, near and distance of the k points nearest to each query, other ids only; NaN counts as farthest."""
    with np.errstate(all="ignore"):  # infinities and NaN are candidates
        size, columns = (q * q).sum(1), np.ascontiguousarray(q.T)
        bound = np.full(len(q), np.inf)  # the k-th smallest square so far, or more
        row, near, apart = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for at in range(0, len(p), width):  # so many points at once
            some, name = p[at : at + width], others[at : at + width]
            theirs = (some * some).sum(1)
            squares = q @ (-2.0 * some).T  # and less the query's own size, which does not change the order
            squares += theirs
            slack = 16 * (q.shape[1] + 8) * np.finfo(float).eps * (size + theirs.max())
            if at == 0 and len(some) > 64 * k:
                first = squares.copy()
                first[ids[:, None] == name[None]] = np.inf
                sets = first[:, : len(some) // 64 * 64].reshape(len(q), -1, 64).min(2)  # k of them hold k points
                bound = np.partition(sets, k - 1, axis=1)[:, k - 1] + size + slack if sets.shape[1] >= k else bound
            limit = bound + slack - size
            i, j = np.nonzero(~(squares > np.where(np.isnan(limit), np.inf, limit)[:, None]))
            other = ids[i] != name[j]
            i, j, points = i[other], j[other], np.ascontiguousarray(some.T)
            for start in range(0, len(i), 1 << 18):  # so many candidates at once
                a, b = i[start : start + (1 << 18)], j[start : start + (1 << 18)]
                total = np.zeros(len(a))
                for c, mine in enumerate(columns):
                    step = mine[a] - points[c][b]
                    total += step * step
                row, near, apart = np.concatenate([row, a]), np.concatenate([near, name[b]]), np.concatenate([apart, np.sqrt(total)])
                order = np.lexsort((near, apart, row))
                row, near, apart = row[order], near[order], apart[order]
                begin = np.searchsorted(row, np.arange(len(q)))
                place = np.arange(len(row)) - begin[row]
                full = row[place == k - 1]
                bound[full] = apart[place == k - 1] ** 2
                keep = place < k
                row, near, apart = row[keep], near[keep], apart[keep]
    return ids[row], near, apart


def clustered_levels(levels: DataFrame, by: str, tolerance: float) -> DataFrame:
    """Levels (level, weight) of a key in order of price: one joins the cluster before it if it lies within the tolerance of the level before; of a cluster the heaviest stays."""
    order = Window.partitionBy(by).orderBy("level")
    apart = F.coalesce(F.col("level") / F.lag("level").over(order) - 1 > tolerance, F.lit(True))
    marked = levels.withColumn("_new", apart.cast("int")).withColumn("cluster", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(by, "cluster").agg(F.max_by("level", F.struct("weight", F.negate("level"))).alias("level"), F.sum("weight").alias("weight"), F.count("*").alias("merged"))


# Keyed writes, as new tables: what a sink's foreachBatch would write.


def kept_final(old: DataFrame, new: DataFrame, keys: list[str], state: str, final: list[str]) -> DataFrame:
    """Upsert by key in which rows of old in a final state are never revised."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rank = F.when((F.col("_new") == 0) & F.col(state).isin(final), 2).otherwise(F.col("_new"))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*old.columns), rank).alias("r")).select("r.*")


def patched(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert by column: the new value where there is one, else the old."""
    values = [c for c in old.columns if c not in keys]
    a, b = (t.select(*keys, F.struct(*values).alias(n)) for t, n in ((old, "_a"), (new, "_b")))
    return a.join(b, keys, "full").select(*keys, *(F.coalesce(F.col("_b")[v], F.col("_a")[v]).alias(v) for v in values))


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert by row: rows of new, and those of old whose keys new does not have."""
    return new.select(*old.columns).unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def added(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or ignore: old, and rows of new whose keys old does not have."""
    return old.unionByName(new.select(*old.columns).join(old.select(*keys).distinct(), keys, "left_anti"))


def newest(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The n newest rows (a bounded log): Spark keeps n rows a task and merges them."""
    return rows.orderBy(*(F.desc(c) for c in order)).limit(n)


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order, as one aggregation that combines before its shuffle."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def mirrored(bars: DataFrame) -> DataFrame:
    """bars, and their mirror images (prices negated, high and low exchanged) under the side -1."""
    flipped = bars.select(*(F.negate({"high": "low", "low": "high"}.get(c, c)).alias(c) if c in ("open", "high", "low", "close") else F.col(c) for c in bars.columns))
    return bars.withColumn("side", F.lit(1)).unionByName(flipped.withColumn("side", F.lit(-1)))
