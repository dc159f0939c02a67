"""Near-duplicate vectors by randomised-rotation binary codes.

Each vector is scaled to length 1 and turned by random rotations; the signs
are its code, and the inner product of the turned vector with the corner of
the cube that its code names is its correction factor. Both are computed once
and stored beside the vector: with them the inner product of a coded vector
and another one is estimated without bias, with a confidence bound that
shrinks with the code's length. Runs of code bits are the bands: vectors of
one label that agree in a band meet there. So many bands are used that a pair
at the threshold meets with probability 1 - MISS. Of the pairs that meet, the
distance of their codes (an estimate of the angle) with its bound rejects
nearly all that are far; those left are taken where they first meet, so each
pair once; the corrected estimate plus its bound rejects again, and only the
rest is recomputed in double precision. Only links that span components leave
the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm import text as T
from tickframe.llm.shared import components, cut, spanning, whole_groups

THRESHOLD = 0.93
MISS = 1e-5
#: Standard deviations of the estimate that its confidence bound takes.
SURE = 6.0
#: Rows of a band's bucket that are compared in one task; more are dealt out as pairs of blocks.
BLOCK = 1024


@lru_cache(maxsize=4)
def rotations(size: int, count: int) -> np.ndarray:
    """Random orthogonal matrices, side by side: size x (size * count)."""
    rng = np.random.default_rng([size, 20240501])
    return np.concatenate([np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(count)], axis=1)


def banding(rows: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Bits of a band and the number of bands for labels of so many rows."""
    bits = max(4, math.ceil(math.log2(max(2, rows))) + 1)
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-agree))


def turns(size: int, bits: int, bands: int) -> int:
    """Rotations of vectors of this size that give all bands their bits."""
    return -(-bits * bands // size)


def coded(vectors: np.ndarray, bits: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (packed bits) and correction factors of unit vectors."""
    size = vectors.shape[1]
    count = turns(size, bits, bands)
    turned = vectors @ rotations(size, count)
    factor = np.abs(turned).sum(1) / math.sqrt(size) / count  # mean over the rotations of <corner, vector>
    return np.packbits(turned >= 0, axis=1), factor


def decoded(codes: np.ndarray, factor: np.ndarray, size: int, count: int) -> np.ndarray:
    """For each code of `count` rotations the vector whose inner product with a unit vector is the estimate."""
    signs = np.unpackbits(codes, axis=1, count=count * size)
    corners = np.where(signs, 1.0, -1.0) @ rotations(size, count).T
    return corners / (math.sqrt(size) * count * factor)[:, None]


def band_keys(codes: np.ndarray, bits: int, bands: int) -> np.ndarray:
    signs = np.unpackbits(codes, axis=1, count=bits * bands)
    return signs.reshape(len(codes), bands, bits) @ (1 << np.arange(bits))


def far(threshold: float, length: int) -> float:
    """Bits of a code of this length beyond which two vectors at the threshold differ in next to no case."""
    share = math.acos(threshold) / math.pi
    return length * share + SURE * math.sqrt(length * share * (1 - share))


def estimate_bound(factor: np.ndarray, size: int, count: int) -> np.ndarray:
    """Half width of the confidence interval of the estimate from `count` codes of `size` bits."""
    return SURE * np.sqrt((1 - np.minimum(factor, 1) ** 2) / (factor**2 * max(1, size - 1) * count))


def _unit(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column("embedding")
    raw = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    norm = np.sqrt((raw * raw).sum(1))
    return raw, norm


def _coded(batches: Iterator[pa.RecordBatch], bits: int, bands: int) -> Iterator[pa.RecordBatch]:
    """Each vector with its code and correction factor."""
    for whole in batches:
        sizes = whole.column("embedding").value_lengths().to_numpy()
        for size in np.unique(sizes):
            batch = whole.filter(pa.array(sizes == size))
            raw, norm = _unit(batch)
            codes, factor = coded(raw / norm[:, None], bits, bands)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(factor)], [*batch.schema.names, "code", "factor"])


def _codes(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)


def _banded(batches: Iterator[pa.RecordBatch], bits: int, bands: int) -> Iterator[pa.RecordBatch]:
    """The buckets of each code, without the vector itself."""
    for whole in batches:
        sizes = whole.column("size").to_numpy()
        for size in np.unique(sizes):
            batch = whole.filter(pa.array(sizes == size))
            keys = band_keys(_codes(batch), bits, bands)
            label = batch.column("label").to_numpy().astype(np.int64).view(np.uint64)
            base = T.mixed(label * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size))
            for band in range(bands):
                bucket = T.mixed(T.mixed(base + np.uint64(band)) + keys[:, band].astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(np.full(len(label), band, np.int32)), batch.column("vec")], ["bucket", "band", "vec"])


def _met(batches: Iterator[pa.RecordBatch], bits: int, bands: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of rows that share a group: (vec, links, root), root null in the rows that count links."""
    for part in whole_groups(batches, "meets"):
        sizes = part.column("embedding").value_lengths().to_numpy()
        for size in np.unique(sizes):  # a bucket holds vectors of one size
            yield _links(part.filter(pa.array(sizes == size)), bits, bands, threshold)


def _links(part: pa.RecordBatch, bits: int, bands: int, threshold: float) -> pa.RecordBatch:
    group, band, block, cross = (part.column(n).to_numpy(zero_copy_only=False) for n in ("meets", "band", "block", "cross"))
    vec, copies, factor = part.column("vec"), part.column("copies").to_numpy(), part.column("factor").to_numpy()
    codes = _codes(part)
    raw, norm = _unit(part)
    size = raw.shape[1]
    count = turns(size, bits, bands)
    most, keys = far(threshold, count * size), band_keys(codes, bits, bands)
    ups, downs = [], []
    at, step = np.arange(len(group)), 1
    while True:
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        a, b = at, at + step
        fit = ~cross[a] | (block[a] != block[b])
        a, b = a[fit], b[fit]
        for low in range(0, len(a), 1 << 14):  # cheapest first: the codes' distance, then whether the pair meets here first
            x, y = a[low : low + (1 << 14)], b[low : low + (1 << 14)]
            near = np.bitwise_count(codes[x] ^ codes[y]).sum(1) <= most
            x, y = x[near], y[near]
            first = (keys[x] == keys[y]).argmax(1) == band[x]
            ups.append(x[first])
            downs.append(y[first])
        step += 1
    links = np.zeros(len(group), np.int64)
    x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (ups, downs))
    if len(x):
        some, own = np.unique(x, return_inverse=True)
        guess = decoded(codes[some], factor[some], size, count)
        bound = estimate_bound(factor, size, count)
        keep = np.zeros(len(x), bool)
        for low in range(0, len(x), 1 << 14):
            i = np.arange(low, min(len(x), low + (1 << 14)))
            estimate = np.einsum("ij,ij->i", guess[own[i]], raw[y[i]]) / norm[y[i]]
            i = i[estimate + bound[x[i]] >= threshold]
            cosine = np.einsum("ij,ij->i", raw[x[i]], raw[y[i]]) / (norm[x[i]] * norm[y[i]])
            keep[i[cosine >= threshold]] = True
        x, y = x[keep], y[keep]
        np.add.at(links, x, copies[y])
        np.add.at(links, y, copies[x])
    member, root = spanning(x, y, len(group))
    some = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays([vec.take(pa.array(some)), vec.take(pa.array(member))]), pa.array(np.concatenate([links[some], np.zeros(len(member), np.int64)])), pa.concat_arrays([pa.nulls(len(some), pa.int64()), vec.take(pa.array(root)).cast(pa.int64())])],
        ["vec", "links", "root"],
    )


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of (vec_id, embedding, label).

    Equal vectors of a label are compared once and counted as often as they
    come. Defined cases: a row whose vector is null, empty, zero or holds a
    null or non-finite component, or whose label is null, links with nothing;
    a label may be of any type that can be compared; vectors of different sizes never link; repeated rows are vectors of their
    own that link with each other; an empty table gives an empty result. Of
    vectors only those three columns are read, so others cannot clash.
    """
    rows = vectors.select("vec_id", "label", "embedding")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    valid = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & ~bad & (length > 0) & (length < float("inf")), F.lit(False))
    named = cut(rows.select("vec_id", "label", "embedding", valid.alias("valid"), F.xxhash64("embedding").alias("h1"), F.xxhash64("embedding", F.lit(1)).alias("h2")))
    same = named.where("valid").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("vec"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    same = cut(same)
    kind, part = (t.simpleString() for t in (vectors.schema["label"].dataType, vectors.schema["embedding"].dataType.elementType))
    most = same.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, bands = banding(most, threshold, miss)

    stored = cut(same.select("label", "vec", "copies", "embedding").mapInArrow(lambda x: _coded(x, bits, bands), f"label {kind}, vec long, copies long, embedding array<{part}>, code binary, factor double"))
    placed = stored.select("vec", F.xxhash64("label").alias("label"), F.size("embedding").alias("size"), "code").mapInArrow(lambda x: _banded(x, bits, bands), "bucket long, band int, vec long")
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = placed.join(sizes, "bucket").withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK // 2)).cast("int"))
    small = shared.where(F.col("n") <= BLOCK).select(F.col("bucket").alias("meets"), "band", "vec", F.lit(0).alias("block"), F.lit(False).alias("cross"))
    large = shared.where(F.col("n") > BLOCK).withColumn("block", F.pmod(F.xxhash64("vec"), F.col("blocks")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("meets"), "band", "vec", "block", (F.col("block") != F.col("other")).alias("cross")
    )
    # A pair of two blocks compares across only; the pair of a block with itself compares within.
    # Vectors join those rows alone that meet another one.
    met = small.unionByName(large).join(stored.select("vec", "copies", "embedding", "code", "factor"), "vec")
    found = cut(met.repartition("meets").sortWithinPartitions("meets").mapInArrow(lambda x: _met(x, bits, bands, threshold), "vec long, links long, root long"))
    links = found.groupBy("vec").agg(F.sum("links").alias("links"))
    parts = components(found.where("root is not null").select(F.col("vec").alias("a"), F.col("root").alias("b")))
    owner = (
        same.select("label", "h1", "h2", "vec", "copies")
        .join(links, "vec", "left")
        .join(parts.withColumnRenamed("node", "vec"), "vec", "left")
        .select(F.col("label").alias("l"), F.col("h1").alias("a1"), F.col("h2").alias("a2"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec").alias("component_id"))
    )
    every = named.select("vec_id", "label", "h1", "h2", "valid")
    joined = every.join(owner, F.col("valid") & (F.col("label") == F.col("l")) & (F.col("h1") == F.col("a1")) & (F.col("h2") == F.col("a2")), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
