"""SimHash fingerprints and near-duplicate components by anchor points.

Fingerprints of 64 bits are compared as two halves. Of two fingerprints that
differ in at most THRESHOLD = 2 bits, one half differs in at most one bit.
Anchors are the words of the [31, 26] Hamming code over the lower 31 bits of
a half: a perfect covering code of radius 1, so each half has an anchor
within 1 and its partner lies within 1 + 1 = 2 of the same anchor. Each
fingerprint is therefore replicated to all anchors within 2 (16, or 1 for a
code word) of each half, and fingerprints are compared only under a common
anchor, by the bits in which all 64 differ. No pair is missed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm import text as T
from tickframe.llm.shared import components, cut, spanning, whole_groups

THRESHOLD = 2
WIDTH = 31
#: Members of one anchor that are compared in one task; more are dealt out as pairs of blocks.
BLOCK = 2048
#: Takes the bodies of some nodes; what it returns takes one index and others, and says which of these are alike.
Compare = Callable[[list[bytes]], Callable[[int, np.ndarray], np.ndarray]]


def fingerprints(texts: pa.Array, k: int = 3, seed: int = 42) -> np.ndarray:
    """Fingerprint of each text: lower-case A-Z, k-word shingles with repeats,
    XXH64 of each; a bit is set if more than half of the hashes have it."""
    w = T.words(texts)
    data = T.LOWER[w.data]
    out = np.zeros(len(texts), np.uint64)
    lengths = w.end - w.start
    at = np.concatenate([[0], np.cumsum(lengths + 1)])
    joined = np.full(int(at[-1]), 32, np.uint8)  # words joined by one space
    inside = np.repeat(w.start - at[:-1], lengths + 1) + np.arange(len(joined))
    letter = np.ones(len(joined), bool)
    letter[at[1:] - 1] = False
    joined[letter] = data[inside[letter]]
    counts = np.diff(w.first)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))  # shingles of each text
    row = np.repeat(np.arange(len(texts)), n)
    if not len(row):
        return out
    begin = np.concatenate([[0], np.cumsum(n)])[:-1]
    first = np.arange(len(row)) - np.repeat(begin, n) + w.first[row]
    last = np.minimum(first + k, w.first[row + 1])
    view, h = joined.tobytes(), xxhash.xxh64_intdigest
    hashed = np.fromiter((h(view[a:b], seed) for a, b in zip(at[first].tolist(), (at[last] - 1).tolist())), np.uint64, len(row))
    some = np.flatnonzero(n)
    starts = begin[some]
    for bit in range(64):
        ones = np.add.reduceat(((hashed >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), starts)
        out[some] |= (ones * 2 > n[some]).astype(np.uint64) << np.uint64(bit)
    return out


def with_fingerprints(docs: DataFrame, k: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep and the fingerprint as a long; null texts have no words."""
    fields = [f for f in docs.schema.fields if f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.chunks(batches):
            fp = fingerprints(part.column("text"), k)
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), pa.array(fp.view(np.int64))], [*(f.name for f in fields), "fp"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "fp long"])
    return docs.select(*(f.name for f in fields), "text").mapInArrow(run, schema)


def anchors_within(half: np.ndarray, bits: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Index and anchor for all code words within 2 of each half (see above).

    The syndrome of a word is the exclusive or of the places (1 .. bits) of
    its ones; a code word has syndrome 0. With bits + 1 a power of two, words
    of syndrome s > 0 have one anchor at distance 1 (flip s) and those at
    distance 2 flip i and i ^ s.
    """
    word = half & np.uint64((1 << bits) - 1)
    syndrome = np.zeros(len(word), np.int64)
    for place in range(1, bits + 1):
        syndrome ^= np.where((word >> np.uint64(place - 1)) & np.uint64(1), place, 0)
    flip = np.zeros(bits + 1, np.uint64)
    flip[1:] = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    index, anchor = [np.arange(len(word))], [word ^ flip[syndrome]]
    for i in range(1, bits + 1):
        j = syndrome ^ i
        at = np.flatnonzero((syndrome > 0) & (j > i))
        index.append(at)
        anchor.append(word[at] ^ flip[i] ^ flip[j[at]])
    return np.concatenate(index), np.concatenate(anchor)


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for side in range(2):
            index, anchor = anchors_within(fp >> np.uint64(32 * side))
            for a in range(0, len(index), 1 << 18):
                b = a + (1 << 18)
                yield pa.RecordBatch.from_arrays([pa.array((anchor[a:b] | np.uint64(side << WIDTH)).view(np.int64)), pa.array(fp[index[a:b]].view(np.int64))], ["anchor", "fp"])


def linked(fp: np.ndarray, group: np.ndarray, block: np.ndarray, cross: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of sorted rows, enough to span each group's components.

    Each row is met with the next one, the one after it and so on to the end
    of its group, for all groups at once (in a cross group only with rows of
    the other block); of the links found, a star for each component is kept.
    """
    a, b = [], []
    at = np.arange(len(fp))
    step = 1
    while True:
        at = at[at + step < len(fp)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        fit = at[~cross[at] | (block[at] != block[at + step])]
        hit = fit[np.bitwise_count(fp[fit] ^ fp[fit + step]) <= threshold]
        a.append(hit)
        b.append(hit + step)
        step += 1
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return spanning(np.concatenate(a), np.concatenate(b), len(fp))


def _compared(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Links of rows (anchor, fp, block, cross) that are sorted by anchor."""
    for part in whole_groups(batches, "anchor"):
        anchor, fp, block, cross = (part.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        member, root = linked(fp.view(np.uint64), anchor, block, cross, threshold)
        yield pa.RecordBatch.from_arrays([pa.array(fp[member]), pa.array(fp[root])], ["a", "b"])


def links(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b) between distinct fingerprints of column fp, enough to
    span the components of all pairs within the threshold."""
    distinct = cut(prints.select("fp").distinct())
    placed = distinct.mapInArrow(_anchored, "anchor long, fp long")
    return _together(placed, "fp").mapInArrow(lambda x: _compared(x, threshold), "a long, b long").distinct()


def _together(placed: DataFrame, node: str) -> DataFrame:
    """Rows of placed whose anchor holds others, brought together by anchor and sorted.

    A group of more than BLOCK rows is dealt out as pairs of blocks, each of
    which is compared as a group of its own: a pair of two blocks across only
    (cross), the pair of a block with itself within.
    """
    columns = [c for c in placed.columns if c != "anchor"]
    counts = placed.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    rows = placed.join(counts, "anchor")
    small = rows.where(F.col("n") <= BLOCK).select("anchor", *columns, F.lit(0).alias("own"), F.lit(False).alias("cross"))
    blocks = F.ceil(F.col("n") / F.lit(BLOCK // 2)).cast("int")
    own = F.pmod(F.xxhash64(node), F.col("blocks")).cast("int")
    pair = F.xxhash64("anchor", F.least("own", "other"), F.greatest("own", "other"))
    large = (
        rows.where(F.col("n") > BLOCK)
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(pair.alias("anchor"), *columns, "own", (F.col("own") != F.col("other")).alias("cross"))
    )
    return small.unionByName(large).repartition("anchor").sortWithinPartitions("anchor")


def near_duplicates(docs: DataFrame, k: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fp (long) and component_id, the smallest doc_id reachable.

    Defined cases: null and empty texts have fingerprint 0 and link like any
    other; rows of one text or one fingerprint are one node, so groups of
    copies cost one row; a null doc_id is never the smallest unless its
    component holds no other; an empty table gives an empty result.
    """
    prints = cut(with_fingerprints(docs, k))
    parts = components(links(prints, threshold))
    node = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    named = node.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = cut(named)
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    name = named.join(least, "component").select("fp", "component_id")
    return prints.join(name, "fp")


#: Minima in a key of a band.
MINIMA = 5
#: Bytes of text whose sets are held at once; workers keep what the largest slice took.
BYTES = 1 << 19


def bands(least: float, miss: float = 1e-5) -> int:
    """So many keys of MINIMA minima that sets of similarity `least` have none in common with the probability `miss`."""
    return math.ceil(math.log(miss) / math.log1p(-(least**MINIMA)))


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct k-word shingles of each text, sorted.

    Case and ASCII punctuation do not count. A text of fewer words is one shingle.
    """
    w = T.words(texts, T.SIGNS)
    hashes = w.hashes(lower=True)
    at, shingle = w.shingles(hashes, k)
    row = w.row[at]
    short = np.flatnonzero((np.diff(w.first) > 0) & (np.diff(w.first) < k))
    row = np.concatenate([row, short])
    shingle = np.concatenate([shingle, T.span_hashes(hashes, w.first[short], w.first[short + 1])])
    return _distinct(row, shingle)


def _distinct(row: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    return row[new], shingle[new]


def identities(row: np.ndarray, shingle: np.ndarray, n: int) -> np.ndarray:
    """128 bits of each of n sets, from its exact shingles; an empty set has 0."""
    out = np.zeros((n, 2), np.uint64)
    if len(row):
        begin = np.flatnonzero(np.diff(row, prepend=-1))
        for side, salt in enumerate((0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)):
            out[row[begin], side] = np.add.reduceat(T.mixed(shingle ^ np.uint64(salt)), begin)
    return out


@lru_cache(maxsize=1)
def _orders(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(41)
    return rng.integers(0, 2**32, n, dtype=np.uint32), rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def band_keys(row: np.ndarray, shingle: np.ndarray, n: int, number: int) -> list[np.ndarray]:
    """For each of n sets `number` keys, each of the minima of MINIMA random orders; an empty set has none.

    Two sets agree in a minimum with the probability of their Jaccard similarity.
    """
    low = (shingle >> np.uint64(16)).astype(np.uint32)
    turn, times = _orders(number * MINIMA)
    keys = np.zeros((n, number), np.uint64)
    begin = np.flatnonzero(np.diff(row, prepend=-1))
    some = row[begin]
    for i in range(number * MINIMA if len(row) else 0):
        least = np.minimum.reduceat((low ^ turn[i]) * times[i], begin)
        band = i // MINIMA
        keys[some, band] = T.mixed(keys[some, band] + least + np.uint64(i + 1))
    full = np.zeros(n, bool)
    full[some] = True
    return [x if y else x[:0] for x, y in zip(keys.view(np.int64), full)]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, as bodies are long."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def _alike(batches: Iterator[pa.RecordBatch], compare: Compare) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose bodies x and y are alike."""
    for batch in _slices(batches):
        keep = [bool(compare([x, y])(0, np.array([1]))[0]) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def joined(part: np.ndarray, block: np.ndarray, cross: bool, alike: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links between rows of different parts that are alike, enough to span what all such links connect.

    Each row is compared with all later ones that are not yet in its part and,
    in a cross group, are of the other block.
    """
    part, out = part.copy(), []
    for i in range(len(part) - 1):
        open_ = part[i + 1 :] != part[i]
        others = np.flatnonzero(open_ & (block[i + 1 :] != block[i]) if cross else open_) + i + 1
        if not len(others):
            continue
        near = others[alike(i, others)]
        met, first = np.unique(part[near], return_index=True)
        out += [(i, j) for j in near[first].tolist()]
        part[np.isin(part, met)] = part[i]
    return out


def _joined(batches: Iterator[pa.RecordBatch], compare: Compare) -> Iterator[pa.RecordBatch]:
    """Links of rows (anchor, node, component, body, own, cross) that are sorted by anchor."""
    for rows in whole_groups(_slices(batches), "anchor"):
        anchor, node, part, block, cross = (rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4, 5))
        bounds = np.flatnonzero(np.diff(anchor, prepend=anchor[0] - 1, append=anchor[-1] - 1))
        bounds[-1] = len(anchor)
        a, b = [], []
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            links = joined(part[low:high], block[low:high], bool(cross[low]), compare(rows.column(3).slice(low, high - low).to_pylist())) if high - low > 1 else []
            a += [low + i for i, _ in links]
            b += [low + j for _, j in links]
        yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])


def _links(placed: DataFrame, bodies: Callable[[DataFrame], DataFrame], compare: Compare, known: DataFrame) -> DataFrame:
    """The links known (a, b), and more that span the components of all alike pairs of nodes with a common anchor.

    placed has (anchor, node, part): nodes of one part are connected by known.
    Every node is first compared with the least one of each of its anchors.
    Anchors whose nodes are then still in several components have all pairs
    of different components compared; anchors of the same nodes count once.
    No pair is passed over unless it is connected already.
    """
    counts = placed.groupBy("anchor").agg(F.min("node").alias("least"), F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
    met = cut(placed.join(counts, "anchor").select("anchor", "node", "part", "least"))
    body = cut(bodies(met.select("node").distinct()))
    pairs = met.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"), "part").distinct()
    pairs = pairs.join(met.select(F.col("node").alias("b"), F.col("part").alias("other")).distinct(), "b").where("part <> other")
    both = pairs.join(body.select(F.col("node").alias("a"), F.col("body").alias("x")), "a").join(body.select(F.col("node").alias("b"), F.col("body").alias("y")), "b")
    stars = cut(both.select("a", "b", "x", "y").mapInArrow(lambda x: _alike(x, compare), "a long, b long").unionByName(known))
    part = met.select("anchor", "node").join(components(stars), "node", "left").select("anchor", "node", F.coalesce("component", "node").alias("component"))
    several = part.groupBy("anchor").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("s"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("t")
    )
    once = several.where("low <> high").groupBy("n", "s", "t").agg(F.min("anchor").alias("anchor"))
    open_ = cut(part.join(once.select("anchor"), "anchor", "left_semi"))
    rest = _together(open_.join(body, "node").select("anchor", "node", "component", "body"), "node")
    return stars.unionByName(rest.mapInArrow(lambda x: _joined(x, compare), "a long, b long"))


def by_sets(bodies: list[bytes], least: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """Exact Jaccard similarity of sets of 64-bit hashes of at least `least`."""
    sets = [np.frombuffer(x, np.uint64) for x in bodies]
    sizes = np.array([len(x) for x in sets])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    values, place = np.unique(np.concatenate(sets), return_inverse=True)

    def alike(i: int, others: np.ndarray) -> np.ndarray:
        own = np.zeros(len(values), np.int64)
        own[place[begin[i] : begin[i + 1]]] = 1
        first = int(others[0])
        both = np.add.reduceat(own[place[begin[first] :]], begin[first:-1] - begin[first])[others - first]
        return both >= least * (sizes[i] + sizes[others] - both)

    return alike


def representatives(docs: DataFrame, k: int = 5, least: float = 0.8, threshold: int | None = None) -> DataFrame:
    """The row of the smallest doc_id of each group of near duplicates.

    With a threshold (THRESHOLD at most), texts are linked if their SimHash
    fingerprints differ in at most so many bits, as in near_duplicates: the
    anchors miss no such pair. Without one and beyond it they are linked at a
    Jaccard similarity of `least` or more of their sets of k-word shingles (as
    64-bit hashes): fingerprints of texts that similar can lie apart. Keys of minima only propose these pairs
    (one of similarity `least` is missed with probability 1e-5); the exact
    sets decide. A group is all that links reach.
    Defined cases: null and empty texts and texts without a word are one
    group; of equal rows of one doc_id one stays; a row with a null doc_id
    stays only if its group has no other; texts are read whole; all columns of
    docs stay as they are, whatever their names.
    """
    number = bands(least)
    every = [F.col(f"`{c}`") for c in docs.columns]
    # Only these names are used below: the caller's columns lie in `row`, so none can clash.
    hashed = docs.select("doc_id", "text", F.xxhash64(*every).alias("row_hash"), F.struct(*every).alias("row"))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.chunks(batches, size=BYTES):
            n = part.num_rows
            fp = pa.array(np.zeros(n, np.int64) if threshold is None else fingerprints(part.column("text")).view(np.int64))
            row, shingle = shingle_sets(part.column("text"), k)
            known = identities(row, shingle, n).view(np.int64)
            keys = pa.array(band_keys(row, shingle, n, number), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_hash"), fp, pa.array(known[:, 0]), pa.array(known[:, 1]), keys], ["doc_id", "row_hash", "fp", "upper", "lower", "keys"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.chunks(batches, size=BYTES):
            row, shingle = shingle_sets(part.column("text"), k)
            bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([shingle[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())], ["node", "body"])

    rows = hashed.select("doc_id", "row_hash", "text").mapInArrow(prints, "doc_id long, row_hash long, fp long, upper long, lower long, keys array<long>")
    # Texts of one set can have several fingerprints, as signs and repeats count there: a row for each.
    low = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_hash")).alias("low")
    each = cut(rows.groupBy("upper", "lower", "fp").agg(F.first("keys").alias("keys"), low))
    nodes = each.groupBy("upper", "lower").agg(F.first("keys").alias("keys"), F.min("low").alias("low"))
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("node"), "upper", "lower", "keys", "low"))

    def bodies(wanted: DataFrame) -> DataFrame:
        at = nodes.join(wanted, "node", "left_semi").select("node", F.col("low.doc_id").alias("of_id"), F.col("low.row_hash").alias("of_hash"))
        own = hashed.join(at, (F.col("row_hash") == F.col("of_hash")) & F.col("doc_id").eqNullSafe(F.col("of_id")))
        return own.select("node", "text").dropDuplicates(["node"]).mapInArrow(sets, "node long, body binary")

    if threshold is None:
        near = nodes.where("false").select(F.col("node").alias("a"), F.col("node").alias("b"))
    else:
        near = each.join(components(links(each, threshold)).withColumnRenamed("node", "fp"), "fp", "left")
        near = near.join(nodes.select("upper", "lower", "node"), ["upper", "lower"]).select(F.coalesce("component", "fp").alias("group"), "node")
        near = near.join(near.groupBy("group").agg(F.min("node").alias("b")), "group").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
        near = cut(near)
    first = nodes.join(components(near), "node", "left").select("node", F.coalesce("component", "node").alias("part"), "keys")
    parts = components(_links(first.select(F.explode("keys").alias("anchor"), "node", "part"), bodies, lambda x: by_sets(x, least), near))
    named = nodes.join(parts, "node", "left").select(F.coalesce("component", "node").alias("component"), "low")
    kept = named.groupBy("component").agg(F.min("low").alias("low")).select(F.col("low.doc_id").alias("kept_id"), F.col("low.row_hash").alias("kept_hash"))
    found = hashed.join(kept, (F.col("row_hash") == F.col("kept_hash")) & F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    return found.dropDuplicates(["doc_id", "row_hash"]).select("row.*")
