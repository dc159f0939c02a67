"""Benchmark decontamination by greedy string tiling.

A text and a benchmark item that share a seed (K neighbouring words; case and
ASCII punctuation do not count) are tiled: the longest match of words not
covered yet becomes a tile, again and again, down to tiles of K words.
Matches are found by running Karp-Rabin hashes of windows, whose length
starts high, doubles when a longer match shows and is halved down to K. The
share of the item's words under tiles is its coverage in the text, however
the passages are ordered; from COVERAGE on the text holds the item.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.llm import text as T
from tickframe.llm.shared import bare, cut, fields_of

K = 5
COVERAGE = 0.5
#: Bytes of benchmark text that are sent to every task, at most; a larger benchmark is joined by its seeds.
BROADCAST_BYTES = 8 << 20
FOUND = "array<struct<item_id:bigint,n_tiles:int,matched_words:int,item_words:int,coverage:double>>"


def tiles(text: np.ndarray, item: np.ndarray, k: int = K, start: int = 20) -> list[tuple[int, int, int]]:
    """Tiles (text start, item start, length) of two arrays of word hashes: always the longest match of free words, of these the first."""
    free_text, free_item = np.ones(len(text), bool), np.ones(len(item), bool)
    out: list[tuple[int, int, int]] = []
    length = max(k, min(start, len(text), len(item)))
    while True:
        found = _matches(text, item, free_text, free_item, length)
        if found and found[0][0] > 2 * length:
            length = found[0][0]
            continue
        heapq.heapify(found := [(-size, a, b) for size, a, b in found])
        while found:
            size, a, b = heapq.heappop(found)
            free = free_text[a : a - size] & free_item[b : b - size]
            if free.all():
                free_text[a : a - size] = free_item[b : b - size] = False
                out.append((a, b, -size))
                continue
            edge = np.flatnonzero(np.diff(free.astype(np.int8), prepend=0, append=0))
            for low, high in zip(edge[::2].tolist(), edge[1::2].tolist()):  # what a tile has left of the match
                if high - low >= length:
                    heapq.heappush(found, (low - high, a + low, b + low))
        if length == k:
            return out
        length = max(k, length // 2)


def _matches(text: np.ndarray, item: np.ndarray, free_text: np.ndarray, free_item: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Maximal matches of free words, of the length at least: (size, text start, item start), longest first."""
    windows = []
    for values, free in ((text, free_text), (item, free_item)):
        at = np.arange(max(0, len(values) - length + 1))
        blocked = np.concatenate([[0], np.cumsum(~free)])
        at = at[blocked[at + length] == blocked[at]]
        windows.append((at, T.span_hashes(values, at, at + length)))
    where = defaultdict(list)
    for b, h in zip(*(x.tolist() for x in windows[1])):
        where[h].append(b)
    out = set()
    for a, h in zip(*(x.tolist() for x in windows[0])):
        for b in where.get(h, ()):
            if a and b and free_text[a - 1] and free_item[b - 1] and text[a - 1] == item[b - 1]:
                continue  # part of a match that starts earlier
            size = 0
            while a + size < len(text) and b + size < len(item) and free_text[a + size] and free_item[b + size] and text[a + size] == item[b + size]:
                size += 1
            if size >= length:
                out.add((size, a, b))
    return sorted(out, reverse=True)


class Items:
    """Benchmark items with their seeds sorted; items of fewer than k words have none and are never found."""

    def __init__(self, ids: list[int], texts: list[str], k: int = K):
        w = T.words(pa.array(texts, pa.string()), T.SIGNS)
        self.k, self.ids, self.first, self.hashes = k, ids, w.first, w.hashes(lower=True)
        at, seed = w.shingles(self.hashes, k)
        order = np.argsort(seed, kind="stable")
        self.seed, self.item = seed[order], w.row[at][order]
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(seed >> np.uint64(42)).astype(np.int64)] = True

    def found(self, texts: pa.Array) -> list[list[tuple[int, int, int, int, float]]]:
        """For each text, (item_id, tiles, matched words, item words, coverage) of all items that share a seed."""
        out: list[list] = [[] for _ in range(len(texts))]
        w = T.words(texts, T.SIGNS)
        hashes = w.hashes(lower=True)
        at, seed = w.shingles(hashes, self.k)
        some = np.flatnonzero(self.filter[(seed >> np.uint64(42)).astype(np.int64)])
        low = np.searchsorted(self.seed, seed[some])
        high = np.searchsorted(self.seed, seed[some], "right")
        hit = high > low
        at, low, high = at[some[hit]], low[hit], high[hit]
        pairs = defaultdict(list)
        for a, row, i, j in zip(at.tolist(), w.row[at].tolist(), low.tolist(), high.tolist()):
            for item in set(self.item[i:j].tolist()):
                pairs[row, item].append(a)
        for (row, item), starts in pairs.items():
            # Only words under a seed can be in a tile; others leave a gap that matches nothing.
            covered = np.unique(np.add.outer(np.array(starts), np.arange(self.k)))
            gap = np.flatnonzero(np.diff(covered) > 1) + 1
            text = np.insert(hashes[covered], gap, np.uint64(0))
            own = self.hashes[self.first[item] : self.first[item + 1]]
            laid = tiles(text, own, self.k)
            size = sum(t[2] for t in laid)
            out[row].append((int(self.ids[item]), len(laid), size, len(own), size / len(own)))
        return out


def _tiled(docs: DataFrame, items: DataFrame, k: int, coverage: float, name: str) -> DataFrame:
    rows = items.select("item_id", "text").where("item_id is not null and text is not null").orderBy("item_id", "text").collect()  # within BROADCAST_BYTES
    shared = docs.sparkSession.sparkContext.broadcast(([r.item_id for r in rows], [r.text for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Items(*shared.value, k)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_tiles", pa.int32()), ("matched_words", pa.int32()), ("item_words", pa.int32()), ("coverage", pa.float64())]))
        names = [kind.value_type.field(i).name for i in range(5)]
        for part in T.chunks(batches):
            found = [[dict(zip(names, x)) for x in sorted(own) if x[4] >= coverage] for own in known.found(part.column("text"))]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], [*part.schema.names, name])

    return docs.mapInArrow(run, f"{fields_of(docs)}, `{name}` {FOUND}")


def _seeds(rows: DataFrame, k: int) -> DataFrame:
    """The distinct seeds of each row of (key, text), and the number of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.chunks(batches):
            w = T.words(part.column("text"), T.SIGNS)
            at, seed = w.shingles(w.hashes(lower=True), k)
            pair = np.unique(np.stack([w.row[at].astype(np.uint64), seed], axis=1), axis=0) if len(at) else np.zeros((0, 2), np.uint64)
            row = pair[:, 0].astype(np.int64)
            n = np.diff(w.first)[row].astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(row)), pa.array(pair[:, 1].copy().view(np.int64)), pa.array(n)], ["key", "seed", "n"])

    return rows.select("key", "text").mapInArrow(run, "key long, seed long, n int")


def _rare(seeds: DataFrame, known: DataFrame, k: int, coverage: float) -> DataFrame:
    """(seed, item_id) of the rarest seeds of each item: as many as a text with the coverage cannot miss all of.

    Tiles are k words at least, so tiles over `coverage` of n words hold at
    least ceil(coverage * n / k) seed places and as many different seeds as
    the item's repeats of a seed allow. Of an item's D different seeds on
    P = n - k + 1 places at least that many less P - D are in the text: one
    of the D - that + 1 rarest is among them.
    """
    often = seeds.groupBy("seed").agg(F.count("*").alias("texts"))
    own = known.join(often, "seed")  # a seed that no text has finds nothing, so it may be left out as the rarest
    number = known.groupBy(F.col("key").alias("item")).agg(F.count("*").alias("d"))
    ranked = own.join(number, own["key"] == number["item"]).withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("texts", "seed")))
    places = F.col("n") - (k - 1)
    need = F.greatest(F.lit(1), F.ceil(F.lit(coverage) * F.col("n") / k - 1e-9) - (places - F.col("d")))
    missing = F.col("d") - F.count("*").over(Window.partitionBy("key"))
    return ranked.withColumn("missing", missing).where(F.col("rank") + F.col("missing") <= F.col("d") - need + 1).select("seed", F.col("key").alias("item_id"))


def _joined(docs: DataFrame, items: DataFrame, k: int, coverage: float, name: str) -> DataFrame:
    """The same for a benchmark of any size: pairs that share a rare seed come from a join.

    A seed common to many texts proposes pairs only where an item has too few
    rarer ones; texts are joined once, with the list of their candidates.
    """
    keyed = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), F.xxhash64(F.coalesce("text", F.lit("")), F.lit(1)).alias("key2"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    texts = cut(keyed.where("row.text is not null").groupBy("key", "key2").agg(F.min("row.text").alias("text")).withColumn("key", F.xxhash64("key", "key2")))
    known = cut(items.select(F.col("item_id").alias("of"), F.col("text").alias("item")).where("of is not null and item is not null").distinct().select(F.xxhash64("of", "item").alias("key"), "of", "item"))
    seeds = _seeds(texts, k)
    pairs = seeds.select("key", "seed").join(cut(_rare(seeds, _seeds(known.select("key", F.col("item").alias("text")), k), k, coverage)), "seed").select("key", "item_id").distinct()
    named = pairs.join(known.select(F.col("key").alias("item_id"), "of", "item"), "item_id")
    both = named.groupBy("key").agg(F.collect_set(F.struct("of", "item")).alias("items")).join(texts, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                for x in Items([r["of"] for r in row["items"]], [r["item"] for r in row["items"]], k).found(pa.array([row["text"]], pa.string()))[0]:
                    if x[4] >= coverage:
                        out.append((row["key"], *x))
            columns = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["key", "item_id", "n_tiles", "matched_words", "item_words", "coverage"])

    found = both.select("key", "items", "text").mapInArrow(run, "key long, item_id long, n_tiles int, matched_words int, item_words int, coverage double")
    lists = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("item_id", "n_tiles", "matched_words", "item_words", "coverage"))).alias("list"))
    rows = keyed.withColumn("key", F.xxhash64("key", "key2")).join(lists, "key", "left")
    return rows.select(*(F.col(f"row.`{c}`") for c in docs.columns), F.coalesce("list", F.array().cast(FOUND)).alias(name))


def tiled(docs: DataFrame, items: DataFrame, k: int = K, coverage: float = COVERAGE, name: str = "found") -> DataFrame:
    """docs with the list of benchmark items that each whole text holds.

    A benchmark of up to BROADCAST_BYTES (checked) goes to every task and docs
    are not shuffled; a larger one is joined by seeds, with the same result.
    Null and empty texts hold nothing; items that are null or shorter than k
    words are never found; an empty benchmark leaves every list empty. Of
    matches of one length the first in the text, then in the item, is marked
    first; repeated rows have the same list; texts are read whole. Other
    columns stay, but one named as the output (in any case of letters) gives
    way to it.
    """
    docs = bare(docs, name)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return (_tiled if size <= BROADCAST_BYTES else _joined)(docs, items, k, coverage, name)
