"""Substring dedup with an FM-index for each shard.

A window is W consecutive words of one document. Documents are cut where the
smallest hash of the K-word runs in a window changes: the windows between two
cuts share that run, so equal windows of any documents lie in pieces of one
key. Pieces whose key occurs in one document only are done. Of the others
each distinct piece is indexed once, with the smallest doc_id that holds it;
keys are dealt out to shards. A shard's FM-index is a wavelet matrix of
packed bits over the Burrows-Wheeler transform of its pieces. All pieces are
then streamed through it from their last word to the first: backward search
keeps the matching statistic, cut at W words, and the suffix interval of each
window; the smallest doc_id in the interval says whether an earlier document
has the window. Pieces of a key with more than HOT distinct ones (a passage in
many surroundings) are dealt over many shards, so that no shard grows with a
key; each shard's index gives its own smallest doc_id of a window, and the
least over the shards is the window's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.llm import text as T
from tickframe.llm.shared import cut, whole_groups

W = 50
K = 20
HOT = 2000
#: Pieces of a shard, about. Keys with more than HOT distinct pieces are dealt over several; results are the same.
SHARD = 6000


def pieces(words: T.Words, w: int = W, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows: key, hash of the content, first word and number of windows of each piece."""
    hashes = words.hashes()
    empty = np.zeros(0, np.int64)
    if len(hashes) < w:
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    at = np.arange(len(hashes) - k + 1)
    runs = T.span_hashes(hashes, at, at + k)
    low = np.uint64((1 << 24) - 1)
    least = (runs & ~low) | (at.astype(np.uint64) & low)  # ties: the first
    wide, have = w - k + 1, 1
    while have < wide:
        step = min(have, wide - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    start = np.arange(len(least))
    inside = words.row[start] == words.row[start + w - 1]
    start, least = start[inside], least[inside]
    place = start + ((least - start.astype(np.uint64)) & low).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1) | (words.row[start[1:]] != words.row[start[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(first, append=len(start))
    start = start[first]
    return runs[place[first]], T.span_hashes(hashes, start, start + count + w - 1), start, count


class Index:
    """FM-index of pieces of numbers, each with a value of which intervals give the minimum."""

    def __init__(self, numbers: np.ndarray, size: np.ndarray, value: np.ndarray, w: int = W):
        self.size, self.w = size, w
        _, symbol = np.unique(numbers, return_inverse=True)
        n, m = len(numbers) + len(size), len(size)
        self.end = np.cumsum(size + 1) - 1  # places of the separators
        text = np.zeros(n, np.int32)
        inside = np.ones(n, bool)
        inside[self.end] = False
        text[inside] = symbol + 1
        self.text = text
        owner = np.repeat(np.arange(m), size + 1)
        # Suffixes are sorted by doubling; separators are all different, so ranks are soon unique.
        rank = np.where(inside, text.astype(np.int64) + m, 0)
        rank[self.end] = np.arange(m)
        depth, at_half, half = 1, None, 1
        while half * 2 <= w:
            half *= 2
        while True:
            if depth == half:
                at_half = rank
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - depth)] = rank[depth:] + 1
            pair = rank * (n + m + int(symbol.max()) + 3) + ahead
            order = np.argsort(pair, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.diff(pair[order], prepend=pair[order[0]]) != 0)
            depth *= 2
            if depth > half and rank[order[-1]] == n - 1:
                break
        suffix = order
        # Rows of the sorted suffixes that agree in the first w words.
        rest = np.minimum(suffix + w - half, n - 1)
        a, b = at_half[suffix], at_half[rest]
        differs = np.ones(n + 1, bool)
        differs[1:-1] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.edge = np.flatnonzero(differs)
        self.block = (np.cumsum(differs[:-1]) - 1).astype(np.int32)
        self.least = np.minimum.reduceat(value[owner[suffix]], self.edge[:-1])  # of each interval of w words
        self._wavelet(text[suffix - 1])
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text))])  # counts of smaller symbols

    def _wavelet(self, row: np.ndarray) -> None:
        """Bits of each level, packed in words, with the ones before each word."""
        self.levels = []
        for level in range(int(row.max()).bit_length() - 1, -1, -1):
            bit = (row >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.levels.append((level, packed, ones, len(bit) - int(bit.sum())))
            row = np.concatenate([row[~bit], row[bit]])
        symbols = np.arange(int(self.text.max()) + 1)
        self.origin = np.zeros(len(symbols), np.int64)
        self.origin = self._down(symbols, np.zeros(len(symbols), np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, packed, ones, zeros in self.levels:
            word = at >> 6
            rank = ones[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> level & 1, zeros + rank, at - rank)
        return at

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals after one more symbol in front."""
        both = self._down(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self.before[symbol] - self.origin[symbol]
        return base + both[: len(symbol)], base + both[len(symbol) :]

    def windows(self) -> list[np.ndarray]:
        """For each piece, the least value of the pieces that hold each of its windows."""
        order = np.argsort(-self.size, kind="stable")
        size, end = self.size[order], self.end[order]
        low, high = np.zeros(len(order), np.int64), np.full(len(order), len(self.text), np.int64)
        first = np.concatenate([[0], np.cumsum(np.maximum(0, self.size - self.w + 1))])
        out = np.zeros(first[-1], np.int64)
        lanes = len(order)
        for step in range(1, int(size[0]) + 1):
            while lanes and size[lanes - 1] < step:
                lanes -= 1
            low, high = self.extend(self.text[end[:lanes] - step], low[:lanes], high[:lanes])
            if step >= self.w:  # longer matches are cut back to w words
                block = self.block[low]
                low, high = self.edge[block], self.edge[block + 1]
                out[first[order[:lanes]] + size[:lanes] - step] = self.least[block]
        return [out[first[i] : first[i + 1]] for i in range(len(order))]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in T.chunks(batches):
        words = T.words(part.column("text"))
        key, content, start, count = pieces(words)
        row = words.row[start]
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), part.column("doc_id").take(take), part.column("rid").take(take), pa.array((start - words.first[row]).astype(np.int32)), pa.array(count.astype(np.int32))],
            ["key", "content", "doc_id", "rid", "start", "count"],
        )


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word hashes of the pieces that each row of (doc_id, text, wanted) names."""
    for part in T.chunks(batches):
        words = T.words(part.column("text"))
        hashes = words.hashes()
        lists = part.column("wanted")
        row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
        wanted = pa.RecordBatch.from_struct_array(lists.flatten())
        start = words.first[row] + wanted.column("start").to_numpy()
        size = wanted.column("count").to_numpy().astype(np.int64) + W - 1
        flat = hashes[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]
        at = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [wanted.column("key"), wanted.column("content"), wanted.column("hot"), part.column("doc_id").take(pa.array(row)), pa.ListArray.from_arrays(at, pa.array(flat.view(np.int64)))],
            ["key", "content", "hot", "least", "words"],
        )


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, key, content, hot, least, words) sorted by shard in, the windows' minima within the shard out.

    Pieces of hot keys also get the hashes of their windows, by which shards are compared.
    """
    for part in whole_groups(batches, "shard"):
        shard = part.column("shard").to_numpy()
        edges = [*np.flatnonzero(np.diff(shard, prepend=shard[0] - 1)).tolist(), len(shard)]
        for a, b in zip(edges, edges[1:]):
            own = part.slice(a, b - a)
            lists = own.column("words")
            flat, size = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
            found = Index(flat, size, own.column("least").to_numpy()).windows()
            at = np.concatenate([[0], np.cumsum(size - W + 1)])
            row = np.flatnonzero(own.column("hot").to_numpy(zero_copy_only=False))
            count = np.zeros(len(size), np.int64)
            count[row] = size[row] - W + 1
            start = np.repeat((np.cumsum(size) - size)[row] - (np.cumsum(count[row]) - count[row]), count[row]) + np.arange(count.sum())
            windows = T.span_hashes(flat.view(np.uint64), start, start + W).view(np.int64)
            names = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(windows))
            minima = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([own.column("key"), own.column("content"), minima, names], ["key", "content", "minima", "windows"])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word ranges [low, high) that windows of smaller documents cover, for each piece of a document."""
    for batch in batches:
        lists = batch.column("minima")
        count = lists.value_lengths().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        hit = lists.flatten().to_numpy() < batch.column("doc_id").to_numpy()[row]
        row, place = row[hit], place[hit]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (place[1:] > place[:-1] + W)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(row)) - 1 if len(first) else first
        start = batch.column("start").to_numpy()[row[first]]
        yield pa.RecordBatch.from_arrays([batch.column("rid").take(pa.array(row[first])), pa.array((start + place[first]).astype(np.int32)), pa.array((start + place[last] + W).astype(np.int32))], ["rid", "low", "high"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in T.chunks(batches):
        words = T.words(part.column("text"))
        n = np.diff(words.first)
        ranges = part.column("ranges").to_pylist()
        gone, kept = [], []
        for i, own in enumerate(ranges):
            keep = np.ones(n[i], bool)
            for r in own or ():
                keep[r["low"] : r["high"]] = False
            at = np.flatnonzero(keep) + words.first[i]
            gone.append(int(n[i]) - len(at))
            data = words.data
            kept.append(b" ".join([data[a:b].tobytes() for a, b in zip(words.start[at].tolist(), words.end[at].tolist())]) if own else b" ".join(data[words.bounds[i] : words.bounds[i + 1]].tobytes().split()))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(gone, pa.int64()), part.column("ranges"), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "ranges", "kept"])


def _row_id() -> Column:
    return F.xxhash64("doc_id", "text")


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, ranges (removed word ranges, may overlap) and kept (text) of each row.

    Defined cases: a null text has no words; texts of fewer than W words lose
    none; rows of one doc_id are not earlier than one another, so repeated
    rows lose the same words; a row with a null doc_id loses nothing and is
    no other row's earlier document; an empty table gives an empty result. Of
    docs only doc_id and text are read, so other columns cannot clash; a text
    of any length is read whole.
    """
    rows = docs.select("doc_id", "text", _row_id().alias("rid"))
    every = rows.where("doc_id is not null").mapInArrow(_cut, "key long, content long, doc_id long, rid long, start int, count int")
    # Cut here, so that both sides of the join come from exchanges of its own and Spark can split a hot key.
    twice = cut(every.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key"))
    shared = cut(every.join(twice, "key"))
    shards = max(1, shared.count() // SHARD)

    distinct = cut(shared.groupBy("key", "content").agg(F.min(F.struct("doc_id", "rid", "start", "count")).alias("x")))
    hot = cut(distinct.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key", F.lit(True).alias("is_hot")))
    named = distinct.join(hot, "key", "left").withColumn("hot", F.coalesce("is_hot", F.lit(False)))
    wanted = named.select("x.rid", F.struct("key", "content", "x.start", "x.count", "hot").alias("w")).groupBy("rid").agg(F.collect_list("w").alias("wanted"))
    one = rows.join(wanted, "rid").dropDuplicates(["rid"])  # a row that is repeated is read once
    fetched = cut(one.select("doc_id", "text", "wanted").mapInArrow(_fetched, "key long, content long, hot boolean, least long, words array<long>"))

    deal = F.when(F.col("hot"), F.xxhash64("key", "content")).otherwise(F.xxhash64("key"))
    dealt = fetched.withColumn("shard", F.pmod(deal, F.lit(shards))).repartition("shard").sortWithinPartitions("shard")
    searched = cut(dealt.select("shard", "key", "content", "hot", "least", "words").mapInArrow(_searched, "key long, content long, minima array<long>, windows array<long>"))
    few = searched.where(F.size("windows") == 0).select("key", "content", "minima")
    single = searched.where(F.size("windows") > 0).select("key", "content", F.posexplode(F.arrays_zip("windows", "minima")).alias("place", "x")).select("key", "content", "place", "x.windows", "x.minima")
    least = single.groupBy("key", "windows").agg(F.min("minima").alias("low"))
    many = (
        single.select("key", "content", "place", "windows")
        .join(cut(least), ["key", "windows"])
        .groupBy("key", "content")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "low"))), lambda x: x["low"]).alias("minima"))
    )
    minima = few.unionByName(many)
    ranges = shared.join(minima, ["key", "content"]).select("rid", "doc_id", "start", "minima").mapInArrow(_ranges, "rid long, low int, high int")
    lists = ranges.groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("low", "high"))).alias("ranges"))
    done = rows.join(lists, "rid", "left").select("doc_id", "text", "ranges")
    return done.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, ranges array<struct<low:int,high:int>>, kept string")
