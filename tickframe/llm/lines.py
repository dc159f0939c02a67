"""Line dedup by pairwise alignment of overlapping documents.

Lines are compared without white space at their ends. Two documents overlap
if they share a seed: the k-th copy of a line, two neighbouring lines, or all lines.
For each seed every document is paired with the first one (smallest doc_id)
that holds it, so that pairs grow with the documents and not with the square
of a group, and no shared seed is passed over: a document that has a line m
times meets the first one with it at least k times, for each k up to m. A pair is aligned by patience diff; where a
stretch has no line that is unique on both sides, the k-th of equal lines is
matched with the k-th. What is left of both is aligned again (PASSES times;
single lines that are still common are then matched one by one), so that
passages in another order are found as well. What the later document has in
common blocks is deleted from it. The earlier
document is read as it was given, and the first holder of a line never loses
it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm.shared import bare, cut
from tickframe.llm.text import mixed


#: Alignments of a pair, one after the other, before what is left in common is matched line by line.
PASSES = 8


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of indices of a and b that patience diff puts in common blocks: equal lines, in order on both sides."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        chain = _chain(_anchors(a, a0, a1, b, b0, b1))
        high = (a1, b1)
        for x, y in reversed(chain):
            out.append((x, y))
            todo.append((x + 1, high[0], y + 1, high[1]))
            high = (x, y)
        if chain:
            todo.append((a0, high[0], b0, high[1]))
    return out


def _anchors(a: list[int], a0: int, a1: int, b: list[int], b0: int, b1: int) -> list[tuple[int, int]]:
    """Lines that are unique on both sides, in the order of a; if there is none, the k-th of equal lines on both."""
    places: dict[int, tuple[list[int], list[int]]] = {}
    for i in range(a0, a1):
        places.setdefault(a[i], ([], []))[0].append(i)
    for i in range(b0, b1):
        if found := places.get(b[i]):
            found[1].append(i)
    unique = [(x[0], y[0]) for x, y in places.values() if len(x) == len(y) == 1]
    return unique or sorted(pair for x, y in places.values() for pair in zip(x, y))


def _chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that rises on both sides."""
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, (_, y) in enumerate(pairs):
        at = bisect_left(tops, y)
        before.append(ends[at - 1] if at else -1)
        tops[at : at + 1], ends[at : at + 1] = [y], [k]
    out, k = [], (ends[-1] if ends else -1)
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def common(a: list[int], b: list[int]) -> list[int]:
    """Indices of a in blocks common with b, when what an alignment leaves of both is aligned again; blank lines (0) do not count."""
    own, other = list(range(len(a))), list(range(len(b)))
    out: list[int] = []
    for _ in range(PASSES):
        pairs = aligned([a[i] for i in own], [b[i] for i in other])
        gone = {own[x] for x, _ in pairs if a[own[x]]}
        if not pairs:
            return out
        out += gone
        used = {other[y] for _, y in pairs}
        other = [i for i in other if i not in used and b[i]]
        seen = {b[i] for i in other}
        own = [i for i in own if i not in gone and a[i] in seen]
        if not own:
            return out
    left = Counter(b[i] for i in other)
    for i in own:
        if left[a[i]] > 0:
            left[a[i]] -= 1
            out.append(i)
    return out


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dropped = []
        for own, other in zip(batch.column("own"), batch.column("other")):
            a = own.values.to_numpy().tolist()
            dropped.append(common(a, other.values.to_numpy().tolist()))
        lists = pa.array(dropped, pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("d_id"), batch.column("d_hash"), lists], ["d_id", "d_hash", "dropped"])


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """d_id and d_hash of each document with a hash of each of its lines and the number of its copies before it."""
    for batch in batches:
        lists = batch.column("solid")
        line = lists.flatten().to_numpy().view(np.uint64)
        size = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((line, row))  # stable: copies stay in order
        new = np.ones(len(order), bool)
        new[1:] = (line[order[1:]] != line[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
        first = np.flatnonzero(new)
        copy = np.empty(len(order), np.uint64)
        copy[order] = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
        seeds = mixed(line + copy * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        at = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(at, pa.array(seeds))], [*batch.schema.names, "copies"])


#: White space at the ends of lines that does not count.
WHITE = " \t\r\x0b\x0c"


def _with_lines(docs: DataFrame) -> DataFrame:
    """Row identity and the hash of each line; a blank line has 0."""
    trimmed = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(WHITE)))
    hashes = F.transform(trimmed, lambda x: F.when(x == "", F.lit(0).cast("long")).otherwise(F.xxhash64(x)))
    return docs.select(F.col("doc_id").alias("d_id"), F.xxhash64("text").alias("d_hash"), hashes.alias("lines"))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(d_id, d_hash, dropped): for each document that loses any, the places of its lines that go."""
    rows = cut(_with_lines(docs.where("doc_id is not null")).distinct())
    solid = F.filter("lines", lambda x: x != 0)
    pairs = F.when(
        F.size("solid") > 1,
        F.transform(F.arrays_zip(F.slice("solid", 1, F.size("solid") - 1).alias("x"), F.slice("solid", 2, F.size("solid") - 1).alias("y")), lambda p: F.xxhash64(p["x"], p["y"], F.lit(2))),
    ).otherwise(F.array().cast("array<bigint>"))
    keys = F.concat(
        "copies",
        F.array_distinct(pairs),
        F.array(F.xxhash64("solid", F.lit(3))),
    )
    counted = rows.select("d_id", "d_hash", solid.alias("solid")).where("size(solid) > 0").mapInArrow(_copies, "d_id long, d_hash long, solid array<long>, copies array<long>")
    seeds = counted.select("d_id", "d_hash", F.explode(keys).alias("seed"))
    first = (
        seeds.groupBy("seed")
        .agg(F.min(F.struct("d_id", "d_hash")).alias("p"), F.count("*").alias("n"))
        .where("n > 1")
        .select("seed", F.col("p.d_id").alias("p_id"), F.col("p.d_hash").alias("p_hash"))
    )
    met = seeds.join(first, "seed").where("d_id <> p_id or d_hash <> p_hash").select("d_id", "d_hash", "p_id", "p_hash").distinct()
    other = rows.select(F.col("d_id").alias("p_id"), F.col("d_hash").alias("p_hash"), F.col("lines").alias("other"))
    both = met.join(rows.withColumnRenamed("lines", "own"), ["d_id", "d_hash"]).join(other, ["p_id", "p_hash"])
    found = both.select("d_id", "d_hash", "own", "other").mapInArrow(_aligned, "d_id long, d_hash long, dropped array<int>")
    return found.groupBy("d_id", "d_hash").agg(F.array_distinct(F.flatten(F.collect_list("dropped"))).alias("dropped")).where("size(dropped) > 0")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with `text` without the deleted lines, `n_lines` and `n_removed` (long).

    Lines are what line ends (0x0A) part; blank lines (of nothing but WHITE)
    are never deleted and no seed. Defined cases: a null text stays null and
    has no lines; rows of one doc_id and one text lose the same lines; of two
    texts of one doc_id the one of the smaller hash is the earlier; a row with
    a null doc_id is neither partner nor changed. Other columns stay, but one
    named n_lines or n_removed (in any case of letters) gives way to the
    output. A text is split once and its rest joined once, whatever its length.
    """
    docs = bare(docs, "n_lines", "n_removed")
    gone = dropped_lines(docs)
    own = docs.select(F.col("doc_id").alias("d_id"), F.xxhash64("text").alias("d_hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = own.join(gone, ["d_id", "d_hash"], "left")
    lines = F.split("row.text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped"))
    # The outer transform binds the split text, so that it is not split again for each line.
    rest = F.transform(F.array(F.struct(lines.alias("lines"), kept.alias("kept"))), lambda x: F.array_join(F.transform(x["kept"], lambda i: F.get(x["lines"], i)), "\n"))
    text = F.when(F.col("dropped").isNull(), F.col("row.text")).otherwise(F.get(rest, F.lit(0)))
    n_lines = F.coalesce(F.when(F.col("row.text").isNotNull(), F.size(lines)), F.lit(0)).cast("long")
    n_removed = F.coalesce(F.size("dropped"), F.lit(0)).cast("long")
    columns = [text.alias(c) if c.lower() == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    return rows.select(*columns, n_lines.alias("n_lines"), F.greatest(n_removed, F.lit(0).cast("long")).alias("n_removed"))
