"""Packing of documents into sequences by best-two-fit, exact on the whole corpus.

Every document's ids, with an end id, are cut into pieces of at most `size`
ids. Best-two-fit fills one bin after the other: the largest piece that still
fits goes in until none does; if the bin holds more than one piece, its
smallest is then replaced by the two unpacked pieces that fill the gap, which
its leaving expands, best, where they fill it better than it did.

What a bin takes depends on the lengths that are left and on nothing else.
So the bins are planned on the counts of lengths, `size` numbers whatever the
corpus: bins that are filled alike one after the other are one run of the
plan with a multiplicity, which gives exactly the bins that filling one at a
time gives. A run ends when some length is left less often than a bin takes
it, which can happen size / length times at most for each, so there are at
most size * (1 + ln size) runs. Pieces are numbered in the order of their length
(one range shuffle of narrow rows); the plan maps a number to its sequence
and place by binary search.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm import bpe
from tickframe.llm import text as T
from tickframe.llm.sharding import numbered
from tickframe.llm.shared import bare, cut, fields_of, fresh

SIZE = 2048
END = 0
#: Ids that a task holds before it hands pieces on, and characters that are encoded at once.
IDS, BLOCK = 1 << 20, 2 << 20


def parted(runs: Iterable[tuple[int, np.ndarray]], size: int, end: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, piece, ids) of documents whose ids come in order, in one or more runs (row, ids) each."""
    none, tail = np.zeros(0, np.int32), np.array([end], np.int32)
    row, piece, held = -1, 0, none
    for now, ids in chain(runs, [(-1, none)]):
        if now != row:
            if row >= 0:
                yield row, piece, np.concatenate([held, tail])
            row, piece, held = now, 0, none
        held = np.concatenate([held, ids]) if len(held) else ids
        for at in range(0, len(held) - size + 1, size):
            yield row, piece, held[at : at + size]
            piece += 1
        held = held[len(held) // size * size :]


def pieces(docs: DataFrame, size: int = SIZE, path: str | None = None, end: int = END, with_ids: bool = True) -> DataFrame:
    """For each piece the document's columns but `text`, and piece (int, from 0), start (ids before it), length, ids (unless left out) and ids_crc32.

    path is a tokenizer file that executors can read, None the word-level file
    of the installed `public_tokenizers` package. A null or empty text has one
    piece, the end id alone; of a long text no more than a block and a piece
    is held. ids_crc32 is that of the ids as little-endian unsigned 32-bit
    numbers. Columns named as an output (in any case of letters) give way to it.
    """
    docs = bare(docs, "piece", "start", "length", "ids", "ids_crc32")
    kept = bare(docs, "text")
    names = kept.columns
    outputs = ["piece", "start", "length", *["ids"] * with_ids, "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = path
        if where is None:
            import public_tokenizers

            where = public_tokenizers.path("word_bpe_49k.json")
        codec = bpe.codec(where)

        def encoded(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
            for rows, parts in bpe.blocks([t or "" for t in texts], BLOCK):
                flat, counts = codec.encode_all(parts)
                yield from zip(rows, np.split(flat, np.cumsum(counts)[:-1]))

        def batch_of(others: pa.RecordBatch, made: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
            row, piece = (np.array([m[k] for m in made], np.int64) for k in (0, 1))
            ids = [m[2] for m in made]
            length = np.array([len(x) for x in ids], np.int64)
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            columns = [pa.array(piece, pa.int32()), pa.array(piece * size), pa.array(length)]
            if with_ids:
                at = pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32())
                columns.append(pa.ListArray.from_arrays(at, pa.array(np.concatenate(ids), pa.int32())))
            return pa.RecordBatch.from_arrays([*others.take(pa.array(row)).columns, *columns, pa.array(crc, pa.int64())], [*others.schema.names, *outputs])

        for part in T.chunks(batches, size=BLOCK):
            others = part.select(names)
            made, have = [], 0
            for found in parted(encoded(part.column("text").to_pylist()), size, end):
                made.append(found)
                have += len(found[2])
                if have >= IDS:
                    yield batch_of(others, made)
                    made, have = [], 0
            if made:
                yield batch_of(others, made)

    columns = f"{fields_of(kept)}, " if kept.columns else ""
    return docs.mapInArrow(run, f"{columns}`piece` int, `start` long, `length` long, {'`ids` array<int>, ' * with_ids}`ids_crc32` long")


def filled(left: list[int], open_: int, size: int) -> tuple[dict[int, int], dict[int, int]]:
    """What best-two-fit puts into the next bin, as {length: copies}: by the greedy step alone, and in the end.

    left has the number of unpacked pieces of each length, open_ a bit for
    each length of which there is any. Of pairs that fill the bin equally the
    one with the longer piece is taken.
    """
    taken, gap = {}, size
    while found := open_ & ((2 << gap) - 1):
        length = found.bit_length() - 1
        copies = min(gap // length, left[length])
        taken[length] = copies
        gap -= copies * length
        if copies == left[length]:
            open_ ^= 1 << length
    smallest = min(taken)
    room, best, pair = gap + smallest, smallest, None
    if sum(taken.values()) > 1:
        longer = open_ & ((1 << smallest) - 1)
        while longer and best < room:
            a = longer.bit_length() - 1
            if 2 * a <= best:
                break
            longer ^= 1 << a
            shorter = open_ & ((2 << min(a, room - a)) - 1)
            if a <= room - a and left[a] < 2:
                shorter &= ~(1 << a)
            b = shorter.bit_length() - 1
            if b > 0 and a + b > best:
                best, pair = a + b, (a, b)
    if pair is None:
        return taken, taken
    final = dict(taken)
    final[smallest] -= 1
    for length in pair:
        final[length] = final.get(length, 0) + 1
    return taken, {length: copies for length, copies in final.items() if copies}


def plan(counts: dict[int, int], size: int = SIZE) -> np.ndarray:
    """The bins for so many pieces of each length: rows (number, alike, bin, offset, length), by number.

    Pieces are numbered from 0 in the order of their length. From `number` on,
    up to the next row's, the k-th lies in bin `bin` + k % alike at the place
    `offset` + k // alike * length.
    """
    left, used, at = [0] * (size + 1), {}, 0
    for length in sorted(counts):
        left[length], used[length] = counts[length], at
        at += counts[length]
    open_ = sum(1 << length for length, n in enumerate(left) if n)
    rows, bins = [], 0
    while open_:
        greedy, final = filled(left, open_, size)
        alike = min((left[k] - max(greedy.get(k, 0), final.get(k, 0))) // final[k] + 1 for k in final)
        offset = 0
        for length in sorted(final, reverse=True):
            rows.append((used[length], alike, bins, offset, length))
            used[length] += alike * final[length]
            left[length] -= alike * final[length]
            offset += final[length] * length
            if not left[length]:
                open_ ^= 1 << length
        bins += alike
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def placed(items: DataFrame, by: list[str], size: int = SIZE) -> DataFrame:
    """items, whose `length` (long) is 1 to size, with sequence_id and offset (long): all packed by best-two-fit.

    Sequences are numbered from 0 and gapless within. Rows of one length are
    taken in the order of the columns `by`; those that agree in them, in any.
    The items are read twice, so they should be stored (see cut). Columns
    named as an output (in any case of letters) give way to it.
    """
    items = bare(items, "sequence_id", "offset")
    table = plan({r.length: r.n for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}, size)
    number = fresh(items.columns, "number")
    rows, names = numbered(items, ["length", *by], number), items.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(number).to_numpy()
            first, alike, bins, offset, length = table[np.searchsorted(table[:, 0], k, "right") - 1].T
            k = k - first
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bins + k % alike), pa.array(offset + k // alike * length)], [*names, "sequence_id", "offset"])

    return rows.mapInArrow(run, f"{fields_of(items)}, `sequence_id` long, `offset` long")


def packed(docs: DataFrame, size: int = SIZE, path: str | None = None, end: int = END, by: str = "doc_id") -> DataFrame:
    """The pieces of docs with their ids, and where each lies: sequence_id and offset. An empty table has none."""
    return placed(cut(pieces(docs, size, path, end)), [by, "piece"], size)


def sequences(rows: DataFrame) -> DataFrame:
    """sequence_id, length and ids (array<int>) of each sequence of packed rows; a sequence is bounded, so a group is."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = rows.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    return whole.select("sequence_id", "length", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"))
