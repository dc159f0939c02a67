"""Compression of vectors to codes of their parts by delta-maintained Lloyd.

A vector's integer components floor(256 x) are cut into PARTS equal parts;
each part position has a codebook of ENTRIES integer entries, which starts as
that part of the first vectors by id. A round assigns every part to its
nearest entry and puts each entry at its parts' mean. The rows with their
last codes are kept in the shared folder, and so are the running sums and
counts of all entries, as exact integers: a round shuffles only what parts
that changed their entry take from the old one and add to the new one, summed
within each task, and adds it to the running sums. The driver sees the
codebooks and these sums alone, whose size is that of the codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm.shared import bare, cut, fields_of, fresh

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Integers a unit of a component, and the largest component that is told apart.
SCALE, BOUND = 256, 1 << 16
#: Equal labels up to so many rows and bytes are sent to all tasks; beyond it they are joined.
FEW_LABELS, FEW_BYTES = 50_000, 8 << 20


def nearest(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Of each row of x the index of the nearest entry, the lowest of equals; exact."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 3 * x.shape[1] * top * top < 1 << 53 else np.int64
    apart = (entries * entries).sum(1).astype(kind) - 2 * (x.astype(kind) @ entries.T.astype(kind))
    return apart.argmin(1)


def _grid(column: pa.Array, size: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), size)


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), parts).astype(np.int64)


def assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows with the code that the codebooks give (binary, a byte a part), `was`: the code before, and the squared error."""
    parts, _, width = books.shape
    size = parts * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _grid(batch.column("ints"), size, np.int64)
            codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for k in range(parts):
                part = x[:, k * width : (k + 1) * width]
                codes[:, k] = j = nearest(part, books[k])
                error += ((part - books[k][j]) ** 2).sum(1)
            made = {"code": pa.array([c.tobytes() for c in codes], pa.binary()), "was": batch.column("code"), "error": pa.array(error)}
            columns = [made.get(n, batch.column(n) if n in batch.schema.names else None) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = [*bare(rows, "code", "was", "error").columns, "code", "was", "error"]
    return rows.mapInArrow(run, f"{fields_of(bare(rows, 'code', 'was', 'error'))}, `code` binary, `was` binary, `error` long")


def deltas(rows: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(slot, change) of the sums and counts of the entries: what parts whose entry changed take and add, summed by task.

    slot numbers (part, entry, place) in order; place 0 holds the count, the others the components' sums.
    """
    parts, entries, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, 1 + width), np.int64)
        for batch in batches:
            x, code = _grid(batch.column("ints"), parts * width, np.int64), _codes(batch.column("code"), parts)
            first = batch.column("was").null_count == batch.num_rows
            was = np.full_like(code, -1) if first else _codes(batch.column("was"), parts)
            for k in range(parts):
                at = np.flatnonzero(code[:, k] != was[:, k])
                moved = np.ones((len(at), 1 + width), np.int64)
                moved[:, 1:] = x[at, k * width : (k + 1) * width]
                np.add.at(total[k], code[at, k], moved)
                if not first:
                    np.subtract.at(total[k], was[at, k], moved)
        flat = total.ravel()
        slot = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(flat[slot])], ["slot", "change"])

    return rows.select("ints", "code", "was").mapInArrow(run, "slot long, change long")


def moved(books: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The codebooks with each entry at the floor of its parts' mean; unused entries stay."""
    count, sums = totals[:, :, :1], totals[:, :, 1:]
    return np.where(count > 0, sums // np.maximum(count, 1), books)


def compressed(vectors: DataFrame, column: str = "embedding", by: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Rows with `code` (binary, one byte a part) and `error` (long) in the vector's place, and the codebooks (part, entry, place).

    Defined cases: rows whose vector is null or empty, holds a null or
    non-finite component, cannot be cut into equal parts, or has another size
    than the first kept one are dropped; components beyond BOUND count as
    BOUND, so that sums and errors stay exact; the first vectors are those of
    the smallest `by`, nulls last, repeated rows counting each (of one `by`
    the smaller vector goes first); with fewer rows than entries the codebooks
    are shorter; an empty table has no rows and empty codebooks. At most 256
    entries. Other columns stay, but those named as an output (in any case of
    letters) give way to it.
    """
    x = F.col(f"`{column}`")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    ints = F.transform(x, lambda v: F.floor(F.greatest(F.least(v.cast("double"), F.lit(float(BOUND))), F.lit(-float(BOUND))) * SCALE).cast("int"))
    usable = x.isNotNull() & (F.size(x) > 0) & (F.size(x) % parts == 0) & ~odd
    rows = bare(vectors.where(usable).withColumn("ints", ints), column, "code", "was", "error")
    seeds = rows.select(F.col(f"`{by}`").alias("by"), "ints").orderBy(F.col("by").asc_nulls_last(), "ints").limit(entries).collect()
    size = len(seeds[0].ints) if seeds else parts
    books = np.array([r.ints for r in seeds if len(r.ints) == size], np.int64).reshape(-1, parts, size // parts).transpose(1, 0, 2)
    if not seeds:
        return rows.select(*bare(rows, "ints").columns, F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), books
    rows = rows.where(F.size("ints") == size).withColumn("code", F.lit(None).cast("binary"))
    totals = np.zeros((*books.shape[:2], 1 + books.shape[2]), np.int64)
    running = None
    for _ in range(rounds):
        rows = cut(assigned(rows, books)).drop("error")
        change = deltas(rows, books.shape)
        running = cut((change if running is None else running.unionByName(change)).groupBy("slot").agg(F.sum("change").alias("change")))
        for r in running.collect():  # as many rows as the codebooks have numbers
            totals.flat[r.slot] = r.change
        books = moved(books, totals)
        rows = rows.drop("was")
    return cut(assigned(rows, books).drop("ints", "was")), books


def restored(rows: DataFrame, books: np.ndarray, column: str = "embedding") -> DataFrame:
    """rows with the vector that each code stands for: the middle of each integer's interval."""
    values = [[[(int(v) + 0.5) / SCALE for v in entry] for entry in book] for book in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(values, np.float32)
        for batch in batches:
            codes = _codes(batch.column("code"), len(table))
            flat = np.concatenate([table[k][codes[:, k]] for k in range(len(table))], axis=1)
            at = pa.array(np.arange(len(codes) + 1) * flat.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(at, pa.array(flat.ravel()))], [*batch.schema.names, column])

    rows = bare(rows, column)
    return rows.mapInArrow(run, f"{fields_of(rows)}, `{column}` array<float>")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' decimal components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(rows: DataFrame, label: str = "label") -> DataFrame:
    """rows with `label_error`: the error summed over equal labels, nulls together.

    The sums are combined within tasks and sent to all of them while they are
    few (counted first); beyond that Spark joins them and splits hot labels.
    """
    rows = bare(rows, "label_error")
    key = fresh(rows.columns, "key")
    sums = cut(rows.groupBy(F.col(f"`{label}`").alias(key)).agg(F.sum("error").alias("label_error")))
    n, size = sums.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(key).cast("string")))).first()
    few = n <= FEW_LABELS and (size or 0) <= FEW_BYTES
    return rows.join(F.broadcast(sums) if few else sums, F.col(f"`{label}`").eqNullSafe(F.col(key)), "left").drop(key)
