"""Quality classifier: hashed word n-gram logistic regression.

Features of a text are hashed counts of its lower-case words, of the words'
shapes (runs of capitals, letters and digits as one sign each, other signs as
they are, a run of one sign once), of pairs of neighbouring words and of
pairs of neighbouring shapes with a mark where both words agree. Counts are
scaled to length 1. Weights are learned by follow-the-regularised-leader
updates (per-coordinate rates, L1 and L2), on slices of the labelled rows in
parallel, and averaged over the slices; a score is a sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm import text as T
from tickframe.llm.shared import bare, fields_of, sampled

BITS = 20
#: Labelled rows to learn from, at most, chosen by the hash of doc_id (the list of ids that is broadcast has no more rows); of texts of more bytes than LONGEST none.
SAMPLE, LONGEST = 12_000, 1 << 18
SLICES = 8
EPOCHS = 4

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 65, 97, 97, 57


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of all features of the texts, ordered by row."""
    w = T.words(texts)
    word = w.hashes(lower=True)
    kind = _CLASS[w.data]
    new = np.ones(len(kind) + 1, bool)
    new[1:-1] = kind[1:] != kind[:-1]
    new[w.start] = True
    at = np.concatenate([[0], np.cumsum(new[:-1])])
    shape = T.span_hashes(T._BYTE[kind[new[:-1]]], at[w.start], at[w.end])
    pair = np.flatnonzero(w.row[1:] == w.row[:-1]) if len(w.row) else w.row
    same = (word[pair] == word[pair + 1]).astype(np.uint64)
    both = T.mixed(word[pair] * np.uint64(3) + word[pair + 1])
    shapes = T.mixed(shape[pair] * np.uint64(5) + shape[pair + 1] * np.uint64(7) + same + np.uint64(1))
    bucket = np.concatenate([word, shape + np.uint64(99), both, T.mixed(shapes)]) & np.uint64((1 << BITS) - 1)
    row = np.concatenate([w.row, w.row, w.row[pair], w.row[pair]]).astype(np.uint64)
    key, count = np.unique((row << np.uint64(BITS)) | bucket, return_counts=True)
    row, bucket = (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64)
    norm = np.sqrt(np.bincount(row, count.astype(float) ** 2, len(texts)))
    return row, bucket, count / norm[row]


@dataclass
class Leader:
    """Follow-the-regularised-leader state for logistic loss."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int, seed: int = 1) -> np.ndarray:
        """Weights; the last one is the bias, the log odds of the labels: what
        a text without known features gets. It is not learned with the rest,
        as nearly every text has features and short ones would pay for it."""
        size = (1 << BITS) + 1
        z, n = np.zeros(size), np.zeros(size)
        share = np.clip(np.mean([y for *_, y in rows]), 0.01, 0.99)
        bias = np.log(share / (1 - share))
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                at, x, y = rows[i]
                w = self.weights(z[at], n[at])
                p = 1 / (1 + np.exp(-np.clip(bias + w @ x, -30, 30)))
                g = (p - y) * x
                step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / self.alpha
                z[at] += g - step * w
                n[at] += g * g
        weights = self.weights(z, n)
        weights[-1] = bias
        return weights

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        pull = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -pull / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> np.ndarray:
    """Weights from docs (doc_id, text) and labels (doc_id, quality).

    Rows whose crc32(doc_id as text) mod 4 is 2 are held out. Labels that are
    null or not 0 or 1 and rows with a null doc_id teach nothing; of several
    labels of a doc_id the smaller counts, of several texts the first. With no
    labelled row all weights are 0 and every score is 0.5.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where("y in (0, 1) and doc_id is not null").where(~held_out())
    chosen = sampled(known, sample, "doc_id")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.chunks(batches):
            row, bucket, value = features(part.column("text"))
            at = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("slice"), part.column("doc_id"), part.column("y"), pa.ListArray.from_arrays(at, pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(value.astype(np.float32)))],
                ["slice", "doc_id", "y", "at", "x"],
            )

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id")
        rows = [(a, x.astype(float), float(y)) for a, x, y in zip(part["at"], part["x"], part["y"])]
        w = Leader().fit(rows, epochs)
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": [at], "w": [w[at]]})

    taught = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST).join(F.broadcast(chosen), "doc_id")
    once = taught.groupBy("doc_id").agg(F.min(F.struct("text", "y")).alias("row")).select("doc_id", "row.*")  # rows of one doc_id teach once
    sliced = once.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).cast("int"))
    fitted = sliced.mapInArrow(sparse, "slice int, doc_id long, y int, at array<int>, x array<float>").groupBy("slice").applyInPandas(fit, "at array<long>, w array<double>")
    weights, slices = np.zeros((1 << BITS) + 1), 0
    for r in fitted.toLocalIterator():
        weights[np.array(r.at, np.int64)] += np.array(r.w)
        slices += 1
    return weights / max(1, slices)


def held_out(column: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def scored(docs: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    """docs with the probability of label 1 of each whole text, as a double.

    Null and empty texts have no features and get the bias alone; repeated
    rows have the same score; a text is read whole, whatever its length.
    Columns of docs stay as they are, but one named as the output (in any case
    of letters) gives way to it; an empty table stays empty.
    """
    docs = bare(docs, name)
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # of fixed size: 2**BITS + 1 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for part in T.chunks(batches):
            row, bucket, value = features(part.column("text"))
            logit = w[-1] + np.bincount(row, w[bucket] * value, part.num_rows)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-logit)))], [*part.schema.names, name])

    return docs.mapInArrow(run, f"{fields_of(docs)}, `{name}` double")


def predicted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= 0.7) of each row of docs."""
    weights = learn(docs, labels)
    rows = scored(docs.select("doc_id", "text"), weights)
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
