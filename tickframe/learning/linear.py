"""Ridge regression from sums: one aggregation gives the normal equations, whatever the rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gram(features: list[str], target: str) -> dict[str, Column]:
    """Sums that the normal equations need: count, sums, products, and products with the target, by name."""
    x = [F.col(f) for f in features]
    k = range(len(x))
    out = {"n": F.count(F.lit(1)).cast("double"), "y": F.sum(target)}
    out |= {f"s{i}": F.sum(x[i]) for i in k} | {f"t{i}": F.sum(x[i] * F.col(target)) for i in k}
    return out | {f"g{i}_{j}": F.sum(x[i] * x[j]) for i in k for j in k if i <= j}


def summed(rows: DataFrame, by: list[str], features: list[str], target: str) -> DataFrame:
    return rows.groupBy(*by).agg(*(c.alias(n) for n, c in gram(features, target).items()))


@dataclass
class Ridge:
    features: list[str]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    base: float

    def score(self) -> Column:
        terms = [(F.col(f) - float(m)) / float(s) * float(w) for f, m, s, w in zip(self.features, self.mean, self.scale, self.weights)]
        return sum(terms, F.lit(self.base))


def fit(rows: DataFrame, features: list[str], target: str, penalty: float) -> Ridge:
    """Weights of features scaled by the rows' own mean and deviation. The driver solves a system of their number."""
    r = summed(rows, [], features, target).first()
    k, n = len(features), r["n"] or 1.0
    mean = np.array([r[f"s{i}"] or 0.0 for i in range(k)]) / n
    square = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]) / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(square), 1e-24))
    base = (r["y"] or 0.0) / n
    right = (np.array([r[f"t{i}"] or 0.0 for i in range(k)]) / n - mean * base) / scale
    weights = np.linalg.solve(square / np.outer(scale, scale) + penalty / n * np.eye(k), right)
    return Ridge(features, mean, scale, weights, float(base))


def solved(sums: DataFrame, key: str, k: int, penalty: float) -> DataFrame:
    """Of sums for k features (as gram names them) a model a row: key, _w (the slopes) and _base.

    A row's k x k system is solved in its task: the covariances, with the share
    penalty / n of each variance added to it, against those with the target.
    """
    names = [*(f"{c}{i}" for c in "st" for i in range(k)), *(f"g{i}_{j}" for i in range(k) for j in range(i, k))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights, bases = [], []
            for r in batch.to_pylist():
                n = r["n"]
                mean = np.array([r[f"s{i}"] for i in range(k)]) / n
                cov = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / n - np.outer(mean, mean)
                right = np.array([r[f"t{i}"] for i in range(k)]) / n - mean * r["y"] / n
                w = np.linalg.lstsq(cov + np.diag(np.diag(cov)) * penalty / n, right, rcond=None)[0]
                weights.append(w.tolist())
                bases.append(r["y"] / n - float(w @ mean))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(weights, pa.list_(pa.float64())), pa.array(bases, pa.float64())], [key, "_w", "_base"])

    kind = sums.schema[key].dataType.simpleString()
    return sums.select(key, "n", "y", *names).mapInArrow(run, f"`{key}` {kind}, _w array<double>, _base double")


def _scored(rows: DataFrame, models: DataFrame, on: str, features: list[str]) -> DataFrame:
    terms = [F.get("_w", F.lit(i)) * F.col(f) for i, f in enumerate(features)]
    return rows.join(models, on).withColumn("score", sum(terms, F.col("_base"))).drop("_w", "_base")


def walked_forward(rows: DataFrame, period: str, features: list[str], target: str, penalty: float, least: int) -> DataFrame:
    """rows with the score of a model that saw earlier periods alone: each period's sums are added up over those before it."""
    sums = summed(rows, [period], features, target)
    before = Window.orderBy(period).rowsBetween(Window.unboundedPreceding, -1)  # a row for each period
    past = sums.select(period, *(F.sum(n).over(before).alias(n) for n in gram(features, target))).where(F.col("n") >= least)
    return _scored(rows, solved(past, period, len(features), penalty), period, features)


def out_of_fold(rows: DataFrame, fold: str, features: list[str], target: str, penalty: float) -> DataFrame:
    """rows with the score of a model of the other folds: the whole sums less the fold's own."""
    sums = summed(rows, [fold], features, target)
    every = Window.partitionBy(F.lit(0))  # a row for each fold
    rest = sums.select(fold, *((F.sum(n).over(every) - F.col(n)).alias(n) for n in gram(features, target)))
    return _scored(rows, solved(rest, fold, len(features), penalty), fold, features)
