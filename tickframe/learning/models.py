"""Trees and clusters on bar features, by Spark's own distributed learners."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.operators.quantiles import percentiles


def assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(rows)


def boosted(train: DataFrame, rows: DataFrame, features: list[str], target: str, rounds: int = 10, depth: int = 3) -> DataFrame:
    """rows with the score of gradient-boosted trees that learned from train."""
    learner = GBTRegressor(featuresCol="features", labelCol=target, maxIter=rounds, maxDepth=depth, seed=7, maxBins=32)
    model = learner.fit(assembled(train, features).select("features", target))
    return model.transform(assembled(rows, features)).withColumnRenamed("prediction", "score").drop("features")


def situations(train: DataFrame, rows: DataFrame, features: list[str], k: int = 6) -> DataFrame:
    """rows with the cluster of their scaled features; scaling and centres come from train."""
    known = assembled(train, features)
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(known)
    model = KMeans(k=k, seed=7, featuresCol="scaled", maxIter=20).fit(scaler.transform(known))
    out = model.transform(scaler.transform(assembled(rows, features))).withColumnRenamed("prediction", "cluster")
    return out.withColumn("place", vector_to_array("scaled")).drop("features", "scaled")


def tail(scored: DataFrame, train: DataFrame, share: float = 0.9) -> DataFrame:
    """Rows whose score reaches the quantile that train's scores have."""
    cut = percentiles(train, [], "score", [share]).select(F.col("value").alias("cut"))  # one row
    return scored.join(F.broadcast(cut), F.lit(True)).where("score >= cut")


def failing(train: DataFrame, rows: DataFrame, features: list[str], failed: str) -> DataFrame:
    """rows with the probability `risk` that the 0/1 column `failed` is 1, by a logistic regression on train."""
    model = LogisticRegression(featuresCol="features", labelCol=failed, regParam=0.01, maxIter=50).fit(assembled(train, features).select("features", failed))
    scored = model.transform(assembled(rows, features))
    return scored.withColumn("risk", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def vetoed(scored: DataFrame, train: DataFrame, share: float = 0.8) -> DataFrame:
    """Rows whose risk is under the quantile that train's risks have."""
    cut = percentiles(train, [], "risk", [share]).select(F.col("value").alias("_cut"))  # one row
    return scored.join(F.broadcast(cut), F.lit(True)).where("risk < _cut").drop("_cut")
