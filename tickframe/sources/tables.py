"""Ticks and bars from the driver's tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, id, price, size and taker side (+1 or -1) of each tick."""
    size = F.get_json_object("props", "$.k").cast("int")
    side = F.when(F.col("event_type").isin("purchase", "click"), 1).otherwise(-1)
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("id"), F.col("value").alias("price"), size.alias("size"), side.alias("side"), "user_id")


def bars(ticks: DataFrame, width: str = "1 hour") -> DataFrame:
    """OHLCV bars of ticks; ties of time go by id. Combined before the shuffle, one row for each symbol and bucket after it."""
    at = F.struct("ts", "id")
    return (
        ticks.groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum(F.col("size").cast("double")).alias("volume"),
            F.sum(F.when(F.col("user_id") % 2 == 0, F.col("size")).otherwise(0).cast("double")).alias("buy"),
            F.count("*").alias("n"),
        )
        .select("symbol", F.col("w.start").alias("bar"), "open", "high", "low", "close", "volume", "buy", "n")
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(ticks(spark, sf_dir))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a query's own files: under spark.checkpoint.dir, which executors share, or a temporary one in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base or tempfile.mkdtemp(prefix='spark-scratch-')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df from files in spark.checkpoint.dir, without its lineage; a temporary folder in local mode."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch(spark, "checkpoint"))
    return df.checkpoint()
