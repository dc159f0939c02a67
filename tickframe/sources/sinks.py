"""Writers for batches and for foreachBatch: tables by key, of which a batch rewrites only what it touches, and logs that only grow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Merge = Callable[[DataFrame, DataFrame], DataFrame]
#: Partitions of a keyed table, by the hash of its keys.
PARTS = 64


def keyed_rows(spark: SparkSession, path: str, schema: str, parts: list[int] | None = None) -> DataFrame:
    """The rows of a table that upserting writes, or of some of its partitions; none before its first batch."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, part_ int").parquet(path)
    return (rows if parts is None else rows.where(F.col("part_").isin(parts))).drop("part_")


def upserting(spark: SparkSession, path: str, schema: str, keys: list[str], merge: Merge, parts: int = PARTS) -> Callable[[DataFrame, int], None]:
    """A writer (batch, number) for writeStream.foreachBatch: merge(old, new) of the rows of those partitions that the batch touches.

    The table lies in `parts` partitions by the hash of the keys; Spark
    replaces the touched ones (dynamic overwrite). Spark may hand over a batch
    again after a failure, so merge must give the same rows when a batch comes
    twice, as upserts by key do.
    """
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")

    def write(batch: DataFrame, number: int) -> None:
        touched = [r[0] for r in batch.select(part).distinct().collect()]  # `parts` at most
        if touched:
            made = merge(keyed_rows(spark, path, schema, touched), batch).withColumn("part_", part).repartition("part_")
            made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part_").parquet(path)

    return write


def appended(events: DataFrame, path: str) -> None:
    """Append events to a JSON-lines log, with the time of writing."""
    events.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)


def row_id(*columns: str):
    """An id that the same row always gets: what a restarted writer would write again has the same key."""
    return F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in columns)), 256)
