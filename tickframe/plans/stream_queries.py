"""Registered queries that run a stream over what has landed (availableNow) and read its sink, and range scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.plans.queries import BARS, TICKS, hourly, query
from tickframe.sources import files
from tickframe.sources.sinks import keyed_rows, upserting
from tickframe.sources.tables import scratch, table
from tickframe.streaming import flow


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, with the schema of the table (the pattern takes a single file as well as a folder)."""
    return flow.tick_stream(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema)


@query("stream_minutes", f"WITH {TICKS}, e AS (SELECT max(ts) - INTERVAL 1 minute AS closed FROM ticks) SELECT symbol, date_trunc('minute', ts)::TIMESTAMP AS minute, round(sum(price * size), 4) AS value, count(*) AS n FROM ticks, e GROUP BY 1, 2, closed HAVING minute + INTERVAL 1 minute <= closed")
def stream_minutes(spark, sf_dir):
    """Minutes that the watermark has closed, each emitted once (append)."""
    where = scratch(spark, "minutes")
    minutes = flow.minute_flow(landed(spark, sf_dir), late="1 minute")
    run = minutes.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.parquet(f"{where}/out")
    return rows.select("symbol", F.col("minute").cast("timestamp_ntz").alias("minute"), F.round("value", 4).alias("value"), "n")


@query("stream_upsert", f"WITH {TICKS} SELECT symbol, user_id, arg_max(id, (ts, id)) AS id, arg_max(price, (ts, id)) AS price FROM ticks GROUP BY 1, 2")
def stream_upsert(spark, sf_dir):
    """The last tick of each symbol and user in a keyed table that foreachBatch writes."""
    where = scratch(spark, "upsert")
    schema = "symbol string, user_id bigint, ts timestamp_ntz, id bigint, price double"

    def newest(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.unionByName(new)
        return both.groupBy("symbol", "user_id").agg(F.max_by(F.struct("ts", "id", "price"), F.struct("ts", "id")).alias("r")).select("symbol", "user_id", "r.*")

    write = upserting(spark, f"{where}/table", schema, ["symbol", "user_id"], newest)
    raw = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    ticks = raw.select(F.col("event_type").alias("symbol"), "user_id", "ts", F.col("event_id").alias("id"), F.col("value").alias("price"))
    run = ticks.writeStream.foreachBatch(write).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return keyed_rows(spark, f"{where}/table", schema).select("symbol", "user_id", "id", "price")


@query("range_bars", f"WITH {BARS} SELECT symbol, bar AS start, close FROM bars WHERE bar >= TIMESTAMP '2024-01-10' AND bar + INTERVAL 1 hour <= TIMESTAMP '2024-01-12 12:30:00'")
def range_bars(spark, sf_dir):
    """Closed bars of a range of time."""
    rows = hourly(spark, sf_dir).withColumnRenamed("bar", "start")
    return files.bars_between(rows, "2024-01-10 00:00:00", "2024-01-12 12:30:00", "1 hour").select("symbol", "start", "close")


@query("closed_bars", f"WITH {BARS}, e AS (SELECT max(ts) AS now FROM ticks) SELECT symbol, count(*) AS n, max(bar) AS last FROM bars, e WHERE bar + INTERVAL 1 hour + INTERVAL 90 seconds <= now GROUP BY 1")
def closed_bars(spark, sf_dir):
    """Bars that are complete 90 seconds before the newest tick."""
    now = table(spark, sf_dir, "events").agg(F.max("ts").alias("now"))  # one row
    rows = hourly(spark, sf_dir).withColumnRenamed("bar", "start").join(F.broadcast(now), F.lit(True))
    return files.closed(rows, F.col("now"), "1 hour", "90 seconds").groupBy("symbol").agg(F.count("*").alias("n"), F.max("start").alias("last"))


@query("order_fills", "WITH o AS (SELECT l_orderkey AS id, min(l_shipdate) AS armed FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), f AS (SELECT l_orderkey AS id, min(l_shipdate) AS filled FROM lineitem WHERE l_linenumber = 2 GROUP BY 1) SELECT o.id, armed + INTERVAL 30 days AS ended FROM o LEFT JOIN f ON f.id = o.id AND f.filled >= o.armed AND f.filled <= o.armed + INTERVAL 30 days WHERE f.id IS NULL")
def order_fills(spark, sf_dir):
    """Orders that nothing filled within 30 days, as a batch: the anti-join that the stream's timer makes."""
    lines = table(spark, sf_dir, "lineitem")
    armed = lines.where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_shipdate").alias("armed"))
    filled = lines.where("l_linenumber = 2").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_shipdate").alias("filled"))
    both = armed.join(filled, "id", "left")
    inside = (F.col("filled") >= F.col("armed")) & (F.col("filled") <= F.col("armed") + F.expr("interval 30 days"))
    return both.where(~F.coalesce(inside, F.lit(False))).select("id", (F.col("armed") + F.expr("interval 30 days")).alias("ended"))
