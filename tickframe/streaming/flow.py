"""Structured Streaming forms of the tick aggregates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def tick_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Ticks from Parquet files as they land; ts as a timestamp, which watermarks need."""
    raw = spark.readStream.schema(schema).parquet(path)
    size = F.get_json_object("props", "$.k").cast("int")
    return raw.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), F.col("value").alias("price"), size.alias("size"))


def minute_flow(ticks: DataFrame, late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Value and count by symbol and minute. Each tick counts once by id;
    ticks later than the watermark are dropped, as is the state behind it."""
    once = ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])
    return once.groupBy("symbol", F.window("ts", width).alias("w")).agg(F.sum(F.col("price") * F.col("size")).alias("value"), F.count("*").alias("n")).select("symbol", F.col("w.start").alias("minute"), "value", "n")


def with_snapshot(minutes: DataFrame, snapshot: DataFrame, on: list[str]) -> DataFrame:
    """Closed minutes with the columns of a static side table by key; minutes without a row keep nulls."""
    return minutes.join(snapshot, on, "left")


BAR_STATE = "last timestamp, mean double, n long"


def running_means(bars: DataFrame, weight: float) -> DataFrame:
    """Exponential mean of each symbol over bars as they come, one row out for each new bar.

    The state is the last bar's time and the mean: a bar at or before that
    time was seen already (a replay), so it is passed over.
    """

    def step(key, frames, state):
        last, mean, n = state.get if state.exists else (pd.Timestamp.min, float("nan"), 0)
        out = []
        for rows in frames:
            for at, close in rows.sort_values("bar")[["bar", "close"]].itertuples(index=False):
                if n and at <= last:
                    continue
                mean = close if n == 0 else mean + weight * (close - mean)
                last, n = at, n + 1
                out.append((key[0], at, mean, n))
        if n:
            state.update((last, mean, n))
        yield pd.DataFrame(out, columns=["symbol", "bar", "mean", "n"])

    return bars.groupBy("symbol").applyInPandasWithState(step, "symbol string, bar timestamp, mean double, n long", BAR_STATE, "append", GroupStateTimeout.NoTimeout)


def expired_orders(orders: DataFrame, life: str, late: str = "0 seconds") -> DataFrame:
    """Orders (id, ts, kind: armed, filled) that no fill closed within `life`: emitted once the watermark has passed their end."""
    seconds = int(pd.Timedelta(life).total_seconds())

    def step(key, frames, state):
        armed = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"id": [key[0]], "armed": [armed], "ended": [armed + pd.Timedelta(seconds=seconds)]})
            return
        for rows in frames:
            if (rows["kind"] == "filled").any():
                if state.exists:
                    state.remove()
                return
            first = rows["ts"].min()
            armed = first if armed is None else min(armed, first)
        state.update((armed,))
        state.setTimeoutTimestamp(int(armed.timestamp() * 1000) + seconds * 1000)

    timed = orders.withWatermark("ts", late)
    return timed.groupBy("id").applyInPandasWithState(step, "id long, armed timestamp, ended timestamp", "armed timestamp", "append", GroupStateTimeout.EventTimeTimeout)
