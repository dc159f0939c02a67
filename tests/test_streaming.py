import datetime as dt

from pyspark.sql import functions as F

from tickframe.operators import relations as R
from tickframe.sources.sinks import keyed_rows, row_id, upserting
from tickframe.sources.tables import ticks
from tickframe.streaming import flow

DIR = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)


def run(frame, folder, name, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/c-{name}").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return frame.sparkSession.table(name)


def minutes(spark):
    return ticks(spark, DIR).groupBy("symbol", F.window("ts", "1 minute")["start"].cast("timestamp").alias("minute")).count()


def test_minute_flow_is_the_batch(spark, tmp_path):
    source = spark.read.parquet(f"{DIR}/events.parquet")
    source.repartition(2).write.parquet(f"{tmp_path}/in")
    source.limit(50).write.mode("append").parquet(f"{tmp_path}/in")  # repeated ticks count once
    got = run(flow.minute_flow(flow.tick_stream(spark, f"{tmp_path}/in", source.schema), late="60 days"), tmp_path, "flow", "update").groupBy("symbol", "minute").agg(F.max("n").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, minutes(spark).collect()))


def test_append_gives_closed_minutes_once_with_their_snapshot(spark, tmp_path):
    source = spark.read.parquet(f"{DIR}/events.parquet")
    source.write.parquet(f"{tmp_path}/in")
    depth = spark.createDataFrame([("view", 0.5), ("click", -0.25)], "symbol string, depth double")
    closed = flow.minute_flow(flow.tick_stream(spark, f"{tmp_path}/in", source.schema), late="1 minute")
    got = run(flow.with_snapshot(closed, depth, ["symbol"]), tmp_path, "closed").collect()
    end = source.agg(F.max("ts")).first()[0] - dt.timedelta(minutes=1)
    want = {(r.symbol, r.minute): r["count"] for r in minutes(spark).collect() if r.minute + dt.timedelta(minutes=1) <= end}
    assert {(r.symbol, r.minute): r.n for r in got} == want and len(got) == len(want) > 0
    assert {r.depth for r in got if r.symbol == "view"} == {0.5} and {r.depth for r in got if r.symbol == "error"} == {None}


def test_state_passes_over_bars_seen_before(spark, tmp_path):
    schema = "symbol string, bar timestamp, close double"
    first = [("a", T0 + dt.timedelta(hours=i), float(i * i % 7)) for i in range(10)]
    second = first[5:] + [("a", T0 + dt.timedelta(hours=i), float(i * i % 7)) for i in range(10, 15)] + [("b", T0, 3.0)]
    means = []
    for k, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = flow.running_means(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 0.5)
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination(120)
    rows = spark.read.parquet(f"{tmp_path}/out").where("symbol = 'a'").orderBy("bar").collect()
    mean = None
    for i in range(15):
        mean = i * i % 7 if mean is None else mean + 0.5 * (i * i % 7 - mean)
        means.append(mean)
    assert [round(r["mean"], 9) for r in rows] == [round(m, 9) for m in means] and [r.n for r in rows] == list(range(1, 16))


def test_orders_expire_when_the_watermark_passes(spark, tmp_path):
    schema = "id long, ts timestamp, kind string"
    hour = dt.timedelta(hours=1)
    spark.createDataFrame([(1, T0, "armed"), (2, T0 + hour, "armed"), (2, T0 + 2 * hour, "filled"), (3, T0 + 3 * hour, "armed")], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: flow.expired_orders(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "24 hours")
    for rows in ([], [(9, T0 + 26 * hour, "armed")], [(9, T0 + 26 * hour, "armed")]):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = stream().writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [(r.id, r.ended - r.armed) for r in got] == [(1, 24 * hour)]


def test_keyed_sink_is_idempotent_and_never_revises_final_rows(spark, tmp_path):
    schema = "key string, status string, r double"
    write = upserting(spark, f"{tmp_path}/t", schema, ["key"], lambda old, new: R.kept_final(old, new, ["key"], "status", ["CLOSED"]), 8)
    rows = [[("x", "OPEN", 0.0), ("y", "CLOSED", 1.0)], [("x", "CLOSED", 2.0), ("y", "OPEN", 9.0)], [("x", "OPEN", 7.0), ("z", "OPEN", 3.0)]]
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        spark.readStream.schema(schema).parquet(f"{tmp_path}/in").writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    want = [("x", "CLOSED", 2.0), ("y", "CLOSED", 1.0), ("z", "OPEN", 3.0)]
    assert sorted(map(tuple, keyed_rows(spark, f"{tmp_path}/t", schema).collect())) == want
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    write(spark.createDataFrame(rows[2], schema).where("key = 'z'"), 2)  # a batch that comes again
    assert sorted(map(tuple, keyed_rows(spark, f"{tmp_path}/t", schema).collect())) == want
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    assert len(set(before) - set(after)) == 1 and len(set(before) & set(after)) == len(before) - 1  # other partitions stay
    write(spark.createDataFrame([], schema), 3)
    ids = [r[0] for r in spark.createDataFrame(rows[0] + rows[0], schema).select(row_id("key", "status")).collect()]
    assert ids[:2] == ids[2:] and ids[0] != ids[1]


def test_upsert_keeps_final_rows(spark):
    old = spark.createDataFrame([(1, "CLOSED", 1.0), (2, "OPEN", 1.0)], "key int, status string, r double")
    new = spark.createDataFrame([(1, "OPEN", 9.0), (2, "CLOSED", 2.0), (3, "OPEN", 3.0)], "key int, status string, r double")
    got = R.kept_final(old, new, ["key"], "status", ["CLOSED"]).collect()
    assert sorted(map(tuple, got)) == [(1, "CLOSED", 1.0), (2, "CLOSED", 2.0), (3, "OPEN", 3.0)]
