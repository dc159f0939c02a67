import datetime as dt
import json
import math

from pyspark.sql import functions as F

from tickframe.sources import files
from tickframe.sources.sinks import appended

T0 = dt.datetime(2024, 1, 1)


def bars(spark, n=60):
    return spark.createDataFrame([(s, T0 + dt.timedelta(days=i), 1.0, 2.0, 0.5, 1.5, float(i)) for s in "ab" for i in range(n)], files.BAR)


def test_ranges_and_closed_bars(spark):
    rows = bars(spark)
    got = files.bars_between(rows, "2024-01-03", "2024-01-06", "1 day").where("symbol = 'a'").select("start").collect()
    assert sorted(r.start.day for r in got) == [3, 4, 5]
    assert files.closed(rows, F.lit("2024-01-03 12:00:00").cast("timestamp_ntz"), "1 day").where("symbol = 'a'").count() == 2
    assert files.closed(rows, F.lit("2024-01-03 00:00:10").cast("timestamp_ntz"), "1 day", "30 seconds").where("symbol = 'a'").count() == 1


def test_monthly_files_are_pruned(spark, tmp_path):
    files.written_monthly(bars(spark), f"{tmp_path}/m")
    rows = files.monthly_bars(spark, f"{tmp_path}/m", "2024-02", "2024-02")
    assert rows.count() == 58
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "month" in plan


def test_json_bars_keep_one_row_a_start(spark, tmp_path):
    bars(spark, 3).unionByName(bars(spark, 3).withColumn("volume", F.col("volume") + 10)).write.json(f"{tmp_path}/j")
    got = files.json_bars(spark, f"{tmp_path}/j").where("symbol = 'a'").orderBy("start").collect()
    assert [r.volume for r in got] == [10.0, 11.0, 12.0]


def test_hourly_metrics(spark, tmp_path):
    (tmp_path / "m.csv").write_text("create_time,symbol,oi,oi_value,taker\n2024-01-01 00:05:00,X,10,1,2\n2024-01-01 00:55:00,X,12,1,8\n2024-01-01 01:00:00,X,bad,1,0\n")
    got = {r.hour.hour: (r.oi, r.taker) for r in files.hourly_metrics(spark, str(tmp_path / "m.csv")).collect()}
    assert got[0][0] == 12.0 and math.isclose(got[0][1], 4.0) and got[1] == (None, None)


def test_funding_and_book(spark, tmp_path):
    (tmp_path / "f.json").write_text("\n".join(json.dumps({"symbol": "X", "ts": t, "rate": "0.001"}) for t in (1000, 2000, 2000)))
    assert files.funding(spark, str(tmp_path / "f.json")).count() == 2
    (tmp_path / "b.json").write_text(json.dumps({"symbol": "X", "ts": "2024-01-01T00:00:00", "notional": [3.0, 3.0, 1.0, 1.0]}))
    assert files.book_depth(spark, str(tmp_path / "b.json")).first().imbalance == 0.5


def test_log(spark, tmp_path):
    for kind in ("entry", "exit", "exit"):
        appended(spark.createDataFrame([(kind, 0.5)], "type string, R double"), f"{tmp_path}/log")
    rows = files.logged(spark, f"{tmp_path}/log", "exit", "R double, logged_at timestamp").collect()
    assert len(rows) == 2 and all(r.R == 0.5 and r.logged_at for r in rows)


def test_feed_items(spark):
    feed = "<rss><channel><item><title>A &amp; B</title><link>http://x</link><pubDate>d</pubDate></item><item><link>y</link></item></channel></rss>"
    rows = files.feed_items(spark.createDataFrame([(feed,)], "xml string"), "xml").collect()
    assert [tuple(r) for r in rows] == [("A & B", "http://x", "d")]


def test_pasted_setups(spark):
    lines = ["BTCUSDT, long, 100, 90, 120", "BTC\tshort\t100\t110\t80", "sol,BUY,$20.5,19,25", "BAD,long,100,110,120", ",long,1,0.5,2", "X,long,?,1,2"]
    rows = spark.createDataFrame(list(enumerate(lines)), "line int, text string")
    good, bad = files.pasted(rows, "Ticker, Direction, Entry Price, SL, Take Profit")
    assert [(r.coin, r.side, r.entry) for r in good.orderBy("line").collect()] == [("BTC", "LONG", 100.0), ("BTC", "SHORT", 100.0), ("SOL", "LONG", 20.5)]
    assert {r.line: r.message for r in bad.collect()} == {3: "levels in the wrong order", 4: "no coin", 5: "no number"}
