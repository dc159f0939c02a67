"""Readers of exchange files: bars, metrics, logs, feeds and pasted tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAR = "symbol string, start timestamp_ntz, open double, high double, low double, close double, volume double"
#: Header names of pasted setups, and the columns they stand for.
ALIASES = {
    "coin": ("coin", "symbol", "ticker"),
    "side": ("side", "direction"),
    "entry": ("entry", "entry_price", "price"),
    "stop": ("stop", "sl", "stop_loss"),
    "tp1": ("tp1", "target", "take_profit", "target_1"),
}


def bars_between(bars: DataFrame, begin: str, end: str, width: str) -> DataFrame:
    """Bars that start at or after begin and are closed by end; both reach the scan as filters on start."""
    start = F.col("start")
    return bars.where((start >= F.lit(begin).cast("timestamp_ntz")) & (start <= F.lit(end).cast("timestamp_ntz") - F.expr(f"interval {width}")))


def closed(bars: DataFrame, now: Column, width: str, grace: str = "0 seconds") -> DataFrame:
    """Bars that are complete at a time: the forming one is left out."""
    return bars.where(F.col("start") <= now - F.expr(f"interval {width}") - F.expr(f"interval {grace}"))


def json_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars from JSON lines; repeated starts of a symbol keep one row, that of the largest volume."""
    rows = spark.read.schema(BAR).json(path)
    return rows.groupBy("symbol", "start").agg(F.max_by(F.struct("open", "high", "low", "close", "volume"), "volume").alias("b")).select("symbol", "start", "b.*")


def monthly_bars(spark: SparkSession, path: str, begin: str, end: str) -> DataFrame:
    """Bars of a table partitioned by symbol and month (yyyy-MM); only the months between are listed."""
    return spark.read.parquet(path).where(F.col("month").between(begin, end))


def written_monthly(bars: DataFrame, path: str) -> None:
    month = F.date_format("start", "yyyy-MM")
    bars.withColumn("month", month).repartition("symbol", "month").write.mode("overwrite").partitionBy("symbol", "month").parquet(path)


def hourly_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Hourly metrics from CSV files, with or without a header: last open interest of the hour and the geometric mean of the taker ratio."""
    raw = spark.read.schema("create_time string, symbol string, oi string, oi_value string, taker string").csv(path)
    at = F.to_timestamp_ntz("create_time", F.lit("yyyy-MM-dd HH:mm:ss"))
    rows = raw.where("create_time <> 'create_time'").select("symbol", at.alias("at"), F.expr("try_cast(oi as double)").alias("oi"), F.expr("try_cast(taker as double)").alias("taker"))
    good = F.col("taker") > 0
    return rows.groupBy("symbol", F.date_trunc("hour", "at").alias("hour")).agg(F.max_by("oi", "at").alias("oi"), F.exp(F.avg(F.when(good, F.log("taker")))).alias("taker"))


def funding(spark: SparkSession, path: str) -> DataFrame:
    """Payments from JSON lines {symbol, ts in ms, rate as text}, one for each symbol and time."""
    rows = spark.read.schema("symbol string, ts bigint, rate string").json(path)
    return rows.select("symbol", F.timestamp_millis("ts").alias("ts"), F.expr("try_cast(rate as double)").alias("rate")).dropDuplicates(["symbol", "ts"])


def book_depth(spark: SparkSession, path: str) -> DataFrame:
    """Notional by level from JSON lines {symbol, ts, notional: [..]}: imbalance of the first and the second half of the levels."""
    rows = spark.read.schema("symbol string, ts timestamp_ntz, notional array<double>").json(path)

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)

    half = F.call_function("div", F.size("notional"), F.lit(2)).cast("int")
    bid, ask = total(F.slice("notional", F.lit(1), half)), total(F.slice("notional", half + 1, half))
    return rows.where(half > 0).select("symbol", "ts", F.when(bid + ask > 0, (bid - ask) / (bid + ask)).alias("imbalance"))


def logged(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """Events of one type from a JSON-lines log."""
    return spark.read.schema(f"type string, {schema}").json(path).where(F.col("type") == kind)


def feed_items(feeds: DataFrame, column: str) -> DataFrame:
    """Items (title, link, date) of XML feeds, a row each; items without a title are left out."""
    shape = "channel struct<item: array<struct<title: string, link: string, pubDate: string>>>"
    items = feeds.select(F.explode(F.from_xml(F.col(column), shape)["channel"]["item"]).alias("i"))
    return items.where("i.title is not null").select("i.title", "i.link", F.col("i.pubDate").alias("date"))


def pasted(rows: DataFrame, header: str) -> tuple[DataFrame, DataFrame]:
    """Setups from pasted lines (line, text) under a header with names of ALIASES, parted by tab or comma: the good rows, and the bad ones with a message."""
    names = [h.strip().lower().replace(" ", "_") for h in header.replace("\t", ",").split(",")]
    at = {c: next((names.index(a) for a in known if a in names), None) for c, known in ALIASES.items()}
    parts = F.transform(F.split("text", "[\t,]"), lambda x: F.trim(x))
    cut = rows.withColumn("p", parts)

    def field(c: str) -> Column:
        return F.lit(None).cast("string") if at[c] is None else F.get("p", F.lit(at[c]))

    def number(c: str) -> Column:
        return F.try_to_number(F.regexp_replace(field(c), "[$ ]", ""), F.lit("999999999.999999")).cast("double")

    side = F.upper(field("side"))
    out = cut.select("line", F.upper(F.regexp_replace(field("coin"), "(?i)USDT$", "")).alias("coin"), F.when(side.isin("LONG", "BUY", "L"), "LONG").when(side.isin("SHORT", "SELL", "S"), "SHORT").alias("side"), number("entry").alias("entry"), number("stop").alias("stop"), number("tp1").alias("tp1"))
    way = F.when(F.col("side") == "LONG", 1).otherwise(-1)
    message = (
        F.when(F.coalesce(F.col("coin"), F.lit("")) == "", "no coin")
        .when(F.col("side").isNull(), "no side")
        .when(F.col("entry").isNull() | F.col("stop").isNull() | F.col("tp1").isNull(), "no number")
        .when((way * (F.col("entry") - F.col("stop")) <= 0) | (way * (F.col("tp1") - F.col("entry")) <= 0), "levels in the wrong order")
    )
    marked = out.withColumn("message", message)
    return marked.where("message is null").drop("message"), marked.where("message is not null").select("line", "message")
