"""Registered queries of scalar functions and sliding windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickframe.functions import scalars as S
from tickframe.functions.registered import register
from tickframe.plans.queries import query, rounded, table, ticks


@query("price_grid", "SELECT p_partkey, floor(round(p_retailprice / 2.5::DOUBLE, 9)) * 2.5::DOUBLE AS low, ceil(round(p_retailprice / 2.5::DOUBLE, 9)) * 2.5::DOUBLE AS high, round(round(p_retailprice / (pow(10.0, floor(log10(p_retailprice))) / 2)) * (pow(10.0, floor(log10(p_retailprice))) / 2), 4) AS near FROM part")
def price_grid(spark, sf_dir):
    price = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", S.to_step(price, 2.5).alias("low"), S.to_step(price, 2.5, "ceil").alias("high"), F.round(S.nearest_round(price), 4).alias("near"))


WORDS = r"(^|[^\p{{L}}])({})($|[^\p{{L}}])"


@query("keyword_sentiment", f"SELECT lang, CASE WHEN regexp_matches(lower(text), '{WORDS.format('worthless|trash')}') THEN -1 WHEN regexp_matches(lower(text), '{WORDS.format('and|und')}') THEN 1 ELSE 0 END AS mood, count(*) AS n FROM documents GROUP BY 1, 2")
def keyword_sentiment(spark, sf_dir):
    mood = S.sentiment(F.col("text"), ["worthless", "trash"], ["and", "und"])
    return table(spark, sf_dir, "documents").groupBy("lang", mood.alias("mood")).agg(F.count("*").alias("n"))


@query("order_sizing", "SELECT o_orderkey, CASE WHEN u * 120 >= 50 THEN u ELSE 0 END AS units FROM (SELECT o_orderkey, floor(round(o_totalprice * 0.01::DOUBLE / 7.5::DOUBLE / 0.5::DOUBLE, 9)) * 0.5::DOUBLE AS u FROM orders)")
def order_sizing(spark, sf_dir):
    units = S.order_size(F.col("o_totalprice"), 0.01, F.lit(120.0), F.lit(112.5), 0.5, 50.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", units.alias("units"))


@query("sliding_flow", "SELECT e.event_type AS symbol, w AS start, count(*) AS n, round(sum(value), 4) AS total FROM events e, LATERAL (SELECT unnest([time_bucket(INTERVAL 15 minutes, ts) - i * INTERVAL 15 minutes FOR i IN range(4)]) AS w) GROUP BY 1, 2")
def sliding_flow(spark, sf_dir):
    """Counts and sums of hours that start every quarter of an hour."""
    rows = ticks(spark, sf_dir).groupBy("symbol", F.window("ts", "1 hour", "15 minutes").alias("w")).agg(F.count("*").alias("n"), F.sum("price").alias("total"))
    return rounded(rows.withColumn("start", F.col("w.start")), "symbol", "start", "n", "total", to=4)


@query("session_flow", "WITH o AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 12 hours THEN 0 ELSE 1 END AS s FROM events), i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM i GROUP BY user_id, k")
def session_flow(spark, sf_dir):
    """Sessions of a user's ticks with gaps under twelve hours."""
    rows = ticks(spark, sf_dir).groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.min("ts").alias("start"), F.count("*").alias("n"), F.sum("price").alias("total"))
    return rounded(rows, "user_id", "start", "n", "total", to=4)


@query("significant_digits", "SELECT p_partkey, CASE WHEN p_retailprice = 0 THEN 0 ELSE round(round(p_retailprice * pow(10.0::DOUBLE, 2 - floor(log10(abs(p_retailprice))))) / pow(10.0::DOUBLE, 2 - floor(log10(abs(p_retailprice)))), 6) END AS price, round(ln(1 + p_retailprice), 6) AS slog, round(tanh(p_retailprice / 1000), 6) AS tanh, round(1 / (1 + exp(-p_retailprice / 1000)), 6) AS logistic FROM part")
def significant_digits(spark, sf_dir):
    price = F.col("p_retailprice")
    small, slog = S.squashed(price / 1000), S.squashed(price)["slog"]
    return table(spark, sf_dir, "part").select("p_partkey", F.round(S.significant(price, 3), 6).alias("price"), F.round(slog, 6).alias("slog"), *(F.round(small[k], 6).alias(k) for k in ("tanh", "logistic")))


@query("calendar_features", "SELECT event_id, round(sin(2 * pi() * (hour(ts) + minute(ts) / 60) / 24), 6) AS hour_sin, round(cos(2 * pi() * (hour(ts) + minute(ts) / 60) / 24), 6) AS hour_cos, isodow(ts)::INT AS weekday, date_trunc('week', ts)::TIMESTAMP AS week, (480 - (hour(ts) * 60 + minute(ts)) % 480)::INT AS to_mark FROM events")
def calendar_features(spark, sf_dir):
    c = S.calendar(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", *(F.round(v, 6).alias(k) if k.startswith("hour") else v.alias(k) for k, v in c.items()))


@query("event_days", "WITH m(day) AS (VALUES (DATE '2024-01-10'), (DATE '2024-01-31')) SELECT event_id FROM events WHERE EXISTS (SELECT 1 FROM m WHERE ts::DATE BETWEEN day - 1 AND day)")
def event_days(spark, sf_dir):
    """Rows on a day of a list or on the one before: a membership test in a literal list."""
    days = [F.lit(d).cast("date") for d in ("2024-01-10", "2024-01-31")]
    near = F.to_date("ts").isin(*days, *(F.date_sub(d, 1) for d in days))
    return table(spark, sf_dir, "events").where(near).select("event_id")


@query("header_names", "SELECT c_custkey, trim(regexp_replace(lower('  ' || c_name || ' (USD)/' || c_mktsegment), '[^a-z0-9]+', '_', 'g'), '_') AS header, upper(left(c_mktsegment, 3)) || '-' || split_part(c_name, '#', 2)::BIGINT AS key FROM customer")
def header_names(spark, sf_dir):
    raw = F.concat(F.lit("  "), "c_name", F.lit(" (USD)/"), "c_mktsegment")
    key = F.concat_ws("-", F.upper(F.left("c_mktsegment", F.lit(3))), F.split_part("c_name", F.lit("#"), F.lit(2)).cast("long").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", S.normal_header(raw).alias("header"), key.alias("key"))


@query("text_chunks", "SELECT doc_id, k::INT AS k, substr(text, k * 4000 + 1, 4000) AS part FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 3999) // 4000)) AS k FROM documents WHERE text IS NOT NULL AND length(text) > 0)")
def text_chunks(spark, sf_dir):
    """Texts in parts of 4000 characters, as a message limit asks."""
    rows = table(spark, sf_dir, "documents").where("length(text) > 0")
    k = F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / 4000).cast("int") - 1))
    return rows.select("doc_id", "text", k.alias("k")).select("doc_id", "k", F.substring("text", F.col("k") * 4000 + 1, F.lit(4000)).alias("part"))


@query("array_tools", "SELECT conv_id, n, total, round(steps / nullif(n - 1, 0), 6) AS step, top::INT AS top FROM (SELECT conv_id, len(l) AS n, list_sum(l)::BIGINT AS total, list_sum([abs(l[i] - l[i - 1]) FOR i IN range(2, len(l) + 1)]) AS steps, list_position(l, list_max(l)) AS top FROM (SELECT conv_id, list(length(text) ORDER BY turn) AS l FROM conversations GROUP BY 1))")
def array_tools(spark, sf_dir):
    """Lengths of a conversation's turns as an array: count, sum, mean step and the place of the longest."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.length("text").alias("n")))), lambda x: x["n"]).alias("l"))
    steps = F.aggregate(F.zip_with(F.slice("l", 2, 1 << 20), "l", lambda a, b: F.coalesce(F.abs(a - b), F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x)
    total = F.aggregate("l", F.lit(0).cast("long"), lambda s, x: s + x)
    n = F.size("l").cast("long")
    return rows.select("conv_id", n.alias("n"), total.alias("total"), F.round(steps / F.nullif(n - 1, F.lit(0).cast("long")), 6).alias("step"), F.array_position("l", F.array_max("l")).cast("int").alias("top"))


@query("map_counters", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, coalesce(max(n) FILTER (event_type = 'purchase'), 0) AS purchases, coalesce(max(n) FILTER (event_type = 'refund'), -1) AS refunds, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS text FROM c GROUP BY 1")
def map_counters(spark, sf_dir):
    """Counts by kind as a map, looked up with a default."""
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = c.groupBy("user_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    text = F.array_join(F.transform(F.map_entries("m"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",")
    return m.select("user_id", F.coalesce(F.try_element_at("m", F.lit("purchase")), F.lit(0)).alias("purchases"), F.coalesce(F.try_element_at("m", F.lit("refund")), F.lit(-1)).cast("long").alias("refunds"), text.alias("text"))


@query("clean_numbers", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 OR l_linenumber = 2 THEN -1 ELSE round(l_extendedprice / l_discount, 4) END AS ratio FROM lineitem")
def clean_numbers(spark, sf_dir):
    """A ratio with nulls, NaN and infinities replaced."""
    raw = F.when(F.col("l_linenumber") != 2, F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.try_divide("l_extendedprice", "l_discount")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.cleaned(raw, -1.0), 4).alias("ratio"))


@query("xml_items", "SELECT page_id, 'T' || page_id AS title, url AS link FROM pages WHERE page_id % 3 > 0")
def xml_items(spark, sf_dir):
    """Items of XML feeds: each page's row as a small feed, parsed again; items without a title are left out."""
    title = F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("<title>T"), F.col("page_id").cast("string"), F.lit("</title>"))).otherwise("")
    feed = F.concat(F.lit("<feed><item>"), title, F.lit("<link>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</link></item></feed>"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.from_xml(feed, "item array<struct<title: string, link: string>>").alias("f"))
    return rows.select("page_id", F.explode("f.item").alias("i")).where("i.title is not null").select("page_id", "i.title", "i.link")


@query("quantile_buckets", "SELECT l_returnflag AS flag, bucket, count(*) AS n, max(l_quantity) AS top FROM (SELECT l_returnflag, l_quantity, ntile(8) OVER (PARTITION BY l_returnflag ORDER BY l_quantity, l_orderkey, l_linenumber)::INT AS bucket FROM lineitem) GROUP BY 1, 2")
def quantile_buckets(spark, sf_dir):
    from pyspark.sql import Window

    place = F.ntile(8).over(Window.partitionBy("l_returnflag").orderBy("l_quantity", "l_orderkey", "l_linenumber"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_quantity", place.alias("bucket"))
    return rows.groupBy("flag", "bucket").agg(F.count("*").alias("n"), F.max("l_quantity").alias("top"))


@query("raised_sizing", "SELECT o_orderkey, CASE WHEN u * 120 >= 3000 THEN u WHEN ceil(round(3000 / 120.0::DOUBLE / 0.5::DOUBLE, 9)) * 0.5::DOUBLE * 7.5::DOUBLE <= o_totalprice * 0.02::DOUBLE THEN ceil(round(3000 / 120.0::DOUBLE / 0.5::DOUBLE, 9)) * 0.5::DOUBLE ELSE 0 END AS units FROM (SELECT *, floor(round(o_totalprice * 0.001::DOUBLE / 7.5::DOUBLE / 0.5::DOUBLE, 9)) * 0.5::DOUBLE AS u FROM orders)")
def raised_sizing(spark, sf_dir):
    units = S.raised_size(F.col("o_totalprice"), 0.001, F.lit(120.0), F.lit(112.5), 0.5, 3000.0, 0.02)
    return table(spark, sf_dir, "orders").select("o_orderkey", units.alias("units"))


@query("sql_functions", "SELECT l_orderkey, l_linenumber, floor(round(l_quantity / 2.5::DOUBLE, 9)) * 2.5::DOUBLE AS step, round(round(l_extendedprice / (pow(10.0, floor(log10(l_extendedprice))) / 2)) * (pow(10.0, floor(log10(l_extendedprice))) / 2), 4) AS near, round((l_extendedprice * 1.1::DOUBLE - l_extendedprice) / (l_extendedprice - l_extendedprice * 0.95::DOUBLE), 6) AS r FROM lineitem")
def sql_functions(spark, sf_dir):
    """The registered SQL functions in a SQL statement: they are inlined, so the plan has no call."""
    register(spark)
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("tf_lines")
    return spark.sql("SELECT l_orderkey, l_linenumber, to_step(l_quantity, 2.5D) AS step, round(nearest_round(l_extendedprice), 4) AS near, round(in_risks(l_extendedprice, l_extendedprice * 0.95D, l_extendedprice * 1.1D), 6) AS r FROM tf_lines")


@query("table_function", "SELECT p_partkey, unnest(range(floor(p_retailprice / 100)::INT, floor((p_retailprice + p_size * 10) / 100)::INT + 1))::INT AS bin FROM part")
def table_function(spark, sf_dir):
    """A row for each price bin that an item's range touches, by a registered table function."""
    register(spark)
    table(spark, sf_dir, "part").createOrReplaceTempView("tf_parts")
    return spark.sql("SELECT p_partkey, b.bin FROM tf_parts, LATERAL price_bins(p_retailprice, p_retailprice + p_size * 10, 100D) b")


@query("aggregate_function", "WITH s AS (SELECT l_suppkey, l_quantity / sum(l_quantity) OVER (PARTITION BY l_suppkey) AS p FROM lineitem) SELECT l_suppkey, round(-sum(p * ln(p)), 6) AS entropy FROM s GROUP BY 1")
def aggregate_function(spark, sf_dir):
    """Entropy of each supplier's quantities by a registered aggregate."""
    register(spark)
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("tf_lines")
    return spark.sql("SELECT l_suppkey, round(share_entropy(l_quantity), 6) AS entropy FROM tf_lines GROUP BY l_suppkey")
