"""Registered queries of joins, sets, sorts and keyed writes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickframe.operators import frames as W
from tickframe.operators import joins as J
from tickframe.operators import relations as R
from tickframe.plans.queries import BARS, OVER, TICKS, hourly, query, rounded, table, ticks

DAYS = "dd AS (SELECT symbol, date_trunc('day', bar)::TIMESTAMP AS day, arg_max(close, bar) AS c, count(*) AS n FROM bars GROUP BY 1, 2 HAVING count(*) >= 23)"


def days(spark, sf_dir, least=23):
    out = hourly(spark, sf_dir).groupBy("symbol", F.date_trunc("day", "bar").alias("day")).agg(F.max_by("close", "bar").alias("c"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least)


@query("asof_complete_day", f"WITH {BARS}, {DAYS}, t AS (SELECT symbol, day + INTERVAL 1 day AS bar, CASE WHEN count(*) OVER w >= 5 THEN sign(c - avg(c) OVER w)::INT ELSE 0 END AS trend FROM dd WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT b.symbol, b.bar, coalesce(t.trend, 0) AS trend FROM bars b ASOF LEFT JOIN t ON b.symbol = t.symbol AND b.bar + INTERVAL 1 hour >= t.bar")
def asof_complete_day(spark, sf_dir):
    """Trend of the last day that is complete (23 hours with trades at least) when the bar closes; 0 before there are five."""
    w = Window.partitionBy("symbol").orderBy("day").rowsBetween(-4, 0)
    trend = F.when(F.count("*").over(w) >= 5, F.signum(F.col("c") - F.avg("c").over(w)).cast("int")).otherwise(0)
    known = days(spark, sf_dir).select("symbol", (F.col("day") + F.expr("interval 1 day")).alias("end"), trend.alias("trend"))
    own = hourly(spark, sf_dir).select("symbol", "bar", (F.col("bar") + F.expr("interval 1 hour")).alias("end"))
    return J.as_of(own, known, "end", "symbol", ["trend"]).select("symbol", "bar", F.coalesce("trend", F.lit(0)).alias("trend"))


@query("lagged_change", f"WITH {BARS}, v AS (SELECT symbol, bar, sum(volume) OVER {OVER} AS oi FROM bars WHERE n > 2), a AS (SELECT b.symbol, b.bar, v.oi FROM bars b ASOF LEFT JOIN v ON b.symbol = v.symbol AND b.bar - INTERVAL 1 hour >= v.bar), e AS (SELECT b.symbol, b.bar, v.oi FROM bars b ASOF LEFT JOIN v ON b.symbol = v.symbol AND b.bar - INTERVAL 5 hours >= v.bar) SELECT a.symbol, a.bar, round(a.oi / e.oi - 1, 6) AS change FROM a JOIN e USING (symbol, bar) WHERE e.oi IS NOT NULL AND a.oi IS NOT NULL")
def lagged_change(spark, sf_dir):
    """Change over four hours of a series that is known an hour late: two as-of lookups."""
    own = hourly(spark, sf_dir)
    series = own.where("n > 2").select("symbol", F.col("bar").alias("at"), F.sum("volume").over(W.order().rowsBetween(Window.unboundedPreceding, 0)).alias("oi"))
    at = own.select("symbol", "bar", F.explode(F.array(F.lit(1), F.lit(5))).alias("lag")).withColumn("at", F.col("bar") - F.make_dt_interval(F.lit(0), F.col("lag")))
    both = J.as_of(at, series, "at", "symbol", ["oi"]).groupBy("symbol", "bar").agg(F.max(F.when(F.col("lag") == 1, F.col("oi"))).alias("a"), F.max(F.when(F.col("lag") == 5, F.col("oi"))).alias("e"))
    return both.where("a is not null and e is not null").select("symbol", "bar", F.round(F.col("a") / F.col("e") - 1, 6).alias("change"))


@query("trailing_mean", f"WITH {BARS}, f AS (SELECT symbol, bar, close / open - 1 AS rate FROM bars WHERE hour(bar) % 8 = 0), b0 AS (SELECT symbol, min(bar) AS first FROM f GROUP BY 1), s AS (SELECT b.symbol, b.bar, sum(f.rate) AS total, count(f.rate) AS points FROM bars b LEFT JOIN f ON f.symbol = b.symbol AND f.bar > b.bar - INTERVAL 72 hours AND f.bar <= b.bar GROUP BY 1, 2) SELECT s.symbol, s.bar, CASE WHEN points >= 3 AND first <= s.bar - INTERVAL 64 hours THEN round(total / 9, 6) END AS rate FROM s JOIN b0 USING (symbol)")
def trailing_mean(spark, sf_dir):
    """Mean of the payments in the 72 hours up to a bar: null for under three of them or a history that does not cover the window."""
    own = hourly(spark, sf_dir)
    paid = own.where(F.hour("bar") % 8 == 0).select("symbol", F.col("bar").alias("at"), (F.col("close") / F.col("open") - 1).alias("rate"))
    first = paid.groupBy("symbol").agg(F.min("at").alias("first"))
    spans = own.select("symbol", "bar", F.xxhash64("symbol", "bar").alias("span"), (F.col("bar") - F.expr("interval 72 hours")).alias("low"), F.col("bar").alias("high"))
    sums = J.interval_sums(spans, paid, "symbol", "rate").join(first, "symbol")
    rate = F.when((F.col("points") >= 3) & (F.col("first") <= F.col("bar") - F.expr("interval 64 hours")), F.round(F.col("total") / 9, 6) + 0.0)
    return sums.select("symbol", "bar", rate.alias("rate"))


@query("day_on_hours", f"WITH {BARS}, {DAYS} SELECT b.symbol, b.bar, dd.c AS day_close FROM bars b LEFT JOIN dd ON dd.symbol = b.symbol AND dd.day = date_trunc('day', b.bar) - INTERVAL 1 day")
def day_on_hours(spark, sf_dir):
    coarse = days(spark, sf_dir).select("symbol", F.col("day").alias("bar"), F.col("c").alias("day_close"))
    return R.on_fine_grid(hourly(spark, sf_dir).select("symbol", "bar"), coarse, "symbol", "day", ["day_close"])


@query("leader_features", f"WITH {BARS}, r AS (SELECT symbol, bar, ln(close / lag(close) OVER {OVER}) AS ret FROM bars), m AS (SELECT bar, ret, avg(ret) OVER (ORDER BY bar ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS mean FROM r WHERE symbol = 'view') SELECT r.symbol, r.bar, round(r.ret - m.ret, 6) AS excess, round(m.mean, 6) AS lead_mean FROM r LEFT JOIN m USING (bar) WHERE r.symbol <> 'view'")
def leader_features(spark, sf_dir):
    """Features of one leading symbol joined by time to all others; null where it has no bar."""
    r = W.returns(hourly(spark, sf_dir))
    lead = r.where("symbol = 'view'").withColumn("lead_mean", F.avg("ret").over(W.last(12))).select("bar", F.col("ret").alias("lead"), "lead_mean")
    rows = r.where("symbol <> 'view'").join(lead, "bar", "left").withColumn("excess", F.col("ret") - F.col("lead"))
    return rounded(rows, "symbol", "bar", "excess", "lead_mean")


@query("last_purchase", f"WITH {TICKS}, p AS (SELECT user_id, ts, id, price FROM ticks WHERE symbol = 'purchase'), l AS (SELECT user_id, ts, arg_max(price, id) AS price FROM p GROUP BY 1, 2) SELECT c.id, l.price AS bought FROM (SELECT * FROM ticks WHERE symbol = 'click') c ASOF LEFT JOIN l ON c.user_id = l.user_id AND c.ts >= l.ts")
def last_purchase(spark, sf_dir):
    """Each click with the newest purchase of its user up to then."""
    own = ticks(spark, sf_dir)
    bought = own.where("symbol = 'purchase'").groupBy("user_id", "ts").agg(F.max_by("price", "id").alias("bought"))
    return J.as_of(own.where("symbol = 'click'").select("id", "user_id", "ts"), bought, "ts", "user_id", ["bought"]).select("id", "bought")


@query("open_gaps", f"WITH {BARS}, g AS (SELECT *, lag(high, 2) OVER {OVER} AS oh, lag(low, 2) OVER {OVER} AS ol FROM bars) SELECT symbol, bar, round(ol, 6) AS top FROM g WHERE high < ol AND NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = g.symbol AND b.bar > g.bar AND b.high >= g.ol)")
def open_gaps(spark, sf_dir):
    """Gaps down that no later high has filled: the anti-join with later bars is their running maximum, seen from the end."""
    rows = hourly(spark, sf_dir)
    later = Window.partitionBy("symbol").orderBy(F.desc("bar")).rowsBetween(Window.unboundedPreceding, -1)
    old = F.lag("low", 2).over(W.order())
    marked = rows.withColumns({"top": old, "after": F.max("high").over(later)}).where("high < top")
    return marked.where("after is null or after < top").select("symbol", "bar", F.round("top", 6).alias("top"))


@query("idle_customers", "SELECT c_custkey FROM customer c WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def idle_customers(spark, sf_dir):
    """Customers without an open order."""
    return R.without(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("active_customers", "SELECT c_custkey, c_name FROM customer c WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def active_customers(spark, sf_dir):
    return R.among(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


TWO = "a AS (SELECT o_orderkey AS k, o_totalprice AS price, o_orderstatus AS status FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 2 = 0 THEN 'F' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 7 <> 0)"


def two(spark, sf_dir):
    """Two versions of the orders: what is held and what comes."""
    rows, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    old = rows.where(k % 5 != 0).select(k.alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    price = F.when(k % 3 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    new = rows.where(k % 7 != 0).select(k.alias("k"), price.alias("price"), F.when(k % 2 == 0, "F").otherwise(F.col("o_orderstatus")).alias("status"))
    return old, new


@query("reconcile_outer", f"WITH {TWO} SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'only_own' WHEN a.k IS NULL THEN 'only_other' WHEN abs(a.price - b.price) > 0.5 THEN 'changed' ELSE 'same' END AS state FROM a FULL JOIN b ON a.k = b.k")
def reconcile_outer(spark, sf_dir):
    old, new = two(spark, sf_dir)
    return R.reconciled(old, new, ["k"], ["price"], 0.5).select("k", "state")


@query("upsert_final", f"WITH {TWO} SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL OR a.status = 'F' THEN a.price ELSE b.price END AS price, CASE WHEN b.k IS NULL OR a.status = 'F' THEN a.status ELSE b.status END AS status FROM a FULL JOIN b ON a.k = b.k")
def upsert_final(spark, sf_dir):
    return R.kept_final(*two(spark, sf_dir), ["k"], "status", ["F"])


@query("upsert_columns", f"WITH {TWO}, c AS (SELECT k, CASE WHEN k % 4 = 0 THEN NULL ELSE price END AS price, status FROM b) SELECT coalesce(a.k, c.k) AS k, coalesce(c.price, a.price) AS price, coalesce(c.status, a.status) AS status FROM a FULL JOIN c ON a.k = c.k")
def upsert_columns(spark, sf_dir):
    old, new = two(spark, sf_dir)
    return R.patched(old, new.withColumn("price", F.when(F.col("k") % 4 != 0, F.col("price"))), ["k"])


@query("upsert_rows", f"WITH {TWO} SELECT * FROM b UNION ALL SELECT * FROM a WHERE k NOT IN (SELECT k FROM b)")
def upsert_rows(spark, sf_dir):
    return R.replaced(*two(spark, sf_dir), ["k"])


@query("insert_new", f"WITH {TWO} SELECT * FROM a UNION ALL SELECT * FROM b WHERE k NOT IN (SELECT k FROM a)")
def insert_new(spark, sf_dir):
    return R.added(*two(spark, sf_dir), ["k"])


@query("bounded_log", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 2000")
def bounded_log(spark, sf_dir):
    """The newest 2000 rows (the bound is the feature)."""
    return R.newest(table(spark, sf_dir, "events").select("event_id", "ts", "event_type"), 2000, "ts", "event_id")


@query("merged_history", f"WITH {TWO} SELECT k, price, status FROM (SELECT * FROM b UNION ALL SELECT * FROM a WHERE k NOT IN (SELECT k FROM b)) ORDER BY price DESC, k DESC LIMIT 1200")
def merged_history(spark, sf_dir):
    """Histories merged by key, the newest (here: largest) 1200 kept."""
    return R.newest(R.replaced(*two(spark, sf_dir), ["k"]), 1200, "price", "k")


@query("first_by_key", "SELECT user_id, event_type, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def first_by_key(spark, sf_dir):
    return R.first_of(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"])


@query("mirrored_bars", f"WITH {BARS}, m AS (SELECT symbol, bar, high, low, close, 1 AS side FROM bars UNION ALL SELECT symbol, bar, -low, -high, -close, -1 FROM bars) SELECT symbol, side, count(*) AS n, round(avg(high - low), 6) AS span, round(avg(close), 6) AS mean FROM m GROUP BY 1, 2")
def mirrored_bars(spark, sf_dir):
    rows = R.mirrored(hourly(spark, sf_dir)).groupBy("symbol", "side")
    return rounded(rows.agg(F.count("*").alias("n"), F.avg(F.col("high") - F.col("low")).alias("span"), F.avg("close").alias("mean")), "symbol", "side", "n", "span", "mean")


@query("blacklist", "SELECT DISTINCT event_type AS symbol FROM events WHERE event_type NOT IN ('error', 'view')")
def blacklist(spark, sf_dir):
    every = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol")).distinct()
    return R.without(every, spark.createDataFrame([("error",), ("view",)], "symbol string"), "symbol")


@query("job_grid", "SELECT r_name AS region, n_name AS nation FROM region, nation WHERE r_regionkey <= n_regionkey")
def job_grid(spark, sf_dir):
    """Pairs of two small tables: every region with the nations of its own and later regions."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.select("n_name", F.explode(F.sequence(F.lit(0), F.col("n_regionkey"))).alias("r_regionkey")).join(region, "r_regionkey").select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"))


@query("odds_lookup", "WITH o AS (SELECT l_returnflag AS flag, CASE WHEN l_quantity >= 40 THEN 2 WHEN l_quantity >= 20 THEN 1 ELSE 0 END AS bucket, l_orderkey, l_linenumber, l_discount FROM lineitem), t AS (SELECT flag, bucket, avg(l_discount) AS odds FROM o WHERE l_orderkey % 2 = 0 GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, bucket, round(odds, 6) AS odds FROM o LEFT JOIN t USING (flag, bucket)")
def odds_lookup(spark, sf_dir):
    """Rows with the odds of their flag and bucket of quantity, learned from half of the orders."""
    rows, edges = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "flag"), [0.0, 20.0, 40.0]
    place = F.when(F.col("l_quantity") >= 40, 2).when(F.col("l_quantity") >= 20, 1).otherwise(0)
    odds = rows.where("l_orderkey % 2 = 0").groupBy("flag", place.alias("bucket")).agg(F.avg("l_discount").alias("odds"))
    return R.bucketed(rows, odds, F.col("l_quantity"), edges, ["flag"]).select("l_orderkey", "l_linenumber", "bucket", F.round("odds", 6).alias("odds"))


LEVELS = "lv AS (SELECT DISTINCT symbol, round(high, 0) AS level FROM bars WHERE n >= 6)"


@query("nearest_levels", f"WITH {BARS}, {LEVELS} SELECT b.symbol, b.bar, (SELECT max(level) FROM lv WHERE lv.symbol = b.symbol AND level <= b.close) AS below, (SELECT min(level) FROM lv WHERE lv.symbol = b.symbol AND level > b.close) AS above FROM bars b")
def nearest_levels(spark, sf_dir):
    own = hourly(spark, sf_dir)
    levels = own.where("n >= 6").select("symbol", F.round("high", 0).alias("level")).distinct()
    return R.nearest_levels(own.select("symbol", "bar", "close"), levels, "symbol", "close").select("symbol", "bar", "below", "above")


@query("level_clusters", f"WITH {BARS}, l AS (SELECT symbol, round(high, 1) AS level, count(*) AS weight FROM bars GROUP BY 1, 2), m AS (SELECT *, CASE WHEN level / lag(level) OVER w - 1 <= 0.003 THEN 0 ELSE 1 END AS st FROM l WINDOW w AS (PARTITION BY symbol ORDER BY level)), c AS (SELECT *, sum(st) OVER (PARTITION BY symbol ORDER BY level) AS cluster FROM m) SELECT symbol, cluster::BIGINT AS cluster, arg_max(level, (weight, -level)) AS level, sum(weight)::BIGINT AS weight, count(*) AS merged FROM c GROUP BY 1, 2")
def level_clusters(spark, sf_dir):
    levels = hourly(spark, sf_dir).groupBy("symbol", F.round("high", 1).alias("level")).agg(F.count("*").alias("weight"))
    return R.clustered_levels(levels, "symbol", 0.003).select("symbol", "cluster", "level", "weight", "merged")


@query("knn", "SELECT query, near, rank::INT AS rank, round(d, 4) AS distance FROM (SELECT q.vec_id AS query, p.vec_id AS near, list_distance(q.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), p.vec_id) AS rank FROM embeddings q, embeddings p WHERE q.vec_id % 20 = 0 AND q.vec_id <> p.vec_id) WHERE rank <= 5")
def knn(spark, sf_dir):
    """The five nearest vectors of every vector whose id is divisible by 20: a stated query set against all rows."""
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return R.nearest_rows(points.where("id % 20 = 0"), points, 5).select("query", "near", "rank", F.round("distance", 4).alias("distance"))


@query("universe_median", f"WITH {BARS}, r AS (SELECT symbol, bar, close / lag(close) OVER {OVER} - 1 AS ret FROM bars), m AS (SELECT bar, median(ret) AS med FROM r WHERE ret IS NOT NULL GROUP BY 1) SELECT symbol, bar, round(ret - med, 6) AS excess FROM r JOIN m USING (bar) WHERE ret IS NOT NULL")
def universe_median(spark, sf_dir):
    """Return less the median of all symbols at the same bar."""
    rows = W.returns(hourly(spark, sf_dir)).where("simple is not null")
    med = rows.groupBy("bar").agg(F.percentile("simple", F.lit(0.5)).alias("med"))
    return rows.join(med, "bar").select("symbol", "bar", F.round(F.col("simple") - F.col("med"), 6).alias("excess"))


@query("adverse_exit", f"WITH {BARS}, n AS (SELECT *, row_number() OVER {OVER} AS i FROM bars), m AS (SELECT bar, close FROM bars WHERE symbol = 'view'), t AS (SELECT n.symbol, n.bar, m.close AS start FROM n JOIN m USING (bar) WHERE n.symbol <> 'view' AND n.n >= 5), x AS (SELECT t.symbol, t.bar, min(m.bar) FILTER (m.close <= t.start * 0.5::DOUBLE) AS exit FROM t LEFT JOIN m ON m.bar > t.bar AND m.bar <= t.bar + INTERVAL 24 hours GROUP BY 1, 2) SELECT * FROM x")
def adverse_exit(spark, sf_dir):
    """When, in the day after a trade's entry, the leading symbol first closes at half its price of then.

    The leader's path of a day is bounded, so it is an array on its own bars, and trades join it by time alone.
    """
    own = hourly(spark, sf_dir)
    path = F.collect_list(F.struct("bar", "close")).over(Window.partitionBy("symbol").orderBy(F.unix_seconds(F.col("bar").cast("timestamp"))).rangeBetween(1, 24 * 3600))
    lead = own.where("symbol = 'view'").select("bar", F.col("close").alias("start"), path.alias("path"))
    first = F.array_min(F.transform(F.filter("path", lambda x: x["close"] <= F.col("start") * 0.5), lambda x: x["bar"]))
    return own.where("symbol <> 'view' and n >= 5").select("symbol", "bar").join(lead, "bar").select("symbol", "bar", first.alias("exit"))


# Sorts


@query("sorted_names", "SELECT c_custkey, row_number() OVER (ORDER BY lower(c_mktsegment), c_acctbal DESC, c_custkey)::INT AS place FROM customer QUALIFY place <= 500")
def sorted_names(spark, sf_dir):
    """A page of rows in the order of text (whatever the letters' case), number, key: a top-k that Spark merges."""
    order = [F.lower("c_mktsegment").asc(), F.desc("c_acctbal"), F.asc("c_custkey")]
    page = table(spark, sf_dir, "customer").orderBy(*order).limit(500)
    return page.select("c_custkey", F.row_number().over(Window.orderBy(*order)).alias("place"))


@query("stable_sort", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_quantity, l_linenumber)::INT AS place FROM lineitem")
def stable_sort(spark, sf_dir):
    """Lines of an order by flag and quantity, equal ones in their own order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_returnflag", "l_quantity", "l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(order).alias("place"))


@query("top_customers", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey DESC LIMIT 50")
def top_customers(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("o_custkey")).limit(50)


@query("outer_fifths", f"WITH {TICKS}, u AS (SELECT date_trunc('day', ts) AS day, user_id, sum(price) AS v FROM ticks GROUP BY 1, 2), k AS (SELECT *, ntile(5) OVER (PARTITION BY day ORDER BY v, user_id) AS fifth FROM u) SELECT strftime(day, '%Y-%m-%d') AS day, user_id, CASE fifth WHEN 5 THEN 1 ELSE -1 END AS side FROM k WHERE fifth IN (1, 5)")
def outer_fifths(spark, sf_dir):
    """Of each day the fifth of users with the most value and the fifth with the least."""
    sums = ticks(spark, sf_dir).groupBy(F.to_date("ts").cast("string").alias("day"), "user_id").agg(F.sum("price").alias("v"))
    fifth = F.ntile(5).over(Window.partitionBy("day").orderBy("v", "user_id"))
    return sums.withColumn("fifth", fifth).where("fifth in (1, 5)").select("day", "user_id", F.when(F.col("fifth") == 5, 1).otherwise(-1).alias("side"))


@query("kth_largest", f"WITH {BARS}, k AS (SELECT symbol, volume, row_number() OVER (PARTITION BY symbol ORDER BY volume DESC, bar) AS rn FROM bars), t AS (SELECT symbol, volume AS cut FROM k WHERE rn = 25) SELECT b.symbol, t.cut, count(*) AS n FROM bars b JOIN t USING (symbol) WHERE b.volume >= t.cut GROUP BY 1, 2")
def kth_largest(spark, sf_dir):
    """The threshold that 25 bars of a symbol reach, and how many do (ties pass)."""
    own = hourly(spark, sf_dir).select("symbol", "bar", "volume")
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("volume"), "bar"))
    cut = own.withColumn("rn", rank).where("rn = 25").select("symbol", F.col("volume").alias("cut"))
    return own.join(cut, "symbol").where("volume >= cut").groupBy("symbol", "cut").agg(F.count("*").alias("n"))


