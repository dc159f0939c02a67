"""More registered queries: statistics, sets, ranks and recurrences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickframe.operators import aggregates as A
from tickframe.operators import frames as W
from tickframe.operators import parallel as P
from tickframe.plans.queries import BARS, OVER, RACE, TICKS, hourly, query, race, rounded, table, ticks

NEXT = f"r AS (SELECT *, lead(close) OVER {OVER} / close - 1 AS fwd FROM bars), x AS (SELECT * FROM r WHERE fwd IS NOT NULL)"


def ahead(spark, sf_dir):
    """Hourly bars with the return to the next close."""
    return hourly(spark, sf_dir).withColumn("fwd", F.lead("close").over(W.order()) / F.col("close") - 1).where("fwd is not null")


@query("rank_ic", f"WITH {BARS}, {NEXT}, k AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY volume) + (count(*) OVER (PARTITION BY symbol, volume) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY symbol ORDER BY fwd) + (count(*) OVER (PARTITION BY symbol, fwd) - 1) / 2.0::DOUBLE AS b FROM x) SELECT symbol, count(*) AS n, round(corr(a, b), 6) AS ic FROM k GROUP BY 1")
def rank_ic(spark, sf_dir):
    def rank(c):
        return F.rank().over(Window.partitionBy("symbol").orderBy(c)) + (F.count("*").over(Window.partitionBy("symbol", c)) - 1) / 2

    rows = ahead(spark, sf_dir).select("symbol", rank("volume").alias("a"), rank("fwd").alias("b"))
    return rounded(rows.groupBy("symbol").agg(F.count("*").alias("n"), F.corr("a", "b").alias("ic")), "symbol", "n", "ic")


@query("brier", f"WITH {BARS}, {NEXT} SELECT symbol, round(avg(pow(buy / volume - (fwd > 0)::INT, 2)), 6) AS brier FROM x WHERE volume > 0 GROUP BY 1")
def brier(spark, sf_dir):
    """Squared error of the bought share as a forecast of a rise."""
    rows = ahead(spark, sf_dir).where("volume > 0")
    return rounded(rows.groupBy("symbol").agg(F.avg(F.pow(F.col("buy") / F.col("volume") - (F.col("fwd") > 0).cast("int"), 2)).alias("brier")), "symbol", "brier")


@query("decile_lift", f"WITH {BARS}, {NEXT}, d AS (SELECT symbol, ntile(10) OVER (PARTITION BY symbol ORDER BY volume, bar)::INT AS decile, fwd FROM x) SELECT symbol, decile, count(*) AS n, round(avg(fwd), 6) AS mean, round(avg((fwd > 0)::INT), 6) AS up FROM d GROUP BY 1, 2")
def decile_lift(spark, sf_dir):
    rows = ahead(spark, sf_dir).withColumn("decile", F.ntile(10).over(Window.partitionBy("symbol").orderBy("volume", "bar")))
    return rounded(rows.groupBy("symbol", "decile").agg(F.count("*").alias("n"), F.avg("fwd").alias("mean"), A.share(F.col("fwd") > 0).alias("up")), "symbol", "decile", "n", "mean", "up")


HAC = f"""WITH {BARS}, {NEXT}, m AS (SELECT symbol, bar, fwd - avg(fwd) OVER (PARTITION BY symbol) AS e, fwd FROM x),
 l AS (SELECT symbol, fwd, e, lag(e) OVER {OVER} AS e1, lag(e, 2) OVER {OVER} AS e2, lag(e, 3) OVER {OVER} AS e3 FROM m),
 s AS (SELECT symbol, count(*) AS n, avg(fwd) AS mean, sum(e * e) + 2 * (0.75::DOUBLE * sum(coalesce(e * e1, 0)) + 0.5::DOUBLE * sum(coalesce(e * e2, 0)) + 0.25::DOUBLE * sum(coalesce(e * e3, 0))) AS v FROM l GROUP BY 1)
 SELECT symbol, n, round(mean, 6) AS mean, CASE WHEN v > 0 THEN round(mean / (sqrt(v) / n), 4) END AS t FROM s"""


@query("hac_t", HAC)
def hac_t(spark, sf_dir):
    """t of the mean next return with Bartlett weights to lag 3."""
    e = ahead(spark, sf_dir).withColumn("e", F.col("fwd") - F.avg("fwd").over(Window.partitionBy("symbol")))
    lags = e.withColumns({f"e{k}": F.col("e") * F.lag("e", k).over(W.order()) for k in (1, 2, 3)})
    v = F.sum(F.col("e") * F.col("e")) + sum((2 * (1 - k / 4) * F.sum(F.coalesce(f"e{k}", F.lit(0.0))) for k in (1, 2, 3)), F.lit(0.0))
    out = lags.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("fwd").alias("mean"), v.alias("v"))
    return out.select("symbol", "n", F.round("mean", 6).alias("mean"), F.when(F.col("v") > 0, F.round(F.col("mean") / (F.sqrt("v") / F.col("n")), 4)).alias("t"))


@query("bh_fdr", f"WITH {BARS}, {NEXT}, g AS (SELECT symbol || ':' || strftime(bar, '%H') AS test, avg(fwd) / (stddev_samp(fwd) / sqrt(count(*))) AS t FROM x GROUP BY 1 HAVING count(*) > 4 AND stddev_samp(fwd) > 0), p AS (SELECT test, 2 / (1 + exp(1.702::DOUBLE * abs(t))) AS p FROM g), k AS (SELECT *, row_number() OVER (ORDER BY p, test) AS rank, count(*) OVER () AS m FROM p), l AS (SELECT *, rank / m * 0.1::DOUBLE AS lim FROM k), b AS (SELECT max(rank) AS best FROM l WHERE p <= lim) SELECT test, round(p, 6) AS p, rank, coalesce(rank <= best, FALSE) AS passes FROM l, b")
def bh_fdr(spark, sf_dir):
    """Hours of the day whose mean next return passes Benjamini-Hochberg at 10 % (p by a logistic approximation)."""
    test = F.concat_ws(":", "symbol", F.date_format("bar", "HH"))
    t = F.avg("fwd") / (F.stddev_samp("fwd") / F.sqrt(F.count("*")))
    rows = ahead(spark, sf_dir).groupBy(test.alias("test")).agg(t.alias("t"), F.count("*").alias("c"), F.stddev_samp("fwd").alias("sd")).where("c > 4 and sd > 0")
    out = A.false_discovery(rows.withColumn("p", 2 / (1 + F.exp(1.702 * F.abs("t")))))
    return rounded(out.withColumn("rank", F.col("rank").cast("long")), "test", "p", "rank", "passes")


@query("xsec_rank", f"WITH {BARS}, r AS (SELECT symbol, bar, close / lag(close) OVER {OVER} - 1 AS ret FROM bars), k AS (SELECT *, row_number() OVER (PARTITION BY bar ORDER BY ret DESC, symbol) AS hi, row_number() OVER (PARTITION BY bar ORDER BY ret, symbol) AS lo, count(*) OVER (PARTITION BY bar) AS c FROM r WHERE ret IS NOT NULL) SELECT bar, symbol, round(ret, 6) AS ret, CASE WHEN hi <= 2 THEN 1 ELSE -1 END AS side FROM k WHERE c >= 4 AND (hi <= 2 OR lo <= 2)")
def xsec_rank(spark, sf_dir):
    """The two best and the two worst symbols of each bar."""
    same = Window.partitionBy("bar")
    rows = W.returns(hourly(spark, sf_dir)).where("simple is not null")
    rows = rows.withColumns({"hi": F.row_number().over(same.orderBy(F.desc("simple"), "symbol")), "lo": F.row_number().over(same.orderBy("simple", "symbol")), "c": F.count("*").over(same)})
    rows = rows.where("c >= 4 and (hi <= 2 or lo <= 2)").withColumn("side", F.when(F.col("hi") <= 2, 1).otherwise(-1))
    return rounded(rows, "bar", "symbol", "simple:ret", "side")


@query("losing_streak", f"{RACE}, k AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY bar DESC) AS rn FROM trades) SELECT symbol, coalesce(min(rn) FILTER (r > 0) - 1, count(*)) AS streak FROM k GROUP BY 1")
def losing_streak(spark, sf_dir):
    """Trades without a win since the last one: a row for each symbol is joined back and counted against."""
    trades = race(spark, sf_dir).select("symbol", "bar", "r")
    wins = trades.groupBy("symbol").agg(F.max(F.when(F.col("r") > 0, F.col("bar"))).alias("win"))
    since = F.count_if(F.col("win").isNull() | (F.col("bar") > F.col("win")))
    return trades.join(wins, "symbol").groupBy("symbol").agg(since.alias("streak"))


@query("calendar_tz", "SELECT strftime(o_orderdate + INTERVAL 330 minutes, '%Y-%m-%d') AS day, o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2")
def calendar_tz(spark, sf_dir):
    """Results by day at UTC+05:30."""
    day = F.date_format(F.col("o_orderdate") + F.expr("interval 330 minutes"), "yyyy-MM-dd")
    return rounded(table(spark, sf_dir, "orders").groupBy(day.alias("day"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), "day", "status", "n", "total", to=2)


@query("band_join", f"WITH {TICKS}, p AS (SELECT * FROM ticks WHERE symbol = 'purchase'), c AS (SELECT * FROM ticks WHERE symbol = 'click'), j AS (SELECT p.id, c.id AS near, row_number() OVER (PARTITION BY p.id ORDER BY abs(epoch_us(p.ts) - epoch_us(c.ts)), c.id) AS rn FROM p JOIN c ON p.user_id = c.user_id AND c.ts BETWEEN p.ts - INTERVAL 6 hours AND p.ts + INTERVAL 6 hours) SELECT id, near FROM j WHERE rn = 1")
def band_join(spark, sf_dir):
    """Each purchase with the same user's nearest click within six hours.

    Both sides fall into six-hour buckets; a purchase looks into three, so
    that the join is an equality on user and bucket.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    own = ticks(spark, sf_dir).withColumn("at", at)
    width = 6 * 3600 * 1_000_000
    bucket = F.floor(F.col("at") / width).cast("long")
    left = own.where("symbol = 'purchase'").select("id", "user_id", "at", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("b"))
    right = own.where("symbol = 'click'").select(F.col("id").alias("near"), "user_id", F.col("at").alias("other"), bucket.alias("b"))
    met = left.join(right, ["user_id", "b"]).where(F.abs(F.col("at") - F.col("other")) <= width)
    return met.groupBy("id").agg(F.min(F.struct(F.abs(F.col("at") - F.col("other")), "near")).alias("x")).select("id", F.col("x.near").alias("near"))


@query("set_parity", "WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error') SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'second', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def set_parity(spark, sf_dir):
    """Users of one set, of the other and of both, from one aggregation instead of three set operations."""
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("a"), F.bool_or(F.col("event_type") == "error").alias("b"))
    counts = users.agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("first"), F.count_if(F.col("b") & ~F.col("a")).alias("second"))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("part"), F.col(c).alias("n")) for c in ("both", "first", "second")))).alias("x")).select("x.*")


@query("html_titles", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(html) AS size FROM pages")
def html_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.length("html").cast("long").alias("size"))


@query("chat_ledger", "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, round(avg(length(text)), 4) AS mean FROM conversations GROUP BY 1")
def chat_ledger(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("role")
    return rounded(rows.agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"), F.avg(F.length("text")).alias("mean")), "role", "turns", "conversations", "mean", to=4)


RSI = f"WITH {BARS}, d AS (SELECT symbol, bar, close - lag(close) OVER {OVER} AS s FROM bars), l AS (SELECT symbol, bar, s, list(greatest(s, 0)) FILTER (s IS NOT NULL) OVER {OVER} AS g, list(greatest(-s, 0)) FILTER (s IS NOT NULL) OVER {OVER} AS b FROM d), v AS (SELECT symbol, bar, CASE WHEN s IS NOT NULL THEN list_reduce(g, lambda a, x: a + (x - a) / 14) END AS up, CASE WHEN s IS NOT NULL THEN list_reduce(b, lambda a, x: a + (x - a) / 14) END AS down FROM l) SELECT symbol, bar, CASE WHEN up + down > 0 THEN round(100 * up / (up + down), 4) END AS rsi FROM v"


@query("wilder_rsi", RSI)
def wilder_rsi(spark, sf_dir):
    return rounded(P.wilder_rsi(hourly(spark, sf_dir)), "symbol", "bar", "rsi", to=4)
