"""Registered queries of statistics, summaries and portfolio figures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickframe.functions.scalars import ratio
from tickframe.operators import aggregates as A
from tickframe.operators import frames as W
from tickframe.operators import quantiles as Q
from tickframe.plans.queries import BARS, OVER, PNL, RACE, TICKS, hourly, ledger, query, race, rounded, table, ticks
from tickframe.plans.reports import NEXT, ahead

# Statistics

TEST = f"WITH {BARS}, {NEXT}, g AS (SELECT symbol, hour(bar) AS hour, count(*) AS n, avg(fwd) AS mean, stddev_samp(fwd) AS sd, avg(fwd) FILTER (bar < TIMESTAMP '2024-01-16') AS a, avg(fwd) FILTER (bar >= TIMESTAMP '2024-01-16') AS b FROM x GROUP BY 1, 2), t AS (SELECT *, CASE WHEN n > 4 AND sd > 0 THEN mean / (sd / sqrt(n)) END AS t FROM g)"
Z, K = "abs(t)", "(1 / (1 + 0.2316419::DOUBLE * abs(t)))"
P = f"2 * exp(-{Z} * {Z} / 2) / sqrt(2 * pi()) * (0.319381530::DOUBLE * {K} - 0.356563782::DOUBLE * pow({K}, 2) + 1.781477937::DOUBLE * pow({K}, 3) - 1.821255978::DOUBLE * pow({K}, 4) + 1.330274429::DOUBLE * pow({K}, 5))"


def tests(spark, sf_dir):
    half = F.col("bar") < F.lit("2024-01-16").cast("timestamp_ntz")
    rows = ahead(spark, sf_dir).groupBy("symbol", F.hour("bar").alias("hour"))
    out = rows.agg(F.count("*").alias("n"), F.avg("fwd").alias("mean"), F.stddev_samp("fwd").alias("sd"), F.avg(F.when(half, F.col("fwd"))).alias("a"), F.avg(F.when(~half, F.col("fwd"))).alias("b"))
    return out.withColumn("t", F.when((F.col("n") > 4) & (F.col("sd") > 0), F.col("mean") / (F.col("sd") / F.sqrt("n"))))


@query("normal_p", f"{TEST} SELECT symbol, hour, round(t, 6) AS t, round({P}, 6) AS p FROM t")
def normal_p(spark, sf_dir):
    return rounded(tests(spark, sf_dir).withColumn("p", A.two_sided_p(F.col("t"))).withColumn("hour", F.col("hour").cast("long")), "symbol", "hour", "t", "p")


@query("gate_verdict", f"{TEST} SELECT symbol, hour, CASE WHEN t IS NULL THEN 'insufficient' WHEN abs(t) < 2 THEN 'not_significant' WHEN NOT coalesce(sign(a) = sign(b) AND sign(a) = sign(mean), FALSE) THEN 'inconsistent' WHEN abs(mean) <= 0.5 THEN 'under_cost' ELSE 'survives' END AS verdict FROM t")
def gate_verdict(spark, sf_dir):
    rows = tests(spark, sf_dir)
    return rows.select("symbol", F.col("hour").cast("long").alias("hour"), A.verdict(F.col("t"), F.col("mean"), F.col("a"), F.col("b"), 0.5).alias("verdict"))


BOOT = f"""{NEXT}, o AS (SELECT symbol, ln(1 + fwd) AS v, row_number() OVER (PARTITION BY symbol ORDER BY bar) - 1 AS i FROM r WHERE fwd IS NOT NULL), p AS (SELECT symbol, i, sum(v) OVER (PARTITION BY symbol ORDER BY i) - v AS s FROM o),
 w AS (SELECT symbol, count(*) AS n, avg(v) AS mean FROM o GROUP BY 1), b AS (SELECT symbol, n, mean, rd, unnest(range(0, n // 24)) AS j FROM w, (SELECT unnest(range(0, 100)) AS rd)), c AS (SELECT *, ((rd * 7919 + j * 104729 + 12345) % 2147483647 * 48271 % 2147483647) % (n - 24) AS st FROM b),
 m AS (SELECT c.symbol, rd, any_value(mean) AS mean, sum(y.s - x.s) / (count(*) * 24) AS m FROM c JOIN p x ON x.symbol = c.symbol AND x.i = st JOIN p y ON y.symbol = c.symbol AND y.i = st + 24 GROUP BY 1, 2)"""


@query("bootstrap_p", f"WITH {BARS}, {BOOT} SELECT symbol, round(any_value(mean), 6) AS mean, (count(*) FILTER (abs(m - mean) >= abs(mean)) + 1) / 101.0::DOUBLE AS p FROM m GROUP BY symbol")
def bootstrap_p(spark, sf_dir):
    rows = ahead(spark, sf_dir).withColumn("v", F.log1p("fwd"))
    return A.block_bootstrap(rows, "symbol", "bar", "v", 24, 100).select("symbol", F.round("mean", 6).alias("mean"), "p")


@query("pearson_pairs", f"WITH {BARS}, r AS (SELECT symbol, bar, ln(close / lag(close) OVER {OVER}) AS ret FROM bars) SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, round(corr(a.ret, b.ret), 6) AS rho FROM r a JOIN r b ON a.bar = b.bar AND a.symbol < b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2")
def pearson_pairs(spark, sf_dir):
    return rounded(correlations(spark, sf_dir), "a", "b", "n", "rho")


def correlations(spark, sf_dir):
    r = W.returns(hourly(spark, sf_dir)).where("ret is not null")
    a, b = (r.select(F.col("symbol").alias(n), "bar", F.col("ret").alias(v)) for n, v in (("a", "x"), ("b", "y")))
    return a.join(b, "bar").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("rho"))


@query("effective_rank", f"WITH {BARS}, r AS (SELECT symbol, bar, ln(close / lag(close) OVER {OVER}) AS ret FROM bars), c AS (SELECT corr(a.ret, b.ret) AS rho FROM r a JOIN r b ON a.bar = b.bar AND a.symbol < b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY a.symbol, b.symbol), k AS (SELECT count(DISTINCT symbol) AS k FROM bars) SELECT k AS symbols, round(k * k / (k + 2 * sum(rho * rho)), 6) AS rank FROM c, k GROUP BY k")
def effective_rank(spark, sf_dir):
    """Participation ratio of the eigenvalues of the correlation matrix: its squared trace over the trace of its square, so the sum of squared correlations is all it needs."""
    rho = correlations(spark, sf_dir).agg(F.sum(F.col("rho") * F.col("rho")).alias("q"), F.array_size(F.collect_set("a")).alias("m"))
    k = (F.col("m") + 1).cast("long")
    return rho.select(k.alias("symbols"), F.round(k * k / (k + 2 * F.col("q")), 6).alias("rank"))


TE = f"d AS (SELECT bar, symbol, (close > lag(close) OVER {OVER})::INT AS u, lag(close) OVER {OVER} AS ok FROM bars), j AS (SELECT x.bar, y.u AS now, lag(y.u) OVER w AS own, lag(x.u) OVER w AS other FROM d x JOIN d y ON x.bar = y.bar WHERE x.symbol = 'view' AND y.symbol = 'click' AND x.ok IS NOT NULL AND y.ok IS NOT NULL WINDOW w AS (ORDER BY x.bar)), c AS (SELECT now, own, other, count(*)::DOUBLE AS n FROM j WHERE own IS NOT NULL GROUP BY 1, 2, 3), m AS (SELECT *, sum(n) OVER (PARTITION BY own, other) AS no, sum(n) OVER (PARTITION BY now, own) AS nn, sum(n) OVER (PARTITION BY own) AS o, sum(n) OVER () AS t FROM c)"


@query("transfer_entropy", f"WITH {BARS}, {TE} SELECT round(sum(n / t * ln((n / no) / (nn / o))), 6) AS te, sum(n)::BIGINT AS n FROM m")
def transfer_entropy(spark, sf_dir):
    """What the last direction of one symbol says about another's next one beyond its own last: from eight counts."""
    d = hourly(spark, sf_dir).withColumn("old", F.lag("close").over(W.order())).where("old is not null").select("symbol", "bar", (F.col("close") > F.col("old")).cast("int").alias("u"))
    x, y = d.where("symbol = 'view'").select("bar", F.col("u").alias("x")), d.where("symbol = 'click'").select("bar", F.col("u").alias("y"))
    w = Window.orderBy("bar")
    rows = x.join(y, "bar").select(F.col("y").alias("now"), F.lag("y").over(w).alias("own"), F.lag("x").over(w).alias("other")).where("own is not null")
    counts = rows.groupBy("now", "own", "other").agg(F.count("*").cast("double").alias("n"))
    total = {k: F.sum("n").over(Window.partitionBy(*by)) for k, by in {"no": ("own", "other"), "nn": ("now", "own"), "o": ("own",), "t": (F.lit(0),)}.items()}
    m = counts.withColumns(total)
    n = F.col("n")
    return m.agg(F.round(F.sum(n / F.col("t") * F.log((n / F.col("no")) / (F.col("nn") / F.col("o")))), 6).alias("te"), F.sum("n").cast("long").alias("n"))


@query("sign_predictors", f"WITH {BARS}, r AS (SELECT symbol, bar, close / lag(close) OVER {OVER} - 1 AS ret FROM bars), s AS (SELECT *, lag(ret) OVER {OVER} AS old, avg(ret) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS mean FROM r) SELECT symbol, count(*) AS n, round(avg((sign(ret) = sign(old))::INT), 6) AS persist, round(avg((sign(ret) = -sign(old))::INT), 6) AS reverse, round(avg((sign(ret) = sign(mean))::INT), 6) AS trend FROM s WHERE old IS NOT NULL AND ret <> 0 GROUP BY 1")
def sign_predictors(spark, sf_dir):
    r = W.returns(hourly(spark, sf_dir)).withColumn("ret", F.col("simple"))
    r = r.withColumns({"old": F.lag("ret").over(W.order()), "mean": F.avg("ret").over(W.before(12))}).where("old is not null and ret <> 0")
    s = F.signum("ret")
    return rounded(r.groupBy("symbol").agg(F.count("*").alias("n"), A.share(s == F.signum("old")).alias("persist"), A.share(s == -F.signum("old")).alias("reverse"), A.share(s == F.signum("mean")).alias("trend")), "symbol", "n", "persist", "reverse", "trend")


@query("volatility_r2", f"WITH {BARS}, r AS (SELECT symbol, bar, ln(close / lag(close) OVER {OVER}) AS ret FROM bars), v AS (SELECT symbol, stddev_samp(ret) OVER a AS past, count(ret) OVER a AS ca, stddev_samp(ret) OVER b AS next, count(ret) OVER b AS cb FROM r WINDOW a AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), b AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING)) SELECT symbol, count(*) AS n, round(pow(corr(past, next), 2), 6) AS r2 FROM v WHERE ca = 24 AND cb = 24 GROUP BY 1")
def volatility_r2(spark, sf_dir):
    after = W.order().rowsBetween(1, 24)
    r = W.returns(hourly(spark, sf_dir)).select("symbol", F.stddev_samp("ret").over(W.last(24)).alias("past"), F.count("ret").over(W.last(24)).alias("ca"), F.stddev_samp("ret").over(after).alias("next"), F.count("ret").over(after).alias("cb"))
    return rounded(r.where("ca = 24 and cb = 24").groupBy("symbol").agg(F.count("*").alias("n"), F.pow(F.corr("past", "next"), 2).alias("r2")), "symbol", "n", "r2")


@query("percentile_cuts", "SELECT o_orderpriority AS priority, round(quantile_cont(o_totalprice, 0.1), 4) AS p10, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY 1")
def percentile_cuts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "priority")
    return rounded(Q.percentile_columns(rows, ["priority"], "o_totalprice", {"p10": 0.1, "p50": 0.5, "p90": 0.9}), "priority", "p10", "p50", "p90", to=4)


@query("edge_pauses", f"{RACE}, s AS (SELECT symbol, hour(bar) // 6 AS part, count(*)::DOUBLE AS n, count(*) FILTER (r > 0)::DOUBLE AS k, sum(r) AS total, sum(r * r) AS q FROM trades GROUP BY 1, 2), h AS (SELECT *, (k / n + 1.96 * 1.96::DOUBLE / (2 * n) + 1.96::DOUBLE * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96::DOUBLE / (4 * n * n))) / (1 + 1.96 * 1.96::DOUBLE / n) AS high, total / n + 2 * sqrt(greatest(0, q - total * total / n) / (n - 1) / n) AS top FROM s) SELECT symbol, part, n::BIGINT AS n, round(high, 6) AS high FROM h WHERE n >= 20 AND (high < 0.45 OR top < 0)")
def edge_pauses(spark, sf_dir):
    """Groups of trades whose win rate or mean is, at its upper bound, below break-even."""
    rows = race(spark, sf_dir).withColumn("part", F.call_function("div", F.hour("bar"), F.lit(6)))
    s = rows.groupBy("symbol", "part").agg(F.count("*").alias("n"), F.count_if(F.col("r") > 0).alias("k"), F.sum("r").alias("total"), F.sum(F.col("r") * F.col("r")).alias("q"))
    n = F.col("n").cast("double")
    _, high = A.wilson(F.col("k").cast("double"), n)
    top = F.col("total") / n + 2 * F.sqrt(F.greatest(F.lit(0.0), F.col("q") - F.col("total") * F.col("total") / n) / (n - 1) / n)
    return s.withColumn("high", high).where((F.col("n") >= 20) & ((F.col("high") < 0.45) | (top < 0))).select("symbol", "part", "n", F.round("high", 6).alias("high"))


@query("harvest_stats", f"WITH {BARS}, f AS (SELECT symbol, bar, close / open - 1 AS rate, lag(close / open - 1) OVER {OVER} AS old FROM bars WHERE hour(bar) % 8 = 0) SELECT symbol, count(*) AS n, round(avg(rate), 6) AS always, round(avg(CASE WHEN old > 0 THEN rate ELSE 0 END), 6) AS selective, count(*) FILTER (sign(rate) <> sign(old)) AS changes FROM f WHERE old IS NOT NULL GROUP BY 1")
def harvest_stats(spark, sf_dir):
    """A periodic payment taken always, or only after a positive one; and how often its sign changes."""
    rows = hourly(spark, sf_dir).where(F.hour("bar") % 8 == 0).withColumn("rate", F.col("close") / F.col("open") - 1)
    rows = rows.withColumn("old", F.lag("rate").over(W.order())).where("old is not null")
    return rounded(rows.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("rate").alias("always"), F.avg(F.when(F.col("old") > 0, F.col("rate")).otherwise(0.0)).alias("selective"), F.count_if(F.signum("rate") != F.signum("old")).alias("changes")), "symbol", "n", "always", "selective", "changes")


@query("separation_t", f"{RACE}, g AS (SELECT symbol, avg(r) FILTER (hour(bar) < 12) AS a, avg(r) FILTER (hour(bar) >= 12) AS b, var_samp(r) FILTER (hour(bar) < 12) / count(*) FILTER (hour(bar) < 12) + var_samp(r) FILTER (hour(bar) >= 12) / count(*) FILTER (hour(bar) >= 12) AS v FROM trades GROUP BY 1) SELECT symbol, CASE WHEN v > 0 THEN round((a - b) / sqrt(v), 6) END AS t FROM g")
def separation_t(spark, sf_dir):
    """t of the difference between two parts of the trades, each with its own variance."""
    early = F.hour("bar") < 12
    a, b = F.when(early, F.col("r")), F.when(~early, F.col("r"))
    g = race(spark, sf_dir).groupBy("symbol").agg(F.avg(a).alias("a"), F.avg(b).alias("b"), (F.var_samp(a) / F.count(a) + F.var_samp(b) / F.count(b)).alias("v"))
    return g.select("symbol", F.when(F.col("v") > 0, F.round((F.col("a") - F.col("b")) / F.sqrt("v"), 6)).alias("t"))


# Summaries


@query("status_board", f"{RACE} SELECT symbol, count(*) AS signals, count(*) FILTER (result = 'OPEN') AS open, count(*) FILTER (result <> 'OPEN') AS closed, min(bar) AS first, max(bar) AS last, count(DISTINCT date_trunc('day', bar)) AS days, CASE WHEN count(*) FILTER (result <> 'OPEN') < 30 THEN 'collecting' WHEN avg(r) FILTER (result <> 'OPEN') > 0 THEN 'positive' ELSE 'negative' END AS verdict FROM trades GROUP BY 1")
def status_board(spark, sf_dir):
    done = F.col("result") != "OPEN"
    g = race(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("signals"), F.count_if(~done).alias("open"), F.count_if(done).alias("closed"), F.min("bar").alias("first"), F.max("bar").alias("last"), F.countDistinct(F.to_date("bar")).alias("days"), F.avg(F.when(done, F.col("r"))).alias("m"))
    return g.withColumn("verdict", F.when(F.col("closed") < 30, "collecting").when(F.col("m") > 0, "positive").otherwise("negative")).drop("m")


@query("period_summary", f"WITH {PNL}, t AS (SELECT max(date_trunc('day', ts)) AS today FROM p), w(name, a, b) AS (VALUES ('today', 0, 0), ('yesterday', 1, 1), ('week', 0, 6), ('all', 0, 100000)) SELECT name, count(*) AS n, count(*) FILTER (pnl > 0) AS wins, round(sum(pnl), 2) AS pnl FROM p, t, w WHERE date_diff('day', ts, today) BETWEEN a AND b GROUP BY 1")
def period_summary(spark, sf_dir):
    """Results of the last day, the day before, the last seven and all, in one pass after the last day is known."""
    rows = ledger(spark, sf_dir)
    last = rows.agg(F.to_date(F.max("ts")).alias("today"))  # one row
    age = F.date_diff("today", F.to_date("ts"))
    parts = F.array_compact(F.array(F.when(age == 0, F.lit("today")), F.when(age == 1, F.lit("yesterday")), F.when(age <= 6, F.lit("week")), F.lit("all")))
    each = rows.join(F.broadcast(last), F.lit(True)).withColumn("name", F.explode(parts))
    return each.groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.col("pnl") > 0).alias("wins"), F.round(F.sum("pnl"), 2).alias("pnl"))


@query("daily_trades", f"WITH {PNL} SELECT strftime(ts, '%Y-%m-%d') AS day, array_to_string([x.k || ':' || x.s FOR x IN list_sort(list({{'k': o_orderkey, 's': symbol}}))], ',') AS trades FROM p WHERE pnl > 50000 GROUP BY 1")
def daily_trades(spark, sf_dir):
    """Days with the list of their large trades (a day's list, in the order of keys)."""
    rows = ledger(spark, sf_dir).where("pnl > 50000").groupBy(F.to_date("ts").cast("string").alias("day"))
    nested = F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.col("symbol").alias("s"))))
    return rows.agg(F.array_join(F.transform(nested, lambda x: F.concat_ws(":", x["k"].cast("string"), x["s"])), ",").alias("trades"))


@query("calendar_extremes", f"WITH {PNL}, d AS (SELECT strftime(ts + INTERVAL 330 minutes, '%Y-%m') AS month, strftime(ts + INTERVAL 330 minutes, '%Y-%m-%d') AS day, sum(pnl) AS r FROM p GROUP BY 1, 2) SELECT month, count(*) AS days, round(sum(r), 2) AS total, arg_max(day, (r, day)) AS best, arg_min(day, (r, day)) AS worst FROM d GROUP BY 1")
def calendar_extremes(spark, sf_dir):
    """Months with their best and worst day at UTC+05:30."""
    at = F.col("ts") + F.expr("interval 330 minutes")
    d = ledger(spark, sf_dir).groupBy(F.date_format(at, "yyyy-MM").alias("month"), F.date_format(at, "yyyy-MM-dd").alias("day")).agg(F.sum("pnl").alias("r"))
    key = F.struct("r", "day")
    return d.groupBy("month").agg(F.count("*").alias("days"), F.round(F.sum("r"), 2).alias("total"), F.max_by("day", key).alias("best"), F.min_by("day", key).alias("worst"))


FLAGS = ("A", "N", "R")
MODES = {"low": "l_discount < 0.03", "mid": "l_discount >= 0.03 AND l_discount < 0.07", "high": "l_discount >= 0.07", "big": "l_quantity > 45"}


@query("conditional_counts", "SELECT l_linestatus AS status, " + ", ".join(f"count(*) FILTER (l_returnflag = '{f}' AND {c}) AS {f.lower()}_{k}" for f in FLAGS for k, c in MODES.items()) + " FROM lineitem GROUP BY 1")
def conditional_counts(spark, sf_dir):
    """Twelve conditional counts in one pass."""
    counts = [F.count_if((F.col("l_returnflag") == f) & F.expr(c)).alias(f"{f.lower()}_{k}") for f in FLAGS for k, c in MODES.items()]
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("status")).agg(*counts)


@query("result_breakdown", f"{RACE}, c AS (SELECT symbol, r, count(*) AS n FROM trades GROUP BY 1, 2) SELECT symbol, string_agg(n || ' x ' || r, ', ' ORDER BY r DESC) AS text FROM c GROUP BY 1")
def result_breakdown(spark, sf_dir):
    """'3 x 2.0, 1 x -1.0': results of a symbol by their count, the largest first."""
    c = race(spark, sf_dir).groupBy("symbol", "r").agg(F.count("*").alias("n"))
    parts = F.sort_array(F.collect_list(F.struct("r", "n")), False)
    return c.groupBy("symbol").agg(F.array_join(F.transform(parts, lambda x: F.concat_ws(" x ", x["n"].cast("string"), x["r"].cast("string"))), ", ").alias("text"))


@query("wins_by_verdict", f"{RACE} SELECT CASE WHEN hour(bar) < 8 THEN 'approved' WHEN hour(bar) < 16 THEN 'neutral' ELSE 'rejected' END AS verdict, count(*) AS n, round(avg((result = 'WIN')::INT), 6) AS win, round(avg(r) FILTER (result <> 'OPEN'), 6) AS mean FROM trades GROUP BY 1")
def wins_by_verdict(spark, sf_dir):
    v = F.when(F.hour("bar") < 8, "approved").when(F.hour("bar") < 16, "neutral").otherwise("rejected")
    g = race(spark, sf_dir).groupBy(v.alias("verdict"))
    return rounded(g.agg(F.count("*").alias("n"), A.share(F.col("result") == "WIN").alias("win"), F.avg(F.when(F.col("result") != "OPEN", F.col("r"))).alias("mean")), "verdict", "n", "win", "mean")


@query("weekly_levels", f"WITH {BARS}, d AS (SELECT symbol, date_trunc('day', bar)::TIMESTAMP AS day, max(high) AS h, min(low) AS l, count(*) AS n FROM bars GROUP BY 1, 2), w AS (SELECT symbol, date_trunc('week', day)::TIMESTAMP AS week, count(*) AS days, max(h) AS high, min(l) AS low FROM d WHERE n >= 20 GROUP BY 1, 2) SELECT symbol, week, CASE WHEN days >= 5 THEN high END AS high, CASE WHEN days >= 5 THEN low END AS low FROM w")
def weekly_levels(spark, sf_dir):
    """High and low of weeks from Monday with five valid days (20 hours) at least, else null."""
    d = hourly(spark, sf_dir).groupBy("symbol", F.date_trunc("day", "bar").alias("day")).agg(F.max("high").alias("h"), F.min("low").alias("l"), F.count("*").alias("n")).where("n >= 20")
    w = d.groupBy("symbol", F.date_trunc("week", "day").alias("week")).agg(F.count("*").alias("days"), F.max("h").alias("high"), F.min("l").alias("low"))
    return w.select("symbol", "week", *(F.when(F.col("days") >= 5, F.col(c)).alias(c) for c in ("high", "low")))


@query("hourly_last_and_log_mean", f"WITH {TICKS} SELECT symbol, date_trunc('hour', ts)::TIMESTAMP AS hour, arg_max(price, (ts, id)) AS last, round(exp(avg(ln(size)) FILTER (size > 0)), 6) AS log_mean FROM ticks GROUP BY 1, 2")
def hourly_last_and_log_mean(spark, sf_dir):
    """Last value of the hour, and the geometric mean of the positive sizes."""
    g = ticks(spark, sf_dir).groupBy("symbol", F.date_trunc("hour", "ts").alias("hour"))
    return g.agg(F.max_by("price", F.struct("ts", "id")).alias("last"), F.round(F.exp(F.avg(F.when(F.col("size") > 0, F.log("size")))), 6).alias("log_mean"))


@query("reindexed_days", f"WITH {PNL}, d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, arg_max(pnl, (ts, o_orderkey)) AS last FROM p WHERE symbol = '1-URGENT' GROUP BY 1), g AS (SELECT unnest(range(min(day), max(day) + INTERVAL 1 day, INTERVAL 1 day))::TIMESTAMP AS day FROM d) SELECT day, round(last, 4) AS last FROM g LEFT JOIN d USING (day)")
def reindexed_days(spark, sf_dir):
    """The last result of each day on the full range of days."""
    d = ledger(spark, sf_dir).where("symbol = '1-URGENT'").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.max_by("pnl", F.struct("ts", "o_orderkey")).alias("last"))
    grid = d.agg(F.explode(F.sequence(F.min("day"), F.max("day"), F.expr("interval 1 day"))).alias("day"))
    return grid.join(d, "day", "left").select("day", F.round("last", 4).alias("last"))


@query("seasonality", f"WITH {PNL}, m AS (SELECT year(ts) AS y, month(ts) AS m, avg(pnl) AS r FROM p GROUP BY 1, 2) SELECT m AS month, count(*) AS years, round(avg(r), 4) AS mean, round(stddev_samp(r) / sqrt(count(*)), 4) AS se FROM m GROUP BY 1")
def seasonality(spark, sf_dir):
    """Months of the year over years as independent periods."""
    m = ledger(spark, sf_dir).groupBy(F.year("ts").alias("y"), F.month("ts").cast("long").alias("month")).agg(F.avg("pnl").alias("r"))
    return m.groupBy("month").agg(F.count("*").alias("years"), F.round(F.avg("r"), 4).alias("mean"), F.round(F.stddev_samp("r") / F.sqrt(F.count("*")), 4).alias("se"))


@query("running_win_rate", f"{RACE} SELECT symbol, bar, round(avg((r > 0)::INT) OVER {OVER}, 6) AS win_rate FROM trades WHERE result <> 'OPEN'")
def running_win_rate(spark, sf_dir):
    """Win rate as it stands after each settled trade."""
    rows = race(spark, sf_dir).where("result <> 'OPEN'")
    return rows.select("symbol", "bar", F.round(A.share(F.col("r") > 0).over(W.order().rowsBetween(Window.unboundedPreceding, 0)), 6).alias("win_rate"))


@query("merged_clusters", f"WITH {PNL}, d AS (SELECT symbol, date_trunc('day', ts) AS day, sum(pnl) AS s, count(*) AS n FROM p GROUP BY 1, 2) SELECT symbol, count(*) AS clusters, sum(n)::BIGINT AS n, round(sum(s), 2) AS total, round(sqrt(sum(s * s)), 2) AS size FROM d GROUP BY 1")
def merged_clusters(spark, sf_dir):
    d = ledger(spark, sf_dir).groupBy("symbol", F.to_date("ts").alias("day")).agg(F.sum("pnl").alias("s"), F.count("*").alias("n"))
    return rounded(d.groupBy("symbol").agg(F.count("*").alias("clusters"), F.sum("n").alias("n"), F.sum("s").alias("total"), F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("size")), "symbol", "clusters", "n", "total", "size", to=2)


@query("quintile_table", f"WITH {BARS}, {NEXT}, q AS (SELECT symbol, ntile(5) OVER (PARTITION BY symbol ORDER BY (high - low) / close, bar) AS q, fwd FROM x) SELECT symbol, q::INT AS q, count(*) AS n, round(avg(abs(fwd)), 6) AS move FROM q GROUP BY 1, 2")
def quintile_table(spark, sf_dir):
    place = F.ntile(5).over(Window.partitionBy("symbol").orderBy((F.col("high") - F.col("low")) / F.col("close"), "bar"))
    return ahead(spark, sf_dir).withColumn("q", place).groupBy("symbol", "q").agg(F.count("*").alias("n"), F.round(F.avg(F.abs("fwd")), 6).alias("move"))


@query("range_regime", f"WITH {BARS}, d AS (SELECT symbol, date_trunc('day', bar)::TIMESTAMP AS day, (max(high) - min(low)) / min(low) AS span FROM bars GROUP BY 1, 2), a AS (SELECT day, avg(span) AS mean FROM d GROUP BY 1) SELECT day, round(mean, 4) AS mean, CASE WHEN mean > 60 THEN 'extreme' WHEN mean > 20 THEN 'high' WHEN mean > 8 THEN 'normal' ELSE 'low' END AS regime FROM a")
def range_regime(spark, sf_dir):
    """Mean daily range of all symbols and its regime."""
    d = hourly(spark, sf_dir).groupBy("symbol", F.date_trunc("day", "bar").alias("day")).agg(ratio(F.max("high") - F.min("low"), F.min("low")).alias("span"))
    a = d.groupBy("day").agg(F.avg("span").alias("mean"))
    regime = F.when(F.col("mean") > 60, "extreme").when(F.col("mean") > 20, "high").when(F.col("mean") > 8, "normal").otherwise("low")
    return a.select("day", F.round("mean", 4).alias("mean"), regime.alias("regime"))


# Portfolio figures


@query("drawdown", f"WITH {PNL}, d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, sum(pnl) / 1e6 AS r FROM p GROUP BY 1), e AS (SELECT *, sum(r) OVER (ORDER BY day) AS eq FROM d) SELECT day, round(eq, 6) AS equity, round(eq - greatest(0, max(eq) OVER (ORDER BY day)), 6) AS drawdown FROM e")
def drawdown(spark, sf_dir):
    """Daily equity and its distance from the peak; the window runs over one row for each day."""
    d = ledger(spark, sf_dir).groupBy(F.date_trunc("day", "ts").alias("day")).agg((F.sum("pnl") / 1e6).alias("r"))
    seen = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    e = d.withColumn("eq", F.sum("r").over(seen))
    return e.select("day", F.round("eq", 6).alias("equity"), F.round(F.col("eq") - F.greatest(F.lit(0.0), F.max("eq").over(seen)), 6).alias("drawdown"))


@query("sharpe_by_year", f"WITH {PNL}, d AS (SELECT symbol, date_trunc('day', ts) AS day, sum(pnl) AS r FROM p GROUP BY 1, 2) SELECT symbol, year(day) AS year, count(*) AS days, round(avg(r) / stddev_samp(r) * sqrt(365), 6) AS sharpe, round(sum(r), 2) AS total FROM d GROUP BY 1, 2")
def sharpe_by_year(spark, sf_dir):
    d = ledger(spark, sf_dir).groupBy("symbol", F.to_date("ts").alias("day")).agg(F.sum("pnl").alias("r"))
    return d.groupBy("symbol", F.year("day").cast("long").alias("year")).agg(F.count("*").alias("days"), F.round(F.avg("r") / F.stddev_samp("r") * F.sqrt(F.lit(365.0)), 6).alias("sharpe"), F.round(F.sum("r"), 2).alias("total"))


@query("above_mean", f"WITH {BARS}, o AS (SELECT symbol, bar, volume, avg(volume) OVER w AS mean, count(*) OVER w AS c FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar RANGE BETWEEN INTERVAL 71 hours PRECEDING AND CURRENT ROW)) SELECT symbol, bar, CASE WHEN c >= 65 THEN volume > mean END AS above FROM o")
def above_mean(spark, sf_dir):
    """Whether volume is above its mean of three days; null under 90 % coverage."""
    hour = Window.partitionBy("symbol").orderBy(F.unix_seconds(F.col("bar").cast("timestamp"))).rangeBetween(-71 * 3600, 0)
    rows = hourly(spark, sf_dir)
    return rows.select("symbol", "bar", F.when(F.count("*").over(hour) >= 65, F.col("volume") > F.avg("volume").over(hour)).alias("above"))


REB = f"WITH {BARS}, d AS (SELECT symbol, date_trunc('day', bar)::TIMESTAMP AS day, arg_max(close, bar) AS c FROM bars GROUP BY 1, 2), r AS (SELECT symbol, day, c / lag(c, 3) OVER w - 1 AS mom, lead(c) OVER w / c - 1 AS next FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day)), k AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY mom, symbol) AS lo, row_number() OVER (PARTITION BY day ORDER BY mom DESC, symbol DESC) AS hi FROM r WHERE mom IS NOT NULL), w AS (SELECT *, CASE WHEN hi <= 2 THEN 0.25::DOUBLE WHEN lo <= 2 THEN -0.25::DOUBLE ELSE 0 END AS wt FROM k), t AS (SELECT *, abs(wt - coalesce(lag(wt) OVER (PARTITION BY symbol ORDER BY day), 0)) AS turn FROM w)"


@query("neutral_rebalance", f"{REB} SELECT day, round(sum(wt * next), 6) AS gross, round(sum(turn), 6) AS turnover, round(sum(wt * next) - 0.001::DOUBLE * sum(turn), 6) AS net FROM t WHERE next IS NOT NULL GROUP BY 1")
def neutral_rebalance(spark, sf_dir):
    """Long the two strongest and short the two weakest symbols of three days, rebalanced daily with the cost of turnover."""
    w = Window.partitionBy("symbol").orderBy("day")
    d = hourly(spark, sf_dir).groupBy("symbol", F.date_trunc("day", "bar").alias("day")).agg(F.max_by("close", "bar").alias("c"))
    r = d.withColumns({"mom": F.col("c") / F.lag("c", 3).over(w) - 1, "next": F.lead("c").over(w) / F.col("c") - 1}).where("mom is not null")
    same = Window.partitionBy("day")
    r = r.withColumns({"lo": F.row_number().over(same.orderBy("mom", "symbol")), "hi": F.row_number().over(same.orderBy(F.desc("mom"), F.desc("symbol")))})
    r = r.withColumn("wt", F.when(F.col("hi") <= 2, 0.25).when(F.col("lo") <= 2, -0.25).otherwise(0.0))
    r = r.withColumn("turn", F.abs(F.col("wt") - F.coalesce(F.lag("wt").over(w), F.lit(0.0)))).where("next is not null")
    out = r.groupBy("day").agg(F.sum(F.col("wt") * F.col("next")).alias("gross"), F.sum("turn").alias("turnover"))
    return rounded(out.withColumn("net", F.col("gross") - 0.001 * F.col("turnover")), "day", "gross", "turnover", "net")


@query("correlation_cap", f"WITH {BARS}, r AS (SELECT symbol, bar, ln(close / lag(close) OVER {OVER}) AS ret FROM bars), c AS (SELECT a.symbol, count(*) FILTER (rho > 0.0) AS close_ FROM (SELECT a.symbol, b.symbol AS other, corr(a.ret, b.ret) AS rho, count(*) AS n FROM r a JOIN r b ON a.bar = b.bar AND a.symbol <> b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 150) a GROUP BY 1) SELECT symbol, close_ >= 2 AS blocked FROM c")
def correlation_cap(spark, sf_dir):
    """Symbols whose returns move with those of two others at least, over 150 shared bars."""
    pairs = correlations(spark, sf_dir).where("n >= 150")
    both = pairs.select(F.col("a").alias("symbol"), "rho").unionByName(pairs.select(F.col("b").alias("symbol"), "rho"))
    return both.groupBy("symbol").agg((F.count_if(F.col("rho") > 0.0) >= 2).alias("blocked"))


@query("target_feasibility", f"WITH {BARS}, r AS (SELECT symbol, bar, ln(close / lag(close) OVER {OVER}) AS ret FROM bars), s AS (SELECT symbol, stddev_samp(ret) AS sd FROM r GROUP BY 1), g(goal) AS (VALUES (1.05::DOUBLE), (1.5::DOUBLE), (4.0::DOUBLE), (100.0::DOUBLE)) SELECT symbol, goal, round(ln(goal) / (sd * sqrt(24)), 6) AS needed, CASE WHEN ln(goal) / (sd * sqrt(24)) <= 0.5 THEN 'likely' WHEN ln(goal) / (sd * sqrt(24)) <= 1.5 THEN 'possible' ELSE 'remote' END AS verdict FROM s, g")
def target_feasibility(spark, sf_dir):
    """Gains within a day against the day's volatility."""
    s = W.returns(hourly(spark, sf_dir)).groupBy("symbol").agg(F.stddev_samp("ret").alias("sd"))
    s = s.withColumn("goal", F.explode(F.array(*(F.lit(g) for g in (1.05, 1.5, 4.0, 100.0)))))
    need = F.log("goal") / (F.col("sd") * F.sqrt(F.lit(24.0)))
    return s.select("symbol", "goal", F.round(need, 6).alias("needed"), F.when(need <= 0.5, "likely").when(need <= 1.5, "possible").otherwise("remote").alias("verdict"))


@query("growth_by_year", f"WITH {PNL}, y AS (SELECT symbol, year(ts) AS year, sum(pnl) AS r FROM p GROUP BY 1, 2) SELECT symbol, year, round(r, 2) AS r, round(sum(r) OVER (PARTITION BY symbol ORDER BY year), 2) AS so_far FROM y")
def growth_by_year(spark, sf_dir):
    y = ledger(spark, sf_dir).groupBy("symbol", F.year("ts").cast("long").alias("year")).agg(F.sum("pnl").alias("r"))
    return y.select("symbol", "year", F.round("r", 2).alias("r"), F.round(F.sum("r").over(Window.partitionBy("symbol").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)), 2).alias("so_far"))


@query("dose_response", f"WITH {BARS}, {NEXT}, c(cut) AS (VALUES (1.0), (1.5), (2.0), (3.0)), v AS (SELECT *, volume / nullif(avg(volume) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), 0) AS push FROM r) SELECT cut::DOUBLE AS cut, count(*) AS n, round(avg(fwd), 6) AS mean, round(avg((fwd > 0)::INT), 6) AS up FROM v, c WHERE push >= cut AND fwd IS NOT NULL GROUP BY 1")
def dose_response(spark, sf_dir):
    """The next return by how far volume exceeds its usual size: each row counts for all thresholds it reaches."""
    rows = hourly(spark, sf_dir).withColumns({"push": F.col("volume") / F.nullif(F.avg("volume").over(W.before(24)), F.lit(0.0)), "fwd": F.lead("close").over(W.order()) / F.col("close") - 1}).where("fwd is not null")
    reached = F.filter(F.array(*(F.lit(c) for c in (1.0, 1.5, 2.0, 3.0))), lambda c: F.col("push") >= c)
    g = rows.withColumn("cut", F.explode(reached)).groupBy("cut")
    return rounded(g.agg(F.count("*").alias("n"), F.avg("fwd").alias("mean"), A.share(F.col("fwd") > 0).alias("up")), "cut", "n", "mean", "up")


@query("confidence_slices", f"WITH {BARS}, {NEXT}, q AS (SELECT buy / nullif(volume, 0) - 0.5 AS pred, fwd, symbol, bar FROM x), k AS (SELECT *, ntile(5) OVER (PARTITION BY symbol ORDER BY abs(pred) DESC, bar)::INT AS slice FROM q WHERE pred IS NOT NULL) SELECT symbol, slice, count(*) AS n, round(avg((sign(pred) = sign(fwd))::INT), 6) AS hit, round(avg(sign(pred) * fwd), 6) AS mean FROM k GROUP BY 1, 2")
def confidence_slices(spark, sf_dir):
    """Hit rate and mean result of forecasts by how strong they are."""
    rows = ahead(spark, sf_dir).withColumn("pred", F.col("buy") / F.nullif(F.col("volume"), F.lit(0.0)) - 0.5).where("pred is not null")
    rows = rows.withColumn("slice", F.ntile(5).over(Window.partitionBy("symbol").orderBy(F.desc(F.abs("pred")), "bar")))
    return rounded(rows.groupBy("symbol", "slice").agg(F.count("*").alias("n"), A.share(F.signum("pred") == F.signum("fwd")).alias("hit"), F.avg(F.signum("pred") * F.col("fwd")).alias("mean")), "symbol", "slice", "n", "hit", "mean")


@query("edge_table", f"WITH {BARS}, h(h) AS (VALUES (1), (4), (12)), f AS (SELECT symbol, bar, hour(bar) // 6 AS family, " + ", ".join(f"lead(close, {k}) OVER {OVER} / close - 1 AS f{k}" for k in (1, 4, 12)) + " FROM bars), e AS (SELECT symbol, bar, family, h, CASE h WHEN 1 THEN f1 WHEN 4 THEN f4 ELSE f12 END AS r FROM f, h), m AS (SELECT family, h, avg(r) AS mean, count(r) AS n FROM e GROUP BY 1, 2), c AS (SELECT family, h, date_trunc('day', bar) AS d, sum(r) AS s, count(r) AS k FROM e WHERE r IS NOT NULL GROUP BY 1, 2, 3) SELECT family, h::INT AS h, any_value(n) AS n, round(any_value(mean), 6) AS mean, round(any_value(mean) / (sqrt(sum(pow(s - k * mean, 2))) / any_value(n)), 4) AS t FROM c JOIN m USING (family, h) GROUP BY 1, 2")
def edge_table(spark, sf_dir):
    """Forward returns by family and horizon with errors clustered by day."""
    family = F.call_function("div", F.hour("bar"), F.lit(6))
    wide = hourly(spark, sf_dir).select(F.to_date("bar").alias("day"), family.alias("family"), *((F.lead("close", h).over(W.order()) / F.col("close") - 1).alias(f"r{h}") for h in (1, 4, 12)))
    rows = wide.select("day", "family", F.explode(F.array(*(F.struct(F.lit(h).alias("h"), F.col(f"r{h}").alias("r")) for h in (1, 4, 12)))).alias("x"))
    rows = rows.select("day", F.concat_ws(":", "family", "x.h").alias("key"), "family", "x.h", "x.r").where("r is not null")
    names = rows.select("key", "family", "h").distinct()
    out = A.clustered_t(rows, "r", "day", "key").join(names, "key")
    return out.select("family", "h", "n", F.round("mean", 6).alias("mean"), F.round("t", 4).alias("t"))


@query("calendar_split", "WITH d AS (SELECT DISTINCT date_trunc('day', o_orderdate) AS day FROM orders), c AS (SELECT quantile_disc(day, 0.6) AS cut FROM d) SELECT (o_orderdate < cut) AS train, count(*) AS n, count(DISTINCT date_trunc('day', o_orderdate)) AS days FROM orders, c GROUP BY 1")
def calendar_split(spark, sf_dir):
    """Train and test rows by the 60 % point of the distinct days."""
    rows = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    days = rows.select("day").distinct()
    place = F.row_number().over(Window.orderBy("day"))  # a row for each day
    numbered = days.withColumns({"i": place, "m": F.count("*").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    cut = numbered.where("i >= 0.6 * m").agg(F.min("day").alias("cut"))
    out = rows.join(F.broadcast(cut), F.lit(True)).groupBy((F.col("o_orderdate") < F.col("cut").cast("timestamp_ntz")).alias("train"))
    return out.agg(F.count("*").alias("n"), F.countDistinct("day").alias("days"))


@query("universe_ranking", f"WITH {TICKS} SELECT symbol, round(sum(price * size), 2) AS turnover, rank() OVER (ORDER BY sum(price * size) DESC)::INT AS rk FROM ticks GROUP BY 1 HAVING sum(price * size) > 1000")
def universe_ranking(spark, sf_dir):
    """Symbols by traded value, small ones left out; ranked after the aggregation."""
    g = ticks(spark, sf_dir).groupBy("symbol").agg(F.sum(F.col("price") * F.col("size")).alias("turnover")).where("turnover > 1000")
    return g.select("symbol", F.round("turnover", 2).alias("turnover"), F.rank().over(Window.orderBy(F.desc("turnover"))).alias("rk"))


@query("exposure_counts", f"{RACE} SELECT symbol, count(*) FILTER (result = 'OPEN') AS waiting, count(*) FILTER (hit IS NOT NULL) AS open, round(sum(CASE WHEN result = 'OPEN' THEN entry * 0.25::DOUBLE ELSE 0 END), 4) AS risk FROM trades GROUP BY 1")
def exposure_counts(spark, sf_dir):
    is_open = F.col("result") == "OPEN"
    return race(spark, sf_dir).groupBy("symbol").agg(F.count_if(is_open).alias("waiting"), F.count_if(F.col("hit").isNotNull()).alias("open"), F.round(F.sum(F.when(is_open, F.col("entry") * 0.25).otherwise(0.0)), 4).alias("risk"))


@query("tercile_grades", f"{RACE}, v AS (SELECT t.symbol, t.bar, t.r, b.volume FROM trades t JOIN bars b USING (symbol, bar)), k AS (SELECT *, ntile(3) OVER (PARTITION BY symbol ORDER BY volume, bar) AS third, ntile(2) OVER (PARTITION BY symbol ORDER BY bar) AS half FROM v), g AS (SELECT symbol, third::INT AS third, count(*) AS n, avg(r) AS mean, avg(r) FILTER (half = 1) AS a, avg(r) FILTER (half = 2) AS b FROM k GROUP BY 1, 2) SELECT symbol, third, n, round(mean, 6) AS mean, CASE WHEN a > 0 AND b > 0 THEN 'A' WHEN mean > 0 THEN 'B' WHEN a > 0 OR b > 0 THEN 'C' ELSE 'D' END AS grade FROM g")
def tercile_grades(spark, sf_dir):
    """Thirds of a feature graded by their mean result and by whether both halves of time agree."""
    rows = race(spark, sf_dir).select("symbol", "bar", "r").join(hourly(spark, sf_dir).select("symbol", "bar", "volume"), ["symbol", "bar"])
    part = Window.partitionBy("symbol")
    rows = rows.withColumns({"third": F.ntile(3).over(part.orderBy("volume", "bar")), "half": F.ntile(2).over(part.orderBy("bar"))})
    g = rows.groupBy("symbol", "third").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.avg(F.when(F.col("half") == 1, F.col("r"))).alias("a"), F.avg(F.when(F.col("half") == 2, F.col("r"))).alias("b"))
    grade = F.when((F.col("a") > 0) & (F.col("b") > 0), "A").when(F.col("mean") > 0, "B").when((F.col("a") > 0) | (F.col("b") > 0), "C").otherwise("D")
    return g.select("symbol", "third", "n", F.round("mean", 6).alias("mean"), grade.alias("grade"))


@query("trade_history", f"{RACE} SELECT symbol, bar, 'settled' AS kind, r FROM trades WHERE result <> 'OPEN' UNION ALL SELECT symbol, bar, 'missed', NULL FROM bars WHERE n = 3")
def trade_history(spark, sf_dir):
    """Settled trades and missed setups in one history."""
    done = race(spark, sf_dir).where("result <> 'OPEN'").select("symbol", "bar", F.lit("settled").alias("kind"), "r")
    missed = hourly(spark, sf_dir).where("n = 3").select("symbol", "bar", F.lit("missed").alias("kind"), F.lit(None).cast("double").alias("r"))
    return done.unionByName(missed)


@query("benchmark_beta", f"WITH {BARS}, d AS (SELECT symbol, date_trunc('day', bar) AS day, arg_max(close, bar) AS c FROM bars GROUP BY 1, 2), r AS (SELECT symbol, day, c / lag(c) OVER (PARTITION BY symbol ORDER BY day) - 1 AS ret FROM d), m AS (SELECT day, avg(ret) AS mkt FROM r WHERE ret IS NOT NULL GROUP BY 1) SELECT symbol, count(*) AS days, round(avg(ret), 6) AS mean, round(regr_slope(ret, mkt), 6) AS beta FROM r JOIN m USING (day) WHERE ret IS NOT NULL GROUP BY 1")
def benchmark_beta(spark, sf_dir):
    """Daily returns against the mean of all symbols."""
    w = Window.partitionBy("symbol").orderBy("day")
    d = hourly(spark, sf_dir).groupBy("symbol", F.to_date("bar").alias("day")).agg(F.max_by("close", "bar").alias("c"))
    r = d.withColumn("ret", F.col("c") / F.lag("c").over(w) - 1).where("ret is not null")
    m = r.groupBy("day").agg(F.avg("ret").alias("mkt"))
    return rounded(r.join(m, "day").groupBy("symbol").agg(F.count("*").alias("days"), F.avg("ret").alias("mean"), F.regr_slope("ret", "mkt").alias("beta")), "symbol", "days", "mean", "beta")


@query("excursion_anatomy", f"WITH {BARS}, n AS (SELECT *, row_number() OVER {OVER} AS i FROM bars), m AS (SELECT a.symbol, a.bar, any_value(a.close) AS e, min(CASE WHEN b.low <= a.close * 0.75::DOUBLE THEN b.i END) AS stop_i, a.i FROM n a JOIN n b ON a.symbol = b.symbol AND b.i BETWEEN a.i + 1 AND a.i + 24 WHERE a.n >= 4 GROUP BY 1, 2, a.i), x AS (SELECT m.symbol, m.bar, max(b.high) / any_value(m.e) - 1 AS mfe FROM m JOIN n b ON b.symbol = m.symbol AND b.i > m.i AND b.i <= coalesce(m.stop_i, m.i + 24) WHERE b.i <= m.i + 24 GROUP BY 1, 2) SELECT symbol, ntile(4) OVER (PARTITION BY symbol ORDER BY mfe, bar)::INT AS q, bar, round(mfe, 6) AS mfe FROM x")
def excursion_anatomy(spark, sf_dir):
    """Best move before the stop within 24 bars, and its quartile."""
    from tickframe.operators.joins import ahead as path
    from tickframe.operators.joins import first_at

    c = F.col("close")
    rows = hourly(spark, sf_dir).withColumn("_p", path(24, "high", "low")).where((F.col("n") >= 4) & (F.size("_p") > 0))
    rows = rows.withColumn("stop", F.coalesce(first_at(F.col("_p"), lambda x: x["low"] <= c * 0.75), F.lit(24)).cast("int"))
    rows = rows.withColumn("mfe", F.array_max(F.transform(F.slice("_p", F.lit(1), F.col("stop")), lambda x: x["high"])) / c - 1)
    return rows.select("symbol", F.ntile(4).over(Window.partitionBy("symbol").orderBy("mfe", "bar")).alias("q"), "bar", F.round("mfe", 6).alias("mfe"))


@query("conjunctions", f"WITH {BARS}, {NEXT}, i AS (SELECT symbol, bar, fwd, unnest([CASE WHEN hour(bar) < 8 THEN 'asia' ELSE 'day' END, CASE WHEN close > open THEN 'up' ELSE 'down' END, CASE WHEN n >= 4 THEN 'busy' ELSE 'calm' END, CASE WHEN buy * 2 > volume THEN 'bought' ELSE 'sold' END, CASE WHEN isodow(bar) > 5 THEN 'weekend' ELSE 'week' END]) AS item FROM x) SELECT a.item AS a, b.item AS b, count(*) AS n, round(avg(a.fwd), 6) AS mean FROM i a JOIN i b ON a.symbol = b.symbol AND a.bar = b.bar AND a.item < b.item GROUP BY 1, 2 HAVING count(*) >= 100")
def conjunctions(spark, sf_dir):
    """Pairs of items that hold together in 100 bars at least, with the mean next return: each bar opens its own pairs."""
    c = F.col
    items = F.array(F.when(F.hour("bar") < 8, "asia").otherwise("day"), F.when(c("close") > c("open"), "up").otherwise("down"), F.when(c("n") >= 4, "busy").otherwise("calm"), F.when(c("buy") * 2 > c("volume"), "bought").otherwise("sold"), F.when(F.weekday("bar") >= 5, "weekend").otherwise("week"))
    rows = ahead(spark, sf_dir).withColumn("i", F.sort_array(items))
    pairs = F.flatten(F.transform("i", lambda a, k: F.transform(F.slice("i", k + 2, F.lit(5)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    g = rows.select("fwd", F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"), F.round(F.avg("fwd"), 6).alias("mean"))
    return g.where("n >= 100")


