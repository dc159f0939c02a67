"""Registered queries of permutation nulls and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickframe.operators import frames as W
from tickframe.operators import nulls as U
from tickframe.operators import quantiles as Q
from tickframe.plans.queries import BARS, RACE, hourly, query, race, rounded
from tickframe.plans.statistic_queries import BOOT, TE, ahead

ROUNDS = 100
#: Index maps by round as rows that turn one half after the other: SQL's own way through the halves.
HASH = "(({x} + rd * 7919 + (k + 1) * 104729) % 2147483647 * 48271 % 2147483647 * 16807 % 2147483647)"


def walk(source: str, key: str) -> str:
    """SQL of pi (key, rd, i, at): where each round from 1 on takes index i of 0 .. n-1; source has key and n."""
    return f"""gr AS (SELECT {key}, n, ceil(sqrt(n::DOUBLE))::BIGINT AS a, (n + ceil(sqrt(n::DOUBLE))::BIGINT - 1) // ceil(sqrt(n::DOUBLE))::BIGINT AS b FROM {source}),
 wk AS (SELECT {key}, n, a, b, rd, i, i // b AS l, i % b AS r, 0 AS k FROM gr, LATERAL (SELECT unnest(range(n)) AS i), (SELECT unnest(range(1, {ROUNDS + 1})) AS rd)
  UNION ALL SELECT {key}, n, a, b, rd, i, CASE WHEN k = 4 THEN l WHEN k % 2 = 0 THEN (l + {HASH.format(x='r')}) % a ELSE l END, CASE WHEN k < 4 AND k % 2 = 1 THEN (r + {HASH.format(x='l')}) % b ELSE r END, CASE WHEN k = 4 THEN 0 ELSE k + 1 END FROM wk WHERE k < 4 OR l * b + r >= n),
 pi AS (SELECT {key}, rd, i, l * b + r AS at FROM wk WHERE k = 4 AND l * b + r < n UNION ALL SELECT {key}, 0, i, i FROM gr, LATERAL (SELECT unnest(range(n)) AS i))"""


PERMUTED = f"""js AS MATERIALIZED (SELECT now, own, other, row_number() OVER (ORDER BY bar) - 1 AS i, 1 AS one FROM j WHERE own IS NOT NULL), nn AS (SELECT 1 AS one, count(*) AS n FROM js), {walk('nn', 'one')},
 cc AS (SELECT rd, a.now, a.own, b.other, count(*)::DOUBLE AS n FROM pi JOIN js a ON a.i = pi.i JOIN js b ON b.i = pi.at GROUP BY 1, 2, 3, 4),
 mm AS (SELECT *, sum(n) OVER (PARTITION BY rd, own, other) AS no, sum(n) OVER (PARTITION BY rd, now, own) AS nw, sum(n) OVER (PARTITION BY rd, own) AS o, sum(n) OVER (PARTITION BY rd) AS t FROM cc),
 st AS (SELECT rd, sum(n / t * ln((n / no) / (nw / o))) AS te FROM mm GROUP BY 1), ob AS (SELECT te AS observed FROM st WHERE rd = 0)"""


@query("entropy_null", f"WITH RECURSIVE {BARS}, {TE}, {PERMUTED} SELECT round(any_value(observed), 6) AS observed, round(avg(te), 6) AS null_mean, round(stddev_samp(te), 6) AS null_sd, round((any_value(observed) - avg(te)) / stddev_samp(te), 4) AS z, round((count(*) FILTER (te >= observed - 1e-12) + 1) / (count(*) + 1), 6) AS p FROM st, ob WHERE rd > 0")
def entropy_null(spark, sf_dir):
    """Transfer entropy from one symbol's direction to another's, against a hundred permutations of the first."""
    d = hourly(spark, sf_dir).withColumn("old", F.lag("close").over(W.order())).where("old is not null").select("symbol", "bar", (F.col("close") > F.col("old")).cast("int").alias("u"))
    x, y = d.where("symbol = 'view'").select("bar", F.col("u").alias("x")), d.where("symbol = 'click'").select("bar", F.col("u").alias("y"))
    both = x.join(y, "bar").withColumn("symbol", F.lit("pair"))
    rows = both.select("symbol", "bar", F.col("y").alias("now"), F.lag("y").over(W.order()).alias("own"), F.lag("x").over(W.order()).alias("other")).where("own is not null")
    rounds = U.shuffled(Q.ordinals(rows, "i"), ["symbol"], "i", "other", ROUNDS)
    found = U.against_null(U.transfer_entropy(rounds, ["round"]), [], "te")
    return rounded(found, "observed", "null_mean", "null_sd", "p").join(found.select(F.round("z", 4).alias("z")), F.lit(True))


GRADED = f"""v AS (SELECT t.symbol, t.bar, t.r, b.volume, row_number() OVER (PARTITION BY t.symbol ORDER BY t.bar) - 1 AS i FROM trades t JOIN bars b USING (symbol, bar)),
 k AS MATERIALIZED (SELECT *, ntile(3) OVER (PARTITION BY symbol ORDER BY volume, bar) AS third, ntile(2) OVER (PARTITION BY symbol ORDER BY bar) AS half FROM v), ns AS (SELECT symbol, count(*) AS n FROM k GROUP BY 1), {walk('ns', 'symbol')},
 y AS (SELECT pi.symbol, rd, a.third, count(*) AS n, avg(b.r) AS m, var_samp(b.r) AS v FROM pi JOIN k a ON a.symbol = pi.symbol AND a.i = pi.i JOIN k b ON b.symbol = pi.symbol AND b.i = pi.at GROUP BY 1, 2, 3),
 hi AS (SELECT *, row_number() OVER (PARTITION BY symbol, rd ORDER BY m DESC, third) AS up, row_number() OVER (PARTITION BY symbol, rd ORDER BY m, third DESC) AS dn FROM y),
 tt AS (SELECT h.symbol, h.rd, h.third AS best, l.third AS worst, CASE WHEN sqrt(h.v / h.n + l.v / l.n) > 0 THEN (h.m - l.m) / sqrt(h.v / h.n + l.v / l.n) ELSE 0 END AS t FROM hi h JOIN hi l ON h.symbol = l.symbol AND h.rd = l.rd WHERE h.up = 1 AND l.dn = 1),
 hf AS (SELECT k.symbol, half, avg(r) FILTER (third = best) AS b, avg(r) FILTER (third = worst) AS w FROM k JOIN tt ON tt.symbol = k.symbol AND rd = 0 GROUP BY 1, 2),
 sd AS (SELECT symbol, bool_and(coalesce(b > w, FALSE)) AS steady FROM hf GROUP BY 1)"""


@query(
    "tercile_nulls",
    f"{RACE.replace('WITH ticks', 'WITH RECURSIVE ticks', 1)}, {GRADED} SELECT o.symbol, o.best::INT AS best, o.worst::INT AS worst, round(o.t, 6) AS t, steady, round((count(*) FILTER (q.t >= o.t - 1e-12) + 1) / (count(*) + 1), 6) AS p FROM tt o JOIN tt q ON q.symbol = o.symbol AND q.rd > 0 JOIN sd ON sd.symbol = o.symbol WHERE o.rd = 0 GROUP BY o.symbol, o.best, o.worst, o.t, steady",
)
def tercile_nulls(spark, sf_dir):
    """Thirds of volume: Welch's t between the best and the worst, whether both halves of time agree, and the share of a
    hundred permutations of the results that reach it."""
    rows = race(spark, sf_dir).select("symbol", "bar", "r").join(hourly(spark, sf_dir).select("symbol", "bar", "volume"), ["symbol", "bar"])
    part = Window.partitionBy("symbol")
    rows = Q.ordinals(rows.withColumns({"third": F.ntile(3).over(part.orderBy("volume", "bar")), "half": F.ntile(2).over(part.orderBy("bar"))}), "i")
    rounds = U.welch(U.shuffled(rows.select("symbol", "i", "third", "r"), ["symbol"], "i", "r", ROUNDS), ["symbol", "round"], "third", "r")
    best = rounds.where("round = 0").select("symbol", "best", "worst")
    halves = rows.join(best, "symbol").groupBy("symbol", "half").agg(F.avg(F.when(F.col("third") == F.col("best"), F.col("r"))).alias("b"), F.avg(F.when(F.col("third") == F.col("worst"), F.col("r"))).alias("w"))
    steady = halves.groupBy("symbol").agg(F.bool_and(F.coalesce(F.col("b") > F.col("w"), F.lit(False))).alias("steady"))
    found = U.against_null(rounds, ["symbol"], "t").join(best, "symbol").join(steady, "symbol")
    return rounded(found, "symbol", "best", "worst", "observed:t", "steady", "p")


@query("bootstrap_interval", f"WITH {BARS}, {BOOT} SELECT symbol, round(any_value(mean), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY 1")
def bootstrap_interval(spark, sf_dir):
    """The middle 95 % of the mean next return over a hundred resamples of blocks of a day's bars."""
    rows = ahead(spark, sf_dir).withColumn("v", F.log1p("fwd"))
    rounds = U.block_sums(rows, "symbol", "bar", {"m": F.col("v")}, 24, 100)
    mean = rows.groupBy("symbol").agg(F.avg("v").alias("mean"))
    return rounded(mean.join(U.interval(rounds, "symbol", "m"), "symbol"), "symbol", "mean", "low", "high")


SHARPE = """dd AS (SELECT symbol, date_trunc('day', bar)::TIMESTAMP AS d, arg_max(close, bar) AS c FROM bars GROUP BY 1, 2), rr AS (SELECT symbol, d, ln(c / lag(c) OVER (PARTITION BY symbol ORDER BY d)) AS v FROM dd),
 o AS (SELECT symbol, d, v, row_number() OVER (PARTITION BY symbol ORDER BY d) - 1 AS i FROM rr WHERE v IS NOT NULL), p AS (SELECT symbol, i, sum(v) OVER w - v AS s, sum(v * v) OVER w - v * v AS q FROM o WINDOW w AS (PARTITION BY symbol ORDER BY i)),
 w AS (SELECT symbol, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS sd FROM o GROUP BY 1), b AS (SELECT symbol, n, rd, unnest(range(0, n // 5)) AS j FROM w, (SELECT unnest(range(0, 400)) AS rd) WHERE n > 10),
 c AS (SELECT *, ((rd * 7919 + j * 104729 + 12345) % 2147483647 * 48271 % 2147483647) % (n - 5) AS st FROM b),
 m AS (SELECT c.symbol, rd, sum(y.s - x.s) / (count(*) * 5) AS m, sum(y.q - x.q) / (count(*) * 5) AS q FROM c JOIN p x ON x.symbol = c.symbol AND x.i = st JOIN p y ON y.symbol = c.symbol AND y.i = st + 5 GROUP BY 1, 2),
 h AS (SELECT symbol, m / sqrt(greatest(q - m * m, 1e-18)) * sqrt(365) AS sharpe, m * 365 AS year FROM m)"""


@query("sharpe_interval", f"WITH {BARS}, {SHARPE} SELECT w.symbol, w.n, round(mean / sd * sqrt(365), 6) AS sharpe, round(quantile_cont(h.sharpe, 0.025), 4) AS low, round(quantile_cont(h.sharpe, 0.975), 4) AS high, round(mean * 365, 6) AS year, round(quantile_cont(h.year, 0.025), 4) AS year_low, round(quantile_cont(h.year, 0.975), 4) AS year_high FROM h JOIN w USING (symbol) GROUP BY w.symbol, w.n, mean, sd")
def sharpe_interval(spark, sf_dir):
    """Yearly Sharpe ratio and return of each symbol's daily closes, with the middle 95 % of 400 resamples of five-day blocks."""
    days = hourly(spark, sf_dir).groupBy("symbol", F.date_trunc("day", "bar").alias("d")).agg(F.max_by("close", "bar").alias("c"))
    rows = days.withColumn("v", F.log(F.col("c") / F.lag("c").over(Window.partitionBy("symbol").orderBy("d")))).where("v is not null")
    rounds = U.block_sums(rows, "symbol", "d", {"m": F.col("v"), "q": F.col("v") * F.col("v")}, 5, 400)
    spread = F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(1e-18)))
    rounds = rounds.withColumns({"sharpe": F.col("m") / spread * F.sqrt(F.lit(365.0)), "year": F.col("m") * 365})
    own = rows.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    out = own.join(U.interval(rounds, "symbol", "sharpe"), "symbol").join(U.interval(rounds, "symbol", "year").withColumnsRenamed({"low": "year_low", "high": "year_high"}), "symbol")
    out = out.select("symbol", "n", F.round(F.col("mean") / F.col("sd") * F.sqrt(F.lit(365.0)), 6).alias("sharpe"), F.round(F.col("mean") * 365, 6).alias("year"), *(F.round(c, 4).alias(c) for c in ("low", "high", "year_low", "year_high")))
    return out
