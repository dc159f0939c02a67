"""Registered queries of setups with memory; their SQL joins each first bar with the numbered bars after it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickframe.operators import patterns as P
from tickframe.plans.queries import BARS, TR, before, hourly, last, query, rounded

KEY = "(PARTITION BY symbol, side ORDER BY bar)"


def prior(n: int) -> str:
    return f"(PARTITION BY symbol, side ORDER BY bar ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def next_(n: int) -> str:
    return f"(PARTITION BY symbol, side ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"


SIDED = f"""WITH {BARS}, {TR}, rg AS (SELECT *, CASE WHEN count(*) OVER w >= 14 THEN avg(tr) OVER w END AS atr, volume / nullif(avg(volume) OVER {before(20)}, 0) AS rel FROM tr WINDOW w AS {last(14)}),
 sd AS (SELECT symbol, 1 AS side, bar, open AS o, high AS h, low AS l, close AS c, volume AS v, atr, rel FROM rg UNION ALL SELECT symbol, -1, bar, -open, -low, -high, -close, volume, atr, rel FROM rg),
 n AS MATERIALIZED (SELECT *, row_number() OVER {KEY} AS i FROM sd)"""


def sides(spark, sf_dir):
    return P.sided(hourly(spark, sf_dir))


BROKEN = f"""{SIDED}, t AS (SELECT *, CASE WHEN count(*) OVER w = 20 THEN max(h) OVER w END AS top, CASE WHEN count(*) OVER w = 20 THEN min(l) OVER w END AS flr FROM n WINDOW w AS {prior(20)}),
 b AS (SELECT *, coalesce(c > top AND lag(c) OVER {KEY} <= lag(top) OVER {KEY}, FALSE) AS new FROM t),
 s AS (SELECT *, lead(i) OVER {KEY} AS until FROM b WHERE new),
 x AS (SELECT s.symbol, s.side, s.bar AS began, s.top, s.flr, s.h AS h0, b.bar, b.i - s.i AS k, b.h, b.l, b.c, b.atr FROM s JOIN b ON b.symbol = s.symbol AND b.side = s.side AND b.i BETWEEN s.i + 1 AND least(s.i + 12, coalesce(s.until, s.i + 12))),
 d AS (SELECT *, min(CASE WHEN c < top THEN k END) OVER (PARTITION BY symbol, side, began) AS dead, greatest(h0, max(h) OVER (PARTITION BY symbol, side, began ORDER BY k)) AS ext FROM x),
 r AS (SELECT *, row_number() OVER (PARTITION BY symbol, side, began ORDER BY k) AS nth FROM d WHERE (dead IS NULL OR k < dead) AND l <= top + 0.1::DOUBLE * atr)"""


@query(
    "break_retests",
    f"{BROKEN} SELECT symbol, bar, side::INT AS side, 'retest' AS setup, began, round(side * top, 6) AS level, round(side * (l - 0.1::DOUBLE * atr), 6) AS stop, round(side * (2 * top - flr), 6) AS target FROM r WHERE nth = 1 UNION ALL SELECT symbol, bar, -side::INT, 'fake', began, round(side * top, 6), round(side * (ext + 0.1::DOUBLE * atr), 6), round(side * (top + flr) / 2, 6) FROM d WHERE k = dead AND k <= 3",
)
def break_retests(spark, sf_dir):
    """Breaks of the twenty-bar range that are retested, and those that fail within three bars."""
    return rounded(P.break_retests(sides(spark, sf_dir)), "symbol", "bar", "side", "setup", "began", "level", "stop", "target")


PEAKED = f"{SIDED}, pk AS (SELECT *, count(*) OVER p = 3 AND count(*) OVER f = 3 AND h > max(h) OVER p AND h > max(h) OVER f AS peak, count(*) OVER p = 3 AND count(*) OVER f = 3 AND l < min(l) OVER p AND l < min(l) OVER f AS dip FROM n WINDOW p AS {prior(3)}, f AS {next_(3)})"


@query(
    "pool_sweeps",
    f"""{PEAKED}, e AS (SELECT * FROM pk WHERE rel >= 1.5 AND atr IS NOT NULL), q AS (SELECT e.symbol, e.side, e.bar, e.i, e.o, e.h, e.c, e.atr, p.i AS pi, p.h AS ph, row_number() OVER (PARTITION BY e.symbol, e.side, e.i ORDER BY p.i DESC) AS nth FROM e JOIN pk p ON p.symbol = e.symbol AND p.side = e.side AND p.peak AND p.i BETWEEN e.i - 48 AND e.i - 3),
 w AS (SELECT a.*, b.pi AS li, greatest(a.ph, b.ph) AS pool FROM q a JOIN q b ON a.symbol = b.symbol AND a.side = b.side AND a.i = b.i AND a.pi < b.pi WHERE a.nth <= 8 AND b.nth <= 8 AND abs(a.ph - b.ph) <= 0.1::DOUBLE * a.atr),
 g AS (SELECT * FROM w WHERE o <= pool AND h > pool AND c < pool AND NOT EXISTS (SELECT 1 FROM n z WHERE z.symbol = w.symbol AND z.side = w.side AND z.i > w.li AND z.i < w.i AND z.h > w.pool)),
 f AS (SELECT *, row_number() OVER (PARTITION BY symbol, side, i ORDER BY pi, li) AS first FROM g)
SELECT f.symbol, f.bar, -f.side::INT AS side, round(any_value(f.side * pool), 6) AS level, round(any_value(f.side * (f.h + 0.1::DOUBLE * f.atr)), 6) AS stop, round(f.side * min(z.l), 6) AS target FROM f JOIN n z ON z.symbol = f.symbol AND z.side = f.side AND z.i BETWEEN f.pi AND f.i - 1 WHERE first = 1 GROUP BY f.symbol, f.bar, f.side""",
)
def pool_sweeps(spark, sf_dir):
    """Bars that sweep a pool of equal highs (or lows) and close back."""
    return rounded(P.pool_sweeps(sides(spark, sf_dir)), "symbol", "bar", "side", "level", "stop", "target")


@query(
    "structure_turns",
    f"""{PEAKED}, p AS (SELECT symbol, side, i, i + 3 AS ready, h, lag(h) OVER {KEY} AS oh FROM pk WHERE peak), d AS (SELECT symbol, side, i + 3 AS ready, l, lag(l) OVER {KEY} AS ol FROM pk WHERE dip),
 a AS (SELECT n.*, lag(n.c) OVER (PARTITION BY n.symbol, n.side ORDER BY n.i) AS pc, p.i AS pi, p.h AS ph, p.oh FROM n ASOF LEFT JOIN p ON p.symbol = n.symbol AND p.side = n.side AND n.i >= p.ready),
 b AS (SELECT a.*, d.l AS dl, d.ol FROM a ASOF LEFT JOIN d ON d.symbol = a.symbol AND d.side = a.side AND a.i >= d.ready),
 k AS (SELECT *, row_number() OVER (PARTITION BY symbol, side, pi ORDER BY i) AS nth FROM b WHERE ph < oh AND dl < ol AND c > ph AND pc <= ph AND atr IS NOT NULL)
SELECT symbol, bar, side::INT AS side, round(side * ph, 6) AS level, round(side * (dl - 0.1::DOUBLE * atr), 6) AS stop, round(side * oh, 6) AS target FROM k WHERE nth = 1""",
)
def structure_turns(spark, sf_dir):
    """Changes of character: the first close beyond the last peak of a falling structure, and the mirror of it."""
    return rounded(P.structure_turns(sides(spark, sf_dir)), "symbol", "bar", "side", "level", "stop", "target")


def confirmed(start: str, columns: str, test: str, low: int, high: int, setup: str, level: str, goal: str, source: str = "n") -> str:
    """SQL of a first bar (row s, with extra columns) and the first bar x from `low` to `high` bars on that passes the test; the latest start of a confirming bar."""
    return f"""{SIDED}, r AS (SELECT *, {columns} FROM n), s AS (SELECT * FROM r WHERE {start}),
 x AS (SELECT s.symbol, s.side, s.bar AS began, s.i AS si, x.i, x.bar, x.atr, s.side * ({level}) AS level, s.side * ({goal}) AS target, row_number() OVER (PARTITION BY s.symbol, s.side, s.i ORDER BY x.i) AS nth FROM s JOIN n x ON x.symbol = s.symbol AND x.side = s.side AND x.i BETWEEN s.i + {low} AND s.i + {high} WHERE {test}),
 u AS (SELECT *, row_number() OVER (PARTITION BY symbol, side, bar ORDER BY began DESC) AS newest FROM x WHERE nth = 1)
SELECT u.symbol, u.bar, u.side::INT AS side, '{setup}' AS setup, u.began, round(any_value(level), 6) AS level, round(u.side * (min(z.l) - 0.2::DOUBLE * any_value(u.atr)), 6) AS stop, round(any_value(target), 6) AS target FROM u JOIN n z ON z.symbol = u.symbol AND z.side = u.side AND z.i BETWEEN u.si AND u.i WHERE newest = 1 GROUP BY u.symbol, u.bar, u.side, u.began"""


SIGNAL = ("symbol", "bar", "side", "setup", "began", "level", "stop", "target")
RANGE = f"CASE WHEN count(*) OVER {prior(24)} = 24 THEN max(h) OVER {prior(24)} END AS top, CASE WHEN count(*) OVER {prior(24)} = 24 THEN min(l) OVER {prior(24)} END AS flr"


@query("springs", confirmed("(top - flr) / atr <= 8 AND l < flr - 0.1::DOUBLE * atr AND rel >= 1", RANGE, "x.c > s.flr AND x.c > x.o", 0, 2, "spring", "s.flr", "s.top"))
def springs(spark, sf_dir):
    """Piercings of a tight range that are won back within three bars."""
    return rounded(P.springs(sides(spark, sf_dir)), *SIGNAL)


@query("climaxes", confirmed("rel >= 1.5 AND c - o <= -1 * atr", "1 AS one", "x.c > (s.o + s.c) / 2 AND x.c > x.o", 1, 3, "climax", "(s.o + s.c) / 2", "greatest(s.h, s.o)"))
def climaxes(spark, sf_dir):
    """Heavy one-sided bars of which the next ones win back half."""
    return rounded(P.climaxes(sides(spark, sf_dir)), *SIGNAL)


@query("broken_absorptions", confirmed("rel >= 1.5 AND h - l <= 1 * atr", "1 AS one", "x.c > s.h AND x.c > x.o", 1, 3, "absorb", "s.h", "NULL::DOUBLE"))
def broken_absorptions(spark, sf_dir):
    """Heavy narrow bars that one of the next bars leaves."""
    return rounded(P.absorptions(sides(spark, sf_dir)), *SIGNAL)


@query(
    "gap_fills",
    f"""{SIDED}, r AS (SELECT *, lag(h, 2) OVER {KEY} AS base, lag(c - o) OVER {KEY} AS thrust, lag(atr) OVER {KEY} AS span, lag(rel) OVER {KEY} AS push FROM n), s AS (SELECT *, (base + l) / 2 AS centre FROM r WHERE l > base AND thrust >= 0.5 * span AND push >= 1),
 x AS (SELECT s.symbol, s.side, s.bar AS began, s.base, s.centre, x.bar, x.i, x.c < s.base AS dead, x.l <= s.centre - 0.05::DOUBLE * s.atr AS hit FROM s JOIN n x ON x.symbol = s.symbol AND x.side = s.side AND x.i BETWEEN s.i + 1 AND s.i + 12),
 f AS (SELECT *, row_number() OVER (PARTITION BY symbol, side, began ORDER BY i) AS nth FROM x WHERE dead OR hit)
SELECT symbol, bar, side::INT AS side, began, round(side * centre, 6) AS level, round(side * base, 6) AS base FROM f WHERE nth = 1 AND NOT dead""",
)
def gap_fills(spark, sf_dir):
    """Gaps behind a strong bar whose centre is met again within twelve bars."""
    return rounded(P.gap_fills(sides(spark, sf_dir)), "symbol", "bar", "side", "began", "level", "base")


@query("break_outcomes", f"{BROKEN}, a AS (SELECT symbol, side, began, TRUE AS retest, FALSE AS fake FROM r WHERE nth = 1 UNION ALL SELECT symbol, side, began, FALSE, TRUE FROM d WHERE k = dead AND k <= 3), g AS (SELECT symbol, side, began, bool_or(retest) AS retest, bool_or(fake) AS fake FROM a GROUP BY 1, 2, 3) SELECT s.symbol, s.side::INT AS side, count(*) AS breaks, count(*) FILTER (g.retest) AS retests, count(*) FILTER (g.fake) AS fakes FROM s LEFT JOIN g ON g.symbol = s.symbol AND g.side = s.side AND g.began = s.bar GROUP BY 1, 2")
def break_outcomes(spark, sf_dir):
    """Of each symbol's breaks on either side, how many are retested and how many fail."""
    rows = sides(spark, sf_dir)
    new = P.ranges(rows, 20)
    new = new.withColumn("new", (F.col("c") > F.col("top")) & (F.lag("c").over(P.by_side()) <= F.lag("top").over(P.by_side()))).where("new")
    breaks = new.groupBy("symbol", "side").agg(F.count("*").alias("breaks"))
    found = P.break_retests(rows).withColumn("side", F.when(F.col("setup") == "fake", -F.col("side")).otherwise(F.col("side")))
    sums = found.groupBy("symbol", "side").agg(F.count_if(F.col("setup") == "retest").alias("retests"), F.count_if(F.col("setup") == "fake").alias("fakes"))
    return breaks.join(sums, ["symbol", "side"], "left").na.fill(0)


RANGED = f"""{SIDED}, g AS (SELECT *, CASE WHEN count(*) OVER p = 48 THEN max(h) OVER p END AS top, CASE WHEN count(*) OVER p = 48 THEN min(l) OVER p END AS flr, avg(v) OVER q AS recent, avg(v) OVER o AS older, CASE WHEN count(*) OVER b = 96 THEN lag(c, 48) OVER {KEY} - max(h) OVER b <= -6 * atr END AS fell FROM n WINDOW p AS {prior(48)}, q AS {prior(24)}, o AS (PARTITION BY symbol, side ORDER BY bar ROWS BETWEEN 48 PRECEDING AND 25 PRECEDING), b AS (PARTITION BY symbol, side ORDER BY bar ROWS BETWEEN 144 PRECEDING AND 49 PRECEDING)), t AS (SELECT *, top - flr AS tall FROM g WHERE top - flr BETWEEN 2 * atr AND 8 * atr)"""


@query(
    "range_setups",
    f"{RANGED} SELECT symbol, bar, side::INT AS side, 'fade' AS setup, round(side * (flr - 0.3::DOUBLE * atr), 6) AS stop, round(side * (top - 0.1::DOUBLE * tall), 6) AS target FROM t WHERE l <= flr + 0.2::DOUBLE * tall AND c > flr AND c < (flr + top) / 2 UNION ALL SELECT symbol, bar, side, 'break', round(side * (flr + top) / 2, 6), round(side * (top + tall), 6) FROM t WHERE c > top AND rel >= 1.5 UNION ALL SELECT symbol, bar, side, CASE WHEN fell THEN 'spring' ELSE 'reclaim' END, round(side * (l - 0.1::DOUBLE * atr), 6), round(side * top, 6) FROM t WHERE l < flr - 0.1::DOUBLE * atr AND c > flr AND (NOT fell OR (fell AND recent < older))",
)
def range_setups(spark, sf_dir):
    """Fades, breaks, springs and reclaims of the two-day range."""
    return rounded(P.range_setups(sides(spark, sf_dir)), "symbol", "bar", "side", "setup", "stop", "target")


@query(
    "body_fakeouts",
    f"{PEAKED}, d AS (SELECT symbol, side, i, i + 3 AS ready, l FROM pk WHERE dip), a AS (SELECT n.*, lag(n.c) OVER w AS oc, lag(n.l) OVER w AS ol, d.l AS price, d.i AS di FROM n ASOF LEFT JOIN d ON d.symbol = n.symbol AND d.side = n.side AND n.i >= d.ready WINDOW w AS (PARTITION BY n.symbol, n.side ORDER BY n.i)) SELECT symbol, bar, side::INT AS side, round(side * price, 6) AS level, round(side * (least(l, ol) - 0.1::DOUBLE * atr), 6) AS stop FROM a WHERE oc < price AND c > price AND i - 1 > di + 3 AND atr IS NOT NULL",
)
def body_fakeouts(spark, sf_dir):
    """Closes beyond the last swing that the next bar takes back."""
    return rounded(P.body_fakeouts(sides(spark, sf_dir)), "symbol", "bar", "side", "level", "stop")


@query(
    "stop_hunts",
    f"{PEAKED}, d AS (SELECT symbol, side, i, l FROM pk WHERE dip), q AS (SELECT n.symbol, n.side, n.bar, n.i, n.l, n.atr, d.i AS di, d.l AS price FROM n JOIN d ON d.symbol = n.symbol AND d.side = n.side AND d.i BETWEEN n.i - 120 AND n.i - 3 WHERE n.atr IS NOT NULL AND n.l < d.l - 0.1::DOUBLE * n.atr AND n.c > d.l), e AS (SELECT q.*, row_number() OVER (PARTITION BY q.symbol, q.side, q.i ORDER BY q.di DESC) AS newest FROM q WHERE EXISTS (SELECT 1 FROM d WHERE d.symbol = q.symbol AND d.side = q.side AND d.i BETWEEN q.i - 120 AND q.i - 3 AND d.i <> q.di AND abs(d.l - q.price) <= 0.25::DOUBLE * q.atr)) SELECT symbol, bar, side::INT AS side, round(side * price, 6) AS level, round(side * (l - 0.1::DOUBLE * atr), 6) AS stop FROM e WHERE newest = 1",
)
def stop_hunts(spark, sf_dir):
    """Sweeps of equal lows (or highs) that close back."""
    return rounded(P.stop_hunts(sides(spark, sf_dir)), "symbol", "bar", "side", "level", "stop")


PARTS = (0.382, 0.5, 0.618, 0.705, 0.786)
IMPULSE = f"""{PEAKED}, u AS (SELECT n.symbol, n.side, n.bar, n.i, n.c, n.atr, p.i AS pi, p.h AS top FROM n JOIN pk p ON p.symbol = n.symbol AND p.side = n.side AND p.i = n.i - 3 AND p.peak WHERE n.atr IS NOT NULL),
 v AS (SELECT u.*, d.i AS di, d.l AS low, row_number() OVER (PARTITION BY u.symbol, u.side, u.i ORDER BY d.i DESC) AS nth FROM u JOIN pk d ON d.symbol = u.symbol AND d.side = u.side AND d.dip AND d.i < u.pi AND d.i >= u.i - 96),
 x AS (SELECT v.symbol, v.side, v.bar, v.i, v.c, v.atr, v.top, v.low, sum((m.h + m.l + m.c) / 3 * m.v) / greatest(sum(m.v), 1e-12) AS vwap FROM v JOIN n m ON m.symbol = v.symbol AND m.side = v.side AND m.i BETWEEN v.di AND v.i WHERE nth = 1 AND top - low >= 4 * v.atr GROUP BY ALL HAVING max(m.h) <= top AND min(CASE WHEN m.i <= v.i - 3 THEN m.l END) >= low),
 e AS (SELECT *, unnest([{', '.join(f"{{'s': 'fib_{p}', 'level': top - {p}::DOUBLE * (top - low)}}" for p in PARTS)}, {{'s': 'vwap', 'level': vwap}}]) AS e FROM x),
 k AS (SELECT *, e.s AS setup, e.level AS level, low - 0.1::DOUBLE * atr AS stop FROM e WHERE e.level < c AND e.level > low),
 f AS (SELECT k.symbol, k.side, k.i, k.setup, m.bar AS at, m.l <= k.level - 0.05::DOUBLE * k.atr AS hit, m.h > k.top OR m.c < k.stop AS gone, row_number() OVER (PARTITION BY k.symbol, k.side, k.i, k.setup ORDER BY m.i) AS nth FROM k JOIN n m ON m.symbol = k.symbol AND m.side = k.side AND m.i BETWEEN k.i + 1 AND k.i + 48 WHERE m.l <= k.level - 0.05::DOUBLE * k.atr OR m.h > k.top OR m.c < k.stop)"""


@query("impulse_pullbacks", f"{IMPULSE} SELECT k.symbol, k.bar, k.side::INT AS side, k.setup, round(k.side * k.level, 6) AS level, round(k.side * k.stop, 6) AS stop, round(k.side * k.top, 6) AS target, CASE WHEN f.hit AND NOT f.gone THEN f.at END AS at FROM k LEFT JOIN f ON f.symbol = k.symbol AND f.side = k.side AND f.i = k.i AND f.setup = k.setup AND f.nth = 1")
def impulse_pullbacks(spark, sf_dir):
    """Fibonacci and anchored-price entries into the last impulse, and when they are filled."""
    return rounded(P.impulse_pullbacks(sides(spark, sf_dir)), "symbol", "bar", "side", "setup", "level", "stop", "target", "at")
