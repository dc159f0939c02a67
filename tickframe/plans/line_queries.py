"""Registered queries of live trend lines, levels in a trade's way, and depth."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickframe.operators import frames as W
from tickframe.operators import obstruction as O
from tickframe.operators import profiles as V
from tickframe.operators import recursive as R
from tickframe.operators import trendlines as L
from tickframe.plans.queries import BARS, TR, hourly, last, query, rounded
from tickframe.plans.recurrences import N, SWING, recursion, with_unit
from tickframe.plans.trigger_queries import AREA, OVERLAP
from tickframe.sources.tables import bars, cut, ticks

#: The life of a line as columns of one row: SQL has no objects, so each state is a CASE over what the bar before left.
LIVE = {
    "y": ("NULL", "CASE WHEN r.born IS NOT NULL THEN r.p2 + r.s * (n.i - r.i2) END"),
    "brk": ("0", "(q_y IS NOT NULL AND n.c - q_y < -0.25::DOUBLE * n.unit)::INT"),
    "test": ("0", "(q_y IS NOT NULL AND q_brk = 0 AND r.testing = 0 AND n.l <= q_y + 0.25::DOUBLE * n.unit)::INT"),
    "done": ("0", "(q_y IS NOT NULL AND q_brk = 0 AND r.testing = 1 AND n.c - q_y > n.unit)::INT"),
    "alive": ("0", "(q_y IS NOT NULL AND q_brk = 0)::INT"),
    "ys": ("NULL", "CASE WHEN q_alive = 1 AND n.sw IS NOT NULL THEN r.p2 + r.s * (n.swi - r.i2) END"),
    "hit": ("0", "(q_ys IS NOT NULL AND abs(n.sw - q_ys) <= 0.35::DOUBLE * n.swu)::INT"),
    "up": ("0", "(q_ys IS NOT NULL AND q_hit = 0 AND n.sw > q_ys)::INT"),
    "void": ("0", "(q_ys IS NOT NULL AND q_hit = 0 AND q_up = 0)::INT"),
    "fresh": ("0", "(n.sw IS NOT NULL AND (q_alive = 0 OR q_void = 1) AND r.lp IS NOT NULL AND n.sw > r.lp)::INT"),
    "drawn": ("0", "(q_up = 1 OR q_fresh = 1)::INT"),
    "prev": ("NULL", "CASE WHEN q_up = 1 THEN r.s WHEN q_fresh = 1 THEN NULL ELSE r.prev END"),
    "s": ("NULL", "CASE WHEN q_up = 1 THEN (n.sw - r.p2) / (n.swi - r.i2) WHEN q_fresh = 1 THEN (n.sw - r.lp) / (n.swi - r.li) ELSE r.s END"),
    "i1": ("NULL", "CASE WHEN q_up = 1 THEN r.i2 WHEN q_fresh = 1 THEN r.li ELSE r.i1 END"),
    "i2": ("NULL", "CASE WHEN q_drawn = 1 THEN n.swi ELSE r.i2 END"),
    "p2": ("NULL", "CASE WHEN q_drawn = 1 THEN n.sw ELSE r.p2 END"),
    "born": ("NULL", "CASE WHEN q_drawn = 1 THEN n.i WHEN q_alive = 0 OR q_void = 1 THEN NULL ELSE r.born END"),
    "u0": ("NULL", "CASE WHEN q_drawn = 1 THEN n.unit ELSE r.u0 END"),
    "no": ("0", "r.no + q_drawn"),
    "touches": ("0", "CASE WHEN q_drawn = 1 THEN 2 ELSE r.touches + q_hit END"),
    "tests": ("0", "CASE WHEN q_drawn = 1 THEN 0 ELSE r.tests + q_done END"),
    "testing": ("0", "CASE WHEN q_drawn = 1 THEN 0 WHEN q_test = 1 THEN 1 WHEN q_done = 1 THEN 0 ELSE r.testing END"),
    "lp": ("sw", "coalesce(n.sw, r.lp)"),
    "li": ("swi", "coalesce(n.swi, r.li)"),
}
SIDED = f"""n1 AS (SELECT n.symbol, n.bar, n.i, n.high, n.low, n.close, rec.unit FROM n JOIN rec USING (symbol, bar)), tu AS (SELECT symbol, bar, turn, CASE WHEN turn > 0 THEN tt ELSE ff END AS price, CASE WHEN turn > 0 THEN ti ELSE fi END AS swi FROM rec WHERE turn <> 0),
 m AS MATERIALIZED (SELECT x.symbol || '|' || s.side AS symbol, x.bar, x.i, s.side, x.unit, s.side * x.close AS c, CASE WHEN s.side > 0 THEN x.low ELSE -x.high END AS l, s.side * t.price AS sw, t.swi, z.unit AS swu FROM n1 x, (VALUES (1), (-1)) s(side) LEFT JOIN tu t ON t.symbol = x.symbol AND t.bar = x.bar AND t.turn = -s.side LEFT JOIN n1 z ON z.symbol = t.symbol AND z.i = t.swi)"""
LIVED = f"WITH RECURSIVE {BARS}, {recursion(N, SWING)}, {recursion(SIDED, LIVE, 'rl', 'm')}, lv AS (SELECT string_split(b.symbol, '|')[1] AS symbol, b.bar, m.side, m.side * b.y AS line, a.no::INT AS number, a.touches::INT AS touches, a.tests::INT AS tests, a.s / a.u0 AS slope, (b.i - a.born)::INT AS age, (a.i2 - a.i1)::INT AS span, CASE WHEN a.prev <> 0 THEN a.s / a.prev END AS accel, b.test = 1 AS test, b.brk = 1 AS broken FROM rl b JOIN rl a ON a.symbol = b.symbol AND a.i = b.i - 1 JOIN m ON m.symbol = b.symbol AND m.i = b.i WHERE b.y IS NOT NULL)"


def lines(spark, sf_dir):
    rows = with_unit(spark, sf_dir)
    return L.live_lines(rows, R.swings(rows))


@query("live_lines", f"{LIVED} SELECT symbol, bar, side::INT AS side, round(line, 6) AS line, number, touches, tests, round(slope, 6) AS slope, age, span, round(accel, 4) AS accel, test, broken FROM lv")
def live_lines(spark, sf_dir):
    """The support and resistance lines that live at each bar."""
    found = rounded(lines(spark, sf_dir), "symbol", "bar", "side", "line", "number", "touches", "tests", "slope", "age", "span", "accel", "test", "broken")
    return found.withColumn("accel", F.round("accel", 4))


@query("line_lives", f"{LIVED} SELECT symbol, side::INT AS side, number, min(bar) AS first, max(bar) AS last, count(*) AS bars, max(touches) AS touches, max(tests) AS tests, count(*) FILTER (test) AS test_bars, bool_or(broken) AS broken FROM lv GROUP BY 1, 2, 3")
def line_lives(spark, sf_dir):
    """Each line's life: how long, how often touched and tested, and whether it was broken."""
    return L.line_lives(lines(spark, sf_dir))


# Obstruction: entries at each bar's close along its body, risking one mean range for two.

FRAMES = {"15 minutes": (2, 50 * 15), "1 hour": (2, 40 * 60), "4 hours": (3, 50 * 240)}  # bars on each side, and the minutes back that count


def bars_sql(name: str, minutes: int) -> str:
    return f"{name} AS (SELECT symbol, time_bucket(INTERVAL {minutes} minutes, ts)::TIMESTAMP AS bar, arg_min(price, (ts, id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, id)) AS close FROM ticks GROUP BY 1, 2)"


def levels_sql(name: str, minutes: int, k: int) -> str:
    """SQL of the levels of one bar size, by joining each bar with its neighbours by number."""
    n = f"n{name} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar) AS i FROM {name})"
    near = f"m{name} AS (SELECT a.symbol, a.i, a.high, a.low, count(*) AS c, max(b.high) AS mh, min(b.low) AS ml FROM n{name} a JOIN n{name} b ON b.symbol = a.symbol AND b.i BETWEEN a.i - {k} AND a.i + {k} GROUP BY 1, 2, 3, 4)"
    kinds = f"k{name} AS (SELECT symbol, i, high AS price, 1 AS kind FROM m{name} WHERE c = {2 * k + 1} AND high >= mh UNION ALL SELECT symbol, i, low, -1 FROM m{name} WHERE c = {2 * k + 1} AND low <= ml)"
    held = f"l{name} AS (SELECT k.symbol, k.i, k.price, k.kind, coalesce(min(CASE WHEN (k.kind > 0 AND b.high >= k.price) OR (k.kind < 0 AND b.low <= k.price) THEN b.i - k.i - 1 END), {2 * k - 1}) AS strength, max(b.bar) + INTERVAL {minutes} minutes AS known FROM k{name} k JOIN n{name} b ON b.symbol = k.symbol AND b.i BETWEEN k.i + 1 AND k.i + {2 * k - 1} GROUP BY 1, 2, 3, 4 HAVING count(*) = {2 * k - 1})"
    return f"{n}, {near}, {kinds}, {held}"


WIDTHS = {"15 minutes": ("q", 15), "1 hour": ("h", 60), "4 hours": ("f", 240)}
ALL_LEVELS = ", ".join(f"{bars_sql(a, m)}, {levels_sql(a, m, FRAMES[w][0])}" for w, (a, m) in WIDTHS.items()) + ", lv AS (" + " UNION ALL ".join(f"SELECT symbol, price, kind, known, {FRAMES[w][1]} AS back, ({m} >= 60 OR strength >= 3) AS major FROM l{a}" for w, (a, m) in WIDTHS.items()) + ")"
ENTRIES = f"{TR}, en AS (SELECT symbol, bar, bar + INTERVAL 1 hour AS at, sign(close - open)::INT AS side, close AS entry, atr FROM (SELECT *, CASE WHEN count(*) OVER w >= 14 THEN avg(tr) OVER w END AS atr FROM tr WINDOW w AS {last(14)}) WHERE atr > 0 AND close <> open), s AS (SELECT *, entry - side * atr AS stop, entry + 2 * side * atr AS target FROM en)"
IN_WAY = "(l.price > least(entry, target) AND l.price < greatest(entry, target))"


def entries(spark, sf_dir):
    rows = W.atr(hourly(spark, sf_dir)).where("atr > 0 and close <> open").withColumn("side", F.signum(F.col("close") - F.col("open")).cast("int"))
    return rows.select("symbol", "bar", "side", F.col("close").alias("entry"), (F.col("close") - F.col("side") * F.col("atr")).alias("stop"), (F.col("close") + 2 * F.col("side") * F.col("atr")).alias("target"))


def quarter(column, more):
    """Quarters of an hour since 1970: every bound here is a whole number of them."""
    return F.call_function("div", F.unix_seconds((column + F.expr(f"interval {more}")).cast("timestamp")), F.lit(900))


@query(
    "path_obstruction",
    f"""WITH {BARS}, {ALL_LEVELS}, {ENTRIES}, c AS (SELECT s.symbol, s.bar, side, entry, stop, target, count(l.price) AS seen, count(*) FILTER (major AND {IN_WAY}) AS major, count(*) FILTER (NOT major AND {IN_WAY}) AS minor, count(*) FILTER (major AND kind = side AND l.price > entry / 1.004::DOUBLE AND l.price < entry / 0.996::DOUBLE) AS near, CASE WHEN side > 0 THEN min(l.price) FILTER (major AND {IN_WAY}) ELSE max(l.price) FILTER (major AND {IN_WAY}) END AS nearest FROM s LEFT JOIN lv l ON l.symbol = s.symbol AND l.known <= s.at AND l.known > s.at - to_minutes(l.back::BIGINT) GROUP BY s.symbol, s.bar, side, entry, stop, target),
 p AS (SELECT *, nearest * (1 - side * 0.002::DOUBLE) AS pulled FROM c)
SELECT symbol, bar, side, major, minor, round(nearest, 6) AS nearest, round(CASE WHEN seen = 0 THEN 0.85 WHEN near > 0 THEN 0 WHEN major = 0 AND minor = 0 THEN 1 WHEN major = 0 THEN 0.85 - least(0.2, minor * 0.05) WHEN abs(pulled - entry) < abs(entry - stop) THEN 0 ELSE least(0.65, 0.3 + abs(pulled - entry) / abs(entry - stop) * 0.15) END::DOUBLE, 6) AS score, round(CASE WHEN near = 0 AND major > 0 AND abs(pulled - entry) >= abs(entry - stop) THEN pulled ELSE target END, 6) AS goal FROM p""",
)
def path_obstruction(spark, sf_dir):
    """Swing levels of three bar sizes between each bar's entry and target, known when it closes, and the score of the way."""
    by_tick, found = ticks(spark, sf_dir), None
    for width, (k, _) in FRAMES.items():
        some = O.swing_levels(bars(by_tick, width), k)
        major = F.lit(True) if width != "15 minutes" else F.col("strength") >= 3
        some = some.select("symbol", F.lit(width).alias("size"), "price", "kind", major.alias("major"), quarter(F.col("seen"), width).alias("at"))
        found = some if found is None else found.unionByName(some)
    rows = cut(entries(spark, sf_dir).withColumn("id", F.monotonically_increasing_id()))
    origin = found.agg(F.min("at")).first()[0] or 0
    flags = {"seen": F.lit(1), "major": F.col("major").cast("int"), "minor": (~F.col("major")).cast("int"), "tops": (F.col("major") & (F.col("kind") > 0)).cast("int"), "floors": (F.col("major") & (F.col("kind") < 0)).cast("int")}
    levels = found.select("symbol", "size", (F.col("at") - origin).alias("at"), "price", F.col("major").alias("strong"), *(c.alias(n) for n, c in flags.items()))
    infinite = F.lit(float("inf"))
    e, t = F.col("entry"), F.col("target")
    bounds = {"way": (F.least(e, t), F.greatest(e, t)), "near": (e / 1.004, e / 0.996), "all": (-infinite, infinite)}
    spans = rows.withColumn("last", quarter(F.col("bar"), "1 hour") - origin).withColumn("w", F.explode(F.array(*(F.struct(F.lit(n).alias("size"), F.lit(back // 15).alias("back")) for n, (_, back) in FRAMES.items()))))
    spans = spans.withColumn("b", F.explode(F.array(*(F.struct(F.lit(i).alias("what"), low.alias("low"), high.alias("high")) for i, (low, high) in enumerate(bounds.values())))))
    spans = spans.select("symbol", "w.size", (F.col("id") * 3 + F.col("b.what")).alias("id"), (F.col("last") - F.col("w.back") + 1).cast("long").alias("first"), F.col("last").cast("long").alias("last"), "b.low", "b.high").where("last >= 0")
    got = O.between(levels, spans, ["symbol", "size"], list(flags), "strong").withColumns({"what": F.col("id") % 3, "id": F.call_function("div", F.col("id"), F.lit(3))})
    picked = {n: (i, c) for n, i, c in (("major", 0, "major"), ("minor", 0, "minor"), ("above", 0, "above"), ("below", 0, "below"), ("tops", 1, "tops"), ("floors", 1, "floors"), ("seen", 2, "seen"))}
    wide = got.groupBy("id").agg(*(F.max(F.when(F.col("what") == i, F.col(c))).alias(n) for n, (i, c) in picked.items()))
    out = rows.join(wide, "id", "left").na.fill(0, ["major", "minor", "tops", "floors", "seen"])
    out = out.withColumn("nearest", F.when(F.col("major") > 0, F.when(F.col("side") > 0, F.col("above")).otherwise(F.col("below"))))
    near = F.when(F.col("side") > 0, F.col("tops")).otherwise(F.col("floors"))
    score, goal = O.level_score(F.col("side"), e, F.col("stop"), t, near, F.col("seen"), F.col("major"), F.col("minor"), F.col("nearest"))
    out = out.withColumns({"score": score, "goal": goal, "major": F.col("major").cast("long"), "minor": F.col("minor").cast("long")})
    return rounded(out, "symbol", "bar", "side", "major", "minor", "nearest", "score", "goal")


DAY_KEY = "db AS (SELECT symbol || '|' || strftime(bar, '%Y-%m-%d') AS symbol, bar, high, low, volume FROM bars)"
DAY_AREA = f"{DAY_KEY}, {OVERLAP.replace('FROM bars', 'FROM db')}, {AREA}, va AS (SELECT string_split(symbol, '|')[1] AS symbol, strptime(string_split(symbol, '|')[2], '%Y-%m-%d')::TIMESTAMP + INTERVAL 1 day AS day, base + (poc - 0.5) * width AS poc, base + hi * width AS vah, base + (lo - 1) * width AS val FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY k DESC) AS rn FROM rec) JOIN g USING (symbol) WHERE rn = 1)"


@query(
    "control_path",
    f"""WITH RECURSIVE {BARS}, {DAY_AREA}, {ENTRIES}, j AS (SELECT s.*, poc, vah, val, side * (entry - poc) / poc AS away, poc * (1 - side * 0.002::DOUBLE) AS pulled, side * poc > side * entry AND side * poc < side * target AS inside FROM s LEFT JOIN va ON va.symbol = s.symbol AND va.day = date_trunc('day', s.bar))
SELECT symbol, bar, side, round(poc, 6) AS poc, round(CASE WHEN poc IS NULL THEN 0.8 WHEN away >= 0.02 THEN 0 WHEN away >= 0.01 THEN 0.25 WHEN inside AND abs(pulled - entry) < abs(entry - stop) * 0.8 THEN 0.15 WHEN inside THEN least(0.55, 0.25 + abs(pulled - entry) / abs(entry - stop) * 0.15) WHEN side * poc <= side * entry AND abs(entry - poc) / entry < 0.005 THEN 1 WHEN side * poc <= side * entry THEN 0.9 WHEN val <= entry AND entry <= vah THEN 0.65 ELSE 0.85 END::DOUBLE, 6) AS score, round(CASE WHEN inside AND away < 0.01 AND abs(pulled - entry) >= abs(entry - stop) * 0.8 THEN pulled ELSE target END, 6) AS goal FROM j""",
)
def control_path(spark, sf_dir):
    """The control point of the day before in each entry's way, and the score of it."""
    rows = hourly(spark, sf_dir).withColumn("day", F.to_date("bar"))
    areas = V.value_area(V.overlap_profile(rows, 24, "symbol", "day"), 24, 0.7, "symbol", "day").withColumn("day", F.date_add("day", 1))
    out = entries(spark, sf_dir).withColumn("day", F.to_date("bar")).join(areas, ["symbol", "day"], "left")
    score, goal = O.control_score(*(F.col(c) for c in ("side", "entry", "stop", "target", "poc", "val", "vah")))
    return rounded(out.withColumns({"score": score, "goal": goal}), "symbol", "bar", "side", "poc", "score", "goal")
