"""Registered queries of learned scores on bar features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickframe.learning import linear as L
from tickframe.learning import models as M
from tickframe.operators import frames as W
from tickframe.operators import quantiles as Q
from tickframe.plans.queries import BARS, OVER, before, hourly, query

ROWS = f"f AS (SELECT symbol, bar, ln(close / lag(close, 4) OVER {OVER}) AS mom, buy / nullif(volume, 0) - 0.5 AS flow, ln(volume / nullif(avg(volume) OVER {before(24)}, 0)) AS push, ln(lead(close) OVER {OVER} / close) AS y FROM bars), x AS (SELECT * FROM f WHERE mom IS NOT NULL AND flow IS NOT NULL AND y IS NOT NULL)"
SUMS = "count(*)::DOUBLE AS n, sum(y) AS y, sum(mom) AS s0, sum(flow) AS s1, sum(mom * y) AS t0, sum(flow * y) AS t1, sum(mom * mom) AS g00, sum(mom * flow) AS g01, sum(flow * flow) AS g11"
NAMES = ("n", "y", "s0", "s1", "t0", "t1", "g00", "g01", "g11")


def solved(source: str, keys: str = "") -> str:
    """SQL of the two slopes and the base from sums, with a penalty of 10."""
    v = f"SELECT {keys} n, s0 / n AS m0, s1 / n AS m1, y / n AS my, g00 / n - pow(s0 / n, 2) AS v0, g11 / n - pow(s1 / n, 2) AS v1, g01 / n - s0 / n * s1 / n AS v01, t0 / n - s0 / n * y / n AS r0, t1 / n - s1 / n * y / n AS r1 FROM {source}"
    w = f"SELECT *, (r0 * v1 * (1 + 10 / n) - r1 * v01) / (v0 * (1 + 10 / n) * v1 * (1 + 10 / n) - v01 * v01) AS a, (r1 * v0 * (1 + 10 / n) - r0 * v01) / (v0 * (1 + 10 / n) * v1 * (1 + 10 / n) - v01 * v01) AS b FROM ({v})"
    return f"SELECT {keys} a, b, my - a * m0 - b * m1 AS base FROM ({w})"


def features(spark, sf_dir):
    b = hourly(spark, sf_dir)
    mom, push = F.log(F.col("close") / F.lag("close", 4).over(W.order())), F.log(F.col("volume") / F.nullif(F.avg("volume").over(W.before(24)), F.lit(0.0)))
    y = F.log(F.lead("close").over(W.order()) / F.col("close"))
    rows = b.select("symbol", "bar", mom.alias("mom"), (F.col("buy") / F.nullif(F.col("volume"), F.lit(0.0)) - 0.5).alias("flow"), push.alias("push"), y.alias("y"))
    return rows.where("mom is not null and flow is not null and y is not null")


CUT = "2024-01-20"


def early():
    return F.col("bar") < F.lit(CUT).cast("timestamp_ntz")


@query("ridge_scores", f"WITH {BARS}, {ROWS}, s AS (SELECT {SUMS} FROM x WHERE bar < TIMESTAMP '{CUT}'), w AS ({solved('s')}) SELECT symbol, bar, round(a * mom + b * flow + base, 6) AS score FROM x, w WHERE bar >= TIMESTAMP '{CUT}'")
def ridge_scores(spark, sf_dir):
    """Scores of later bars by a ridge regression on earlier ones; scaling comes from those alone."""
    rows = features(spark, sf_dir)
    model = L.fit(rows.where(early()), ["mom", "flow"], "y", 10.0)
    return rows.where(~early()).select("symbol", "bar", F.round(model.score(), 6).alias("score"))


WEEKS = f"p AS (SELECT date_trunc('week', bar) AS week, {SUMS} FROM x GROUP BY 1), c AS (SELECT week, {', '.join(f'sum({n}) OVER (ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS {n}' for n in NAMES)} FROM p), w AS ({solved('(SELECT * FROM c WHERE n >= 200)', 'week,')})"


@query("walk_forward", f"WITH {BARS}, {ROWS}, {WEEKS} SELECT symbol, bar, round(a * mom + b * flow + base, 6) AS score FROM x JOIN w ON w.week = date_trunc('week', x.bar)")
def walk_forward(spark, sf_dir):
    """Scores of each week by the weeks before it: cumulative sums, a model a row, no loop over splits."""
    rows = features(spark, sf_dir).withColumn("week", F.date_trunc("week", "bar"))
    return L.walked_forward(rows, "week", ["mom", "flow"], "y", 10.0, 200).select("symbol", "bar", F.round("score", 6).alias("score"))


FOLDS = f"z AS (SELECT *, day(bar) % 3 AS fold FROM x), p AS (SELECT fold, {SUMS} FROM z GROUP BY 1), c AS (SELECT fold, {', '.join(f'sum({n}) OVER () - {n} AS {n}' for n in NAMES)} FROM p), w AS ({solved('c', 'fold,')}), o AS (SELECT symbol, bar, a * mom + b * flow + base AS score FROM z JOIN w USING (fold))"


@query("fold_threshold", f"WITH {BARS}, {ROWS}, {FOLDS} SELECT symbol, count(*) AS n, round(quantile_cont(score, 0.9), 6) AS cut FROM o GROUP BY 1")
def fold_threshold(spark, sf_dir):
    """The 90 % point of out-of-fold scores of each symbol."""
    rows = features(spark, sf_dir).withColumn("fold", F.dayofmonth("bar") % 3)
    out = L.out_of_fold(rows, "fold", ["mom", "flow"], "y", 10.0)
    cuts = Q.percentiles(out, ["symbol"], "score", [0.9]).select("symbol", F.round("value", 6).alias("cut"))
    return out.groupBy("symbol").agg(F.count("*").alias("n")).join(cuts, "symbol")


WIDE = "count(*)::DOUBLE AS n, sum(y) AS y, " + ", ".join(f"sum({x}) AS s{i}, sum({x} * y) AS t{i}" for i, x in enumerate(("mom", "flow", "push"))) + ", " + ", ".join(f"sum({a} * {b}) AS g{i}{j}" for i, a in enumerate(("mom", "flow", "push")) for j, b in enumerate(("mom", "flow", "push")) if i <= j)
WIDE_NAMES = ("n", "y", *(f"{c}{i}" for c in "st" for i in range(3)), *(f"g{i}{j}" for i in range(3) for j in range(i, 3)))


def determinant(columns: list[list[str]]) -> str:
    """SQL of the determinant of three columns of three expressions."""
    (a, d, g), (b, e, h), (c, f, i) = columns
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def cramer(source: str, key: str) -> str:
    """SQL of three slopes and the base by Cramer's rule, with a penalty of 10."""
    v = f"SELECT {key}, n, y / n AS my, " + ", ".join(f"s{i} / n AS m{i}, t{i} / n - s{i} / n * y / n AS r{i}" for i in range(3)) + ", " + ", ".join(f"(g{i}{j} / n - s{i} / n * s{j} / n){' * (1 + 10 / n)' if i == j else ''} AS v{i}{j}" for i in range(3) for j in range(i, 3)) + f" FROM {source}"
    matrix = [[f"v{min(i, j)}{max(i, j)}" for i in range(3)] for j in range(3)]
    own = ["r0", "r1", "r2"]
    weights = ", ".join(f"{determinant([own if j == k else matrix[j] for j in range(3)])} / {determinant(matrix)} AS w{k}" for k in range(3))
    return f"SELECT {key}, w0, w1, w2, my - w0 * m0 - w1 * m1 - w2 * m2 AS base FROM (SELECT *, {weights} FROM ({v}))"


WIDE_ROWS = f"{ROWS}, xw AS (SELECT * FROM x WHERE push IS NOT NULL)"


@query("walk_forward_wide", f"WITH {BARS}, {WIDE_ROWS}, p AS (SELECT date_trunc('week', bar) AS week, {WIDE} FROM xw GROUP BY 1), c AS (SELECT week, {', '.join(f'sum({n}) OVER (ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS {n}' for n in WIDE_NAMES)} FROM p), w AS ({cramer('(SELECT * FROM c WHERE n >= 200)', 'week')}) SELECT symbol, bar, round(w0 * mom + w1 * flow + w2 * push + base, 6) AS score FROM xw JOIN w ON w.week = date_trunc('week', xw.bar)")
def walk_forward_wide(spark, sf_dir):
    """Scores of each week by three features over the weeks before it."""
    rows = features(spark, sf_dir).where("push is not null").withColumn("week", F.date_trunc("week", "bar"))
    return L.walked_forward(rows, "week", ["mom", "flow", "push"], "y", 10.0, 200).select("symbol", "bar", F.round("score", 6).alias("score"))


@query("fold_threshold_wide", f"WITH {BARS}, {WIDE_ROWS}, z AS (SELECT *, day(bar) % 3 AS fold FROM xw), p AS (SELECT fold, {WIDE} FROM z GROUP BY 1), c AS (SELECT fold, {', '.join(f'sum({n}) OVER () - {n} AS {n}' for n in WIDE_NAMES)} FROM p), w AS ({cramer('c', 'fold')}), o AS (SELECT symbol, w0 * mom + w1 * flow + w2 * push + base AS score FROM z JOIN w USING (fold)) SELECT symbol, count(*) AS n, round(quantile_cont(score, 0.9), 6) AS cut FROM o GROUP BY 1")
def fold_threshold_wide(spark, sf_dir):
    """The 90 % point of out-of-fold scores of three features for each symbol."""
    rows = features(spark, sf_dir).where("push is not null").withColumn("fold", F.dayofmonth("bar") % 3)
    out = L.out_of_fold(rows, "fold", ["mom", "flow", "push"], "y", 10.0)
    cuts = Q.percentiles(out, ["symbol"], "score", [0.9]).select("symbol", F.round("value", 6).alias("cut"))
    return out.groupBy("symbol").agg(F.count("*").alias("n")).join(cuts, "symbol")


@query("boosted_scores")
def boosted_scores(spark, sf_dir):
    """Gradient-boosted trees on earlier bars, scores of later ones."""
    rows = features(spark, sf_dir).where("push is not null")
    return M.boosted(rows.where(early()), rows.where(~early()), ["mom", "flow", "push"], "y").select("symbol", "bar", "score")


@query("boosted_tail")
def boosted_tail(spark, sf_dir):
    """Later bars whose score is in the top tenth of what earlier bars score."""
    rows = features(spark, sf_dir).where("push is not null")
    scored = M.boosted(rows.where(early()), rows, ["mom", "flow", "push"], "y")
    return M.tail(scored.where(~early()), scored.where(early())).select("symbol", "bar", "score", "y")


@query("situation_clusters")
def situation_clusters(spark, sf_dir):
    """Clusters of bar features learned from earlier bars, with the mean next return of each cluster in later ones."""
    rows = features(spark, sf_dir).where("push is not null")
    out = M.situations(rows.where(early()), rows.where(~early()), ["mom", "flow", "push"])
    return out.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("y").alias("mean"))


@query("loss_similarity", "WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag AS setup, l_linestatus AS side, l_shipmode_ AS regime, l_partkey FROM (SELECT *, CASE WHEN l_quantity > 25 THEN 'large' ELSE 'small' END AS l_shipmode_ FROM lineitem)), k AS (SELECT l_partkey, any_value(1) AS one, arg_max(setup, (l_orderkey, l_linenumber)) AS setup, arg_max(side, (l_orderkey, l_linenumber)) AS side, arg_max(regime, (l_orderkey, l_linenumber)) AS regime FROM l GROUP BY 1) SELECT l_orderkey, l_linenumber, (CASE WHEN l.setup = k.setup THEN 3 ELSE 0 END + CASE WHEN l.side = k.side THEN 2 ELSE 0 END + CASE WHEN l.regime = k.regime THEN 1 ELSE 0 END)::INT AS likeness FROM l JOIN k USING (l_partkey)")
def loss_similarity(spark, sf_dir):
    """Likeness of each line's context with the last one of the same part: points for each field that agrees."""
    from tickframe.sources.tables import table

    regime = F.when(F.col("l_quantity") > 25, "large").otherwise("small")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("setup"), F.col("l_linestatus").alias("side"), regime.alias("regime"))
    last = rows.groupBy("l_partkey").agg(F.max_by(F.struct("setup", "side", "regime"), F.struct("l_orderkey", "l_linenumber")).alias("k"))
    points = sum((F.when(F.col(c) == F.col(f"k.{c}"), w).otherwise(0) for c, w in (("setup", 3), ("side", 2), ("regime", 1))), F.lit(0))
    return rows.join(last, "l_partkey").select("l_orderkey", "l_linenumber", points.cast("int").alias("likeness"))


@query("failure_veto")
def failure_veto(spark, sf_dir):
    """Later bars that a model of falls, learned from earlier ones, does not veto."""
    rows = features(spark, sf_dir).where("push is not null").withColumn("fell", (F.col("y") < -0.5).cast("double"))
    scored = M.failing(rows.where(early()), rows, ["mom", "flow", "push"], "fell")
    return M.vetoed(scored.where(~early()), scored.where(early())).select("symbol", "bar", "risk", "y")
