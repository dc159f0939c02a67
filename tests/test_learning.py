import numpy as np
from pyspark.sql import functions as F

from tickframe.learning import linear as L
from tickframe.learning import models as M


def made(spark, n=600):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((n, 3)) * [1.0, 5.0, 0.2] + [3.0, -2.0, 0.0]
    y = 0.5 * x[:, 0] - 0.2 * x[:, 1] + 4 * x[:, 2] + 0.1 * rng.standard_normal(n)
    rows = [(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "id int, a double, b double, c double, y double")


def test_ridge_is_the_normal_equations(spark):
    x, y, rows = made(spark)
    model = L.fit(rows, ["a", "b", "c"], "y", 7.0)
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + 7.0 * np.eye(3), z.T @ (y - y.mean()))
    assert np.allclose(model.weights, want) and np.isclose(model.base, y.mean())
    got = [r.s for r in rows.select("id", model.score().alias("s")).orderBy("id").collect()]
    assert np.allclose(got, z @ want + y.mean())


def test_walk_forward_uses_the_past_alone(spark):
    x, y, rows = made(spark)
    out = L.walked_forward(rows.withColumn("week", F.floor(F.col("id") / 100)), "week", ["a", "b"], "y", 3.0, 150).collect()
    assert {r.week for r in out} == {2, 3, 4, 5}
    for r in out[::50]:
        past, own = x[: r.week * 100, :2], y[: r.week * 100]
        z = (past - past.mean(0)) / past.std(0)
        w = np.linalg.solve(z.T @ z + 3.0 * np.eye(2), z.T @ (own - own.mean()))
        assert np.isclose(r.score, ((x[r.id, :2] - past.mean(0)) / past.std(0)) @ w + own.mean())


def test_trees_and_clusters_learn(spark):
    _, y, rows = made(spark)
    scored = M.boosted(rows.where("id < 400"), rows.where("id >= 400"), ["a", "b", "c"], "y", rounds=8)
    pairs = [(r.score, r.y) for r in scored.collect()]
    assert len(pairs) == 200 and np.corrcoef(*zip(*pairs))[0, 1] > 0.7
    kept = M.tail(scored, scored).count()
    assert 15 <= kept <= 25
    groups = M.situations(rows.where("id < 400"), rows, ["a", "b", "c"], 4).groupBy("cluster").count().collect()
    assert len(groups) == 4 and sum(r["count"] for r in groups) == 600


def test_risk_separates_failures(spark):
    _, y, rows = made(spark)
    marked = rows.withColumn("failed", (F.col("y") < 1.0).cast("double"))
    scored = M.failing(marked.where("id < 400"), marked, ["a", "b", "c"], "failed")
    late = scored.where("id >= 400")
    means = {r.failed: r.m for r in late.groupBy("failed").agg(F.avg("risk").alias("m")).collect()}
    assert means[1.0] > means[0.0] + 0.3
    kept = M.vetoed(late, scored.where("id < 400"), 0.8)
    assert 100 < kept.count() < 200 and kept.where("failed = 1").count() < late.where("failed = 1").count()
