import numpy as np
from pyspark.sql import functions as F

from tickframe.operators import nulls as U


def test_index_maps_are_permutations(spark):
    rows = spark.createDataFrame([(n, k) for n in (1, 2, 3, 5, 10, 97, 400) for k in (1, 2, 50)], "n long, key long")
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    got = rows.withColumn("at", U.index_map(F.col("i"), F.col("n"), F.col("key"))).collect()
    maps = {}
    for r in got:
        maps.setdefault((r.n, r.key), {})[r.i] = r.at
    for (n, _), m in maps.items():
        assert sorted(m.values()) == list(range(n))
    assert maps[97, 1] != maps[97, 2] and sum(i == a for i, a in maps[400, 1].items()) < 20


def test_shuffled_values_and_share(spark):
    values = [float(x) for x in np.random.default_rng(1).permutation(50)]
    rows = spark.createDataFrame([(g, i, v) for g in "ab" for i, v in enumerate(values)], "g string, i long, v double")
    out = U.shuffled(rows, ["g"], "i", "v", 5).collect()
    for g in "ab":
        for k in range(6):
            mine = {r.i: r.v for r in out if r.g == g and r["round"] == k}
            assert sorted(mine.values()) == sorted(values)
            assert (list(mine[i] for i in range(50)) == values) == (k == 0)
    stats = spark.createDataFrame([(k, 5.0 if k == 0 else float(k)) for k in range(10)], "round long, t double")
    r = U.against_null(stats, [], "t").first()
    assert (r.observed, r.null_mean, r.p) == (5.0, 5.0, 0.6)


def test_welch(spark):
    rng = np.random.default_rng(4)
    rows = [(1, p, float(v)) for p, (m, n) in enumerate([(0.0, 30), (1.0, 20), (0.4, 10)]) for v in rng.normal(m, 1 + p, n)]
    r = U.welch(spark.createDataFrame(rows, "g int, part int, r double"), ["g"], "part", "r").first()
    parts = [np.array([v for _, q, v in rows if q == p]) for p in range(3)]
    means = [x.mean() for x in parts]
    hi, lo = parts[int(np.argmax(means))], parts[int(np.argmin(means))]
    assert (r.best, r.worst) == (int(np.argmax(means)), int(np.argmin(means)))
    assert abs(r.t - (hi.mean() - lo.mean()) / np.sqrt(hi.var(ddof=1) / len(hi) + lo.var(ddof=1) / len(lo))) < 1e-9
