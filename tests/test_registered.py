import pytest

from tickframe.functions import registered as G
from tickframe.plans.queries import hourly

DIR = "/root/testdata/sf0.001"


def test_operators_by_name(spark):
    rows = G.applied(hourly(spark, DIR), ("returns", {"k": 2}), ("ema", {"n": 5}), ("bollinger", {"n": 10, "k": 1.5}))
    assert {"ret", "simple", "ema5", "upper"} <= set(rows.columns) and rows.count() > 0
    with pytest.raises(ValueError):
        G.registered("ema")(lambda bars: bars)
    G.registered("own")(lambda bars, k=1: bars.limit(k))
    assert G.applied(hourly(spark, DIR), ("own", {"k": 3})).count() == 3
    del G.OPERATORS["own"]


def test_sql_functions_are_inlined(spark):
    G.register(spark)
    row = spark.sql("SELECT session_phase(8) AS s, wilson_low(5, 10) AS w, in_risks(100, 100, 3) AS r").first()
    assert row.s == "london" and abs(row.w - 0.2366) < 1e-3 and row.r is None
    plan = spark.range(5).selectExpr("to_step(id * 1.7, 0.5) as x")._jdf.queryExecution().optimizedPlan().toString()
    assert "to_step" not in plan
