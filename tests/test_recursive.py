import datetime as dt
import math
import random

import numpy as np
from pyspark.sql import functions as F

from tickframe.operators import recursive as R
from tickframe.plans.queries import hourly
from tickframe.plans.recurrences import with_unit

DIR = "/root/testdata/sf0.001"


def keyed(df, value):
    return {(r.symbol, r.bar): r[value] for r in df.collect()}


def test_values_do_not_change_when_the_future_is_cut(spark):
    bars = hourly(spark, DIR)
    end = dt.datetime(2024, 1, 18)
    past = bars.where(f"bar < timestamp_ntz '{end}'")
    for run, value in ((R.kalman_trend, "z"), (R.wilder_rsi, "rsi"), (R.seeded_rsi, "srsi"), (R.atr_kinds, "wilder"), (R.directional, "adx"), (R.parabolic, "sar"), (R.smoothers, "kama")):
        whole, part = keyed(run(bars), value), keyed(run(past), value)
        assert part and all(whole[k] == v or (v is None and whole[k] is None) for k, v in part.items())
    rows = with_unit(spark, DIR)
    for run in (R.zigzag, R.swings):
        turns = {(r.symbol, r.bar, r.kind) for r in run(rows, 1.0).collect() if r.confirmed < end}
        assert turns and turns == {(r.symbol, r.bar, r.kind) for r in run(rows.where(f"bar < timestamp_ntz '{end}'"), 1.0).collect()}


def turns(bars, times, unit):
    """All turns by searching the bars since the last one again at each bar."""
    out, begin, way = [], 0, 0
    for i in range(1, len(bars)):
        close = bars[i][2]
        for side in (way,) if way else (1, -1):
            value = lambda j: side * bars[j][0 if side > 0 else 1]  # noqa: B023, E731
            seen = range(begin, i + 1)
            top = max(seen, key=lambda j: (value(j), -j))
            price = value(top)
            if way and out and out[-1][3] == "close" and price <= side * out[-1][4]:
                top, price = begin, side * out[-1][4]
            if (way or top < i) and price - side * close >= times * unit:
                rest = list(range(top + 1, i + 1))
                out.append((top, side * price, side, "bars" if rest else "close", close))
                begin, way = (rest[0], -side) if rest else (i, -side)
                break
    return [(a, round(b, 9), c) for a, b, c, *_ in out]


def test_zigzag_against_a_search_over_all_bars(spark):
    rnd = random.Random(6)
    day = dt.datetime(2024, 1, 1)
    rows, want = [], {}
    for k in range(12):
        price, bars = 100.0, []
        for i in range(300):
            price += rnd.gauss(0, 1)
            bars.append((price + rnd.random(), price - rnd.random(), price))
        want[str(k)] = turns(bars, 3.0, 1.0)
        rows += [(str(k), day + dt.timedelta(hours=i), h, lo, c, 1.0) for i, (h, lo, c) in enumerate(bars)]
    found = R.zigzag(spark.createDataFrame(rows, "symbol string, bar timestamp_ntz, high double, low double, close double, unit double"), 3.0).orderBy("symbol", "confirmed").collect()
    for k in want:
        got = [((r.bar - day) // dt.timedelta(hours=1), round(r.price, 9), r.kind) for r in found if r.symbol == k]
        assert got == want[k] and len(got) > 5
        assert all(a[2] == -b[2] and a[0] < b[0] for a, b in zip(got, got[1:]))


def test_state_passes_between_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(100).selectExpr("cast(id % 3 as string) as symbol", "id as bar", "cast(id * id % 37 as double) as close")
        got = {(r.symbol, r.bar): r.ema5 for r in R.ema(rows, 5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in range(3):
        mean = None
        for i in range(k, 100, 3):
            x = float(i * i % 37)
            mean = x if mean is None else mean + (x - mean) / 3
            assert abs(got[str(k), i] - mean) < 1e-12


def test_acceleration_filter_is_the_weighted_least_squares(spark):
    """With no noise in the acceleration and the same noise at all bars, the filter's end is the prior-weighted parabola fit."""
    n = 160
    rows = [("a", i, math.exp(1e-5 * i * i - 1e-3 * i + (0.01 if i % 2 else -0.01))) for i in range(n)]
    got = R.kalman_acceleration(spark.createDataFrame(rows, "symbol string, bar long, close double"), process=0.0, span=10).orderBy("bar").collect()
    y = np.log([c for *_, c in rows])
    change, mean = np.diff(y) ** 2, None
    noise = []
    for v in change:
        mean = v if mean is None else mean + 2 / 11 * (v - mean)
        noise.append(max(mean, 1e-10))
    start = np.array([y[0], 0.0, 0.0])
    h = np.array([[1.0, i, i * i / 2] for i in range(1, n)])
    weight = 1 / np.array(noise)
    cov = np.linalg.inv(np.eye(3) + (h * weight[:, None]).T @ h)
    x = cov @ (start + (h * weight[:, None]).T @ y[1:])
    end = np.array([[1, n - 1, (n - 1) ** 2 / 2], [0, 1, n - 1], [0, 0, 1]])
    x, cov = end @ x, end @ cov @ end.T
    assert got[5].slope_z is None
    assert np.isclose(got[-1].slope_z, x[1] / cov[1, 1] ** 0.5, rtol=1e-6) and np.isclose(got[-1].accel_z, x[2] / cov[2, 2] ** 0.5, rtol=1e-6)


def test_slices_give_the_same_mean(spark):
    bars = hourly(spark, DIR).select("symbol", "bar", "close")
    gaps = bars.withColumn("close", F.when(F.hour("bar") > 3, F.col("close")))
    for rows in (bars, gaps):
        for unit in ("day", "week"):
            a, b = keyed(R.ema(rows, 9), "ema9"), keyed(R.sliced_ema(rows, 9, unit=unit), "ema9")
            assert a.keys() == b.keys() and all((v is None and b[k] is None) or abs(v - b[k]) < 1e-9 for k, v in a.items())


def test_one_trade_at_a_time(spark):
    rows = spark.createDataFrame([("a", 1, 5, 0.1), ("a", 2, 3, 0.2), ("a", 5, 6, 0.3), ("b", 2, 9, 0.4)], "symbol string, entry int, exit int, r double")
    assert sorted(r.r for r in R.without_overlap(rows).collect()) == [0.1, 0.3, 0.4]
