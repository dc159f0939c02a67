import datetime

import numpy as np
import pandas as pd
import pytest

from tickframe.operators import frames as W
from tickframe.operators import parallel as P
from tickframe.operators import recursive as R

BAR = "symbol string, bar timestamp_ntz, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(21)
    rows = []
    for s, n in (("a", 700), ("b", 333), ("c", 1), ("d", 15)):
        close = np.round(100 * np.exp(np.cumsum(rng.standard_normal(n) * 0.02)), 4)
        for i in range(n):
            if i % 97 in range(40, 75):
                continue  # days without a bar
            o, c = close[max(0, i - 1)], close[i]
            rows.append((s, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i), float(o), float(max(o, c) + rng.random()), float(min(o, c) - rng.random()), float(c), float(rng.integers(1, 99))))
    return spark.createDataFrame(rows, BAR).repartition(7).cache()


def frame(df, columns):
    return df.select("symbol", "bar", *columns).toPandas().sort_values(["symbol", "bar"]).reset_index(drop=True)


PAIRS = {
    "rma wilder exp lagged": (P.atr_kinds, R.atr_kinds),
    "rsi": (P.wilder_rsi, R.wilder_rsi),
    "srsi": (P.seeded_rsi, R.seeded_rsi),
    "macd signal hist": (P.macd, R.macd),
    "pdi mdi adx": (P.directional, R.directional),
    "sema20": (lambda b, **k: P.seeded_ema(b, 20, **k), lambda b: R.seeded_ema(b, 20)),
    "ewvar sigma_before": (P.spread, R.spread),
    "normed": (lambda b, **k: P.normed(W.returns(b), 50, **k), lambda b: R.normed(W.returns(b), 50)),
    "ha_open ha_close": (P.heikin_ashi, R.heikin_ashi),
    "heat heat_way": (P.excitation, R.excitation),
    "z level": (P.kalman_trend, R.kalman_trend),
}


@pytest.mark.parametrize("names", PAIRS)
@pytest.mark.parametrize("unit", ["day", "month"])
def test_same_as_a_row_at_a_time(bars, names, unit):
    mine, other = PAIRS[names]
    columns = names.split()
    a, b = frame(mine(bars, unit=unit), columns), frame(other(bars), columns)
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-7, atol=1e-9)


def test_small_batches(bars, spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        a = frame(P.kalman_trend(bars, unit="month"), ["z", "level"])
        c = frame(P.atr_kinds(bars, unit="month"), ["lagged"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pd.testing.assert_frame_equal(a, frame(R.kalman_trend(bars), ["z", "level"]), rtol=1e-7, atol=1e-9)
    pd.testing.assert_frame_equal(c, frame(R.atr_kinds(bars), ["lagged"]), rtol=1e-7, atol=1e-9)


def test_residual_and_seeded_range(bars):
    got = frame(P.kalman_trend(bars, span=20), ["close", "level", "dev"])
    ranges = frame(P.atr_kinds(bars), ["high", "low", "close", "sma"])
    for s in ("a", "b"):
        rows, mean = got[got.symbol == s], None
        for i, r in enumerate(rows.itertuples()):
            left = np.log(r.close) - np.log(r.level)
            if i:
                mean = left**2 if mean is None else mean + 2 / 21 * (left**2 - mean)
            assert np.isnan(r.dev) if i <= 20 else r.dev == pytest.approx(left / np.sqrt(mean), rel=1e-6, abs=1e-6)
        rows, held, old, seen = ranges[ranges.symbol == s], None, None, []
        for i, r in enumerate(rows.itertuples()):
            if i:
                seen.append(max(r.high - r.low, abs(r.high - old), abs(r.low - old)))
            old = r.close
            if i == 14:
                held = np.mean(seen)
            elif i > 14:
                held += 2 / 15 * (seen[-1] - held)
            assert np.isnan(r.sma) if i < 14 else r.sma == pytest.approx(held)


def test_tasks_are_slices_of_time(bars):
    plan = P.wilder_rsi(bars)._jdf.queryExecution().toString()
    assert "hashpartitioning(symbol" in plan and "slice_" in plan
