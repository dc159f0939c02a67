"""Cutting later bars off leaves everything before as it was: no rule looks ahead."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickframe.operators import coherence as C
from tickframe.operators import estimators as E
from tickframe.operators import families as T
from tickframe.operators import parallel as P
from tickframe.operators import patterns as S
from tickframe.operators import pressure as L
from tickframe.operators import quantiles as Q
from tickframe.operators import recursive as R
from tickframe.operators import strategies as G
from tickframe.operators import trendlines as N

T0 = datetime.datetime(2024, 1, 1)
CUT = T0 + datetime.timedelta(hours=431)


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(31)
    rows = []
    for s in ("a", "b"):
        close = 100 * np.exp(np.cumsum(rng.standard_normal(600) * 0.02))
        for i in range(600):
            o, c = close[max(0, i - 1)] * (1 + 0.004 * rng.standard_normal()), close[i]
            v = float(rng.integers(1, 200))
            rows.append((s, T0 + datetime.timedelta(hours=i), float(o), float(max(o, c) * (1 + 0.01 * rng.random())), float(min(o, c) * (1 - 0.01 * rng.random())), float(c), v, float(np.floor(v * rng.random())), 5))
    return spark.createDataFrame(rows, "symbol string, bar timestamp_ntz, open double, high double, low double, close double, volume double, buy double, n long").repartition(3).cache()


def unit(b):
    return P.atr_kinds(b).withColumnRenamed("rma", "unit")


CASES = {
    "kalman": lambda b: P.kalman_trend(b).select("symbol", "bar", "z", "level", "dev"),
    "ranges": lambda b: P.atr_kinds(b).select("symbol", "bar", "rma", "wilder", "lagged", "sma"),
    "mixed": lambda b: E.mixed_trend(b).select("symbol", "bar", "imm_z", "calm"),
    "clock": lambda b: E.clocked_trend(b).select("symbol", "bar", "clock_z", "pace"),
    "cycle": lambda b: E.fisher(E.adaptive_means(b)).select("symbol", "bar", "mama", "fama", "fisher"),
    "mask": lambda b: Q.expanding_mask(b, "high", 0.1, 50, 40).select("symbol", "bar", "top", "bottom", "high", "low"),
    "quantile": lambda b: Q.trailing_quantile(b, "volume", 3, 0.8).select("symbol", "bar", "cut"),
    "lines": lambda b: N.live_lines(unit(b), R.swings(unit(b))),
    "states": lambda b: C.nine_states(b).select("symbol", "bar", "state"),
    "families": lambda b: T.triggers(T.trigger_sides(b, "a"), 6),
    "formulas": lambda b: L.base_series(b).select("symbol", "bar", "pos", "dev", "vz", "vr", "eff", "curv", "wick"),
    "retests": lambda b: S.break_retests(S.sided(b)),
    "pools": lambda b: S.pool_sweeps(S.sided(b), near=0.4, heavy=1.0),
    "turns": lambda b: S.structure_turns(S.sided(b)),
    "springs": lambda b: S.springs(S.sided(b)),
    "climaxes": lambda b: S.climaxes(S.sided(b)),
    "gaps": lambda b: S.gap_fills(S.sided(b)),
    "in_range": lambda b: S.range_setups(S.sided(b)),
    "fakeouts": lambda b: S.body_fakeouts(S.sided(b)),
    "hunts": lambda b: S.stop_hunts(S.sided(b)),
    "impulses": lambda b: S.impulse_pullbacks(S.sided(b), tall=2.0).drop("at"),
    **{f"{f}_strategies": lambda b, f=f: G.signals(b, f) for f in ("trend", "breakout", "reversion", "action", "flow")},
}


def rows(frame):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("name", CASES)
def test_prefix_is_kept(bars, name):
    until = F.lit(CUT).cast("timestamp_ntz")
    whole = CASES[name](bars).where(F.col("bar") <= until)
    short = CASES[name](bars.where(F.col("bar") <= until))
    a, b = rows(whole), rows(short)
    assert a == b and len(a) > 0
