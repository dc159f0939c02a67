import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickframe.operators import quantiles as Q

T0 = datetime.datetime(2024, 1, 1)
BAR = "symbol string, bar timestamp_ntz, v double"


def series(spark, seed, symbols=3, n=500):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(symbols):
        values = rng.choice([0.0, 1.5, -2.0], n) if s == 0 else rng.standard_cauchy(n) * 10.0 ** rng.integers(-3, 4, n)
        rows += [(f"s{s}", T0 + datetime.timedelta(hours=i), None if rng.random() < 0.1 else float(x)) for i, x in enumerate(values)]
    return rows, spark.createDataFrame(rows, BAR).repartition(5)


@pytest.mark.parametrize("few", [3, 50, 10**6])
def test_percentiles(spark, monkeypatch, few):
    monkeypatch.setattr(Q, "BUCKETS", 8)
    rows, frame = series(spark, 1)
    frame = frame.unionByName(spark.createDataFrame([(None, T0, x) for x in (1.0, float("nan"), float("inf"), 3.0)] + [("none", T0, None), ("one", T0, 5.0), ("wide", T0, -1.7e308), ("wide", T0, 1.7e308)], BAR))
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(r.symbol, r.share): r.value for r in Q.percentiles(frame, ["symbol"], "v", shares, few).collect()}
    held = {None: [1.0, 3.0], "one": [5.0], "wide": [-1.7e308, 1.7e308]}
    for s, _, v in rows:
        if v is not None:
            held.setdefault(s, []).append(v)
    assert got.keys() == {(s, q) for s in held for q in shares}
    for (s, q), v in got.items():
        assert s == "wide" or v == pytest.approx(np.quantile(held[s], q), rel=1e-12)
    whole = [v for vs in held.values() for v in vs]
    assert Q.percentiles(frame, [], "v", [0.25], few).first().value == pytest.approx(np.quantile(whole, 0.25))
    assert Q.percentiles(frame.where("symbol = 'none'"), [], "v", [0.5], few).count() == 0


def test_kth():
    rng = np.random.default_rng(3)
    block, value, weight = rng.integers(0, 9, 300), rng.integers(0, 20, 300) / 4, rng.integers(1, 4, 300)
    first, last, rank, want = [], [], [], []
    for _ in range(200):
        a, b = sorted(rng.integers(0, 9, 2))
        inside = np.sort(np.repeat(value[(block >= a) & (block <= b)], weight[(block >= a) & (block <= b)]))
        first.append(a), last.append(b), rank.append(rng.integers(0, len(inside)))
        want.append(inside[rank[-1]])
    assert Q.kth(block, value, weight, *map(np.array, (first, last, rank))).tolist() == want


@pytest.mark.parametrize("few", [40, 10**6])
def test_expanding_mask(spark, monkeypatch, few):
    monkeypatch.setattr(Q.in_blocks, "__defaults__", (few,))
    rows, frame = series(spark, 2)
    got = {(r.symbol, r.bar): (r.top, r.bottom, r.high, r.low) for r in Q.expanding_mask(frame, "v", 0.15, 30, 20).collect()}
    want = {}
    for s in ("s0", "s1", "s2"):
        seen, high, low, since = [], None, None, 0
        for _, bar, v in (r for r in rows if r[0] == s):
            if v is None:
                continue
            if len(seen) >= 30 and (high is None or since >= 20):
                ordered = sorted(seen)
                high, low, since = ordered[math.floor(len(seen) * (1 - 0.15))], ordered[math.floor(len(seen) * 0.15)], 0
            want[s, bar] = (high is not None and v >= high, low is not None and v <= low, high, low)
            seen.append(v)
            since += 1
    assert got == want
    assert Q.expanding_mask(frame.where(F.lit(False)), "v").count() == 0


@pytest.mark.parametrize("few", [40, 10**6])
def test_trailing_quantile(spark, monkeypatch, few):
    monkeypatch.setattr(Q.in_blocks, "__defaults__", (few,))
    rows, frame = series(spark, 4)
    frame = frame.where("day(bar) not in (7, 8, 9, 10)")
    for r in Q.trailing_quantile(frame, "v", 3, 0.9).collect():
        day = r.bar.date()
        before = [v for s, bar, v in rows if s == r.symbol and v is not None and bar.day not in (7, 8, 9, 10) and 1 <= (day - bar.date()).days <= 3]
        assert r.cut == (pytest.approx(np.quantile(before, 0.9), rel=1e-12) if before else None)
