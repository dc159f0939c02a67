"""The rule book and the formula library against plain pandas: their SQL shares the conditions' text with Spark."""

import numpy as np
import pandas as pd
import pytest

from tickframe.plans.catalog import QUERIES
from tickframe.sources.tables import hourly

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bars(spark):
    return hourly(spark, DIR).toPandas().sort_values(["symbol", "bar"]).reset_index(drop=True)


def rules(b):
    o, h, l, c, v = b.open, b.high, b.low, b.close, b.volume
    fast, slow = c.ewm(span=20, adjust=False).mean(), c.ewm(span=50, adjust=False).mean()
    mid, sd = c.rolling(20, 1).mean(), c.rolling(20, 1).std(ddof=0)
    top, floor, usual = h.shift().rolling(20, 1).max(), l.shift().rolling(20, 1).min(), v.shift().rolling(20, 1).mean()
    body, up_tail, down_tail = (c - o).abs(), h - np.maximum(o, c), np.minimum(o, c) - l
    ph, pl, po, pc = h.shift(), l.shift(), o.shift(), c.shift()
    return {
        "golden": ((fast > slow) & (fast.shift() <= slow.shift()), (fast < slow) & (fast.shift() >= slow.shift())),
        "band_fade": ((c < mid - 2 * sd) & (c > o), (c > mid + 2 * sd) & (c < o)),
        "breakout": (c > top, c < floor),
        "engulfing": ((pc < po) & (o < pc) & (c > po), (pc > po) & (o > pc) & (c < po)),
        "outside": ((h > ph) & (l < pl) & (c > o), (h > ph) & (l < pl) & (c < o)),
        "pin": ((down_tail > 2 * body) & (up_tail < body), (up_tail > 2 * body) & (down_tail < body)),
        "momentum": (c / c.shift(12) > 2, c / c.shift(12) < 0.5),
        "volume_push": ((v > 2 * usual) & (c > o), (v > 2 * usual) & (c < o)),
        "inside_break": ((h < ph) & (l > pl) & (c > (ph + pl) / 2), (h < ph) & (l > pl) & (c < (ph + pl) / 2)),
        "failed_break": ((l < floor) & (c > floor), (h > top) & (c < top)),
        "mean_pullback": ((fast > slow) & (l <= fast) & (c > fast), (fast < slow) & (h >= fast) & (c < fast)),
        "three_in_row": ((c > o) & (pc > po) & (c.shift(2) > o.shift(2)), (c < o) & (pc < po) & (c.shift(2) < o.shift(2))),
        "gap_away": (l > ph, h < pl),
        "doji_turn": (((pc - po).abs() < 0.1 * (ph - pl)) & (c > ph), ((pc - po).abs() < 0.1 * (ph - pl)) & (c < pl)),
        "wide_close": ((c > l + 0.9 * (h - l)) & (h - l > 2 * (ph - pl)), (c < l + 0.1 * (h - l)) & (h - l > 2 * (ph - pl))),
        "band_walk": ((c > mid + sd) & (pc > mid), (c < mid - sd) & (pc < mid)),
        "spring": ((l < floor) & (c > floor) & (v > usual), (h > top) & (c < top) & (v > usual)),
        "climax": ((v > 3 * usual) & (c < mid - 2 * sd), (v > 3 * usual) & (c > mid + 2 * sd)),
        "vacuum": ((v < 0.5 * usual) & (c > top), (v < 0.5 * usual) & (c < floor)),
        "retest": ((pc > top) & (l <= top) & (c > top), (pc < floor) & (h >= floor) & (c < floor)),
    }


def test_rule_book(spark, bars):
    got = {(r.symbol, r.rule): (r.longs, r.shorts) for r in QUERIES["rule_book"](spark, DIR).collect()}
    want = {(s, k): (int(a.sum()), int(b.sum())) for s, part in bars.groupby("symbol") for k, (a, b) in rules(part).items()}
    assert got == want and sum(map(sum, want.values())) > 100


def test_formula_library(spark, bars):
    got = QUERIES["formula_library"](spark, DIR).toPandas().sort_values(["symbol", "bar"]).reset_index(drop=True)
    want = []
    for _, b in bars[bars.volume > 0].groupby("symbol"):
        c, span = b.close, (b.high - b.low).where(b.high > b.low)
        mid, sd = c.rolling(24, 1).mean(), c.rolling(24, 1).std(ddof=0)
        f = pd.DataFrame({"f1": np.tanh((c - b.open) / span), "f2": np.tanh(c / c.shift(4) - 1), "f3": np.tanh((2 * b.buy - b.volume) / b.volume), "f4": -np.tanh((c - mid) / sd.where(sd > 0)), "f5": np.tanh(np.log(b.volume / b.volume.shift().rolling(24, 1).mean()))})
        want.append(f.assign(ensemble=f.sum(axis=1, skipna=False) / 5))
    want = pd.concat(want).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[list(want)], want, atol=1e-6, check_dtype=False)
