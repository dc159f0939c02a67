"""Registered queries of estimators of trend; their SQL carries the state from bar to bar in a recursive table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickframe.operators import estimators as E
from tickframe.operators import joins as J
from tickframe.plans.queries import BARS, ORACLE_SQL, OVER, before, frame, hourly, last, query, rounded
from tickframe.plans.recurrences import N, recurrence, recursion

VAR = "CASE WHEN r.v IS NULL THEN pow(q_y - r.y, 2) ELSE r.v + (2.0::DOUBLE / 101) * (pow(q_y - r.y, 2) - r.v) END"


def model(k: str, mix: str, drift: str) -> dict[str, tuple[str, str]]:
    """States of one of two mixed trends: what it starts the bar from (m...), its prediction, its surprise and what it ends with."""
    w = f"q_{mix}"

    def blend(x: str) -> str:
        return f"{w} * r.{x}a + (1 - {w}) * r.{x}b"

    apart = {"p": "pow(r.xa - r.xb, 2)", "q": "(r.xa - r.xb) * (r.sa - r.sb)", "r": "pow(r.sa - r.sb, 2)"}
    out = {f"m{x}{k}": ("0", blend(x)) for x in "xs"} | {f"m{x}{k}": ("0", f"{blend(x)} + {w} * (1 - {w}) * {apart[x]}") for x in "pqr"}
    out |= {
        f"hp{k}": ("0", f"q_mp{k} + 2 * q_mq{k} + q_mr{k}"),
        f"hq{k}": ("0", f"q_mq{k} + q_mr{k}"),
        f"hr{k}": ("0", f"q_mr{k} + {drift} * q_o"),
        f"w{k}": ("0", f"q_hp{k} + q_o"),
        f"e{k}": ("0", f"q_y - q_mx{k} - q_ms{k}"),
        f"x{k}": ("ln(close)", f"q_mx{k} + q_ms{k} + q_hp{k} / q_w{k} * q_e{k}"),
        f"s{k}": ("0", f"q_ms{k} + q_hq{k} / q_w{k} * q_e{k}"),
        f"p{k}": ("1", f"q_hp{k} - q_hp{k} * q_hp{k} / q_w{k}"),
        f"q{k}": ("0", f"q_hq{k} - q_hp{k} * q_hq{k} / q_w{k}"),
        f"r{k}": ("1", f"q_hr{k} - q_hq{k} * q_hq{k} / q_w{k}"),
        f"l{k}": ("0", f"exp(-q_e{k} * q_e{k} / (2 * q_w{k})) / sqrt(q_w{k})"),
    }
    return out


recurrence(
    "mixed_trend",
    E.mixed_trend,
    ["imm_z", "calm"],
    {
        "y": ("ln(close)", "ln(n.close)"),
        "v": ("NULL", VAR),
        "o": ("0", "greatest(q_v, 1e-10)"),
        "c": ("0.5", "0.98 * r.calm + 0.02 * (1 - r.calm)"),
        "ua": ("0", "0.98 * r.calm / q_c"),
        "ub": ("0", "0.02 * r.calm / (1 - q_c)"),
        **model("a", "ua", "3e-5"),
        **model("b", "ub", "3e-4"),
        "calm": ("0.5", "q_c * q_la / (q_c * q_la + (1 - q_c) * q_lb)"),
        "sz": ("0", "q_calm * q_sa + (1 - q_calm) * q_sb"),
        "rz": ("0", "q_calm * q_ra + (1 - q_calm) * q_rb + q_calm * (1 - q_calm) * pow(q_sa - q_sb, 2)"),
    },
    "CASE WHEN i > 101 THEN round(sz / sqrt(greatest(rz, 1e-18)), 4) END AS imm_z, CASE WHEN i > 101 THEN round(calm, 4) END AS calm",
    to=4,
)
PACED = N.replace("n AS MATERIALIZED", "n0 AS") + f", n AS MATERIALIZED (SELECT *, CASE WHEN avg(volume) OVER w > 0 THEN least(5, greatest(0.2::DOUBLE, volume / avg(volume) OVER w)) ELSE 1 END AS pace FROM n0 WINDOW w AS {before(180)})"
CLOCK = {
    "y": ("ln(close)", "ln(n.close)"),
    "v": ("NULL", "greatest(1e-10, CASE WHEN r.v IS NULL THEN pow(q_y - r.y, 2) / n.pace ELSE r.v + (2.0::DOUBLE / 101) * (pow(q_y - r.y, 2) / n.pace - r.v) END)"),
    "hp": ("0", "r.p + 2 * n.pace * r.q + n.pace * n.pace * r.d"),
    "hq": ("0", "r.q + n.pace * r.d"),
    "w": ("0", "q_hp + q_v * n.pace"),
    "x": ("ln(close)", "r.x + n.pace * r.s + q_hp / q_w * (q_y - r.x - n.pace * r.s)"),
    "s": ("0", "r.s + q_hq / q_w * (q_y - r.x - n.pace * r.s)"),
    "p": ("1", "q_hp - q_hp * q_hp / q_w"),
    "q": ("0", "q_hq - q_hp * q_hq / q_w"),
    "d": ("1", "r.d + 1e-4 * q_v * n.pace - q_hq * q_hq / q_w"),
}
frame("clocked_trend", E.clocked_trend, ["pace", "clock_z"], "", to=4)
ORACLE_SQL["clocked_trend"] = f"WITH RECURSIVE {BARS}, {recursion(PACED, CLOCK)} SELECT rec.symbol, rec.bar, round(pace, 4) AS pace, CASE WHEN rec.i > 101 THEN round(s / sqrt(greatest(d, 1e-18)), 4) END AS clock_z FROM rec JOIN n USING (symbol, bar)"

TICKED = f"c AS (SELECT *, sum(volume) OVER {OVER} AS run, sum(volume) OVER (PARTITION BY symbol) * 0.02::DOUBLE AS unit FROM bars), k AS (SELECT symbol, greatest(ceil(run / unit) - 1, 0)::BIGINT AS tick, bar, open, high, low, close, volume FROM c), vb AS (SELECT symbol, tick, min(bar) AS begins, max(bar) AS ends, arg_min(open, bar) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar) AS close, sum(volume) AS volume FROM k GROUP BY 1, 2)"


@query("volume_clock", f"WITH {BARS}, {TICKED} SELECT symbol, tick, begins, ends, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM vb")
def volume_clock(spark, sf_dir):
    """Bars of equal volume, a fiftieth of their symbol's each."""
    return rounded(E.volume_bars(hourly(spark, sf_dir), 0.02), "symbol", "tick", "begins", "ends", "open", "high", "low", "close", "volume")


@query("clock_return", f"WITH {BARS}, {TICKED}, x AS (SELECT symbol, ends + INTERVAL 1 hour AS bar, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY tick)) AS ret FROM vb) SELECT b.symbol, b.bar, round(x.ret, 6) AS ret FROM bars b ASOF LEFT JOIN x ON b.symbol = x.symbol AND b.bar >= x.bar")
def clock_return(spark, sf_dir):
    """Back in time: of each hour the return of the last bar of the volume clock that had ended before it."""
    own = hourly(spark, sf_dir)
    clock = E.volume_bars(own, 0.02)
    ret = F.log(F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("tick")))
    known = clock.select("symbol", (F.col("ends") + F.expr("interval 1 hour")).alias("bar"), ret.alias("ret"))
    return rounded(J.as_of(own.select("symbol", "bar"), known, "bar", "symbol", ["ret"]), "symbol", "bar", "ret")


def delayed(state: str, first: str, own: str, depth: int) -> dict[str, tuple[str, str]]:
    """A state and, as state1 .. stateN, what it was up to N bars ago."""
    return {f"{state}{k}": ("0", f"r.{state}{k - 1 if k > 1 else ''}") for k in range(depth, 0, -1)} | {state: (first, own)}


def hilbert(*lags: str) -> str:
    return "(" + " + ".join(f"{w}::DOUBLE * {x}" for w, x in zip((0.0962, 0.5769, -0.5769, -0.0962), lags)) + ") * (0.075 * r.per + 0.54)"


def late(x: str, other: str = "0") -> str:
    return f"CASE WHEN n.i > 6 THEN {x} ELSE {other} END"


LOGS = N.replace("n AS MATERIALIZED", "n0 AS") + f", n AS MATERIALIZED (SELECT *, ln(close) AS y, (4 * ln(close) + 3 * ln(lag(close, 1) OVER {OVER}) + 2 * ln(lag(close, 2) OVER {OVER}) + ln(lag(close, 3) OVER {OVER})) / 10 AS four FROM n0)"
CYCLE = {
    **delayed("sm", "0", late("n.four"), 6),
    **delayed("det", "0", late(hilbert("q_sm", "q_sm2", "q_sm4", "q_sm6")), 9),
    **delayed("quad", "0", late(hilbert("q_det", "q_det2", "q_det4", "q_det6")), 6),
    "inp": ("0", late("q_det3")),
    # The in-phase part is the detrended one three bars ago; it is 0 for the first six bars.
    "ji": ("0", late(hilbert("q_inp", "CASE WHEN n.i > 8 THEN q_det5 ELSE 0 END", "CASE WHEN n.i > 10 THEN q_det7 ELSE 0 END", "CASE WHEN n.i > 12 THEN q_det9 ELSE 0 END"))),
    "jq": ("0", late(hilbert("q_quad", "q_quad2", "q_quad4", "q_quad6"))),
    "ii": ("0", late("0.2 * (q_inp - q_jq) + 0.8 * r.ii")),
    "qq": ("0", late("0.2 * (q_quad + q_ji) + 0.8 * r.qq")),
    "re": ("0", late("0.2 * (q_ii * r.ii + q_qq * r.qq) + 0.8 * r.re")),
    "im": ("0", late("0.2 * (q_ii * r.qq - q_qq * r.ii) + 0.8 * r.im")),
    "raw": ("0", "CASE WHEN q_im <> 0 AND q_re <> 0 THEN 360 / degrees(atan(q_im / q_re)) ELSE r.per END"),
    "held": ("0", "CASE WHEN r.per > 0 THEN CASE WHEN q_raw > 1.5 * r.per THEN 1.5 * r.per WHEN q_raw < 0.67 * r.per THEN 0.67 * r.per ELSE q_raw END ELSE q_raw END"),
    "per": ("0", late("0.2 * least(50, greatest(6, q_held)) + 0.8 * r.per")),
    "ph": ("0", late("CASE WHEN q_inp <> 0 THEN degrees(atan(q_quad / q_inp)) ELSE r.ph END")),
    "al": ("0", "least(0.5, greatest(0.05, 0.5 / greatest(r.ph - q_ph, 1)))"),
    "mama": ("y", late("q_al * n.y + (1 - q_al) * r.mama", "n.y")),
    "fama": ("y", late("q_al / 2 * q_mama + (1 - q_al / 2) * r.fama", "n.y")),
}
frame("adaptive_means", E.adaptive_means, ["mama", "fama"], "")
ORACLE_SQL["adaptive_means"] = f"WITH RECURSIVE {BARS}, {recursion(LOGS, CYCLE)} SELECT symbol, bar, round(mama, 6) AS mama, round(fama, 6) AS fama FROM rec"

PLACED = N.replace("n AS MATERIALIZED", "n0 AS") + f", n AS MATERIALIZED (SELECT *, CASE WHEN max(ln(close)) OVER w > min(ln(close)) OVER w THEN 0.66 * ((ln(close) - min(ln(close)) OVER w) / (max(ln(close)) OVER w - min(ln(close)) OVER w) - 0.5) ELSE 0 END AS place FROM n0 WINDOW w AS {last(10)})"
FISHER = {
    "v": ("0", "CASE WHEN n.i > 10 THEN least(0.999, greatest(-0.999, n.place + 0.67 * r.v)) ELSE 0 END"),
    "f": ("0", "CASE WHEN n.i > 10 THEN 0.5 * ln((1 + q_v) / (1 - q_v)) + 0.5 * r.f ELSE 0 END"),
}
frame("fisher_transform", E.fisher, ["fisher"], "")
ORACLE_SQL["fisher_transform"] = f"WITH RECURSIVE {BARS}, {recursion(PLACED, FISHER)} SELECT symbol, bar, round(f, 6) AS fisher FROM rec"

frame("rsi_simple", E.simple_rsi, ["rsi_simple"], f", d AS (SELECT *, close - lag(close) OVER {OVER} AS s FROM bars) SELECT symbol, bar, CASE WHEN count(s) OVER w = 14 AND sum(abs(s)) OVER w > 0 THEN round(100 * sum(greatest(s, 0)) OVER w / (sum(greatest(s, 0)) OVER w + sum(greatest(-s, 0)) OVER w), 6) END AS rsi_simple FROM d WINDOW w AS {last(14)}")
