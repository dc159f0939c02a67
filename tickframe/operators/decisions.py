"""Classifiers, gates and filter catalogues: ladders of conditions on columns that are there already."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.operators.frames import before, last, order


def ladder(*steps: tuple[Column, object], otherwise: object = None) -> Column:
    """The value of the first step whose condition holds."""
    out = None
    for condition, value in steps:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise)


def volume_displacement(ratio: Column, displacement: Column, volume: float = 1.25, least: float = 0.4) -> Column:
    """Four states of volume (against its mean) and displacement (body over range)."""
    heavy, wide = ratio >= volume, displacement >= least
    return ladder((heavy & wide, "momentum"), (heavy, "absorption"), (wide, "vacuum"), otherwise="chop")


def session(hour: Column) -> Column:
    """Phase of the UTC day."""
    return ladder((hour < 7, "asia"), (hour < 13, "london"), (hour < 21, "new_york"), otherwise="close")


def regime(close: Column, fast: Column, slow: Column, strength: Column, least: float = 20.0) -> Column:
    """1 up, 2 down, 0 flat (no trend strength), 3 mixed; null while an input is."""
    known = fast.isNotNull() & slow.isNotNull() & strength.isNotNull()
    return F.when(known, ladder((strength < least, 0), ((close > slow) & (fast > slow), 1), ((close < slow) & (fast < slow), 2), otherwise=3))


def routed(bars: DataFrame, narrow: float, quiet: float = 1.3, calm: float = 0.5, direct: float = 0.52, apart: float = 0.003) -> DataFrame:
    """State of bars with columns me, ema21 and ema50: a squeeze, an expansion, or a range; the first 48 bars are a range."""
    number = F.row_number().over(order())
    width = (F.max("high").over(before(24)) - F.min("low").over(before(24))) / F.col("close")
    ratio = F.col("volume") / F.nullif(F.avg("volume").over(before(24)), F.lit(0.0))
    marked = bars.withColumns({"number": number, "bandwidth": width, "ratio": F.coalesce(ratio, F.lit(1.0))})
    c, e21, e50 = F.col("close"), F.col("ema21"), F.col("ema50")
    state = ladder(
        (F.col("number") <= 48, "range"),
        ((F.col("bandwidth") <= narrow) & (F.col("ratio") < quiet) & (F.col("me") < calm), "squeeze"),
        ((F.col("me") >= direct) & (F.abs(e21 - e50) / c >= apart) & (((c > e21) & (e21 > e50)) | ((c < e21) & (e21 < e50))), "expansion"),
        otherwise="range",
    )
    return marked.withColumn("state", state)


def contains_any(columns: Iterable[str], term: str) -> Column:
    """Whether one of the columns holds the term, in any case of letters; nulls hold nothing."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(term.lower())), F.lit(False))
    return found


def entry(side: Column, trend: Column, rate: Column, cap: float, weak: Column) -> tuple[Column, Column]:
    """Whether an entry is allowed, and why not: longs need an up trend and a rate that is not over the cap, shorts a trend that is not up (or weakness) and a known positive rate."""
    reason = ladder(
        ((side == "L") & (F.coalesce(trend, F.lit(0)) != 1), "trend not up"),
        ((side == "L") & (rate > cap), "overheated"),
        (side == "L", "ok"),
        (~((F.coalesce(trend, F.lit(0)) <= 0) | weak), "trend not down"),
        (rate.isNull(), "no history"),
        (rate <= 0, "rate not positive"),
        otherwise="ok",
    )
    return reason == "ok", reason


def rule(a: Column, b: Column, mode: str) -> Column:
    """Two conditions joined by a mode: A, B, A|B or A&B; an unknown condition counts as not met."""
    a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    return {"A": a, "B": b, "A|B": a | b, "A&B": a & b}[mode]


def passed(rows: DataFrame, catalogue: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row for each row and filter of the catalogue (name -> applies, removes): kept unless the filter applies and
    is known to remove, so an unknown condition keeps."""
    verdicts = [F.struct(F.lit(name).alias("filter"), (~F.coalesce(applies & removes, F.lit(False))).alias("kept")) for name, (applies, removes) in catalogue.items()]
    return rows.withColumn("_v", F.explode(F.array(*verdicts))).select("*", "_v.*").drop("_v")


def segment(at: Column, cuts: list[tuple[str, str]], group: Column, unseen: str = "UNSEEN") -> Column:
    """Name of the date range (name, exclusive end) of a time; rows of the held-out group are unseen."""
    steps = [(at < F.lit(end).cast("timestamp_ntz"), name) for name, end in cuts]
    return F.when(group, unseen).otherwise(ladder(*steps, otherwise="FINAL"))


def confluence(scores: dict[str, tuple[Column, float]], ok: float, adjust: float) -> tuple[Column, Column]:
    """Weighted sum of scores (0.5 where one is missing) and its verdict; a score of 0 is a veto."""
    known = {name: (F.coalesce(score, F.lit(0.5)), weight) for name, (score, weight) in scores.items()}
    veto = F.lit(False)
    total = F.lit(0.0)
    for score, weight in known.values():
        veto, total = veto | (score == 0), total + score * weight
    total = F.when(veto, 0.0).otherwise(total)
    return total, ladder((veto, "REJECT"), (total >= ok, "PASS"), (total >= adjust, "ADJUST"), otherwise="REJECT")


def drift_ok(close: Column, old: Column, side: Column, gate: float) -> Column:
    """Whether price has not moved against the side by more than the gate; unknown history passes."""
    return F.coalesce(side * (close / old - 1) >= -gate, F.lit(True))


def clamped(value: Column, low: float, high: float, default: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.nanvl(value.cast("double"), F.lit(None).cast("double")), F.lit(default))))


def market_state(bars: DataFrame) -> DataFrame:
    """Nine states: place in the trailing range (low, middle, high) by direction of the last day (down, flat, up)."""
    low, high = F.min("low").over(last(48)), F.max("high").over(last(48))
    place = F.when(high > low, (F.col("close") - low) / (high - low))
    move = F.col("close") / F.lag("close", 24).over(order()) - 1
    marked = bars.withColumns({"place": place, "move": move})
    at = ladder((F.col("place") < 1 / 3, "low"), (F.col("place") > 2 / 3, "high"), otherwise="middle")
    way = ladder((F.col("move") < -0.05, "down"), (F.col("move") > 0.05, "up"), otherwise="flat")
    return marked.withColumn("state", F.when(F.col("place").isNotNull() & F.col("move").isNotNull(), F.concat_ws("_", at, way)))
