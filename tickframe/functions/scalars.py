"""Column expressions of market data; all stay in Spark's own functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_step(value: Column, step: float, way: str = "floor") -> Column:
    """value on the grid of step: floor, ceil or the nearest."""
    n = F.round(value / step, 9)
    return {"floor": F.floor, "ceil": F.ceil, "round": F.round}[way](n).cast("double") * step


def ratio(value: Column, by: Column) -> Column:
    """value / by of doubles as IEEE has it: infinite over 0, and NaN for 0 / 0, where Spark's division is an error."""
    return F.when(by == 0, value * F.pow(by, F.lit(-1.0))).otherwise(value / by)


def nearest_round(price: Column) -> Column:
    """The nearest multiple of half the price's power of ten; null for prices of 0 and less."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(price))) / 2
    return F.when(price > 0, F.round(price / unit) * unit)


def sentiment(text: Column, bad: list[str], good: list[str]) -> Column:
    """-1 if text has a bad word, else 1 if it has a good one, else 0: whole words, case does not count."""

    def any_of(words: list[str]) -> Column:
        return F.rlike(F.lower(text), F.lit(r"(^|[^\p{L}])(" + "|".join(w.lower() for w in words) + r")($|[^\p{L}])"))

    return F.when(any_of(bad), -1).when(any_of(good), 1).otherwise(0)


def order_size(equity: Column, risk: float, entry: Column, stop: Column, step: float, least: float) -> Column:
    """Units that lose the share `risk` of equity at the stop, on the lot grid; 0 if their value is under `least`."""
    units = to_step(equity * risk / F.abs(entry - stop), step)
    return F.when(entry != stop, F.when(units * entry >= least, units).otherwise(0.0))


def significant(value: Column, digits: int) -> Column:
    """value rounded to so many significant digits; 0 stays 0."""
    power = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(value))))
    return F.when(value == 0, F.lit(0.0)).otherwise(F.round(value * power) / power)


def squashed(value: Column) -> dict[str, Column]:
    """Signed logarithm, tanh and logistic of a value."""
    return {"slog": F.signum(value) * F.log1p(F.abs(value)), "tanh": F.tanh(value), "logistic": 1 / (1 + F.exp(-value))}


def calendar(at: Column) -> dict[str, Column]:
    """Hour as a point on the circle, weekday (Monday 1), start of the week, minutes to the next eight-hour mark."""
    hour = F.hour(at) + F.minute(at) / 60
    return {
        "hour_sin": F.sin(2 * math.pi * hour / 24),
        "hour_cos": F.cos(2 * math.pi * hour / 24),
        "weekday": F.weekday(at) + 1,
        "week": F.date_trunc("week", at),
        "to_mark": (F.lit(480) - (F.hour(at) * 60 + F.minute(at)) % 480).cast("int"),
    }


def normal_header(name: Column) -> Column:
    """Lower-case header with other signs than letters and digits as single underscores, none at its ends."""
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))


def raised_size(equity: Column, risk: float, entry: Column, stop: Column, step: float, least: float, most: float) -> Column:
    """Units on the lot grid that lose `risk` of equity at the stop; raised to the smallest allowed value if the risk of that stays within `most`, else 0."""
    units = to_step(equity * risk / F.abs(entry - stop), step)
    raised = to_step(least / entry, step, "ceil")
    fits = raised * F.abs(entry - stop) <= equity * most
    return F.when(entry != stop, F.when(units * entry >= least, units).when(fits, raised).otherwise(0.0))


def cleaned(value: Column, default: float) -> Column:
    """A number in place of nulls, NaN and infinities."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.lit(default)).otherwise(value)
