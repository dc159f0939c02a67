"""Live trend lines: born at a confirmed swing, touched, tested and redrawn, and ended by a break."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.operators.frames import order
from tickframe.operators.recursive import Step, scanned


@dataclass
class Line:
    first: float  # numbers of the bars of its two swings
    second: float
    price: float  # at the second one
    slope: float
    born: float
    unit: float
    number: int
    before: float | None = None  # slope of the line that it redraws
    touches: int = 2
    tests: int = 0
    testing: bool = False

    def at(self, i: float) -> float:
        return self.price + self.slope * (i - self.second)


COLUMNS = "line double, number int, touches int, tests int, slope double, age int, span int, accel double, test boolean, broken boolean"


def live_lines(bars: DataFrame, turns: DataFrame, beyond: float = 0.25, touch: float = 0.35, zone: float = 0.25, away: float = 1.0) -> DataFrame:
    """For each bar and side (1: the support, -1: the resistance, which is the support of negated prices) the line that
    lives there, as it stands before the bar: its value, number, touches, tests, slope in units at birth, age and span in
    bars, slope over that of the line it redrew (accel), and whether the bar tests or breaks it.

    bars have a `unit`, turns are confirmed swings (symbol, bar, price, kind,
    confirmed; one a bar at most). A swing above the swing before it on its
    side starts a line; a later one within `touch` units of the line is a
    touch, one above it redraws the line through the last two, one under it
    ends it. A low within `zone` units of the line is a test, which is over
    once a close is `away` units off. A close `beyond` units under the line
    breaks it. Rows without a line are left out.
    """
    numbered = bars.withColumn("i_", F.row_number().over(order()).cast("double"))
    place = numbered.select("symbol", "bar", F.col("i_").alias("at_i"), F.col("unit").alias("at_unit"))
    swings = turns.join(place, ["symbol", "bar"]).select("symbol", F.col("confirmed").alias("bar"), (-F.col("kind")).alias("side"), F.col("price").alias("swing"), "at_i", "at_unit")
    both = numbered.withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1)))).join(swings, ["symbol", "bar", "side"], "left")
    sided = both.select("symbol", "bar", "side", "i_", "unit", "at_i", "at_unit", (F.col("side") * F.col("close")).alias("c_"), F.when(F.col("side") > 0, F.col("low")).otherwise(-F.col("high")).alias("l_"), (F.col("side") * F.col("swing")).alias("p_"))
    keyed = sided.withColumn("key_", F.concat_ws("|", "side", "symbol"))

    def start() -> Step:
        line: Line | None = None
        last: tuple[float, float] | None = None
        count = 0

        def step(i, unit, close, low, at, at_unit, price):
            nonlocal line, last, count
            out = (None,) * 10
            if line is not None:
                y = line.at(i)
                broken = close - y < -beyond * unit
                test = not broken and low <= y + zone * unit and not line.testing
                accel = line.slope / line.before if line.before else None
                out = (y, line.number, line.touches, line.tests, line.slope / line.unit, int(i - line.born), int(line.second - line.first), accel, test, broken)
                if broken:
                    line = None
                elif test:
                    line.testing = True
                elif line.testing and close - y > away * unit:
                    line.testing, line.tests = False, line.tests + 1
            if price is None:
                return out
            drawn = None
            if line is not None:
                y = line.at(at)
                if abs(price - y) <= touch * at_unit:
                    line.touches += 1
                elif price > y:
                    drawn = Line(line.second, at, price, (price - line.price) / (at - line.second), i, unit, count + 1, line.slope)
                else:
                    line = None
            if line is None and last is not None and price > last[1]:
                drawn = Line(last[0], at, price, (price - last[1]) / (at - last[0]), i, unit, count + 1)
            if drawn is not None:
                line, count = drawn, count + 1
            last = (at, price)
            return out

        return step

    found = scanned(keyed, start, ["i_", "unit", "c_", "l_", "at_i", "at_unit", "p_"], COLUMNS, by="key_").where("line is not null")
    return found.withColumn("line", F.col("side") * F.col("line")).select("symbol", "bar", "side", *(c.split()[0] for c in COLUMNS.split(", ")))


def line_lives(found: DataFrame) -> DataFrame:
    """A row for each line of live_lines: its first and last bar, bars, touches and tests, and whether a break ended it."""
    out = found.groupBy("symbol", "side", "number")
    return out.agg(F.min("bar").alias("first"), F.max("bar").alias("last"), F.count("*").alias("bars"), F.max("touches").alias("touches"), F.max("tests").alias("tests"), F.count_if("test").alias("test_bars"), F.bool_or("broken").alias("broken"))
