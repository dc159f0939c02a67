"""Recurrences over the rows of a key in time order; a value uses rows up to its own only.

A key's rows come sorted to one task and pass it in Arrow batches: what is
held between rows is the recurrence's state alone (a closure), so memory does
not grow with a key, and the sort may spill.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from tickframe.operators.frames import order, true_range

Step = Callable[..., tuple]


def scanned(rows: DataFrame, start: Callable[[], Step], inputs: list[str], outputs: str, by: str = "symbol", on: tuple[str, ...] = ("bar",)) -> DataFrame:
    """rows with the columns `outputs` (a schema text) of a recurrence over each key.

    start makes the state of a key: a function that takes the values of
    `inputs` of the next row and returns the values of `outputs`.
    """
    fields = [(f.name, to_arrow_type(f.dataType)) for f in _parse_datatype_string(outputs).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step = None, None
        for batch in batches:
            made = []
            for k, *values in zip(batch.column(by).to_pylist(), *(batch.column(c).to_pylist() for c in inputs)):
                if step is None or k != key:
                    key, step = k, start()
                made.append(step(*values))
            columns = list(zip(*made)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, (_, t) in zip(columns, fields))], [*batch.schema.names, *(n for n, _ in fields)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), outputs])
    return rows.repartition(by).sortWithinPartitions(by, *on).mapInArrow(run, schema)


def _mean(weight: float) -> Callable[[float | None], float | None]:
    """Exponential mean from the first value; a null keeps the value before."""
    held = None

    def step(x):
        nonlocal held
        if x is not None:
            held = x if held is None else held + weight * (x - held)
        return held

    return step


def ema(bars: DataFrame, n: int, column: str = "close") -> DataFrame:
    """Exponential mean with weight 2 / (n + 1), from the first value, by symbol; nulls are passed over."""

    def start() -> Step:
        mean = _mean(2 / (n + 1))
        return lambda x: (mean(x),)

    return scanned(bars, start, [column], f"ema{n} double")


def sliced_ema(bars: DataFrame, n: int, column: str = "close", unit: str = "day") -> DataFrame:
    """The same mean for keys too long for one task: slices of time pass on their own, and one row a slice is carried on.

    Within a slice the mean runs from 0; what came before it adds its own mean
    times the weight's complement to the power of the values since. Only the
    slices' ends, a row each, pass one after the other.
    """
    keep = 1 - 2 / (n + 1)

    def local() -> Step:
        held, count = 0.0, 0

        def step(x):
            nonlocal held, count
            if x is not None:
                held, count = keep * held + (1 - keep) * x, count + 1
            return held, count

        return step

    def carry() -> Step:
        held = None

        def step(first, end, count):
            nonlocal held
            before, known = (first if held is None else held), held is not None
            held = end + keep**count * before if count else held
            return before, known

        return step

    slices = bars.withColumn("slice_", F.date_trunc(unit, "bar")).withColumn("key_", F.concat_ws("|", "symbol", F.col("slice_").cast("string")))
    inner = scanned(slices, local, [column], "local_ double, i_ long", by="key_")
    ends = inner.groupBy("symbol", "slice_").agg(F.min_by(column, F.struct(F.col(column).isNull(), "bar")).alias("first_"), F.max_by("local_", "i_").alias("end_"), F.max("i_").alias("count_"))
    carried = scanned(ends, carry, ["first_", "end_", "count_"], "carry_ double, known_ boolean", on=("slice_",)).select("symbol", "slice_", "carry_", "known_")
    out = inner.join(carried, ["symbol", "slice_"]).withColumn(f"ema{n}", F.when((F.col("i_") > 0) | F.col("known_"), F.col("local_") + F.pow(F.lit(keep), "i_") * F.col("carry_")))
    return out.select(*bars.columns, f"ema{n}")


def seeded_ema(bars: DataFrame, n: int, column: str = "close") -> DataFrame:
    """Exponential mean from the simple mean of the first n values on, which is also what the first n rows get; null for shorter symbols."""
    number = F.row_number().over(order())
    first = bars.withColumn("i_", number).where(F.col("i_") <= n).groupBy("symbol").agg(F.when(F.count("*") == n, F.avg(column)).alias("seed_"))

    def start() -> Step:
        count, held = 0, None

        def step(x, seed):
            nonlocal count, held
            count += 1
            held = seed if count <= n or held is None else held + 2 / (n + 1) * (x - held)
            return (held,)

        return step

    return scanned(bars.join(first, "symbol"), start, [column, "seed_"], f"sema{n} double").drop("seed_")


def atr_kinds(bars: DataFrame, n: int = 14) -> DataFrame:
    """Average true range in its forms, each with its own start: `rma` (Wilder from the first bar), `wilder` (null
    before n ranges that have a close before them), `exp` (weight 2 / (n + 1)), `lagged` (of 20 bars, up to the bar before)."""

    def start() -> Step:
        rma, exp, slow, wilder = _mean(1 / n), _mean(2 / (n + 1)), _mean(2 / 21), _mean(1 / n)
        count, old = -1, None

        def step(tr, span):
            nonlocal count, old
            count += 1
            first = span if tr is None else tr
            late, old = old, slow(first)
            w = wilder(tr)
            return rma(first), (w if count >= n else None), exp(first), late

        return step

    ranged = true_range(bars).withColumn("span_", F.col("high") - F.col("low"))
    ranged = ranged.withColumn("tr", F.when(F.lag("close").over(order()).isNotNull(), F.col("tr")))
    return scanned(ranged, start, ["tr", "span_"], "rma double, wilder double, exp double, lagged double").drop("span_")


def _share(up: float, down: float) -> float | None:
    return 100 * up / (up + down) if up + down > 0 else None


def wilder_rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """RSI of close from the smoothed mean gains and losses, weight 1 / n, from the first change on."""

    def start() -> Step:
        gain, loss, old = _mean(1 / n), _mean(1 / n), None

        def step(close):
            nonlocal old
            change, old = (None if old is None else close - old), close
            if change is None:
                return (None,)
            return (_share(gain(max(change, 0.0)), loss(max(-change, 0.0))),)

        return step

    return scanned(bars, start, ["close"], "rsi double")


def seeded_rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """RSI whose means start as simple means of the first n changes; null before."""

    def start() -> Step:
        up = down = 0.0
        old, count = None, 0

        def step(close):
            nonlocal up, down, old, count
            change, old = (None if old is None else close - old), close
            if change is None:
                return (None,)
            count += 1
            if count <= n:
                up, down = up + max(change, 0.0), down + max(-change, 0.0)
                if count < n:
                    return (None,)
                up, down = up / n, down / n
            else:
                up, down = (up * (n - 1) + max(change, 0.0)) / n, (down * (n - 1) + max(-change, 0.0)) / n
            return (_share(up, down),)

        return step

    return scanned(bars, start, ["close"], "srsi double")


def directional(bars: DataFrame, n: int = 14) -> DataFrame:
    """+DI, -DI and ADX from Wilder means that start at the first bar."""

    def start() -> Step:
        plus, minus, span, index = (_mean(1 / n) for _ in range(4))
        last = None

        def step(high, low, close):
            nonlocal last
            h, lo, c = last or (high, low, close)
            last = (high, low, close)
            up, down = high - h, lo - low
            tr = max(high - low, abs(high - c), abs(low - c))
            p, m, t = plus(up if up > down and up > 0 else 0.0), minus(down if down > up and down > 0 else 0.0), max(span(tr), 1e-12)
            pdi, mdi = 100 * p / t, 100 * m / t
            return pdi, mdi, index(100 * abs(pdi - mdi) / max(pdi + mdi, 1e-12))

        return step

    return scanned(bars, start, ["high", "low", "close"], "pdi double, mdi double, adx double")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    def start() -> Step:
        a, b, s = _mean(2 / (fast + 1)), _mean(2 / (slow + 1)), _mean(2 / (signal + 1))

        def step(close):
            line = a(close) - b(close)
            mean = s(line)
            return line, mean, line - mean

        return step

    return scanned(bars, start, ["close"], "macd double, signal double, hist double")


def supertrend(bars: DataFrame, n: int = 10, times: float = 3.0) -> DataFrame:
    """Direction (1 or -1) and the bands that only tighten while the close stays inside."""

    def start() -> Step:
        span = _mean(1 / n)
        last = None

        def step(high, low, close):
            nonlocal last
            old = close if last is None else last[0]
            reach = times * span(max(high - low, abs(high - old), abs(low - old)))
            top, floor, way = (high + low) / 2 + reach, (high + low) / 2 - reach, 1
            if last is not None:
                _, over, under, before = last
                way = 1 if close > over else -1 if close < under else before
                top = top if top < over or old > over else over
                floor = floor if floor > under or old < under else under
            last = (close, top, floor, way)
            return top, floor, way

        return step

    return scanned(bars, start, ["high", "low", "close"], "band_top double, band_floor double, trend int")


def parabolic(bars: DataFrame, first: float = 0.02, most: float = 0.2) -> DataFrame:
    """Stop-and-reverse line and its side (1 below a rise, -1 above a fall)."""

    def start() -> Step:
        state, past = None, []

        def step(high, low):
            nonlocal state
            if state is None:
                state = (1, low, high, first)
            else:
                way, line, best, pace = state
                line += pace * (best - line)
                # The line never enters the two bars before; seen from a fall, all signs turn.
                near = [(lo if way > 0 else -h) for h, lo in past]
                line = way * min(way * line, *near)
                if (low < line) if way > 0 else (high > line):
                    state = (-way, best, low if way > 0 else high, first)
                else:
                    ahead = high if way > 0 else low
                    if way * ahead > way * best:
                        best, pace = ahead, min(pace + first, most)
                    state = (way, line, best, pace)
            past.append((high, low))
            del past[:-2]
            return state[1], state[0]

        return step

    return scanned(bars, start, ["high", "low"], "sar double, side int")


def heikin_ashi(bars: DataFrame) -> DataFrame:
    def start() -> Step:
        body = None

        def step(o, h, low, c):
            nonlocal body
            close = (o + h + low + c) / 4
            begin = (o + c) / 2 if body is None else (body[0] + body[1]) / 2
            body = (begin, close)
            return begin, close

        return step

    return scanned(bars, start, ["open", "high", "low", "close"], "ha_open double, ha_close double")


def kalman_trend(bars: DataFrame, process: float = 1e-4, span: int = 100) -> DataFrame:
    """Slope of a local linear trend of log close over its standard error (null for the first `span` bars), and the level.

    The noise of an observation is the exponentially weighted variance of the
    log returns, 1e-10 at least; the slope's own noise is the share `process`
    of it.
    """

    def start() -> Step:
        count, y = -1, 0.0
        level, slope, a, b, d = 0.0, 0.0, 1.0, 0.0, 1.0  # a, b, d: the covariance's three numbers
        change = _mean(2 / (span + 1))

        def step(close):
            nonlocal count, y, level, slope, a, b, d
            count += 1
            old, y = y, math.log(close)
            if count == 0:
                level = y
                return None, close
            noise = max(change((y - old) ** 2), 1e-10)
            level += slope
            a, b, d = a + 2 * b + d, b + d, d + process * noise
            total = a + noise
            gain, pull, error = a / total, b / total, y - level
            level, slope = level + gain * error, slope + pull * error
            a, b, d = a - gain * a, b - gain * b, d - pull * b
            return (slope / math.sqrt(max(d, 1e-18)) if count > span else None), math.exp(level)

        return step

    return scanned(bars, start, ["close"], "z double, level double")


def kalman_acceleration(bars: DataFrame, process: float = 1e-6, span: int = 100) -> DataFrame:
    """Level, slope and acceleration of log close: slope and acceleration over their standard errors (null for the first `span` bars).

    As kalman_trend, with noise in the acceleration alone; three numbers and their covariance are the state.
    """
    move = np.array([[1.0, 1.0, 0.5], [0.0, 1.0, 1.0], [0.0, 0.0, 1.0]])

    def start() -> Step:
        count, y, x, p = -1, 0.0, np.zeros(3), np.eye(3)
        change = _mean(2 / (span + 1))

        def step(close):
            nonlocal count, y, x, p
            count += 1
            old, y = y, math.log(close)
            if count == 0:
                x[0] = y
                return None, None
            noise = max(change((y - old) ** 2), 1e-10)
            x, p = move @ x, move @ p @ move.T
            p[2, 2] += process * noise
            gain = p[:, 0] / (p[0, 0] + noise)
            x = x + gain * (y - x[0])
            p = p - np.outer(gain, p[0])
            if count <= span:
                return None, None
            return float(x[1] / math.sqrt(max(p[1, 1], 1e-18))), float(x[2] / math.sqrt(max(p[2, 2], 1e-18)))

        return step

    return scanned(bars, start, ["close"], "slope_z double, accel_z double")


def zigzag(bars: DataFrame, times: float = 3.0, unit: str = "unit") -> DataFrame:
    """Turning points of highs and lows that a close confirms: it must lie `times` the column `unit` off the extreme.

    One row for each confirmed turn: symbol, bar and price of the extreme,
    kind (1 top, -1 floor) and the bar that confirmed it. Kinds alternate. The
    bars since the last extreme are kept, as the next one lies among them.
    """

    def furthest(bars, way):
        """The first of the extreme bars, its price and the bars after it."""
        at = max(range(len(bars)), key=lambda i: (way * bars[i][1 if way > 0 else 2], -i))
        return bars[at][0], bars[at][1 if way > 0 else 2], bars[at + 1 :]

    def start() -> Step:
        ends = {}  # way -> (bar, price, bars after it); both ways until the first turn

        def step(bar, high, low, close, u):
            nonlocal ends
            if not ends:
                ends = {1: (bar, high, []), -1: (bar, low, [])}
                return None, None, None
            for way, (at, price, after) in ends.items():
                if way * (high if way > 0 else low) > way * price:
                    ends[way] = (bar, high if way > 0 else low, [])
                else:
                    after.append((bar, high, low))
            for way, (at, price, after) in ends.items():
                if way * (price - close) >= times * u and (after or len(ends) == 1):
                    ends = {-way: furthest(after, -way) if after else (bar, close, [])}
                    return at, price, way
            return None, None, None

        return step

    kind = bars.schema["bar"].dataType.simpleString()
    turns = scanned(bars, start, ["bar", "high", "low", "close", unit], f"at_ {kind}, price double, kind int").where("kind is not null")
    return turns.select("symbol", F.col("at_").alias("bar"), "price", "kind", F.col("bar").alias("confirmed"))


def swings(bars: DataFrame, times: float = 3.0, unit: str = "unit") -> DataFrame:
    """Turning points that the other side's extreme confirms: a low `times` the unit under the top, or a high over the floor."""

    def start() -> Step:
        way, top, floor = 0, None, None

        def step(bar, high, low, u):
            nonlocal way, top, floor
            if top is None:
                top, floor = (high, bar), (low, bar)
                return None, None, None
            reach = times * u
            rose, fell = way >= 0 and high > top[0], way <= 0 and low < floor[0]
            top, floor = ((high, bar) if rose else top), ((low, bar) if fell else floor)
            if way >= 0 and (top[1] < bar if way == 0 else not rose) and top[0] - low >= reach:
                found, way, floor = (top[1], top[0], 1), -1, (low, bar)
                return found
            if way <= 0 and (floor[1] < bar if way == 0 else not fell) and high - floor[0] >= reach:
                found, way, top = (floor[1], floor[0], -1), 1, (high, bar)
                return found
            return None, None, None

        return step

    kind = bars.schema["bar"].dataType.simpleString()
    turns = scanned(bars, start, ["bar", "high", "low", unit], f"at_ {kind}, price double, kind int").where("kind is not null")
    return turns.select("symbol", F.col("at_").alias("bar"), "price", "kind", F.col("bar").alias("confirmed"))


def excitation(bars: DataFrame, tau: float = 8.0, least: float = 2.0) -> DataFrame:
    """Intensity of shocks (moves of `least` true ranges and more) that decays by exp(-1 / tau) a bar, and its signed form."""

    def start() -> Step:
        span, old, all_, way = _mean(1 / 14), None, 0.0, 0.0
        keep = math.exp(-1 / tau)

        def step(high, low, close):
            nonlocal old, all_, way
            c = close if old is None else old
            unit = max(span(max(high - low, abs(high - c), abs(low - c))), 1e-12)
            move = 0.0 if old is None else (close - old) / unit
            old = close
            shock = abs(move) > least
            all_, way = keep * all_ + shock, keep * way + shock * (1 if move > 0 else -1)
            return all_, way

        return step

    return scanned(bars, start, ["high", "low", "close"], "heat double, heat_way double")


def spread(bars: DataFrame, span: int = 100) -> DataFrame:
    """Exponentially weighted variance of log returns, 1e-10 at least, and the deviation known a bar before."""

    def start() -> Step:
        mean, old, last = _mean(2 / (span + 1)), None, None

        def step(close):
            nonlocal old, last
            y, before = math.log(close), last
            last = 1e-10 if old is None else max(mean((y - old) ** 2), 1e-10)
            old = y
            return last, (None if before is None else math.sqrt(before))

        return step

    return scanned(bars, start, ["close"], "ewvar double, sigma_before double")


def smoothers(bars: DataFrame, period: int = 10, gamma: float = 0.7) -> DataFrame:
    """Filter bank of close: two-pole smoother, adaptive mean, Laguerre filter and lag-corrected exponential mean."""
    root = math.exp(-1.414 * math.pi / period)
    b = 2 * root * math.cos(1.414 * math.pi / period)
    c = -root * root

    def start() -> Step:
        past, two, kama, lag, four = [], [], None, None, None

        def step(x):
            nonlocal kama, lag, four
            past.append(x)
            del past[: -period - 1]
            two.append(x if len(two) < 2 else (1 - b - c) * (x + past[-2]) / 2 + b * two[-1] + c * two[-2])
            if len(two) > 2:
                del two[0]
            if len(past) <= period:
                kama = x
            else:
                path = sum(abs(q - p) for p, q in zip(past, past[1:]))
                share = abs(x - past[0]) / path if path > 0 else 0.0
                kama += (share * (2 / 3 - 2 / 31) + 2 / 31) ** 2 * (x - kama)
            four = four or [x] * 4
            new = [(1 - gamma) * x + gamma * four[0]]
            for k in range(1, 4):
                new.append(-gamma * new[k - 1] + four[k - 1] + gamma * four[k])
            four = new
            back = (period - 1) // 2
            source = 2 * x - past[-1 - back] if len(past) > back and lag is not None else x
            lag = x if lag is None else lag + 2 / (period + 1) * (source - lag)
            return two[-1], kama, (four[0] + 2 * four[1] + 2 * four[2] + four[3]) / 6, lag

        return step

    return scanned(bars, start, ["close"], "smooth double, kama double, laguerre double, zlema double")


def _stretches(batch: pa.RecordBatch, by: str) -> Iterator[tuple[object, int, int]]:
    """Keys of a sorted batch with the bounds of their rows."""
    codes = batch.column(by).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    edges = [*np.flatnonzero(np.diff(codes, prepend=codes[0] - 1)).tolist(), len(codes)] if len(codes) else [0]
    for low, high in zip(edges, edges[1:]):
        yield batch.column(by)[low].as_py(), low, high


def cooled(events: DataFrame, gap: float) -> DataFrame:
    """Events (symbol, at in seconds, id) at least gap after the last one kept: a greedy choice for each symbol.

    A task jumps by binary search from one kept event to the next, so it takes a step for each of these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, free = None, -math.inf
        for batch in batches:
            at, keep = batch.column("at").to_numpy(), np.zeros(batch.num_rows, bool)
            for name, low, high in _stretches(batch, "symbol"):
                if name != key:
                    key, free = name, -math.inf
                i = low + int(np.searchsorted(at[low:high], free))
                while i < high:
                    keep[i], free = True, at[i] + gap
                    i = max(i + 1, low + int(np.searchsorted(at[low:high], free)))
            yield batch.filter(pa.array(keep))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    return events.repartition("symbol").sortWithinPartitions("symbol", "at", "id").mapInArrow(run, schema)


def without_overlap(trades: DataFrame) -> DataFrame:
    """Trades (symbol, entry, exit, ...) such that a symbol has one open at a time: the earliest entry wins."""

    def start() -> Step:
        free = None

        def step(entry, leave):
            nonlocal free
            keep = free is None or entry >= free
            free = leave if keep else free
            return (keep,)

        return step

    return scanned(trades, start, ["entry", "exit"], "keep_ boolean", on=("entry", "exit")).where("keep_").drop("keep_")


def threshold_bars(ticks: DataFrame, threshold: str, value: str = "value") -> DataFrame:
    """The number of the bar of each tick (symbol, ts, id): a bar ends with the tick that takes its sum of `value` to the column `threshold`.

    A task sums stretches of ticks at once, from each bar's start on, so it takes a step for each bar and stretch.
    """
    stretch = 512

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, number = None, 0.0, 0
        for batch in batches:
            v, limit = (batch.column(n).to_numpy(zero_copy_only=False) for n in (value, threshold))
            out = np.zeros(batch.num_rows, np.int64)
            for name, i, high in _stretches(batch, "symbol"):
                if name != key:
                    key, total, number = name, 0.0, 0
                while i < high:
                    to = min(i + stretch, high)
                    sums = np.cumsum(np.concatenate([[total], v[i:to]]))[1:]
                    full = np.flatnonzero(sums >= limit[i:to])
                    if len(full):
                        to = i + int(full[0]) + 1
                    out[i:to] = number
                    total, number = (0.0, number + 1) if len(full) else (sums[-1], number)
                    i = to
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "number"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in ticks.schema.fields), "number long"])
    return ticks.repartition("symbol").sortWithinPartitions("symbol", "ts", "id").mapInArrow(run, schema)


def structure(bars: DataFrame) -> DataFrame:
    """Breaks of structure on bars with last_top and last_floor: a close beyond the latest confirmed extreme, once for
    each. `event` is BOS with the trend so far and CHOCH against it (the first break has no trend: BOS); `trend` is what
    holds after the bar; `place` is where the close lies between the two extremes."""

    def start() -> Step:
        trend, done_top, done_floor = 0, None, None

        def step(close, top, floor):
            nonlocal trend, done_top, done_floor
            way = 1 if top is not None and top != done_top and close > top else -1 if floor is not None and floor != done_floor and close < floor else 0
            event = None if not way else "CHOCH" if trend == -way else "BOS"
            if way > 0:
                done_top, trend = top, 1
            elif way < 0:
                done_floor, trend = floor, -1
            place = (close - floor) / (top - floor) if top is not None and floor is not None and top > floor else None
            return event, trend, place

        return step

    return scanned(bars, start, ["close", "last_top", "last_floor"], "event string, trend int, place double")


def normed(bars: DataFrame, span: int = 50, column: str = "ret") -> DataFrame:
    """A series over the root of the exponential mean of its squares; nulls are passed over."""

    def start() -> Step:
        mean = _mean(2 / (span + 1))

        def step(x):
            square = mean(None if x is None else x * x)
            return (x / math.sqrt(square) if x is not None and square > 0 else None,)

        return step

    return scanned(bars, start, [column], "normed double")


def positions(bars: DataFrame) -> DataFrame:
    """Position held after each bar by a channel rule: 1 after a close above `top`, -1 after one below `floor`, else as before."""

    def start() -> Step:
        held = 0

        def step(close, top, floor):
            nonlocal held
            if top is not None and close > top:
                held = 1
            elif floor is not None and close < floor:
                held = -1
            return (held,)

        return step

    return scanned(bars, start, ["close", "top", "floor"], "held int")
