"""Recurrences as associative scans: slices of a key's time pass in tasks of their own.

A row stands for a map of the recurrence's state (an affine map for a mean, a
conditioned Gaussian for a Kalman filter), and maps are composed in any
bracketing. Within a slice the maps up to each row are composed by doubling;
the slices' whole maps, a row each, are composed in order; and what came
before a slice is composed with each of its rows. Tasks grow with the slices
of time, not with the keys. The same recurrences a row at a time are in
`recursive`; values agree up to rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = "day"
Compose = Callable[[np.ndarray, np.ndarray], np.ndarray]


def prefixes(maps: np.ndarray, key: np.ndarray, compose: Compose) -> np.ndarray:
    """Of each row the composition of all maps of its run of equal keys up to it."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        at = np.flatnonzero(key[step:] == key[:-step]) + step
        if not len(at):
            break
        maps[at] = compose(maps[at - step], maps[at])
        step *= 2
    return maps


def _lists(values: np.ndarray) -> pa.ListArray:
    at = pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32())
    return pa.ListArray.from_arrays(at, pa.array(values.ravel()))


def _runs(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Numbers of the runs of equal keys in a sorted batch."""
    new = np.zeros(batch.num_rows, bool)
    for name in names:
        codes = batch.column(name).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(new)


def _grid(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix; NaN where it is null."""
    out = np.full((len(column), width), np.nan)
    known = column.is_valid().to_numpy(zero_copy_only=False)
    out[known] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


class _Runs:
    """Compositions along sorted batches; holds the map of the run that is open."""

    def __init__(self, keys: list[str], compose: Compose):
        self.keys, self.compose, self.open, self.tail = keys, compose, None, None

    def push(self, batch: pa.RecordBatch, maps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the runs, the compositions up to each row, and those up to the row before (NaN on a run's first)."""
        key = _runs(batch, self.keys)
        found = prefixes(maps, key, self.compose)
        goes_on = self.open == tuple(batch.column(k)[0] for k in self.keys)
        if goes_on:
            here = key == 0
            found[here] = self.compose(np.repeat(self.tail[None], here.sum(), 0), found[here])
        past = np.concatenate([found[:1], found[:-1]])
        past[np.diff(key, prepend=-1) != 0] = np.nan
        if goes_on:
            past[0] = self.tail
        self.open, self.tail = tuple(batch.column(k)[batch.num_rows - 1] for k in self.keys), found[-1]
        return key, found, past


def associative(rows: DataFrame, inputs: list[str], width: int, maps: Callable[..., np.ndarray], compose: Compose, finish: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], outputs: list[str], unit: str = UNIT) -> DataFrame:
    """rows with the columns `outputs` (double) of a recurrence over each symbol's bars; symbols are not null.

    maps gives the rows' maps (`width` numbers each, the first of them never
    NaN) from the inputs as float arrays, null as NaN. finish gives the outputs
    from the compositions of all maps up to each row and of those before it
    (NaN on a symbol's first row); NaN becomes null. The rows are shuffled
    once, by slice: the exchange is read for the slices' ends and for the rows.
    """

    def source(batch: pa.RecordBatch) -> np.ndarray:
        return maps(*(batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in inputs))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, held = _Runs(["symbol", "slice_"], compose), None
        for batch in batches:
            if batch.num_rows:
                before = runs.open
                key, found, _ = runs.push(batch, source(batch))
                if held is not None and before != tuple(batch.column(k)[0] for k in runs.keys):
                    yield held
                last = np.flatnonzero(np.diff(key, append=key[-1] + 1))
                whole = pa.RecordBatch.from_arrays([batch.column("symbol").take(pa.array(last)), batch.column("slice_").take(pa.array(last)), _lists(found[last])], ["symbol", "slice_", "end_"])
                if len(last) > 1:
                    yield whole.slice(0, len(last) - 1)
                held = whole.slice(len(last) - 1)
        if held is not None:
            yield held

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(["symbol"], compose)
        for batch in batches:
            if batch.num_rows:
                _, _, past = runs.push(batch, _grid(batch.column("end_"), width))
                lists = _lists(past)
                yield pa.RecordBatch.from_arrays([batch.column("symbol"), batch.column("slice_"), pa.ListArray.from_arrays(lists.offsets, lists.values, mask=pa.array(np.isnan(past[:, 0])))], ["symbol", "slice_", "before_"])

    kept = rows.columns

    def after(before: np.ndarray, own: np.ndarray) -> np.ndarray:
        known, inside = ~np.isnan(before[:, 0]), ~np.isnan(own[:, 0])
        out = np.where(inside[:, None], own, before)
        both = known & inside
        out[both] = compose(before[both], own[both])
        return out

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(["symbol", "slice_"], compose)
        for batch in batches:
            if batch.num_rows:
                _, found, past = runs.push(batch, source(batch))
                before = _grid(batch.column("before_"), width)
                made = finish(after(before, found), after(before, past))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(made[o], from_pandas=True) for o in outputs)], [*kept, *outputs])

    symbol = rows.schema["symbol"].dataType.simpleString()
    sliced = rows.withColumn("slice_", F.date_trunc(unit, "bar")).repartition("symbol", "slice_")
    kind = sliced.schema["slice_"].dataType.simpleString()
    parts = sliced.sortWithinPartitions("symbol", "slice_", "bar").mapInArrow(ends, f"symbol {symbol}, slice_ {kind}, end_ array<double>")
    starts = parts.repartition("symbol").sortWithinPartitions("symbol", "slice_").mapInArrow(carried, f"symbol {symbol}, slice_ {kind}, before_ array<double>")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), *(f"`{o}` double" for o in outputs)])
    met = sliced.join(starts, ["symbol", "slice_"]).sortWithinPartitions("symbol", "slice_", "bar")
    return met.mapInArrow(whole, schema)


def before_row(rows: DataFrame, unit: str = UNIT, number: str | None = None, **columns: str) -> DataFrame:
    """rows with, under each given name, a numeric column's value at the bar before (double), and with the bar's number from 0 (long)."""
    names, inputs = list(columns), [f"in{i}_" for i in range(len(columns))]

    def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.concatenate([a[:, :1] + b[:, :1], b[:, 1:]], 1)

    def finish(total: np.ndarray, past: np.ndarray) -> dict[str, np.ndarray]:
        return dict(zip(names, past[:, 1:].T)) | ({number: total[:, 0] - 1} if number else {})

    fed = rows.withColumns({"in_": F.lit(1.0), **{i: F.col(c).cast("double") for i, c in zip(inputs, columns.values())}})
    out = associative(fed, ["in_", *inputs], 1 + len(names), lambda *x: np.stack(x, 1), compose, finish, [*names, *([number] if number else [])], unit).drop("in_", *inputs)
    return out.withColumn(number, F.col(number).cast("long")) if number else out


# Means: a map is (keep, add, first value, count of values) for each mean; the value is keep * first + add.


def means(weights: list[float]) -> tuple[int, Callable[..., np.ndarray], Compose, Callable[[np.ndarray], list[np.ndarray]]]:
    """Width, maps, composition and values of exponential means with these weights, each of an input of its own; a null input keeps the mean."""
    k, w = len(weights), np.array(weights)

    def maps(*inputs: np.ndarray) -> np.ndarray:
        x = np.stack(inputs[:k], 1)
        known = ~np.isnan(x)
        x = np.where(known, x, 0.0)
        return np.concatenate([np.where(known, 1 - w, 1.0), w * x, x, known], 1)

    def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        (keep, add, first, known), (keep2, add2, first2, known2) = (np.split(x, 4, 1) for x in (a, b))
        return np.concatenate([keep * keep2, keep2 * add + add2, np.where(known > 0, first, first2), known + known2], 1)

    def values(total: np.ndarray) -> list[np.ndarray]:
        keep, add, first, known = np.split(total, 4, 1)
        mean = np.where(known == 1, first, keep * first + add)  # the first value itself, without rounding
        return list(np.where(known > 0, mean, np.nan).T)

    return 4 * k, maps, compose, values


def smoothed(rows: DataFrame, unit: str = UNIT, **columns: tuple[str | Column, float]) -> DataFrame:
    """rows with, under each name, the exponential mean (of the given weight) of a column from its first known value on."""
    inputs = [f"in{i}_" for i in range(len(columns))]
    fed = rows.withColumns({i: (F.col(c) if isinstance(c, str) else c).cast("double") for i, (c, _) in zip(inputs, columns.values())})
    width, maps, compose, values = means([w for _, w in columns.values()])
    names = list(columns)
    return associative(fed, inputs, width, maps, compose, lambda total, _: dict(zip(names, values(total))), names, unit).drop(*inputs)


def lines(rows: DataFrame, keep: list[Column], add: list[Column], names: list[str], unit: str = UNIT) -> DataFrame:
    """rows with h = keep * (h of the bar before) + add under each name, where a symbol starts from 0."""
    k = len(names)
    inputs = [f"in{i}_" for i in range(2 * k)]
    fed = rows.withColumns({i: c.cast("double") for i, c in zip(inputs, [*keep, *add])})

    def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.concatenate([a[:, :k] * b[:, :k], b[:, :k] * a[:, k:] + b[:, k:]], 1)

    return associative(fed, inputs, 2 * k, lambda *x: np.stack(x, 1), compose, lambda total, _: dict(zip(names, total[:, k:].T)), names, unit).drop(*inputs)


def ranged(bars: DataFrame, unit: str = UNIT, number: str | None = None, **columns: str) -> DataFrame:
    """bars with the close before (old_) and the true range, which for a symbol's first bar is null (tr_) or its span (first_)."""
    out = before_row(bars, unit, number, old_="close", **columns)
    span = F.col("high") - F.col("low")
    tr = F.when(F.col("old_").isNotNull(), F.greatest(span, F.abs(F.col("high") - F.col("old_")), F.abs(F.col("low") - F.col("old_"))))
    return out.withColumn("tr_", tr).withColumn("first_", F.coalesce("tr_", span))


def atr_kinds(bars: DataFrame, n: int = 14, unit: str = UNIT) -> DataFrame:
    """The average true range in its forms, as in recursive.atr_kinds, and `sma`: from the simple mean of the first n ranges on (null before)."""
    rows = ranged(bars, unit, "i_")
    seed = rows.where(F.col("i_").between(1, n)).groupBy("symbol").agg(F.when(F.count("tr_") == n, F.avg("tr_")).alias("seed_"))
    w = {"rma": 1 / n, "_w": 1 / n, "exp": 2 / (n + 1), "_slow": 2 / 21}
    width, maps, compose, values = means(list(w.values()))

    def finish(total: np.ndarray, past: np.ndarray) -> dict[str, np.ndarray]:
        return dict(zip(w, values(total))) | {"lagged": values(past)[3]}

    fed = rows.withColumns({"in0_": F.col("first_"), "in1_": F.col("tr_"), "in2_": F.col("first_"), "in3_": F.col("first_")})
    rows = associative(fed, ["in0_", "in1_", "in2_", "in3_"], width, maps, compose, finish, [*w, "lagged"], unit).join(seed, "symbol", "left")
    first = F.col("i_") <= n
    rows = lines(rows, [F.when(first, 0.0).otherwise(1 - 2 / (n + 1))], [F.when(F.col("i_") < n, 0.0).when(first, F.col("seed_")).otherwise(F.col("first_") * 2 / (n + 1))], ["_sma"], unit)
    out = rows.withColumns({"wilder": F.when(F.col("i_") >= n, F.col("_w")), "sma": F.when(F.col("i_") >= n, F.col("_sma"))})
    return out.withColumnRenamed("tr_", "tr").drop("i_", "old_", "first_", "_w", "_slow", "_sma", "seed_", "in0_", "in1_", "in2_", "in3_")


def share_of(up: Column, down: Column) -> Column:
    return F.when(up + down > 0, 100 * up / (up + down))


def wilder_rsi(bars: DataFrame, n: int = 14, unit: str = UNIT) -> DataFrame:
    """RSI of close from means of gains and losses with weight 1 / n, from the first change on."""
    rows = before_row(bars, unit, old_="close")
    change = F.col("close") - F.col("old_")
    rows = smoothed(rows, unit, up_=(F.greatest(change, F.lit(0.0) + change * 0), 1 / n), down_=(F.greatest(-change, F.lit(0.0) + change * 0), 1 / n))
    return rows.withColumn("rsi", F.when(F.col("old_").isNotNull(), share_of(F.col("up_"), F.col("down_")))).drop("old_", "up_", "down_")


def seeded_rsi(bars: DataFrame, n: int = 14, unit: str = UNIT) -> DataFrame:
    """RSI whose means start as the simple means of the first n changes; null before."""
    rows = before_row(bars, unit, "i_", old_="close")
    change = F.col("close") - F.col("old_")
    rows = rows.withColumns({"gain_": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))), "loss_": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0)))})
    seeds = rows.where(F.col("i_").between(1, n)).groupBy("symbol").agg(F.avg("gain_").alias("up0_"), F.avg("loss_").alias("down0_"))
    rows = rows.join(seeds, "symbol", "left")
    keep = F.when(F.col("i_") <= n, 0.0).otherwise((n - 1) / n)

    def add(seed: str, x: str) -> Column:
        return F.when(F.col("i_") < n, 0.0).when(F.col("i_") == n, F.col(seed)).otherwise(F.col(x) / n)

    rows = lines(rows, [keep, keep], [add("up0_", "gain_"), add("down0_", "loss_")], ["up_", "down_"], unit)
    rows = rows.withColumn("srsi", F.when(F.col("i_") >= n, share_of(F.col("up_"), F.col("down_"))))
    return rows.drop("i_", "old_", "up_", "down_", "up0_", "down0_")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, unit: str = UNIT) -> DataFrame:
    rows = smoothed(bars, unit, _a=("close", 2 / (fast + 1)), _b=("close", 2 / (slow + 1))).withColumn("macd", F.col("_a") - F.col("_b"))
    rows = smoothed(rows, unit, signal=("macd", 2 / (signal + 1)))
    return rows.withColumn("hist", F.col("macd") - F.col("signal")).drop("_a", "_b")


def directional(bars: DataFrame, n: int = 14, unit: str = UNIT) -> DataFrame:
    """+DI, -DI and ADX from means with weight 1 / n that start at the first bar."""
    rows = ranged(bars, unit, None, h_="high", l_="low")
    up, down = F.coalesce(F.col("high") - F.col("h_"), F.lit(0.0)), F.coalesce(F.col("l_") - F.col("low"), F.lit(0.0))
    plus, minus = F.when((up > down) & (up > 0), up).otherwise(0.0), F.when((down > up) & (down > 0), down).otherwise(0.0)
    rows = smoothed(rows, unit, p_=(plus, 1 / n), m_=(minus, 1 / n), t_=("first_", 1 / n))
    t = F.greatest("t_", F.lit(1e-12))
    rows = rows.withColumns({"pdi": 100 * F.col("p_") / t, "mdi": 100 * F.col("m_") / t})
    rows = smoothed(rows, unit, adx=(100 * F.abs(F.col("pdi") - F.col("mdi")) / F.greatest(F.col("pdi") + F.col("mdi"), F.lit(1e-12)), 1 / n))
    return rows.drop("old_", "tr_", "first_", "h_", "l_", "p_", "m_", "t_")


def seeded_ema(bars: DataFrame, n: int, column: str = "close", unit: str = UNIT) -> DataFrame:
    """Exponential mean from the simple mean of the first n values on, which is also what the first n rows get; null for shorter symbols."""
    rows = before_row(bars, unit, "i_")
    seeds = rows.where(F.col("i_") < n).groupBy("symbol").agg(F.when(F.count(F.lit(1)) == n, F.avg(column)).alias("seed_"))
    w, first = 2 / (n + 1), F.col("i_") < n
    rows = rows.join(seeds, "symbol")
    rows = lines(rows, [F.when(first, 0.0).otherwise(1 - w)], [F.when(first, F.coalesce("seed_", F.lit(0.0))).otherwise(F.col(column) * w)], ["mean_"], unit)
    return rows.withColumn(f"sema{n}", F.when(F.col("seed_").isNotNull(), F.col("mean_"))).drop("i_", "seed_", "mean_")


def squared_changes(weight: float) -> tuple[int, Callable[..., np.ndarray], Compose, Callable[[np.ndarray], np.ndarray]]:
    """Width, maps, composition and values of the exponential mean of squared changes of an input without nulls.

    A map holds its count of rows, its first and last input and the mean of the
    changes within; composing two adds the change between them. values gives
    the mean, NaN before the first change.
    """
    _, _, join, mean = means([weight])

    def maps(y: np.ndarray, *_: np.ndarray) -> np.ndarray:
        one, none = np.ones_like(y), np.zeros_like(y)
        return np.stack([one, y, y, one, none, none, none], 1)

    def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        change = (b[:, 1] - a[:, 2]) ** 2
        between = np.stack([np.full_like(change, 1 - weight), weight * change, change, np.ones_like(change)], 1)
        return np.concatenate([a[:, :1] + b[:, :1], a[:, 1:2], b[:, 2:3], join(join(a[:, 3:], between), b[:, 3:])], 1)

    return 7, maps, compose, lambda total: mean(total[:, 3:])[0]


def spread(bars: DataFrame, span: int = 100, unit: str = UNIT) -> DataFrame:
    """Exponentially weighted variance of log returns (1e-10 at least), and the deviation that the bar before had."""
    width, maps, compose, values = squared_changes(2 / (span + 1))

    def finish(total: np.ndarray, past: np.ndarray) -> dict[str, np.ndarray]:
        now, old = (np.fmax(values(x), 1e-10) for x in (total, past))
        return {"ewvar": now, "sigma_before": np.where(total[:, 0] > 1, np.sqrt(old), np.nan)}

    return associative(bars.withColumn("y_", F.log("close")), ["y_"], width, maps, compose, finish, ["ewvar", "sigma_before"], unit).drop("y_")


def normed(rows: DataFrame, span: int, column: str = "ret", unit: str = UNIT) -> DataFrame:
    """A column over the root of the exponential mean of its squares."""
    out = smoothed(rows, unit, v_=(F.col(column) * F.col(column), 2 / (span + 1)))
    return out.withColumn("normed", F.when(F.col("v_") > 0, F.col(column) / F.sqrt("v_"))).drop("v_")


def heikin_ashi(bars: DataFrame, unit: str = UNIT) -> DataFrame:
    rows = bars.withColumn("ha_close", (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4)
    rows = before_row(rows, unit, old_="ha_close")
    first = F.col("old_").isNull()
    rows = lines(rows, [F.when(first, 0.0).otherwise(0.5)], [F.when(first, (F.col("open") + F.col("close")) / 2).otherwise(F.col("old_") / 2)], ["ha_open"], unit)
    return rows.drop("old_")


def excitation(bars: DataFrame, n: int = 14, bound: float = 2.0, life: float = 8.0, unit: str = UNIT) -> DataFrame:
    """Intensity that each move of over `bound` mean true ranges raises by one (by its sign in `heat_way`), decaying by exp(-1 / life) a bar."""
    rows = smoothed(ranged(bars, unit), unit, a_=("first_", 1 / n))
    move = F.coalesce((F.col("close") - F.col("old_")) / F.greatest("a_", F.lit(1e-12)), F.lit(0.0))
    rows = rows.withColumn("move_", move)
    shock = F.abs("move_") > bound
    keep = F.lit(float(np.exp(-1 / life)))
    rows = lines(rows, [keep, keep], [shock.cast("double"), F.when(shock, F.signum("move_")).otherwise(0.0)], ["heat", "heat_way"], unit)
    return rows.drop("old_", "tr_", "first_", "a_", "move_")


# Kalman filter of a local linear trend. A map is a Gaussian conditioned on the rows' observations, given the state before
# them: x ~ N(A x0 + b, C), with the likelihood of x0 in information form (e, J): the parallel filter of Särkkä and
# García-Fernández (2021).


def _gaussian(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    def parts(x: np.ndarray) -> list[np.ndarray]:
        return [x[:, i:j].reshape(-1, 2, k) for i, j, k in ((0, 4, 2), (4, 6, 1), (6, 10, 2), (10, 12, 1), (12, 16, 2))]

    (a1, b1, c1, e1, j1), (a2, b2, c2, e2, j2) = parts(a), parts(b)
    inner = np.linalg.inv(np.eye(2) + c1 @ j2)
    ahead, back = a2 @ inner, a1.transpose(0, 2, 1) @ inner.transpose(0, 2, 1)
    out = [ahead @ a1, ahead @ (b1 + c1 @ e2) + b2, ahead @ c1 @ a2.transpose(0, 2, 1) + c2, back @ (e2 - j2 @ b1) + e1, back @ j2 @ a1 + j1]
    return np.concatenate([x.reshape(len(a), x.shape[1] * x.shape[2]) for x in out], 1)


def kalman_trend(bars: DataFrame, process: float = 1e-4, span: int = 100, unit: str = UNIT) -> DataFrame:
    """Slope of a local linear trend of log close over its standard error (`z`, null for the first `span` bars), the
    level, and `dev`: the log close's distance from the level in roots of the exponential mean of its squares (null as z is).

    An observation's noise is the exponentially weighted variance of log
    returns, 1e-10 at least; the slope's own noise is the share `process` of it.
    """
    width, changes, join, values = squared_changes(2 / (span + 1))
    rows = associative(bars.withColumn("y_", F.log("close")), ["y_"], width, changes, join, lambda total, _: {"i_": total[:, 0] - 1, "v_": values(total)}, ["i_", "v_"], unit)

    def maps(y: np.ndarray, v: np.ndarray, i: np.ndarray) -> np.ndarray:
        noise = np.maximum(np.where(i == 0, 1.0, v), 1e-10)
        one, none = np.ones_like(y), np.zeros_like(y)
        later = [one, one, none, one, none, none, none, none, none, process * noise, y / noise, y / noise, *[1 / noise] * 4]
        first = [none, none, none, none, y, none, one, none, none, one, *[none] * 6]  # the state at a symbol's first bar is given
        return np.where((i == 0)[:, None], np.stack(first, 1), np.stack(later, 1))

    def finish(total: np.ndarray, _: np.ndarray) -> dict[str, np.ndarray]:
        return {"x_": total[:, 4], "s_": total[:, 5], "d_": total[:, 9]}

    rows = associative(rows, ["y_", "v_", "i_"], 16, maps, _gaussian, finish, ["x_", "s_", "d_"], unit)
    rows = smoothed(rows.withColumn("left_", F.when(F.col("i_") > 0, F.col("y_") - F.col("x_"))), unit, e_=(F.col("left_") * F.col("left_"), 2 / (span + 1)))
    late = F.col("i_") > span
    rows = rows.withColumns({"z": F.when(late, F.col("s_") / F.sqrt(F.greatest("d_", F.lit(1e-18)))), "level": F.exp("x_"), "dev": F.when(late, F.col("left_") / F.sqrt(F.greatest("e_", F.lit(1e-18))))})
    return rows.drop("i_", "y_", "v_", "x_", "s_", "d_", "left_", "e_")
