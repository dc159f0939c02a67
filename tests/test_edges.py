"""Queries against their SQL over few rows that the given tables hardly have: prices of 0, volumes that tie."""

import datetime as dt
import time

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.test_queries import rows
from tickframe.functions.formulas import evaluated
from tickframe.operators.profiles import overlap_profile, value_area
from tickframe.operators.relations import nearest_rows
from tickframe.plans.catalog import ORACLE_SQL, QUERIES
from tickframe.plans.queries import rounded
from tickframe.plans.state_queries import EQUATIONS

START = dt.datetime(2024, 1, 1)


def against_sql(spark, folder, name, table, columns):
    """The rows of a query and those of its SQL, sorted, over one table written to the folder."""
    path = f"{folder}/{table}.parquet"
    pq.write_table(columns, path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return rows(QUERIES[name](spark, str(folder)).toPandas()), rows(con.execute(ORACLE_SQL[name]).df())


def events(found):
    """The table events of (hour, symbol, price, size)."""
    hours, symbols, prices, sizes = zip(*found, strict=True)
    return pa.table(
        {
            "event_id": pa.array(range(len(found)), pa.int64()),
            "ts": pa.array([START + dt.timedelta(hours=h, seconds=i % 3600) for i, h in enumerate(hours)], pa.timestamp("us")),
            "user_id": pa.array(range(len(found)), pa.int64()),
            "event_type": pa.array(symbols),
            "value": pa.array(prices, pa.float64()),
            "props": pa.array([f'{{"k": {s}}}' for s in sizes]),
        }
    )


def test_double_bottoms_after_a_floor_at_zero(spark, tmp_path):
    lows = [5, 4, 3, 0, 3, 4, 5, 4, 3, 0, 3, 4, 5, 4, 3, 2, 3, 4, 5, 4, 3, 2.1, 3, 4, 5]
    got, want = against_sql(spark, tmp_path, "double_bottoms", "events", events([(h, "view", p, 1) for h, p in enumerate(lows)]))
    assert got == want and len(got) == 1


def test_range_regime_of_days_from_zero(spark, tmp_path):
    """Days whose lowest price is 0 have an infinite range, those at 0 all day none that is a number."""
    found = [(h, "view", p, 1) for h, p in ((0, 0.0), (1, 3.0), (24, 2.0), (25, 3.0), (48, 0.0), (49, 0.0), (72, -2.0), (73, 1.0))] + [(26, "click", 1.0, 1), (27, "click", 30.0, 1)]
    got, want = against_sql(spark, tmp_path, "range_regime", "events", events(found))
    assert got == want and len(got) == 4
    assert sorted(r["regime"] for r in QUERIES["range_regime"](spark, str(tmp_path)).collect()) == ["extreme", "extreme", "low", "normal"]


def tied(spark):
    """Bars of ten symbols that all cover the lowest bins of 24: frames of them in several orders, the width of a symbol's bins, and its volumes added in the order of time."""
    found = [(f"s{s}", START + dt.timedelta(hours=h), 0.01 * ((h + s) % 3), 142.65 + 1.37 * (h * (s + 3) % 11), float(1 + (h * 7 + s) % 13)) for s in range(10) for h in range(200)]
    width = {f"s{s}": max(b[3] for b in found if b[0] == f"s{s}") / 24 for s in range(10)}
    want = {f"s{s}": [0.0] * 24 for s in range(10)}
    for symbol, _, low, high, volume in found:
        for i in range(24):
            over = min(high, i * width[symbol] + width[symbol]) - max(low, i * width[symbol])
            want[symbol][i] += volume * over / (high - low) if over > 0 else 0.0
    orders = found, found[::-1], found[::3] + found[1::3] + found[2::3]
    return [spark.createDataFrame(o, "symbol string, bar timestamp_ntz, low double, high double, volume double").repartition(3, "bar") for o in orders], width, want


def test_profiles_add_in_the_order_of_time(spark):
    """Bins that the same bars cover tie but for the last digit, which must not depend on how rows lie."""
    frames, _, want = tied(spark)
    for bars in frames:
        got = {(r.symbol, r.bin): r.v for r in overlap_profile(bars, 24, "symbol").collect()}
        assert got == {(s, i): v for s, volumes in want.items() for i, v in enumerate(volumes)}


def against_one_thread(spark, name):
    """The rows of a query and of its SQL at sf0.1; by several threads the SQL adds in any order, and tied bins come out at random."""
    con = duckdb.connect(config={"threads": 1})
    con.execute("CREATE VIEW events AS SELECT * FROM read_parquet('/root/testdata/sf0.1/events.parquet')")
    return rows(QUERIES[name](spark, "/root/testdata/sf0.1").toPandas()), rows(con.execute(ORACLE_SQL[name]).df())


def test_control_path_of_tied_bins(spark):
    got, want = against_one_thread(spark, "control_path")
    assert got == want and len(got) == 3534


def test_value_area_of_tied_bins(spark):
    frames, width, want = tied(spark)
    assert all(sum(v > max(volumes) * (1 - 1e-12) for v in volumes) > 1 for volumes in want.values())
    for bars in frames:
        got = {r.symbol: r.poc for r in value_area(overlap_profile(bars, 24, "symbol"), 24, 0.7, "symbol").collect()}
        assert got == {s: (volumes.index(max(volumes)) + 0.5) * width[s] for s, volumes in want.items()}


def test_value_area_against_one_thread(spark):
    got, want = against_one_thread(spark, "value_area")
    assert got == want and len(got) == 5


def vectors(n, width, seed):
    """The table embeddings of n vectors, of which some are equal and others lie far out."""
    values = np.random.default_rng(seed).normal(size=(n, width)).astype(np.float32)
    values[n // 2 : n // 2 + n // 10] = values[0]
    values[-5:] *= 1e6
    return pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": pa.array(list(values), pa.list_(pa.float32()))})


def test_nearest_rows_among_equal_and_far_ones(spark, tmp_path):
    pq.write_table(vectors(1500, 64, 1), f"{tmp_path}/embeddings.parquet")
    points = spark.read.parquet(f"{tmp_path}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    got = sorted((r.query, r.near, r.rank, r.distance) for r in nearest_rows(points.where("id % 20 = 0"), points, 5, block=30, part=200).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
    want = sorted(con.execute(ORACLE_SQL["knn"].replace("round(d, 4)", "d")).fetchall())
    assert [r[:3] for r in got] == [r[:3] for r in want] and len(got) == 375
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], rel=1e-14, abs=0)


def test_nearest_rows_of_many_pairs_end_in_time(spark, tmp_path):
    """90 million pairs took 49 seconds by their differences, on four cores."""
    pq.write_table(vectors(60_000, 64, 2), f"{tmp_path}/embeddings.parquet")
    points = spark.read.parquet(f"{tmp_path}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    start = time.monotonic()
    assert nearest_rows(points.where("id < 1500"), points, 5).count() == 7500
    assert time.monotonic() - start < 25


def test_symbolic_equations_where_tanh_is_nearly_one(spark):
    steps = [-1.7 - n / 100 for n in range(31)]
    found = [(f"{x} {y} {z}", x, z, y) for x in [*steps, 40.0] for y in [*steps, 0.5] for z in (-1.0, 0.0, 1.0)]
    got = rounded(evaluated(spark.createDataFrame(found, "symbol string, s4 double, s12 double, s24 double"), EQUATIONS), "symbol", *EQUATIONS).toPandas()
    con = duckdb.connect()
    con.execute("CREATE TABLE g (symbol VARCHAR, s4 DOUBLE, s12 DOUBLE, s24 DOUBLE, start INT, known BOOL DEFAULT TRUE)")
    con.executemany("INSERT INTO g (symbol, s4, s12, s24) VALUES (?, ?, ?, ?)", found)
    want = con.execute("WITH p AS (" + ORACLE_SQL["symbolic_equations"].split(", p AS (")[1]).df().drop(columns="bar")
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["symbolic_equations", "size_coherence"])
def test_slopes_of_bars_that_fall_to_nothing(spark, tmp_path, name):
    """One symbol falls to next to nothing late in a day, so that exp overflows, and one ends at 0."""
    tiny = [(h, "tiny", 100.0 if h < 24 * 9 else 500.0 if h % 24 < 20 else 1e-3, 1) for h in range(24 * 12)]
    none = [(h, "none", 0.0 if h > 24 * 8 else 5.0 + h % 7, 1) for h in range(24 * 16)]
    got, want = against_sql(spark, tmp_path, name, "events", events(tiny + none))
    assert got == want and len(got) > 300
