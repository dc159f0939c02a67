"""Functions and operators by name: SQL functions that Catalyst inlines, a table function, an aggregate, and frame operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tickframe.operators import events as E
from tickframe.operators import frames as W
from tickframe.operators import recursive as R

#: SQL functions: name and arguments, type, body. They are expanded into the plan, so they cost what the body costs.
SQL_FUNCTIONS = [
    ("to_step(x DOUBLE, step DOUBLE)", "DOUBLE", "floor(round(x / step, 9)) * step"),
    ("nearest_round(p DOUBLE)", "DOUBLE", "CASE WHEN p > 0 THEN round(p / (pow(10, floor(log10(p))) / 2)) * (pow(10, floor(log10(p))) / 2) END"),
    ("session_phase(h INT)", "STRING", "CASE WHEN h < 7 THEN 'asia' WHEN h < 13 THEN 'london' WHEN h < 21 THEN 'new_york' ELSE 'close' END"),
    ("in_risks(entry DOUBLE, stop DOUBLE, price DOUBLE)", "DOUBLE", "CASE WHEN entry <> stop THEN (price - entry) / (entry - stop) END"),
    ("wilson_low(k DOUBLE, n DOUBLE)", "DOUBLE", "(k / n + 3.8416D / (2 * n) - 1.96D * sqrt(k / n * (1 - k / n) / n + 3.8416D / (4 * n * n))) / (1 + 3.8416D / n)"),
    ("price_bins(low DOUBLE, high DOUBLE, width DOUBLE)", "TABLE (bin INT)", "SELECT explode(sequence(CAST(floor(low / width) AS INT), CAST(floor(high / width) AS INT)))"),
]

#: Operators on bars by name: what a user's own strategy adds to, and picks from by a parameter.
OPERATORS: dict[str, Callable[..., DataFrame]] = {
    "returns": W.returns,
    "atr": W.atr,
    "bollinger": W.bollinger,
    "donchian": W.donchian_breakouts,
    "stochastic": W.stochastic,
    "robust_z": W.robust_z,
    "ema": R.ema,
    "macd": R.macd,
    "supertrend": R.supertrend,
    "kalman": R.kalman_trend,
    "sweeps": E.sweeps,
    "absorption": E.absorption,
}


def registered(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Decorator: adds an operator under a name that is not taken."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in OPERATORS:
            raise ValueError(f"operator {name} is there already")
        OPERATORS[name] = f
        return f

    return add


def applied(bars: DataFrame, *steps: tuple[str, dict]) -> DataFrame:
    """Operators one after the other, each by its name and parameters."""
    for name, parameters in steps:
        bars = OPERATORS[name](bars, **parameters)
    return bars


@F.pandas_udf(DoubleType())
def entropy(values: pd.Series) -> float:
    """Entropy of the values' shares of their sum: an aggregate for groups of bounded size."""
    shares = values[values > 0] / values[values > 0].sum()
    return float(-(shares * np.log(shares)).sum())


def register(spark: SparkSession) -> None:
    """Make the functions known to spark.sql in this session."""
    for head, kind, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udf.register("share_entropy", entropy)
