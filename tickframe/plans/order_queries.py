"""Registered queries of order statistics over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickframe.operators import frames as W
from tickframe.operators import quantiles as Q
from tickframe.plans.queries import BARS, OVER, hourly, query, rounded

SCORE = f"WITH {BARS}, o AS (SELECT *, row_number() OVER {OVER} - 1 AS j FROM (SELECT symbol, bar, close / lag(close, 4) OVER {OVER} - 1 AS score FROM bars) WHERE score IS NOT NULL)"


@query(
    "expanding_mask",
    f"{SCORE}, l AS (SELECT symbol, list(score ORDER BY j) AS v FROM o GROUP BY 1), c AS (SELECT symbol, k, list_sort(v[1 : 100 + 200 * k]) AS w FROM l, LATERAL (SELECT unnest(range(0, (len(v) - 1 - 100) // 200 + 1)) AS k)), b AS (SELECT symbol, k, w[floor(len(w) * (1 - 0.1::DOUBLE))::BIGINT + 1] AS high, w[floor(len(w) * 0.1::DOUBLE)::BIGINT + 1] AS low FROM c) SELECT o.symbol, bar, round(score, 6) AS score, round(high, 6) AS high, round(low, 6) AS low, coalesce(score >= high, FALSE) AS top, coalesce(score <= low, FALSE) AS bottom FROM o LEFT JOIN b ON b.symbol = o.symbol AND o.j >= 100 AND b.k = (o.j - 100) // 200",
)
def expanding_mask(spark, sf_dir):
    """Bars whose four-hour return is in the top or bottom tenth of those before it; the bounds are refreshed every 200 bars."""
    rows = hourly(spark, sf_dir).select("symbol", "bar", (F.col("close") / F.lag("close", 4).over(W.order()) - 1).alias("score"))
    return rounded(Q.expanding_mask(rows, "score", 0.1, 100, 200), "symbol", "bar", "score", "high", "low", "top", "bottom")


@query("universe_cuts", f"{SCORE} SELECT round(quantile_cont(score, 0.05), 6) AS p05, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.95), 6) AS p95 FROM o")
def universe_cuts(spark, sf_dir):
    """Percentiles of the four-hour return over all symbols and bars."""
    rows = hourly(spark, sf_dir).select((F.col("close") / F.lag("close", 4).over(W.order()) - 1).alias("score"))
    return rounded(Q.percentile_columns(rows, [], "score", {"p05": 0.05, "p50": 0.5, "p95": 0.95}), "p05", "p50", "p95")
