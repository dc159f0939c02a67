"""Catalogues of filters on signals: crowding on either side, and situations of market, symbol and calendar.

A filter has a rule for whom it applies to and a condition that removes; a
condition that is not known keeps, so features are null where history lacks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.operators import frames as W
from tickframe.operators import quantiles as Q
from tickframe.operators.joins import as_of

Catalogue = dict[str, tuple[Column, Column]]
c = F.col


def covered(value: Column, name: str, n: int, share: float = 0.9) -> Column:
    """value where at least this share of the last n bars (which there must be) has the column."""
    enough = (F.count(F.lit(1)).over(W.last(n)) == n) & (F.count(name).over(W.last(n)) >= share * n)
    return F.when(enough, value)


def crowding_features(bars: DataFrame, interest: str, ratio: str, flow: str, day: int = 24, long: int = 120) -> DataFrame:
    """bars with build (log change of open interest over a day), high (its log distance from its long mean), lean (log of
    the long/short ratio over its long median) and taken (mean taker flow of a day); non-positive interest and ratios are unknown."""
    rows = bars.withColumns({n: F.when(c(n) > 0, c(n)) for n in (interest, ratio)})
    rows = rows.withColumns({"old_": F.lag(interest, day).over(W.order()), "mean_": F.avg(interest).over(W.last(long)), "median_": W.middle(W.windowed(ratio, long)), "flow_": F.avg(flow).over(W.last(day))})
    return rows.withColumns(
        {
            "build": covered(F.log(c(interest) / c("old_")), interest, day + 1),
            "high": covered(F.log(c(interest) / c("mean_")), interest, long),
            "lean": covered(F.log(c(ratio) / c("median_")), ratio, long),
            "taken": covered(c("flow_"), flow, day),
        }
    ).drop("old_", "mean_", "median_", "flow_")


def crowding_filters() -> Catalogue:
    """Eight filters, each for one side: what removes is the opposite of what the filter asks for."""
    short, long = c("side") == "S", c("side") == "L"
    return {
        "S_RETAIL_LONG": (short, c("lean") <= 0),
        "S_OI_BUILD": (short, c("build") <= 0),
        "S_OI_HIGH": (short, c("high") <= 0),
        "S_TAKER_SELL": (short, c("taken") >= 0),
        "L_RETAIL_SHORT": (long, c("lean") >= 0),
        "L_OI_BUILD": (long, c("build") <= 0),
        "L_OI_HIGH": (long, c("high") <= 0),
        "L_TAKER_BUY": (long, c("taken") <= 0),
    }


def order_entropy(n: int) -> tuple[Column, Column]:
    """The code of the order of the last three closes, and of such codes (as code_) the entropy over the last n, with the
    correction for their number, as a share of its maximum."""
    one, two = F.lag("close", 2).over(W.order()), F.lag("close", 1).over(W.order())
    code = 4 * (two < one).cast("int") + 2 * (c("close") < one).cast("int") + (c("close") < two).cast("int")
    counts = F.array(*(F.count_if(c("code_") == k).over(W.last(n)).cast("double") for k in (0, 1, 3, 4, 6, 7)))
    seen = F.filter(counts, lambda x: x > 0)
    entropy = F.aggregate(seen, F.lit(0.0), lambda s, x: s - x / n * F.log(x / n)) + (F.size(seen) - 1) / (2 * n)
    return code, F.when(F.count("code_").over(W.last(n)) == n, entropy / math.log(6))


def situation_features(bars: DataFrame, trades: DataFrame, leader: str, n: int = 60, back: int = 48) -> DataFrame:
    """bars with what the situations read.

    trades are (symbol, bar, exit, r). path: efficiency over n bars, and that
    of the leader; ratio: variance ratio; disorder: entropy of orders; squeeze:
    the last ranges over the long mean; whipsaw: the symbol's last two closed
    trades lost; wins: of the last ten closed trades of all symbols; gain and
    leader_gain: log return of `back` bars; ahead: the share of the other
    symbols that beat the leader (three at least known); listed: first bar.
    """
    rows = W.variance_ratio(W.true_range(bars), 6, 120)
    steps = F.abs(c("close") - F.lag("close").over(W.order()))
    rows = rows.withColumns({"step_": steps, "code_": order_entropy(n)[0], "gain": F.log(c("close") / F.lag("close", back).over(W.order()))})
    net, path = F.abs(c("close") - F.lag("close", n).over(W.order())), F.sum("step_").over(W.last(n))
    rows = rows.withColumns({"path": F.when(net.isNotNull() & (path > 0), net / path), "disorder": order_entropy(n)[1], "squeeze": W.full(F.avg("tr").over(W.last(14)) / F.avg("tr").over(W.last(120)), 120, W.last(120))})
    lead = rows.where(c("symbol") == leader).select("bar", c("path").alias("leader_path"), c("gain").alias("leader_gain"))
    rows = rows.join(lead, "bar", "left")
    beats = F.when(c("symbol") != leader, c("gain") > c("leader_gain"))
    season = rows.groupBy("bar").agg(F.when(F.count(beats) >= 3, F.avg(beats.cast("double"))).alias("ahead"))
    first = bars.groupBy("symbol").agg(F.min("bar").alias("listed"))
    rows = rows.join(season, "bar").join(first, "symbol").drop("step_", "code_", "r1", "rq")
    own = Window.partitionBy("symbol").orderBy("exit", "bar")
    closed = trades.withColumns({"lost_": c("r") < 0, "old_": F.lag(c("r") < 0).over(own)})
    last_two = closed.groupBy("symbol", c("exit").alias("bar")).agg(F.max_by(c("lost_") & c("old_"), "bar").alias("whipsaw"))
    rows = as_of(rows, last_two, "bar", "symbol", ["whipsaw"])
    # Closed trades of all symbols are numbered by slices of time; each counts for itself and the nine after it.
    numbered = Q.ordinals(trades.select(F.lit("all").alias("symbol"), F.struct("exit", "symbol", c("bar").alias("entry")).alias("turn"), c("exit").alias("bar"), (c("r") > 0).cast("int").alias("won")), "i_", order="turn")
    spread = numbered.select(F.explode(F.sequence(c("i_"), c("i_") + 9)).alias("i_"), "won").groupBy("i_").agg(F.sum("won").alias("wins"), F.count(F.lit(1)).alias("n_")).where("n_ = 10")
    tens = numbered.join(spread, "i_").groupBy("bar").agg(F.max_by("wins", "i_").alias("wins")).withColumn("all_", F.lit("all"))
    return as_of(rows.withColumn("all_", F.lit("all")), tens, "bar", "all_", ["wins"]).drop("all_")


def situation_filters(leader: str, days: list[str], n: int = 60, young: str = "5 days") -> Catalogue:
    """Thirteen filters on the features of situations; days are dates that count with the day before them."""
    every, other = F.lit(True), c("symbol") != leader
    long, short = other & (c("side") == "L"), other & (c("side") == "S")
    dates = [F.lit(d).cast("date") for d in days]
    near = F.to_date("bar").isin(*dates) | F.date_add(F.to_date("bar"), 1).isin(*dates)
    return {
        "COIN_CHOP": (every, c("path") < 1 / math.sqrt(n)),
        "BTC_CHOP": (every, c("leader_path") < 1 / math.sqrt(n)),
        "MEAN_REVERT": (every, c("vr") < 1),
        "DISORDER": (every, c("disorder") > 0.967),
        "SQUEEZE": (every, c("squeeze") < 0.75),
        "COIN_WHIPSAW": (every, c("whipsaw")),
        "SYSTEM_COLD": (every, c("wins") <= 2),
        "RS_LEADER": (long, c("gain") <= c("leader_gain")),
        "ALT_SEASON": (long, c("ahead") <= 0.5),
        "RS_LAGGARD": (short, c("gain") >= c("leader_gain")),
        "WEEKEND": (every, F.weekday("bar") >= 5),
        "NEW_LISTING": (every, c("bar") < c("listed") + F.expr(f"interval {young}")),
        "FOMC": (every, near),
    }
