"""Families of triggers: each bar's side by rule, fired where the rule newly holds and thinned by a pause."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.operators import frames as W
from tickframe.operators import quantiles as Q
from tickframe.operators.recursive import cooled

c = F.col


def way(value: Column, test: Column) -> Column:
    """The sign of a value where the test holds, else 0."""
    return F.when(test, F.signum(value)).otherwise(0.0).cast("int")


def trigger_sides(bars: DataFrame, leader: str, bound: float = 2.0) -> DataFrame:
    """bars with a column for each family: 1 or -1 where its condition holds, else 0.

    lead: the leader's three-bar move is out by `bound` deviations (of the 60
    bars before) and the symbol has moved less; flow: bought minus sold volume
    of ten bars is out against the 120 bars before, along it; spent: the same
    at an extreme of close and on heavy volume, against it; flush: open
    interest (a day's volume here) falls into its lowest tenth of five days in
    a move of a range, against the move; build: it rises into its highest
    tenth as close breaks six bars; fade: close is out against the day's
    weighted price, back to it; open: the first closes out of the 08:00 to
    10:00 range until 16:00; settle: an eighth hour after a one-sided one.
    """
    w = W.order()
    rows = W.atr(bars).withColumns({"move": F.log(c("close") / F.lag("close", 3).over(w)), "bought": F.sum("buy").over(W.last(10)), "traded": F.sum("volume").over(W.last(10)), "oi": F.sum("volume").over(W.last(24)), "priced": F.sum(c("close") * c("volume")).over(W.last(24))})
    rows = rows.withColumns({"imb": F.when(c("traded") > 0, (2 * c("bought") - c("traded")) / c("traded")), "doi": F.when(F.lag("oi").over(w) > 0, c("oi") / F.lag("oi").over(w) - 1), "dev": F.when(c("oi") > 0, c("close") * c("oi") / c("priced") - 1), "old": F.lag("close").over(w)})
    long = W.before(120)

    def out_of(name: str, frame: Window, n: int, centred: bool) -> Column:
        value = c(name) - F.avg(name).over(frame) if centred else c(name)
        sd = F.stddev_pop(name).over(frame)
        return F.when((F.count(name).over(frame) >= n) & (sd > 0), value / sd)

    rows = rows.withColumns({"move_z": out_of("move", W.before(60), 60, False), "imb_z": out_of("imb", long, 120, True), "dev_z": out_of("dev", long, 120, False), "usual": F.avg("traded").over(long), "top": F.max("close").over(W.last(10)), "low_": F.min("close").over(W.last(10)), "high6": F.max("high").over(W.before(6)), "low6": F.min("low").over(W.before(6))})
    lead = rows.where(c("symbol") == leader).select("bar", c("move").alias("lead_move"), c("move_z").alias("lead_z"))
    rows = rows.join(lead, "bar", "left")
    for name, share in (("doi_low", 0.1), ("doi_high", 0.9)):
        rows = Q.trailing_quantile(rows, "doi", 5, share).withColumnRenamed("cut", name)
    day = Window.partitionBy("symbol", F.to_date("bar"))
    early = F.hour("bar").between(8, 9)
    rows = rows.withColumns({"open_top": F.max(F.when(early, c("high"))).over(day), "open_low": F.min(F.when(early, c("low"))).over(day), "rate": F.lag((2 * c("buy") - c("volume")) / F.nullif(c("volume"), F.lit(0.0)), 8).over(w)})
    jump = c("close") - c("old")
    extreme = ((c("imb") > 0) & (c("close") >= c("top"))) | ((c("imb") < 0) & (c("close") <= c("low_")))
    beyond = F.when(c("close") > c("open_top"), 1.0).when(c("close") < c("open_low"), -1.0)
    broken = F.when(c("close") > c("high6"), 1.0).when(c("close") < c("low6"), -1.0)
    follows = F.signum("lead_move") * c("move") < F.signum("lead_move") * c("lead_move")
    return rows.withColumns(
        {
            "lead": way(c("lead_move"), (c("symbol") != leader) & (F.abs("lead_z") >= bound) & follows),
            "flow": way(c("imb"), F.abs("imb_z") >= bound),
            "spent": way(-c("imb"), (F.abs("imb_z") >= bound) & extreme & (c("traded") >= 1.2 * c("usual"))),
            "flush": way(-jump, (c("doi") <= c("doi_low")) & (F.abs(jump) >= c("atr"))),
            "build": way(broken, (c("doi") >= c("doi_high")) & broken.isNotNull()),
            "fade": way(-c("dev"), F.abs("dev_z") >= bound),
            "open": way(beyond, F.hour("bar").between(10, 15) & beyond.isNotNull()),
            "settle": way(-c("rate"), (F.hour("bar") % 8 == 0) & (F.abs("rate") >= 0.5)),
        }
    )


FAMILIES = ("lead", "flow", "spent", "flush", "build", "fade", "open", "settle")


def triggers(sides: DataFrame, pause: int) -> DataFrame:
    """symbol, family, bar and side where a family's side newly is not 0, `pause` bars at least after the family's last one kept."""
    w = W.order()
    numbered = sides.withColumn("n_", F.row_number().over(w))
    new = F.array(*(F.struct(F.lit(f).alias("family"), F.when(F.coalesce(F.lag(f).over(w), F.lit(0)) != c(f), c(f)).otherwise(0).alias("side")) for f in FAMILIES))
    rows = numbered.withColumn("all_", new).select("symbol", "bar", "n_", F.explode(F.filter("all_", lambda x: x["side"] != 0)).alias("x"))
    events = rows.select(F.concat_ws("|", "symbol", "x.family").alias("symbol"), c("n_").cast("double").alias("at"), c("n_").cast("long").alias("id"), F.struct("symbol", "x.family", "bar", "x.side").alias("e"))
    return cooled(events, float(pause)).select("e.*")
