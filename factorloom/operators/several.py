"""Several strategies at once: the strategy is a key through selection, weights, returns, allocation and trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.expressions import safe_div
from factorloom.operators.combine import top_n


def strategy_weights(scores: DataFrame, n: int) -> DataFrame:
    """trade_date, strategy, code, fwd, weight: equal weights of each strategy's best ``n`` by ``score``."""
    held = top_n(scores, n, "strategy")
    return held.select("trade_date", "strategy", "code", "fwd", (F.lit(1.0) / F.count("*").over(Window.partitionBy("trade_date", "strategy"))).alias("weight"))


def strategy_gross(weights: DataFrame) -> DataFrame:
    return weights.groupBy("trade_date", "strategy").agg(F.sum(F.col("weight") * F.coalesce("fwd", F.lit(0.0))).alias("gross"))


def risk_allocation(gross: DataFrame, rows: int = 12) -> DataFrame:
    """trade_date, strategy, share: in proportion to the inverse deviation of the last ``rows`` returns known on the date.

    What a date's weights earn is known on the next one. Shares are equal on dates where a strategy's deviation is not yet known.
    """
    past = Window.partitionBy("strategy").orderBy("trade_date").rowsBetween(-rows, -1)
    known = gross.withColumn("inverse", F.when(F.count("gross").over(past) == rows, safe_div(F.lit(1.0), F.stddev_samp("gross").over(past))))
    date = Window.partitionBy("trade_date")
    all_known = F.count("inverse").over(date) == F.count("*").over(date)
    share = F.when(all_known, safe_div(F.col("inverse"), F.sum("inverse").over(date))).otherwise(1.0 / F.count("*").over(date))
    return known.select("trade_date", "strategy", share.alias("share"))


def combined(weights: DataFrame, shares: DataFrame) -> DataFrame:
    """trade_date, strategy, code, weight: parts of the whole; those of a name add up to what is held of it."""
    return weights.join(shares, ["trade_date", "strategy"]).select("trade_date", "strategy", "code", (F.col("weight") * F.col("share")).alias("weight"))


def netting(parts: DataFrame, calendar: DataFrame) -> DataFrame:
    """trade_date, apart, net: what strategies would trade each for itself, and what is left when they trade together; without the traces of sums of nothing.

    ``calendar`` has trade_date and next_date; the first date is all bought.
    """
    left = parts.join(calendar, "trade_date").where("next_date is not null").select(F.col("next_date").alias("trade_date"), "strategy", "code", (-F.col("weight")).alias("weight"))
    changes = parts.unionByName(left).groupBy("trade_date", "strategy", "code").agg(F.sum("weight").alias("d"))
    dates = parts.select("trade_date").distinct()
    by_name = changes.groupBy("trade_date", "code").agg(F.sum(F.abs("d")).alias("apart"), F.abs(F.sum("d")).alias("net"))
    trace = lambda c: (F.round(F.sum(c), 12) + 0.0).alias(c)
    return by_name.groupBy("trade_date").agg(trace("apart"), trace("net")).join(dates, "trade_date", "left_semi")
