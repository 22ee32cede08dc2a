"""Where excess comes from: allocation, selection and interaction by group, date by date, then at any level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PARTS = ("allocation", "selection", "interaction")


def effects(held: DataFrame, market: DataFrame, group: str, *more: str) -> DataFrame:
    """trade_date, ``group``, ``more``, allocation, selection, interaction.

    ``held`` and ``market`` have trade_date, code, ``group``, fwd; both are held at equal weights, and held names are among the
    market's. Over the groups of a date the parts add up to the return of what is held less the market's. Names without
    a return are in neither. ``more`` are columns that the group determines.
    """
    date = Window.partitionBy("trade_date")
    kept = market.where(F.col("fwd").isNotNull() & F.col(group).isNotNull())
    own = held.where(F.col("fwd").isNotNull() & F.col(group).isNotNull()).groupBy("trade_date", group).agg(F.count("*").alias("n_own"), F.sum("fwd").alias("r_own"))
    own = own.withColumn("w_own", F.col("n_own") / F.sum("n_own").over(date))
    all_ = kept.groupBy("trade_date", group, *more).agg(F.count("*").alias("n_all"), F.sum("fwd").alias("r_all"))
    all_ = all_.withColumns({"w_all": F.col("n_all") / F.sum("n_all").over(date), "whole": F.sum("r_all").over(date) / F.sum("n_all").over(date)})
    joined = all_.join(own, ["trade_date", group], "left").join(own.select("trade_date").distinct(), "trade_date", "left_semi")
    w_own, bench = F.coalesce("w_own", F.lit(0.0)), F.col("r_all") / F.col("n_all")
    ret = F.coalesce(F.col("r_own") / F.col("n_own"), bench)  # a group without holdings selects nothing
    return joined.select(
        "trade_date", group, *more,
        ((w_own - F.col("w_all")) * (bench - F.col("whole"))).alias("allocation"),
        (F.col("w_all") * (ret - bench)).alias("selection"),
        ((w_own - F.col("w_all")) * (ret - bench)).alias("interaction"),
    )


def levels(parts: DataFrame, *dimensions: str) -> DataFrame:
    """``dimensions``, level, the parts and their sum, at every level from all dimensions down to none, in one pass.

    A level leaves out the last dimensions; its number tells how many are left.
    """
    sets = [[F.col(d) for d in dimensions[:k]] for k in range(len(dimensions), -1, -1)]
    left = sum(((1 - F.grouping(d)) for d in dimensions), F.lit(0))
    total = F.sum(sum((F.col(p) for p in PARTS[1:]), F.col(PARTS[0])))
    return parts.groupingSets(sets, *dimensions).agg(left.cast("int").alias("level"), *[F.sum(p).alias(p) for p in PARTS], total.alias("excess"))
