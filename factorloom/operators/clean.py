"""Cross-sectional cleaning, date by date: winsorize, neutralize, standardize, in this order.

``keys`` name what else a cross-section is one of, as the factor's name where factors stand in rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.expressions import average_rank, by_date, clip, safe_div


def winsorize(panel: DataFrame, x: str, low: float = 0.025, high: float = 0.975, out: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Values beyond the date's quantiles are pulled back to them."""
    bounds = F.percentile(x, [low, high]).over(by_date(*keys))
    return panel.withColumn("__bounds", bounds).withColumn(out or x, clip(F.col(x), F.col("__bounds")[0], F.col("__bounds")[1])).drop("__bounds")


def _demeaned(x: Column, *keys: str) -> Column:
    return x - F.avg(x).over(Window.partitionBy("trade_date", *keys))


def neutralize(panel: DataFrame, x: str, how: tuple[str, ...] = ("industry",), log_size: bool = False, out: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Residual of the date's least squares on industry dummies and, if named, size.

    By Frisch and Waugh: within industries both value and size lose their means, then the value loses
    its slope on size. Rows without an industry, or without a size where it is used, give null.
    """
    within = [k for k in how if k != "market_cap"]
    sized = "market_cap" in how
    size = F.log("market_cap") if log_size else F.col("market_cap").cast("double")
    usable = F.col(x).isNotNull() & (size.isNotNull() if sized else F.lit(True))
    for k in within:
        usable = usable & F.col(k).isNotNull()
    panel = panel.withColumn("__x", F.when(usable, F.col(x)))
    panel = panel.withColumn("__x", _demeaned(F.col("__x"), *keys, *within))
    if sized:
        panel = panel.withColumn("__z", F.when(usable, size)).withColumn("__z", _demeaned(F.col("__z"), *keys, *within))
        slope = safe_div(F.sum(F.col("__x") * F.col("__z")).over(by_date(*keys)), F.sum(F.col("__z") * F.col("__z")).over(by_date(*keys)))
        panel = panel.withColumn("__x", F.col("__x") - F.coalesce(slope, F.lit(0.0)) * F.col("__z")).drop("__z")
    return panel.withColumn(out or x, F.col("__x")).drop("__x")


def standardize(panel: DataFrame, x: str, out: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Z-scores of the date with the sample deviation; null where all values are equal."""
    score = safe_div(F.col(x) - F.avg(x).over(by_date(*keys)), F.stddev_samp(x).over(by_date(*keys)))
    return panel.withColumn(out or x, score)


def clean(panel: DataFrame, x: str, how: tuple[str, ...] | None = ("industry",), low: float = 0.025, high: float = 0.975, out: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """The three steps; ``how`` None leaves out the second."""
    out = out or x
    panel = winsorize(panel, x, low, high, out, keys)
    panel = neutralize(panel, out, how, keys=keys) if how else panel
    return standardize(panel, out, keys=keys)


def rank_transform(panel: DataFrame, x: str, out: str) -> DataFrame:
    """Average ranks of the date in place of values."""
    return panel.withColumn(out, average_rank(F.col(x), "trade_date"))
