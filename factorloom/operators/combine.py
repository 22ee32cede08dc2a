"""From factors to holdings: composites, selection and weights, date by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.expressions import by_date, percent_rank, quantile_group, safe_div


def ranks(values: DataFrame, *names: str) -> DataFrame:
    """Adds ``<name>_rank``: ascending average rank over the number of names of the date."""
    return values.withColumns({f"{n}_rank": percent_rank(F.col(n), "trade_date") for n in names})


def composite(values: DataFrame, weights: dict[str, Column | float], out: str = "score") -> DataFrame:
    """Weighted mean of rank columns; null if one is null or the weights add up to nothing."""
    total = sum((w if isinstance(w, Column) else F.lit(float(w)) for w in weights.values()), F.lit(0.0))
    parts = sum((F.col(n) * (w if isinstance(w, Column) else F.lit(float(w))) for n, w in weights.items()), F.lit(0.0))
    return values.withColumn(out, safe_div(parts, total))


def dynamic_weights(rolled: DataFrame, a: str, b: str) -> DataFrame:
    """Weights by rolling ICs, none below 0; one half each where both are not positive."""
    up = lambda x: F.when(F.col(x).isNotNull(), F.greatest(F.col(x), F.lit(0.0)))
    share = lambda x: F.when((up(a) + up(b)) == 0, 0.5).otherwise(safe_div(up(x), up(a) + up(b)))
    return rolled.withColumns({f"{a}_weight": share(a), f"{b}_weight": share(b)})


def universe(panel: DataFrame, min_days: int = 60) -> DataFrame:
    """Not under special treatment, listed long enough, not suspended."""
    return panel.where(~F.col("is_st") & (F.col("list_days") >= min_days) & ~F.col("is_suspend"))


def size_floor(panel: DataFrame, q: float = 0.2) -> DataFrame:
    """Strictly above the date's size quantile."""
    return panel.withColumn("__floor", F.percentile("market_cap", q).over(by_date())).where("market_cap > __floor").drop("__floor")


def top_n(values: DataFrame, n: int, *strata: str, score: str = "score") -> DataFrame:
    """The best ``n`` of each date, or of each stratum of it; ties go to the smaller code."""
    place = F.row_number().over(Window.partitionBy("trade_date", *strata).orderBy(F.desc_nulls_last(score), "code"))
    return values.where(F.col(score).isNotNull()).withColumn("place", place).where(F.col("place") <= n)


def select_by_size(values: DataFrame, n: int, groups: int = 3, score: str = "score") -> DataFrame:
    """``n`` of each size group, so that the holdings don't lean to one size."""
    return top_n(values.withColumn("size_group", quantile_group(F.col("market_cap"), groups, "trade_date")).where("size_group is not null"), n, "size_group", score=score)


def with_inertia(values: DataFrame, held: DataFrame, bonus: float, score: str = "score") -> DataFrame:
    """Names that were held at the date's previous rebalance get a bonus."""
    was = held.select("trade_date", "code").withColumn("__held", F.lit(True))
    return values.join(was, ["trade_date", "code"], "left").withColumn(score, F.col(score) + F.when(F.col("__held"), bonus).otherwise(0.0)).drop("__held")


def with_penalty(values: DataFrame, held: DataFrame, weight: float, score: str = "score") -> DataFrame:
    """Score less ``weight`` times the expected turnover: 1 for a name not held, else 0."""
    return with_inertia(values.withColumn(score, F.col(score) - weight), held, weight, score)


def banded(values: DataFrame, n: int, band: int, score: str = "score") -> DataFrame:
    """Names enter among the best ``n`` and stay until they leave the best ``n + band``.

    A name is held if it last entered no earlier than it last left, so no fold over dates is needed.
    """
    ranked = values.withColumn("place", F.when(F.col(score).isNotNull(), F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc_nulls_last(score), "code"))))
    past = Window.partitionBy("code").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    entered = F.max(F.when(F.col("place") <= n, F.col("trade_date"))).over(past)
    left = F.max(F.when(F.col("place").isNull() | (F.col("place") > n + band), F.col("trade_date"))).over(past)
    return ranked.withColumn("__held", F.coalesce(entered > left, entered.isNotNull())).where("__held").drop("__held")


def weigh(picked: DataFrame, how: str, x: str = "score") -> DataFrame:
    """Adds ``weight``, adding up to 1 on each date: equal, cap, factor (shifted to be positive), inverse_vol."""
    raw = {
        "equal": F.lit(1.0),
        "cap": F.col("market_cap"),
        "factor": F.col(x) - F.min(x).over(by_date()) + 1.0,
        "inverse_vol": safe_div(F.lit(1.0), F.abs(F.col(x))),
    }[how]
    rows = picked.withColumn("__raw", raw)
    return rows.withColumn("weight", safe_div(F.col("__raw"), F.sum("__raw").over(by_date()))).drop("__raw")
