"""How well a factor tells the next return: rank information coefficients, layers, scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.expressions import average_rank, by_code, centred_rank, correlation, quantile_group, rank_correlation, safe_div

MIN_NAMES = 20


def forward_return(panel: DataFrame, horizon: int = 1, out: str = "fwd") -> DataFrame:
    """The label: the return from this row to ``horizon`` rows on. The panel must be dense."""
    return panel.withColumn(out, safe_div(F.lead("close", horizon).over(by_code()), F.col("close")) - 1)


def asof_return(prices: DataFrame, periods: DataFrame) -> DataFrame:
    """period, code, ret: first close at or after each period's start to the last at or before its end.

    ``prices`` is trade_date, code, close; ``periods`` is start, end, which do not overlap. Only the
    calendar meets the periods by range; prices then find their period by date, and both ends of all
    periods are found in one pass. Fewer than two prices give no row.
    """
    known = prices.where("close is not null")
    dates = known.select("trade_date").distinct().join(F.broadcast(periods), F.col("trade_date").between(F.col("start"), F.col("end")))
    inside = known.join(dates.select("trade_date", "start"), "trade_date")
    ends = inside.groupBy("start", "code").agg(F.min_by("close", "trade_date").alias("first"), F.max_by("close", "trade_date").alias("last"), F.count("*").alias("n"))
    return ends.where("n >= 2").select("start", "code", (safe_div(F.col("last"), F.col("first")) - 1).alias("ret"))


def rank_ic(values: DataFrame, factor: str, label: str = "fwd", keys: tuple[str, ...] = ("trade_date",), min_names: int = MIN_NAMES) -> DataFrame:
    """``keys``, ic, n: Spearman's correlation in each group of more than ``min_names`` pairs.

    It comes from sums of whole numbers, rounded to twelve digits, so it is the same in any run.
    """
    pairs = values.where(F.col(factor).isNotNull() & F.col(label).isNotNull())
    ranked = pairs.withColumns({"__f": centred_rank(F.col(factor), *keys), "__r": centred_rank(F.col(label), *keys)})
    return ranked.groupBy(*keys).agg((F.round(rank_correlation(F.col("__f"), F.col("__r")), 12) + 0.0).alias("ic"), F.count("*").alias("n")).where(F.col("n") > min_names)


def ic_stats(series: DataFrame, *keys: str) -> DataFrame:
    """Mean, sample deviation, their ratio and the share of positive months."""
    mean, std = F.avg("ic"), F.stddev_samp("ic")
    rows = series.where("ic is not null")
    return (rows.groupBy(*keys) if keys else rows).agg(
        F.count("*").alias("months"), mean.alias("ic_mean"), std.alias("ic_std"), safe_div(mean, std).alias("icir"), F.avg(F.when(F.col("ic") > 0, 1.0).otherwise(0.0)).alias("win_rate")
    )


def layers(values: DataFrame, factor: str, groups: int = 5, keys: tuple[str, ...] = ("trade_date",)) -> DataFrame:
    """Adds ``group``, 1 to ``groups`` by the factor, in each cross-section."""
    return values.withColumn("group", quantile_group(F.col(factor), groups, *keys))


def layer_returns(values: DataFrame, factor: str, groups: int = 5, label: str = "fwd", keys: tuple[str, ...] = ("trade_date",)) -> DataFrame:
    """Mean label of each group."""
    cut = layers(values.where(F.col(factor).isNotNull() & F.col(label).isNotNull()), factor, groups, keys)
    return cut.where("group is not null").groupBy(*keys, "group").agg(F.avg(label).alias("ret"), F.count("*").alias("n"))


def long_short(layered: DataFrame, groups: int = 5, keys: tuple[str, ...] = ("trade_date",)) -> DataFrame:
    """Top group's return less the bottom group's."""
    pick = lambda g: F.max(F.when(F.col("group") == g, F.col("ret")))
    return layered.groupBy(*keys).agg((pick(groups) - pick(1)).alias("ret"))


def monotonicity(layered: DataFrame, groups: int = 5) -> DataFrame:
    """One row: is the mean return strictly monotone over the groups, and its rank correlation."""
    means = layered.groupBy("group").agg(F.avg("ret").alias("mean"))
    ordered = means.withColumn("step", F.col("mean") - F.lag("mean").over(Window.orderBy("group")))
    ranked = ordered.withColumn("rank", F.rank().over(Window.orderBy("mean")).cast("double"))
    up, down = F.sum((F.col("step") > 0).cast("int")), F.sum((F.col("step") < 0).cast("int"))
    rho = correlation(F.col("group").cast("double"), F.col("rank"))
    return ranked.agg(((up == groups - 1) | (down == groups - 1)).alias("strict"), rho.alias("rho"), (F.abs(rho) >= 0.8).alias("approximate"))


def streaks(series: DataFrame, *keys: str) -> DataFrame:
    """Runs of negative ICs: first and last date, length, and the sum of the ICs in the run."""
    marked = series.where("ic is not null").withColumn("neg", F.col("ic") < 0)
    island = F.row_number().over(Window.partitionBy(*keys).orderBy("trade_date")) - F.row_number().over(Window.partitionBy(*keys, "neg").orderBy("trade_date"))
    runs = marked.withColumn("island", island).where("neg").groupBy(*keys, "island")
    return runs.agg(F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"), F.count("*").alias("length"), F.sum("ic").alias("total")).drop("island")


def signs(series: DataFrame, *keys: str) -> DataFrame:
    """``keys``, sign: -1 where the mean IC is negative, so that a flipped factor is expected to be good."""
    return series.groupBy(*keys).agg(F.when(F.avg("ic") < 0, -1.0).otherwise(1.0).alias("sign"))


def membership_change(members: DataFrame, *keys: str) -> DataFrame:
    """``keys``, turnover: the mean share of a date's names that were not members a month before."""
    before = F.lag("trade_date").over(Window.partitionBy(*keys, "code").orderBy("trade_date"))
    marked = members.select(*keys, "trade_date", F.coalesce(before == F.add_months("trade_date", -1), F.lit(False)).alias("stays"))
    dates = marked.groupBy(*keys, "trade_date").agg(F.avg(F.when(F.col("stays"), 0.0).otherwise(1.0)).alias("new"))
    # a row for each date from here on
    dates = dates.withColumn("first", F.min("trade_date").over(Window.partitionBy(*keys))).where("trade_date > first")
    return dates.groupBy(*keys).agg(F.avg("new").alias("turnover"))


def agreement(series: DataFrame, part: str, *keys: str) -> DataFrame:
    """``keys``, share: of the values of ``part``, the share whose mean IC is positive. Without keys one row, null if there is no value."""
    means = series.groupBy(*keys, part).agg(F.avg("ic").alias("mean")).where("mean is not null")
    return (means.groupBy(*keys) if keys else means).agg(F.avg(F.when(F.round("mean", 9) > 0, 1.0).otherwise(0.0)).alias("share"))


def rolling_ic(series: DataFrame, rows: int = 12) -> DataFrame:
    """Rolling mean over full windows, the expanding mean and deviation, and the alarm two deviations below."""
    w = Window.orderBy("trade_date")
    recent = F.when(F.count("ic").over(w.rowsBetween(1 - rows, 0)) == rows, F.avg("ic").over(w.rowsBetween(1 - rows, 0)))
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    rolled = series.select("trade_date", "ic", recent.alias("rolling_ic"), F.avg("ic").over(past).alias("mean_so_far"), F.stddev_samp("ic").over(past).alias("std_so_far"))
    return rolled.withColumn("alarm", F.coalesce(F.col("rolling_ic") < F.col("mean_so_far") - 2 * F.col("std_so_far"), F.lit(False)))


def switch(rolled: DataFrame, strict: bool = False) -> DataFrame:
    """``on`` unless the last three rolling ICs add up below 0 (``strict``: unless all are below 0)."""
    w = Window.orderBy("trade_date").rowsBetween(-2, 0)
    three = F.count("rolling_ic").over(w) == 3
    off = (F.max("rolling_ic").over(w) < 0) if strict else (F.sum("rolling_ic").over(w) < 0)
    return rolled.select("trade_date", "rolling_ic", (~F.coalesce(three & off, F.lit(False))).alias("on"))


def bucketed(values: DataFrame, x: str, groups: int, out: str) -> DataFrame:
    return values.withColumn(out, quantile_group(F.col(x), groups, "trade_date"))


def moments(x: Column) -> dict[str, Column]:
    """Skewness and excess kurtosis, corrected for bias as the sample estimates are."""
    n = F.count(x).cast("double")
    skew = F.when((n > 2) & (F.stddev_pop(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when((n > 3) & (F.stddev_pop(x) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))
    return {"skew": skew, "kurt": kurt}


def histogram(values: DataFrame, x: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of ``bins`` equal cells; 0 and bins + 1 hold what is outside."""
    return values.where(F.col(x).isNotNull()).groupBy(F.width_bucket(F.col(x), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def density(values: DataFrame, x: str, *keys: str, grid: int = 10, cells: int = 50, width: int = 5) -> DataFrame:
    """``keys``, point, x, density: a Gaussian kernel's, at ``grid`` points a deviation, up to ``width`` deviations from the mean.

    Values are counted in cells of a fiftieth of a deviation first; only cells, which are few, meet the points. The bandwidth is
    1.06 deviations over the fifth root of the count. Keys whose values are all equal have no rows.
    """
    known = values.where(F.col(x).isNotNull())
    stats = known.groupBy(*keys).agg(F.avg(x).alias("__mean"), F.stddev_samp(x).alias("__std"), F.count("*").alias("__n")).where(F.col("__std") > 0)
    c = F.col
    at = F.broadcast(stats) if not keys else stats
    counted = known.join(at, list(keys)) if keys else known.join(at)
    counted = counted.groupBy(*keys, F.floor((c(x) - c("__mean")) / (c("__std") / cells)).alias("__cell"), "__mean", "__std", "__n").agg(F.count("*").alias("__c"))
    counted = counted.withColumn("point", F.explode(F.sequence(F.lit(-grid * width), F.lit(grid * width))))
    h = 1.06 * c("__std") * F.pow(c("__n"), F.lit(-0.2))
    z = (c("point") * c("__std") / grid - (c("__cell") + 0.5) * c("__std") / cells) / h
    summed = counted.groupBy(*keys, "point", "__mean", "__std", "__n").agg(F.sum(c("__c") * F.exp(-z * z / 2)).alias("__s"))
    return summed.select(*keys, "point", (c("__mean") + c("point") * c("__std") / grid).alias("x"), (c("__s") / (c("__n") * h * F.sqrt(2 * F.pi()))).alias("density"))


def points(metric: Column, acceptable: float, excellent: float) -> Column:
    """0 to 10: 6 at the acceptable value, 10 at the excellent one, straight in between and below."""
    slope = F.when(metric >= acceptable, 6 + 4 * (metric - acceptable) / (excellent - acceptable)).otherwise(6 * metric / acceptable)
    return F.when(metric.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(10.0), slope)))


def grade(metric: Column, acceptable: float, excellent: float) -> Column:
    return F.when(metric > excellent, "excellent").when(metric > acceptable, "pass").otherwise("fail")
