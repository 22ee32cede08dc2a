"""Column expressions that every operator shares. All are built in, so plans stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

DATE, CODE = "trade_date", "code"


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or either is null or not finite."""
    a, b = (F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x) for x in (a.cast("double"), b.cast("double")))
    return F.try_divide(a, b)


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    """x pulled back to the bounds; null stays null."""
    low, high = (b if isinstance(b, Column) else F.lit(float(b)) for b in (low, high))
    return F.when(x.isNotNull(), F.greatest(low, F.least(high, x)))


def by_date(*more: str) -> Window:
    return Window.partitionBy(DATE, *more)


def by_code(*more: str) -> Window:
    """A security's history; later rows are never in a frame that ends at the current row."""
    return Window.partitionBy(CODE, *more).orderBy(DATE)


def trailing(rows: int) -> Window:
    return by_code().rowsBetween(1 - rows, 0)


def full(value: Column, counted: Column, rows: int) -> Column:
    """A rolling value where all ``rows`` of the frame have one; else null."""
    return F.when(F.count(counted).over(trailing(rows)) == rows, value)


def rolling_mean(x: Column, rows: int) -> Column:
    return full(F.avg(x).over(trailing(rows)), x, rows)


def rolling_std(x: Column, rows: int) -> Column:
    return full(F.stddev_samp(x).over(trailing(rows)), x, rows)


def change(x: Column, rows: int = 1) -> Column:
    """x over its value ``rows`` rows ago, less one."""
    return safe_div(x, F.lag(x, rows).over(by_code())) - 1


def average_rank(x: Column, *keys: str) -> Column:
    """Ascending rank within ``keys``; ties share the mean of their ranks; null stays null."""
    some = x.isNotNull().alias("some")
    rank = F.rank().over(Window.partitionBy(*keys, some).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, x)) - 1) / 2.0
    return F.when(x.isNotNull(), rank)


def percent_rank(x: Column, *keys: str) -> Column:
    """The average rank over the number of values."""
    return safe_div(average_rank(x, *keys), F.count(x).over(Window.partitionBy(*keys)))


def centred_rank(x: Column, *keys: str) -> Column:
    """Twice the ascending average rank within ``keys``, less its mean: a whole number, and these add up to 0. No x may be null."""
    ordered = Window.partitionBy(*keys).orderBy(x)
    peers = F.count(F.lit(1)).over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
    return 2 * F.rank().over(ordered) + peers - F.count(F.lit(1)).over(Window.partitionBy(*keys)) - 2


def rank_correlation(x: Column, y: Column) -> Column:
    """Of centred ranks; sums of whole numbers, so the result is the same in any order. Null where either is constant."""
    total = lambda a, b: F.sum((a * b).cast("decimal(20,0)")).cast("double")
    return safe_div(total(x, y), F.sqrt(total(x, x)) * F.sqrt(total(y, y)))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's; null, never an error, where either is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return safe_div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def quantile_group(x: Column, groups: int, *keys: str) -> Column:
    """Equal-frequency groups 1 to ``groups`` with edges closed at the right, so ties stay together.

    Null where x is null, and for all of a cross-section whose edges coincide.
    """
    edges = F.percentile(x, [i / groups for i in range(groups + 1)]).over(Window.partitionBy(*keys))
    above = reduce(lambda a, b: a + b, [(x > edges[i]).cast("int") for i in range(1, groups)]) + 1
    distinct = all_of(*[edges[i] < edges[i + 1] for i in range(groups)])
    return F.when(x.isNotNull() & distinct, above)
