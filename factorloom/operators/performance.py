"""Ratios, drawdowns and calendar returns of return series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.expressions import safe_div

RISK_FREE = 0.03


def annual_return(ret: Column, periods: int) -> Column:
    """Compounded to a year; null where everything is lost, as with a spread below -1."""
    return F.when(F.product(1 + ret) > 0, F.pow(F.product(1 + ret), F.lit(float(periods)) / F.count(ret)) - 1)


def drawdown_curve(returns: DataFrame, include_initial: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds nav, peak and drawdown (0 or less); ``include_initial`` counts the start as a peak of 1."""
    w = Window.partitionBy(*keys).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    curve = returns.withColumn("nav", F.product(1 + F.col("ret")).over(w))
    peak = F.max("nav").over(w)
    curve = curve.withColumn("peak", F.greatest(peak, F.lit(1.0)) if include_initial else peak)
    return curve.withColumn("drawdown", (F.col("nav") - F.col("peak")) / F.col("peak"))


def metrics(returns: DataFrame, periods: int = 252, rf: float = RISK_FREE, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key: ret is the strategy's, bench_ret the benchmark's."""
    curve = drawdown_curve(returns, keys=keys)
    ret, bench = F.col("ret"), F.col("bench_ret")
    root = F.sqrt(F.lit(float(periods)))
    rows = (curve.groupBy(*keys) if keys else curve).agg(
        F.count("*").alias("n"),
        (F.product(1 + ret) - 1).alias("cumulative"),
        annual_return(ret, periods).alias("annual_return"),
        annual_return(bench, periods).alias("bench_annual"),
        (F.stddev_samp(ret) * root).alias("annual_vol"),
        (F.stddev_samp(F.when(ret < 0, ret)) * root).alias("downside_vol"),
        (F.stddev_samp(F.when(ret > 0, ret)) * root).alias("upside_vol"),
        (safe_div(F.avg(ret - bench), F.stddev_samp(ret - bench)) * root).alias("information_ratio"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg(F.when(ret > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        safe_div(F.avg(F.when(ret > 0, ret)), F.abs(F.avg(F.when(ret < 0, ret)))).alias("profit_loss"),
    )
    return rows.withColumns(
        {
            "excess": F.col("annual_return") - F.col("bench_annual"),
            "sharpe": safe_div(F.col("annual_return") - rf, F.col("annual_vol")),
            "sortino": safe_div(F.col("annual_return") - rf, F.col("downside_vol")),
            "calmar": safe_div(F.col("annual_return"), F.abs("max_drawdown")),
        }
    )


def recovery(curve: DataFrame) -> DataFrame:
    """trough_date, peak_date, recovered_date and days from trough to the old peak; null if never."""
    trough = curve.agg(F.min_by("trade_date", F.struct("drawdown", "trade_date")).alias("trough_date"), F.min_by("peak", F.struct("drawdown", "trade_date")).alias("old_peak"))
    joined = curve.join(F.broadcast(trough))  # one row
    found = joined.agg(
        F.first("trough_date").alias("trough_date"),
        F.max(F.when((F.col("trade_date") <= F.col("trough_date")) & (F.col("drawdown") == 0), F.col("trade_date"))).alias("peak_date"),
        F.min(F.when((F.col("trade_date") > F.col("trough_date")) & (F.col("nav") >= F.col("old_peak")), F.col("trade_date"))).alias("recovered_date"),
    )
    return found.withColumn("days", F.datediff("recovered_date", "trough_date"))


def calendar_returns(returns: DataFrame, unit: str = "year") -> DataFrame:
    """Compounded return of each period."""
    return returns.groupBy(F.trunc("trade_date", unit).alias("period")).agg((F.product(1 + F.col("ret")) - 1).alias("ret"), F.count("*").alias("n"))


def report(rows: DataFrame) -> DataFrame:
    """Labels with formatted figures, for the edge of a program only."""
    pct = lambda c: F.format_string("%.2f%%", F.col(c) * 100)
    num = lambda c: F.format_string("%.2f", F.col(c))
    return rows.select(pct("annual_return").alias("annual_return"), pct("annual_vol").alias("annual_vol"), num("sharpe").alias("sharpe"), num("information_ratio").alias("information_ratio"), pct("max_drawdown").alias("max_drawdown"), num("calmar").alias("calmar"))
