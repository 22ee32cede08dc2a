"""Rebalancing backtests. Weights formed on a date earn the return to the next one.

Where costs are proportional the value is a running product. A minimum fee and stops depend on the
path; they are one fold over a strategy's sorted dates, as a column expression in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.expressions import safe_div
from factorloom.operators.combine import top_n, weigh
from factorloom.sources.scratch import written


@dataclass(frozen=True)
class Costs:
    """Rates on the traded value; commission has a minimum and is charged on ``sides`` sides."""

    commission: float = 0.0003
    minimum: float = 5.0
    slippage: float = 0.001
    tax: float = 0.001
    sides: int = 2


@dataclass(frozen=True)
class BacktestConfig:
    """Dates are inclusive; ``rebalance_freq`` is week, biweekly, month or quarter."""

    start_date: str | None = None
    end_date: str | None = None
    initial_capital: float = 10_000_000.0
    rebalance_freq: str = "month"
    max_holding: int = 50
    costs: Costs = Costs()


class Strategy:
    """What to hold on a date: ``signals`` scores names, ``weights`` turns scores into weights."""

    def signals(self, panel: DataFrame) -> DataFrame:
        raise NotImplementedError

    def weights(self, signals: DataFrame, config: BacktestConfig) -> DataFrame:
        return weigh(top_n(signals, config.max_holding), "equal").select("trade_date", "code", "weight")


def trade_cost(value: Column, is_buy: Column, costs: Costs = Costs()) -> Column:
    """Of one trade: commission with its minimum, slippage, and tax on sales."""
    v = F.abs(value)
    return F.greatest(v * costs.commission, F.lit(costs.minimum)) * costs.sides + v * costs.slippage + F.when(is_buy, 0.0).otherwise(v * costs.tax)


def rebalance_dates(dates: DataFrame, freq: str = "month") -> DataFrame:
    """The last trading date of each week, 14 days, month or quarter."""
    unit = F.floor(F.datediff("trade_date", F.lit("1970-01-05").cast("date")) / 14) if freq == "biweekly" else F.trunc("trade_date", freq)
    return dates.select("trade_date").distinct().groupBy(unit.alias("__unit")).agg(F.max("trade_date").alias("trade_date")).select("trade_date")


def period_returns(weights: DataFrame, labels: DataFrame) -> DataFrame:
    """trade_date, gross: what the weights of the date earn until the next; a missing return earns 0."""
    joined = weights.join(labels.select("trade_date", "code", "fwd"), ["trade_date", "code"], "left")
    return joined.groupBy("trade_date").agg(F.sum(F.col("weight") * F.coalesce("fwd", F.lit(0.0))).alias("gross"))


def trades(weights: DataFrame, labels: DataFrame, calendar: DataFrame) -> DataFrame:
    """trade_date, code, change: target weight less the weight that the last target has drifted to.

    ``calendar`` has trade_date and next_date. Names without a new target are sold.
    """
    grown = weights.join(labels.select("trade_date", "code", "fwd"), ["trade_date", "code"], "left").withColumn("__g", F.col("weight") * (1 + F.coalesce("fwd", F.lit(0.0))))
    drift = grown.withColumn("drifted", safe_div(F.col("__g"), F.sum("__g").over(Window.partitionBy("trade_date"))))
    drift = drift.join(calendar, "trade_date").where("next_date is not null").select(F.col("next_date").alias("trade_date"), "code", "drifted")
    drift = drift.join(weights.select("trade_date").distinct(), "trade_date", "left_semi")
    both = weights.select("trade_date", "code", "weight").join(drift, ["trade_date", "code"], "full_outer")
    change = F.coalesce("weight", F.lit(0.0)) - F.coalesce("drifted", F.lit(0.0))
    return both.select("trade_date", "code", change.alias("change"))


def turnover(traded: DataFrame) -> DataFrame:
    """One-way: half of the absolute changes."""
    return traded.groupBy("trade_date").agg((0.5 * F.sum(F.abs("change"))).alias("turnover"))


def nav_proportional(gross: DataFrame, traded: DataFrame, rate: float) -> DataFrame:
    """trade_date, cost, net, nav: costs are ``rate`` times the absolute changes."""
    cost = traded.groupBy("trade_date").agg((F.sum(F.abs("change")) * rate).alias("cost"))
    net = gross.join(cost, "trade_date").withColumn("net", (1 - F.col("cost")) * (1 + F.col("gross")) - 1)
    return net.select("trade_date", "cost", "net", F.product(1 + F.col("net")).over(Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)).alias("nav"))


def nav_fold(gross: DataFrame, traded: DataFrame, capital: float, costs: Costs = Costs(), keys: tuple[str, ...] = ()) -> DataFrame:
    """Final value and total cost with minimum fees, for each strategy in ``keys``."""
    by = [*keys, "trade_date"]
    # trades in order of code, so that sums are the same in any run
    steps = traded.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "change"))), lambda t: t["change"]).alias("changes"))
    days = gross.join(steps, by).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("trade_date", "gross", "changes"))).alias("days"))

    def step(state: Column, day: Column) -> Column:
        def fee(total: Column, change: Column) -> Column:
            return total + F.when(change == 0, 0.0).otherwise(trade_cost(change * state["value"], change > 0, costs))

        cost = F.aggregate(day["changes"], F.lit(0.0), fee)
        return F.struct(((state["value"] - cost) * (1 + day["gross"])).alias("value"), (state["cost"] + cost).alias("cost"))

    start = F.struct(F.lit(float(capital)).alias("value"), F.lit(0.0).alias("cost"))
    return days.select(*keys, F.aggregate("days", start, step).alias("s")).select(*keys, "s.value", "s.cost")


def stopped_nav(returns: DataFrame, limit: float = 0.15, position: float = 0.5) -> DataFrame:
    """Final value and peak when drawdowns beyond ``limit`` cut the position for the next step."""
    days = returns.agg(F.array_sort(F.collect_list(F.struct("trade_date", "ret"))).alias("days"))

    def step(state: Column, day: Column) -> Column:
        held = F.when(state["nav"] / state["peak"] - 1 < -limit, position).otherwise(1.0)
        nav = state["nav"] * (1 + held * day["ret"])
        return F.struct(nav.alias("nav"), F.greatest(state["peak"], nav).alias("peak"), (state["cut"] + (held < 1).cast("int")).alias("cut"))

    start = F.struct(F.lit(1.0).alias("nav"), F.lit(1.0).alias("peak"), F.lit(0).alias("cut"))
    return days.select(F.aggregate("days", start, step).alias("s")).select("s.nav", "s.peak", F.col("s.cut").alias("cut_steps"))


def stop_losses(holdings: DataFrame, limit: float = 0.10) -> DataFrame:
    """First date on which price over cost, less 1, is below -``limit``; holdings have cost and close."""
    breach = F.when(F.col("close") / F.col("cost") - 1 < -limit, F.col("trade_date"))
    return holdings.groupBy("code", "period").agg(F.min(breach).alias("stop_date"))


def vol_target(vol: Column, threshold: float, base: float = 1.0) -> Column:
    """The position falls in proportion when volatility is above the threshold."""
    return F.when(vol > threshold, base * threshold / vol).otherwise(base)


def backtest(strategy: Strategy, panel: DataFrame, prices: DataFrame, config: BacktestConfig) -> tuple[DataFrame, DataFrame]:
    """(nav by day, trades): a strategy on monthly signals, held over daily prices.

    ``panel`` has a row for each month and code, dated by the month's first day and known at its end; the rest is ``hold``'s.
    """
    return hold(written(strategy.weights(strategy.signals(panel), config), "weights"), prices, config)


def hold(weights: DataFrame, prices: DataFrame, config: BacktestConfig) -> tuple[DataFrame, DataFrame]:
    """(nav by day, trades) of monthly weights, which are read in several branches and so should be a written table.

    ``prices`` is trade_date, code, close and dense; it needs no other names than those of the weights. On a rebalancing day, the last of its unit, the
    weights of the last month that has ended are bought at the day's close. In between they drift. Costs are
    rates on the traded share of the value, so the value is a running product; minimum fees are
    ``nav_fold``'s. nav has trade_date, nav, drawdown; trades have trade_date, code, change, cost.
    """
    span = prices.where(F.col("trade_date") >= config.start_date) if config.start_date else prices
    span = span.where(F.col("trade_date") <= config.end_date) if config.end_date else span

    # calendars: a row for each day, month or rebalancing, so windows over all of them are small
    every = Window.orderBy("trade_date")
    days = span.select("trade_date").distinct()
    ends = days.groupBy(F.trunc("trade_date", "MM").alias("month")).agg(F.max("trade_date").alias("trade_date"))
    turns = rebalance_dates(days, config.rebalance_freq).withColumn("turn", F.lit(True))
    known = F.last("month", ignorenulls=True).over(every.rowsBetween(Window.unboundedPreceding, 0))
    before = F.last(F.when(F.col("turn"), F.col("trade_date")), ignorenulls=True).over(every.rowsBetween(Window.unboundedPreceding, -1))
    marked = days.join(turns, "trade_date", "left").join(ends, "trade_date", "left")
    marked = marked.select("trade_date", F.coalesce("turn", F.lit(False)).alias("turn"), known.alias("month"), before.alias("bought"))

    at_turn = marked.where("turn").select(F.col("trade_date").alias("bought"), "month")
    held = at_turn.join(weights.withColumnRenamed("trade_date", "month"), "month").select("bought", "code", "weight")
    held = held.join(span.select(F.col("trade_date").alias("bought"), "code", F.col("close").alias("cost")), ["bought", "code"], "left")
    path = marked.where("bought is not null").select("trade_date", "bought", "turn").join(held, "bought").join(span.select("trade_date", "code", "close"), ["trade_date", "code"], "left")
    path = path.withColumn("value", F.col("weight") * F.coalesce(safe_div(F.col("close"), F.col("cost")), F.lit(1.0)))
    growth = path.groupBy("bought", "trade_date", "turn").agg(F.sum("value").alias("growth"))

    drifted = path.where("turn").select("trade_date", "code", safe_div(F.col("value"), F.sum("value").over(Window.partitionBy("trade_date"))).alias("drifted"))
    both = held.select(F.col("bought").alias("trade_date"), "code", "weight").join(drifted, ["trade_date", "code"], "full_outer")
    rates = config.costs
    change = F.coalesce("weight", F.lit(0.0)) - F.coalesce("drifted", F.lit(0.0))
    traded = both.select("trade_date", "code", change.alias("change"))
    rate = rates.commission * rates.sides + rates.slippage + F.when(F.col("change") < 0, rates.tax).otherwise(0.0)
    traded = traded.withColumn("cost", F.abs("change") * rate)

    kept = traded.groupBy("trade_date").agg((1 - F.sum("cost")).alias("kept"))
    ended = growth.where("turn").select("trade_date", F.col("growth").alias("ended"))
    base = kept.join(ended, "trade_date", "left").withColumn("base", F.product(F.col("kept") * F.coalesce("ended", F.lit(1.0))).over(every.rowsBetween(Window.unboundedPreceding, 0)))
    nav = growth.join(base.select(F.col("trade_date").alias("bought"), "base"), "bought").select("trade_date", (F.lit(config.initial_capital) * F.col("base") * F.col("growth")).alias("nav"))
    peak = F.max("nav").over(every.rowsBetween(Window.unboundedPreceding, 0))
    return nav.withColumn("drawdown", (F.col("nav") - peak) / peak), traded
