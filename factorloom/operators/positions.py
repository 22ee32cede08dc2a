"""Positions that depend on their path: average cost, stops, re-entry, minimum fees.

A strategy's days are a chain: what is held tomorrow depends on what was sold today. So they are walked in order, each
strategy in one task, as a stream: its state is what it holds, and rows come sorted, so a path of any length takes no
more memory than its names. Strategies are independent and run side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators.backtest import BacktestConfig, Costs, rebalance_dates

#: Trades of less are none.
LEAST_TRADE = 1e-6


@dataclass
class Portfolio:
    """Cash and holdings (code: shares and average cost), with what is told of each day."""

    costs: Costs
    cash: float
    stock_limit: float | None = None
    fund_limit: float | None = None
    held: dict = field(default_factory=dict)
    peak: float = 0.0
    cut: bool = False
    fees: float = 0.0
    stopped: int = 0

    def trade(self, code, value: float, price: float) -> None:
        """Buys for ``value``, or sells where it is negative. Sales keep the average cost."""
        if abs(value) <= LEAST_TRADE:
            return
        v, c = abs(value), self.costs
        fee = max(v * c.commission, c.minimum) * c.sides + v * c.slippage + (v * c.tax if value < 0 else 0.0)
        shares, cost = self.held.get(code, (0.0, 0.0))
        after = shares + value / price
        self.cash -= value + fee
        self.fees += fee
        if value > 0:
            cost = (shares * cost + value) / after
        self.held[code] = (after, cost)

    def day(self, prices: dict, targets: dict) -> float:
        """One day at its closes: rebalancing to the targets, if there are any, else the stops. The value before trades."""
        self.fees, self.stopped = 0.0, 0
        nav = self.cash + sum(shares * prices[c] for c, (shares, _) in sorted(self.held.items()))
        self.peak = max(self.peak, nav)
        below = self.fund_limit is not None and nav / self.peak - 1 < -self.fund_limit
        if targets:
            self.cut = below
            for c in sorted({*self.held, *targets}):
                worth = self.held.get(c, (0.0, 0.0))[0] * prices[c]
                self.trade(c, targets.get(c, 0.0) * nav * (0.5 if below else 1.0) - worth, prices[c])
            self.held = {c: h for c, h in self.held.items() if c in targets}
            return nav
        for c in sorted(self.held):
            shares, cost = self.held[c]
            if self.stock_limit is not None and prices[c] / cost - 1 < -self.stock_limit:
                self.trade(c, -shares * prices[c], prices[c])
                del self.held[c]
                self.stopped += 1
        if below and not self.cut:
            self.cut = True
            for c in sorted(self.held):
                self.trade(c, -self.held[c][0] * prices[c] / 2, prices[c])
        return nav


def path_rows(weights: DataFrame, prices: DataFrame, freq: str = "month") -> DataFrame:
    """trade_date, code, price, weight: a row for each name that may be held on a day; ``weight`` is its target on a day of rebalancing.

    ``weights`` is month, code, weight, known at the month's end; ``prices`` is dense.
    """
    days = prices.select("trade_date").distinct()
    every = Window.orderBy("trade_date")  # a calendar: a row for each day
    ends = rebalance_dates(days, "month").select("trade_date", F.trunc("trade_date", "MM").alias("month"))
    turns = rebalance_dates(days, freq).withColumn("turn", F.lit(True))
    known = F.last("month", ignorenulls=True).over(every.rowsBetween(Window.unboundedPreceding, 0))
    marked = days.join(ends, "trade_date", "left").join(turns, "trade_date", "left").select("trade_date", "turn", known.alias("month"))
    bought = F.last(F.when(F.col("turn"), F.col("trade_date")), ignorenulls=True).over(every.rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("bought", bought)
    named = marked.where("turn").select("trade_date", "month").join(weights, "month").select("trade_date", "code", "weight")
    kept = marked.where("bought is not null").select("trade_date", "bought").join(named.select(F.col("trade_date").alias("bought"), "code"), "bought").select("trade_date", "code", F.lit(None).cast("double").alias("weight"))
    rows = kept.unionByName(named).groupBy("trade_date", "code").agg(F.max("weight").alias("weight"))
    return rows.join(prices.select("trade_date", "code", F.col("close").alias("price")), ["trade_date", "code"]).where("price > 0")


SHAPE = "strategy string, trade_date date, code bigint, nav double, cash double, fees double, names int, stopped int, cut boolean, shares double, cost double, price double"
NAMES = [part.split()[0] for part in SHAPE.split(", ")]


def _walked(config: BacktestConfig):
    """A row for each strategy and day, and on days of rebalancing one for each name held after it."""

    def told(key: tuple, fund: Portfolio, rows: list[tuple]) -> list[tuple]:
        prices, targets = {c: p for c, p, _ in rows}, {c: w for c, _, w in rows if w is not None}
        nav = fund.day(prices, targets)
        out = [(*key, None, nav, fund.cash, fund.fees, len(fund.held), fund.stopped, fund.cut, None, None, None)]
        return out + [(*key, c, None, None, None, None, None, None, s, cost, prices[c]) for c, (s, cost) in sorted(fund.held.items())] if targets else out

    def packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    kinds = {"string": pa.string(), "date": pa.date32(), "bigint": pa.int64(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = pa.schema([(part.split()[0], kinds[part.split()[1]]) for part in SHAPE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fund, rows = None, None, []
        for batch in batches:
            out: list[tuple] = []
            for name, stock, whole, date, code, price, weight in zip(*(batch.column(c).to_pylist() for c in ("strategy", "stock_limit", "fund_limit", "trade_date", "code", "price", "weight")), strict=True):
                if key != (name, date):
                    if rows:
                        out += told(key, fund, rows)
                    if key is None or key[0] != name:
                        fund = Portfolio(config.costs, config.initial_capital, stock, whole)
                    key, rows = (name, date), []
                rows.append((code, price, weight))
            yield packed(out, schema)
        if rows:
            yield packed(told(key, fund, rows), schema)

    return run


def walk(rows: DataFrame, strategies: DataFrame, config: BacktestConfig) -> DataFrame:
    """``SHAPE``: all ``strategies`` (strategy, stock_limit, fund_limit; null for none) along their ``rows``, those of ``path_rows`` with a strategy.

    Rows with a code are what is held after a rebalancing: shares, average cost and price; the others are days: the value
    before trades, cash and fees after them, names held, names stopped, and whether the position is cut to a half.
    A name stopped out is bought again on the next day of rebalancing that targets it. Names without a price can't be held.
    """
    each = rows.join(strategies, "strategy")
    return each.repartition("strategy").sortWithinPartitions("strategy", "trade_date", "code").mapInArrow(_walked(config), SHAPE)
