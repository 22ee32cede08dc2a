"""Factors as declarations, and the library of them.

A factor names the panel columns it needs and how many rows it looks back, and gives a column
expression. ``calc_factors`` computes any number of factors in one select over the panel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.expressions import by_code, change, clip, full, rolling_mean, rolling_std, safe_div, trailing
from factorloom.operators.clean import clean

PERIODS = 252


@dataclass(frozen=True)
class Factor:
    """``calc`` gives the column; ``neutralize`` names what the cleaned value is neutral to.

    Where ``in_parts`` is set, ``calc`` takes what makes a column of its own of a rolling value that the factor refers to several times.
    """

    name: str
    dependencies: tuple[str, ...]
    calc: Callable[..., Column]
    max_window: int = 1
    neutralize: tuple[str, ...] | None = ("industry",)
    direction: int = 1
    family: str = ""
    in_parts: bool = False


class Registry:
    """Factors by unique name."""

    def __init__(self) -> None:
        self.factors: dict[str, Factor] = {}

    def add(self, factor: Factor) -> Factor:
        if factor.name in self.factors:
            raise ValueError(f"there is a factor named {factor.name} already")
        self.factors[factor.name] = factor
        return factor

    def __getitem__(self, name: str) -> Factor:
        return self.factors[name]


LIBRARY = Registry()


def _factor(name: str, dependencies: str, calc: Callable[..., Column], window: int = 1, neutralize: tuple[str, ...] | None = ("industry",), direction: int = 1, family: str = "", in_parts: bool = False) -> Factor:
    return LIBRARY.add(Factor(name, tuple(dependencies.split()), calc, window, neutralize, direction, family, in_parts))


c = F.col
BOTH = ("industry", "market_cap")


def daily_return() -> Column:
    return change(c("close"))


def _enhanced_ep() -> Column:
    ratio = F.coalesce(safe_div(c("operating_cash_flow"), F.abs(c("net_profit"))), F.lit(0.0))
    return F.coalesce(safe_div(F.lit(1.0), c("pe_ratio")), F.lit(0.0)) * clip(ratio, -10, 10)


def momentum(rows: int) -> Callable[[], Column]:
    return lambda: change(c("close"), rows)


def volatility(rows: int) -> Callable[[], Column]:
    """Negated, so that a high value is expected to be good."""
    return lambda: -(rolling_std(c("ret"), rows) * F.sqrt(F.lit(float(PERIODS))))


def _whole(x: Column) -> Column:
    return x


def _stability(part: Callable[[Column], Column] = _whole) -> Column:
    return safe_div(F.lit(1.0), part(rolling_std(c("roe"), 12)))


def _amplitude(part: Callable[[Column], Column] = _whole) -> Column:
    w = trailing(20)
    return full(safe_div(part(F.max("high").over(w)), part(F.min("low").over(w))) - 1, c("high"), 20)


def _idio_vol(rows: int) -> Callable[..., Column]:
    """Standard deviation of what the market does not explain of the returns in the window."""

    def calc(part: Callable[[Column], Column] = _whole) -> Column:
        both = c("ret").isNotNull() & c("bench").isNotNull()
        y, x = F.when(both, c("ret")), F.when(both, c("bench"))
        w = trailing(rows)
        n, vy, cov, vx = (part(value.over(w)) for value in (F.count(y), F.var_pop(y), F.covar_pop(y, x), F.var_pop(x)))
        return F.when(n == rows, F.sqrt(F.greatest(F.lit(0.0), (vy - safe_div(cov * cov, vx)) * n / (n - 2))))

    return calc


MAS5 = _factor("mas5", "close", lambda: rolling_mean(c("close"), 5), 5, family="price")
INTRADAY = _factor("intraday", "open close", lambda: safe_div(c("close"), c("open")) - 1, family="price")
EP = _factor("ep", "pe_ratio", lambda: safe_div(F.lit(1.0), c("pe_ratio")), family="value")
BP = _factor("bp", "pb_ratio", lambda: safe_div(F.lit(1.0), c("pb_ratio")), family="value")
SP = _factor("sp", "amount market_cap", lambda: safe_div(c("amount"), c("market_cap")), family="value")
DP = _factor("dp", "dividends market_cap", lambda: safe_div(c("dividends"), c("market_cap")), family="value")
EP_EX = _factor("ep_ex_items", "profit_ex_items amount", lambda: safe_div(c("profit_ex_items"), c("amount")), family="value")
GROSS_MARGIN = _factor("gross_margin", "amount operating_cash_flow", lambda: safe_div(c("amount") - c("operating_cash_flow"), c("amount")), family="quality")
ROE = _factor("roe", "roe", lambda: c("roe"), family="quality")
ROA = _factor("roa", "net_profit amount", lambda: safe_div(c("net_profit"), c("amount")), family="quality")
CASH_QUALITY = _factor("cash_quality", "operating_cash_flow net_profit", lambda: safe_div(c("operating_cash_flow"), c("net_profit")), family="quality")
STABILITY = _factor("earnings_stability", "roe", _stability, 12, family="quality", in_parts=True)
MOMENTUM20 = _factor("momentum20", "close", momentum(20), 21, BOTH, family="momentum")
MOMENTUM60 = _factor("momentum60", "close", momentum(60), 61, BOTH, family="momentum")
MOMENTUM120 = _factor("momentum120", "close", momentum(120), 121, BOTH, family="momentum")
ACCELERATION = _factor("momentum_acceleration", "close", lambda: change(c("close"), 6) - (safe_div(F.lag("close", 6).over(by_code()), F.lag("close", 12).over(by_code())) - 1), 13, BOTH, family="momentum")
ENHANCED_EP = _factor("enhanced_ep", "pe_ratio operating_cash_flow net_profit", _enhanced_ep, family="value")
GAP = _factor("gap", "open close", lambda: safe_div(c("open") - F.lag("close").over(by_code()), F.lag("close").over(by_code())), 2, BOTH, family="price")
VOLATILITY20 = _factor("volatility20", "ret", volatility(20), 21, BOTH, family="risk")
DOWNSIDE_VOL = _factor("downside_vol", "ret", lambda: -F.stddev_samp(F.when(c("ret") < 0, c("ret"))).over(trailing(20)), 21, BOTH, family="risk")
IDIO_VOL = _factor("idio_vol", "ret bench", lambda part=_whole: -_idio_vol(20)(part), 21, BOTH, family="risk", in_parts=True)
AMPLITUDE = _factor("amplitude20", "high low", _amplitude, 20, BOTH, -1, "risk", in_parts=True)
TURNOVER20 = _factor("turnover20", "volume", lambda: rolling_mean(c("volume"), 20), 20, BOTH, -1, "liquidity")
AMOUNT20 = _factor("amount20", "amount", lambda: rolling_mean(c("amount"), 20), 20, BOTH, -1, "liquidity")
AMIHUD = _factor("amihud", "ret amount", lambda: rolling_mean(safe_div(F.abs(c("ret")), c("amount")), 20), 21, BOTH, 1, "liquidity")
REVENUE_GROWTH = _factor("revenue_growth", "amount", lambda: change(c("amount"), 12), 13, family="growth")
PROFIT_GROWTH = _factor("profit_growth", "net_profit", lambda: safe_div(c("net_profit") - F.lag("net_profit", 12).over(by_code()), F.abs(F.lag("net_profit", 12).over(by_code()))), 13, family="growth")


def with_market(panel: DataFrame) -> DataFrame:
    """Adds ``ret`` and ``bench``, the mean return of the date."""
    panel = panel.withColumn("ret", daily_return())
    return panel.withColumn("bench", F.avg("ret").over(Window.partitionBy("trade_date")))


def calc_factors(panel: DataFrame, factors: Iterable[Factor], start: str | None = None, end: str | None = None, adjust: str | None = None, skip_paused: bool = False, cleaned: bool = False, keep: tuple[str, ...] = (), returns: bool = False) -> DataFrame:
    """trade_date, code, the columns of the panel that ``keep`` names, and a column for each factor.

    Dates before ``start`` only warm up the windows. ``adjust`` names a column of adjustment factors for
    prices; ``skip_paused`` drops suspended rows before any window, so that they count in none. With ``returns`` the
    panel has ``ret`` and ``bench`` already, and as they are wanted.
    """
    factors = list(factors)
    if len({f.name for f in factors}) < len(factors):
        raise ValueError("factor names must be unique")
    if lacking := {d for f in factors for d in f.dependencies} - {*panel.columns, "ret", "bench"}:
        raise ValueError(f"the panel has no column {', '.join(sorted(lacking))}")
    rows = panel.where("trade_date <= '%s'" % end) if end else panel
    rows = rows.where("not is_suspend") if skip_paused else rows
    if adjust:
        rows = rows.withColumns({p: c(p) * c(adjust) for p in ("open", "high", "low", "close") if p in rows.columns})
    rows = with_market(rows) if not returns and any({"ret", "bench"} & set(f.dependencies) for f in factors) else rows
    carried = [k for k in dict.fromkeys([*keep, "industry", "market_cap"]) if k in rows.columns]
    parts: dict[str, Column] = {}

    def part(value: Column) -> Column:
        name = f"__part_{len(parts)}"
        parts[name] = value
        return c(name)

    columns = [(f.calc(part) if f.in_parts else f.calc()).alias(f"__{f.name}") for f in factors]
    made = (rows.withColumns(parts) if parts else rows).select("trade_date", "code", *carried, *columns)
    made = made.where(f"trade_date >= '{start}'") if start else made
    for f in factors:
        made = clean(made, f"__{f.name}", f.neutralize, out=f"__{f.name}") if cleaned else made
    return made.select("trade_date", "code", *keep, *[c(f"__{f.name}").alias(f.name) for f in factors])


def long_form(values: DataFrame, names: list[str]) -> DataFrame:
    """trade_date, code, factor_name, factor: one row for each factor, for plans over many factors."""
    return values.unpivot(["trade_date", "code"], names, "factor_name", "factor")


def pandas_factor(panel: DataFrame, name: str, calc: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """trade_date, code, value: for a factor that no column expression gives. ``calc`` gets a security's rows by date.

    A security's history is one group; nothing else is. Built-in expressions are the way wherever they will do.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("trade_date")
        return rows[["trade_date", "code"]].assign(**{name: calc(rows).astype(float)})

    kinds = {f.name: f.dataType.simpleString() for f in panel.schema}
    return panel.groupBy("code").applyInPandas(run, f"trade_date {kinds['trade_date']}, code {kinds['code']}, {name} double")


def wide_view(values: DataFrame, name: str) -> DataFrame:
    """A row for each date and a column for each code; for sinks only."""
    return values.groupBy("trade_date").pivot("code").agg(F.first(name))
