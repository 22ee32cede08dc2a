"""Security panels: one row for each date and code, from Parquet tables.

``monthly_panel`` derives a month-by-security panel from order lines, and ``daily_prices`` a daily one: a
supplier stands for a security. Amounts are summed as whole ten-thousandths, so they are the same in any order. The
lines are scanned once: their cells, one for each code and month with trades, are a written table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.functions.expressions import by_code, safe_div
from factorloom.sources.scratch import written

#: Share of returned lines above which a name is flagged as under special treatment.
ST_SHARE = 0.5


@dataclass(frozen=True)
class PanelSource:
    """Where the tables of a panel are, and what a query has written so far."""

    spark: SparkSession
    sf_dir: str
    held: dict[str, DataFrame] = field(default_factory=dict, compare=False, repr=False)

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The table of this name, which is written when it is first asked for."""
        if name not in self.held:
            self.held[name] = written(build(), name)
        return self.held[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def lines(self) -> DataFrame:
        """Only the columns that a panel needs reach the scan."""
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("code"), "l_partkey", "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("returnflag"), F.to_date("l_shipdate").alias("ship"),
            *[F.col(f"l_{c}").alias(c) for c in ("quantity", "extendedprice", "discount", "tax")],
        )

    def industries(self) -> DataFrame:
        """code, industry, region."""
        nations = self.table("nation").select(F.col("n_nationkey").alias("industry"), F.col("n_regionkey").alias("region"))
        return self.table("supplier").select(F.col("s_suppkey").alias("code"), F.col("s_nationkey").alias("industry")).join(nations, "industry").select("code", "industry", "region")


def _exact(x: Column) -> Column:
    """A sum of whole ten-thousandths, the same in any order; whole numbers, as decimals take several times as long."""
    whole = F.rint(x * 1e4 + F.signum(x) * 1e-9).cast("bigint")
    return F.sum(whole).cast("double") / 1e4


def observed_months(lines: DataFrame) -> DataFrame:
    """The cells that have trades."""
    gross, unit = F.col("extendedprice"), F.col("extendedprice") / F.col("quantity")
    first = F.struct("ship", "l_orderkey", "l_linenumber")
    return lines.groupBy("code", F.trunc("ship", "MM").alias("trade_date")).agg(
        F.min_by(unit, first).alias("open"),
        F.max(unit).alias("high"),
        F.min(unit).alias("low"),
        _exact(gross).alias("amount"),
        _exact(F.col("quantity")).alias("volume"),
        _exact(F.col("discount")).alias("discounts"),
        _exact(gross * (F.col("discount") - F.col("tax"))).alias("net_profit"),
        _exact(gross * F.col("discount")).alias("operating_cash_flow"),
        _exact(gross * F.col("tax")).alias("dividends"),
        _exact(F.when(F.col("returnflag") != "R", gross * (F.col("discount") - F.col("tax"))).otherwise(0.0)).alias("profit_ex_items"),
        F.count("*").alias("lines"),
        F.sum((F.col("returnflag") == "R").cast("int")).alias("returned"),
    )


def densify(cells: DataFrame) -> DataFrame:
    """A row for every code and month from the first to the last month that any code has.

    Without it a gap would stretch every horizon that counts rows. The bounds are one row of the plan.
    """
    bounds = cells.agg(F.sequence(F.min("trade_date"), F.max("trade_date"), F.expr("interval 1 month")).alias("months")).where("months is not null")
    grid = cells.select("code").distinct().join(F.broadcast(bounds)).select("code", F.explode("months").alias("trade_date"))
    return grid.join(cells, ["code", "trade_date"], "left")


def monthly_panel(source: PanelSource) -> DataFrame:
    """All fields of the factor library; null where a security did not trade in the month."""
    dense = densify(source.once("cells", lambda: observed_months(source.lines())))
    listed = F.min(F.when(F.col("lines") > 0, F.col("trade_date"))).over(Window.partitionBy("code"))
    year = by_code().rowsBetween(-11, 0)
    panel = dense.select(
        "trade_date",
        "code",
        "open",
        "high",
        "low",
        safe_div(F.col("amount"), F.col("volume")).alias("close"),
        "volume",
        "amount",
        "net_profit",
        "operating_cash_flow",
        "dividends",
        "profit_ex_items",
        safe_div(F.col("amount"), F.col("net_profit")).alias("pe_ratio"),
        safe_div(F.col("amount"), F.col("operating_cash_flow") + F.col("net_profit")).alias("pb_ratio"),
        safe_div(F.col("discounts"), F.col("lines")).alias("roe"),
        F.sum("amount").over(year).alias("market_cap"),
        F.coalesce(safe_div(F.col("returned"), F.col("lines")) > ST_SHARE, F.lit(False)).alias("is_st"),
        F.col("lines").isNull().alias("is_suspend"),
        F.datediff("trade_date", listed).alias("list_days"),
    )
    return panel.join(source.industries(), "code", "left")


def calendar(panel: DataFrame) -> DataFrame:
    """Trading dates with the month's end flag and the next date."""
    dates = panel.select("trade_date").distinct()
    return dates.select("trade_date", F.lead("trade_date").over(Window.orderBy("trade_date")).alias("next_date"))


def daily_closes(source: PanelSource, codes: DataFrame | None = None) -> DataFrame:
    """trade_date, code, close, volume, amount: a day's mean price of the days with trades; of ``codes`` only, if given."""
    lines = source.lines() if codes is None else source.lines().join(codes, "code", "left_semi")
    days = lines.groupBy("code", F.col("ship").alias("trade_date")).agg(_exact(F.col("extendedprice")).alias("amount"), _exact(F.col("quantity")).alias("volume"))
    return days.select("trade_date", "code", safe_div(F.col("amount"), F.col("volume")).alias("close"), "volume", "amount")


def trading_days(source: PanelSource) -> DataFrame:
    """trade_date: the days on which any name trades."""
    return source.once("trading-days", lambda: source.lines().select(F.col("ship").alias("trade_date")).distinct())


def daily_prices(source: PanelSource, codes: DataFrame | None = None) -> DataFrame:
    """The dense daily panel: trade_date, code, close (the last known), traded (whether on this day).

    With ``codes`` it has no other names, on the days of all: what is held is priced, not all that could be.
    """
    cells = source.once("days", lambda: daily_closes(source)) if codes is None else written(daily_closes(source, codes), "days")
    days = (cells if codes is None else trading_days(source)).agg(F.array_sort(F.collect_set("trade_date")).alias("days"))  # as many as the calendar has
    grid = cells.select("code").distinct().join(F.broadcast(days)).select("code", F.explode("days").alias("trade_date"))
    past = by_code().rowsBetween(Window.unboundedPreceding, 0)
    dense = grid.join(cells, ["code", "trade_date"], "left")
    return dense.select("trade_date", "code", F.last("close", ignorenulls=True).over(past).alias("close"), F.col("close").isNotNull().alias("traded"), "amount")
