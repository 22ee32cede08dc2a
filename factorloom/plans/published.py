"""Queries on factors from published figures only: what was known on a date, with restatements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions.expressions import safe_div
from factorloom.operators.evaluate import forward_return, ic_stats, rank_ic
from factorloom.operators.factors import LIBRARY, calc_factors
from factorloom.plans import sql
from factorloom.plans.catalog import register
from factorloom.plans.evaluation import STATS
from factorloom.plans.market import FACTOR_SQL
from factorloom.sources.panel import PanelSource, monthly_panel
from factorloom.sources.point_in_time import known_figures

# Months from a period to its first figures, and to their restatement without what was returned; ours.
FIRST, RESTATED = 2, 5
FACTORS = ("ep", "roe", "enhanced_ep", "roa", "cash_quality", "bp")


def figures(source: PanelSource) -> DataFrame:
    """code, valid, published and a month's figures: first of all its lines, later without those returned. One scan for both."""
    gross = F.col("extendedprice")
    exact = lambda x: F.sum(x.cast("decimal(18,4)")).cast("double")
    kept = lambda x: F.when(F.col("returnflag") != "R", x).otherwise(0.0)
    parts = {"net_profit": gross * (F.col("discount") - F.col("tax")), "operating_cash_flow": gross * F.col("discount"), "discounts": F.col("discount"), "lines": F.lit(1.0)}
    sums = source.lines().groupBy("code", F.trunc("ship", "MM").alias("valid")).agg(*[exact(x).alias(n) for n, x in parts.items()], *[exact(kept(x)).alias(f"{n}_kept") for n, x in parts.items()])
    version = lambda months, end: F.struct(F.add_months("valid", months).alias("published"), *[F.col(f"{n}{end}").alias(n) for n in ("net_profit", "operating_cash_flow")], safe_div(F.col(f"discounts{end}"), F.col(f"lines{end}")).alias("roe"))
    return sums.select("code", "valid", F.inline(F.array(version(FIRST, ""), version(RESTATED, "_kept"))))


def published_panel(source: PanelSource) -> DataFrame:
    """The monthly panel with profits, cash flows and returns on equity as they were known on each date, and valuations from these."""
    rows = known_figures(monthly_panel(source), figures(source))
    return rows.withColumns({"pe_ratio": safe_div(F.col("amount"), F.col("net_profit")), "pb_ratio": safe_div(F.col("amount"), F.col("operating_cash_flow") + F.col("net_profit"))})


_FIGURES = f"""fi AS (SELECT code, trade_date AS valid, sum((p * (d - t))::DECIMAL(18,4))::DOUBLE AS np, sum((p * d)::DECIMAL(18,4))::DOUBLE AS cf, sum(d::DECIMAL(18,4))::DOUBLE / count(*) AS roe,
  sum((CASE WHEN rf <> 'R' THEN p * (d - t) ELSE 0.0 END)::DECIMAL(18,4))::DOUBLE AS np2, sum((CASE WHEN rf <> 'R' THEN p * d ELSE 0.0 END)::DECIMAL(18,4))::DOUBLE AS cf2,
  sum((CASE WHEN rf <> 'R' THEN d ELSE 0.0 END)::DECIMAL(18,4))::DOUBLE / nullif(sum((rf <> 'R')::INT), 0) AS roe2 FROM li GROUP BY ALL),
pub AS (SELECT code, valid, (valid + to_months({FIRST}))::DATE AS published, np, cf, roe FROM fi UNION ALL SELECT code, valid, (valid + to_months({RESTATED}))::DATE, np2, cf2, roe2 FROM fi),
kf AS (SELECT p.trade_date, p.code, arg_max(struct_pack(valid := valid, published := published, np := np, cf := cf, roe := u.roe), (valid, published)) AS k FROM panel p JOIN pub u ON u.code = p.code AND u.published <= p.trade_date GROUP BY ALL),
pp AS (SELECT p.* EXCLUDE (net_profit, operating_cash_flow, roe, pe_ratio, pb_ratio), k.valid AS valid, k.published AS published, k.np AS net_profit, k.cf AS operating_cash_flow, k.roe AS roe,
  amount / nullif(k.np, 0) AS pe_ratio, amount / nullif(k.cf + k.np, 0) AS pb_ratio FROM panel p LEFT JOIN kf USING (trade_date, code))"""
_COLUMNS = ", ".join(f"{FACTOR_SQL[n]} AS {n}" for n in FACTORS)


@register("figures_known", sql.query(_FIGURES, "SELECT trade_date, code, valid, published, net_profit, operating_cash_flow, roe FROM pp"))
def figures_known(source):
    """The figures of each date and code, with their period and publication."""
    return published_panel(source).select("trade_date", "code", "valid", "published", "net_profit", "operating_cash_flow", "roe")


@register("factors_published", sql.query(_FIGURES, f"SELECT trade_date, code, {_COLUMNS} FROM pp"))
def factors_published(source):
    """Value and quality factors from nothing but what was published by the date."""
    return calc_factors(published_panel(source), [LIBRARY[n] for n in FACTORS])


@register("ic_published", sql.query(_FIGURES, f"pf AS (SELECT trade_date, code, lead(close) OVER (PARTITION BY code ORDER BY trade_date) / nullif(close, 0) - 1 AS fwd, {_COLUMNS} FROM pp)", "pl AS (" + " UNION ALL ".join(f"SELECT trade_date, '{n}' AS factor_name, {n} AS factor, fwd FROM pf" for n in FACTORS) + ")", sql.ic("pi", "factor", "pl", keys="trade_date, factor_name"), f"SELECT factor_name, {STATS} FROM pi WHERE ic IS NOT NULL GROUP BY factor_name"))
def ic_published(source):
    """What the factors are worth when they wait for publication."""
    values = calc_factors(forward_return(published_panel(source)), [LIBRARY[n] for n in FACTORS], keep=("fwd",))
    long = values.unpivot(["trade_date", "code", "fwd"], list(FACTORS), "factor_name", "factor")
    return ic_stats(rank_ic(long, "factor", keys=("trade_date", "factor_name")), "factor_name")


@register("figures_restated", sql.query(_FIGURES, "SELECT year(valid)::INT AS year, count(*) AS n, avg((np2 - np) / nullif(abs(np), 0)) AS mean_change, sum((sign(np2) <> sign(np))::INT)::BIGINT AS turned FROM fi GROUP BY 1"))
def figures_restated(source):
    """By year: how far restatements moved profits, and how many changed their sign."""
    first = figures(source).groupBy("code", "valid").agg(F.min_by("net_profit", "published").alias("np"), F.max_by("net_profit", "published").alias("np2"))
    turned = F.sum((F.sign("np2") != F.sign("np")).cast("int")).alias("turned")
    return first.groupBy(F.year("valid").alias("year")).agg(F.count("*").alias("n"), F.avg(safe_div(F.col("np2") - F.col("np"), F.abs("np"))).alias("mean_change"), turned)
