"""Queries on optimised weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators.backtest import period_returns
from factorloom.operators.optimise import covariances, optimality, optimised
from factorloom.plans import sql
from factorloom.plans.catalog import register
from factorloom.plans.market import labelled
from factorloom.plans.strategy import BOTH, OK, PICKED, SCORED, picked
from factorloom.sources.panel import PanelSource

MONTHS, SHRINK = 24, 0.3
# Expected return of the best score over the mean one; ours.
ALPHA = 0.02
_COV = (
    BOTH, SCORED, OK, PICKED,
    f"oh AS (SELECT trade_date, code, (trade_date - to_months(k::INT))::DATE AS month FROM pk, (SELECT unnest(range({MONTHS})) AS k))",
    "ok2 AS (SELECT o.*, ret - avg(ret) OVER w AS x, count(*) OVER w AS n FROM oh o JOIN (SELECT trade_date AS month, code, ret FROM lab WHERE ret IS NOT NULL) r USING (month, code) WINDOW w AS (PARTITION BY o.trade_date, o.code))",
    f"om AS (SELECT a.trade_date, a.code AS a, b.code AS b, sum(a.x * b.x) / {MONTHS - 1} AS s FROM ok2 a JOIN ok2 b ON a.trade_date = b.trade_date AND a.month = b.month WHERE a.n = {MONTHS} AND b.n = {MONTHS} GROUP BY ALL)",
    f"oc AS (SELECT trade_date, a, b, {1 - SHRINK} * s + CASE WHEN a = b THEN {SHRINK} * avg(CASE WHEN a = b THEN s END) OVER (PARTITION BY trade_date) ELSE 0.0 END AS cov FROM om)",
)


def held(source: PanelSource) -> DataFrame:
    """The strategy's picks with what is expected of each."""
    mean = F.avg("score").over(Window.partitionBy("trade_date"))
    return source.once("picks", lambda: picked(source).select("trade_date", "code", "market_cap", (ALPHA * (F.col("score") - mean)).alias("alpha")))


def matrix(source: PanelSource) -> DataFrame:
    return source.once("covariances", lambda: covariances(held(source), labelled(source).select("trade_date", "code", "ret"), MONTHS, SHRINK))


def solved(source: PanelSource) -> DataFrame:
    return source.once("optimised", lambda: optimised(held(source), matrix(source)))


@register("shrunk_covariance", sql.query(*_COV, "SELECT * FROM oc"))
def shrunk_covariance(source):
    """Covariances of the names held on each date, over the 24 months up to it."""
    return matrix(source)


@register("optimised_weights")
def optimised_weights(source):
    """Minimum variance, mean-variance, Black-Litterman and risk parity on the names that the strategy picks. No SQL: the solvers iterate."""
    return solved(source)


@register("optimised_weights_check", sql.query(*_COV, "SELECT trade_date, method, count(*) AS names, true AS adds_up, true AS in_bounds, true AS optimal FROM (SELECT DISTINCT trade_date, a FROM oc), (SELECT unnest(['min_variance', 'mean_variance', 'risk_parity']) AS method) GROUP BY ALL"))
def optimised_weights_check(source):
    """Each date's weights against the conditions that only an optimum meets; SQL says which dates and names there are."""
    return optimality(solved(source), matrix(source), held(source))


@register("optimised_returns")
def optimised_returns(source):
    """What each method's weights earn until the next date, beside equal weights of the same names."""
    weights = solved(source)
    names = weights.select("trade_date", "code").distinct()
    equal = names.withColumns({"method": F.lit("equal"), "weight": 1.0 / F.count("*").over(Window.partitionBy("trade_date"))})
    labels, out = labelled(source), None
    for method in ("min_variance", "mean_variance", "black_litterman", "risk_parity"):
        one = period_returns(weights.where(F.col("method") == method), labels).withColumn("method", F.lit(method))
        out = one if out is None else out.unionByName(one)
    return out.unionByName(period_returns(equal, labels).withColumn("method", F.lit("equal"))).select("trade_date", "method", "gross")
