"""Every query of the factor library with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factorloom.operators.evaluate import rank_ic
from factorloom.plans import allocation, evaluation, grid, learned, market, portfolio, positions, published, reports, research, screening, strategy  # noqa: F401
from factorloom.plans.catalog import ORACLES, PLANS
from factorloom.sources.panel import PanelSource


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly rank ICs of cleaned momentum; the smallest tables have ten names, hence the low bound."""
    return rank_ic(market.cleaned(PanelSource(spark, sf_dir)), "mom", min_names=5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, plan=plan: plan(PanelSource(spark, sf_dir)) for name, plan in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
