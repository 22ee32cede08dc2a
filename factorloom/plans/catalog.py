"""Where queries register: a name, the Spark plan, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from factorloom.sources.panel import PanelSource

PLANS: dict[str, Callable[[PanelSource], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable:
    """Adds a plan, a function of a PanelSource; names are unique."""

    def add(plan: Callable[[PanelSource], DataFrame]) -> Callable[[PanelSource], DataFrame]:
        if name in PLANS:
            raise ValueError(f"there is a query named {name} already")
        PLANS[name] = plan
        if oracle is not None:
            ORACLES[name] = oracle
        return plan

    return add
