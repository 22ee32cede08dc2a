"""Rank correlations by ranges of packed values."""

from datetime import date

import numpy as np
import pytest

from factorloom.operators import correlate
from factorloom.operators.factors import LIBRARY, calc_factors


def _ranks(x):
    _, place, own = np.unique(x, return_inverse=True, return_counts=True)
    return (2 * (np.cumsum(own) - own) + own - len(x))[place].astype(float)


@pytest.mark.parametrize("keys", [(), ("year",)])
def test_ranges_and_blocks(spark, monkeypatch, keys):
    """Many ranges and blocks: ties, a value that fills ranges, unknown values, NaN, zeros of both signs, a constant, one factor that is never known."""
    monkeypatch.setattr(correlate, "RANGE", 40)
    monkeypatch.setattr(correlate, "BLOCK", 64)
    rng = np.random.default_rng(7)
    rows = []
    for k in range(600):
        x = [float(rng.normal()), float(rng.integers(0, 4)), 0.0 if rng.random() < 0.7 else float(rng.normal()), 5.0, None, -0.0 if k % 2 else 0.0]
        x = [None if v is None or rng.random() < 0.1 else v for v in x]
        x[0] = float("nan") if k % 97 == 0 else x[0]
        rows.append((date(2000 + k % 3, 1, 1), k, 2000 + k % 3 if k % 50 else None, *x))
    names = list("abcdef")
    given = spark.createDataFrame(rows, "trade_date date, code long, year int, " + ", ".join(f"{n} double" for n in names))
    got = {(*[r[k] for k in keys], r["first"], r["second"]): (r.rho, r.n) for r in correlate.rank_correlations(given, names, keys).collect()}
    wanted = {}
    for group in {r[2] for r in rows} if keys else {None}:
        part = [r[3:] for r in rows if not keys or r[2] == group]
        ranks = []
        for i in range(len(names)):
            at = [k for k, r in enumerate(part) if r[i] is not None]
            ranks.append(dict(zip(at, _ranks(np.array([part[k][i] for k in at], np.float32)), strict=True)) if at else {})
        for i in range(len(names)):
            for j in range(i + 1, len(names)):
                both = sorted(ranks[i].keys() & ranks[j].keys())
                if both:
                    x, y = (np.array([ranks[f][k] for k in both]) for f in (i, j))
                    rho = None if x.std() == 0 or y.std() == 0 else float(np.corrcoef(x, y)[0, 1])
                    wanted[(*([group] if keys else []), names[i], names[j])] = (rho, len(both))
    assert got.keys() == wanted.keys()
    for at, (rho, n) in wanted.items():
        assert got[at][1] == n
        assert got[at][0] == (None if rho is None else pytest.approx(rho, abs=1e-12))


def test_no_rows_at_all(spark):
    empty = spark.createDataFrame([], "trade_date date, code long, year int, a double, b double")
    assert correlate.rank_correlations(empty, ["a", "b"]).collect() == []
    assert correlate.rank_correlations(empty, ["a", "b"], ("year",)).collect() == []


def test_values_are_no_rows_of_their_own(spark):
    given = spark.createDataFrame([(date(2000, 1, 1), 1, 2000, 1.0, 2.0), (date(2000, 1, 1), 2, 2000, 2.0, 1.0)], "trade_date date, code long, year int, a double, b double")
    plan = correlate.rank_correlations(given, ["a", "b"], ("year",))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "SortMergeJoin" not in plan and "Window" not in plan


def test_rolling_values_are_taken_once(spark):
    columns = sorted({d for f in LIBRARY.factors.values() for d in f.dependencies} | {"ret", "bench", "industry", "market_cap"})
    panel = spark.createDataFrame([], "trade_date date, code long, " + ", ".join(f"{n} double" for n in columns))
    plan = calc_factors(panel, LIBRARY.factors.values(), returns=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("covar_pop(") == 1 and plan.count("max(high") == 1 and "windowspecdefinition(trade_date" not in plan
