"""Several strategies, attribution and densities on hand-made rows."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.operators.attribution import effects, levels
from factorloom.operators.evaluate import density
from factorloom.operators.several import combined, netting, risk_allocation, strategy_gross, strategy_weights

MONTHS = [dt.date(2000 + m // 12, m % 12 + 1, 1) for m in range(16)]


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(5)
    rows = [(d, c, s, float(rng.normal()), float(rng.normal(0, 0.01 * (1 + 3 * (s == "b"))))) for d in MONTHS for s in "ab" for c in range(6)]
    return spark.createDataFrame(rows, "trade_date date, code long, strategy string, score double, fwd double")


def test_parts_add_up_to_the_whole(scores):
    weights = strategy_weights(scores, 3)
    gross = strategy_gross(weights)
    shares = {(r.trade_date, r.strategy): r.share for r in risk_allocation(gross).collect()}
    each = {(r.trade_date, r.strategy): r.gross for r in gross.collect()}
    assert all(abs(shares[d, "a"] + shares[d, "b"] - 1) < 1e-12 for d in MONTHS) and shares[MONTHS[11], "a"] == 0.5
    past = lambda s: np.std([each[d, s] for d in MONTHS[1:13]], ddof=1)
    assert shares[MONTHS[13], "a"] == pytest.approx(past("b") / (past("a") + past("b")))
    parts = combined(weights, risk_allocation(gross))
    whole = parts.join(scores.select("trade_date", "code", "strategy", "fwd"), ["trade_date", "code", "strategy"]).groupBy("trade_date").agg(F.sum(F.col("weight") * F.col("fwd")).alias("r")).collect()
    assert all(r.r == pytest.approx(sum(shares[r.trade_date, s] * each[r.trade_date, s] for s in "ab"), abs=1e-14) for r in whole)


def test_netting(spark):
    shape = "trade_date date, strategy string, code long, weight double"
    first, second = MONTHS[:2]
    parts = spark.createDataFrame([(first, "a", 1, 0.5), (first, "b", 2, 0.5), (second, "a", 2, 0.5), (second, "b", 1, 0.5)], shape)
    calendar = spark.createDataFrame([(first, second), (second, None)], "trade_date date, next_date date")
    got = {r.trade_date: (r.apart, r.net) for r in netting(parts, calendar).collect()}
    assert got == {first: (1.0, 1.0), second: (2.0, 0.0)}  # the two swap their names


def test_effects_add_up_at_every_level(spark):
    rng = np.random.default_rng(2)
    market = [(d, c, c % 4, c % 2, None if c == 11 else float(rng.normal())) for d in MONTHS[:3] for c in range(12)]
    shape = "trade_date date, code long, industry int, region int, fwd double"
    held = [r for r in market if r[1] in (0, 1, 4, 5, 11)]
    parts = effects(spark.createDataFrame(held, shape), spark.createDataFrame(market, shape), "industry", "region")
    mean = lambda rows: np.mean([r[4] for r in rows if r[4] is not None])
    for r in parts.groupBy("trade_date").agg(F.sum(F.col("allocation") + F.col("selection") + F.col("interaction")).alias("excess")).collect():
        assert abs(r.excess - (mean([x for x in held if x[0] == r.trade_date]) - mean([x for x in market if x[0] == r.trade_date]))) < 1e-12
    table = levels(parts, "region", "industry").collect()
    assert sorted(r.level for r in table) == [0, 1, 1, 2, 2, 2, 2]
    by_level = {k: sum(r.excess for r in table if r.level == k) for k in (0, 1, 2)}
    assert by_level[0] == pytest.approx(by_level[1]) == pytest.approx(by_level[2])


def test_density_against_direct_sums(spark):
    x = np.random.default_rng(4).normal(3, 2, 400)
    got = density(spark.createDataFrame([("k", float(v)) for v in x] + [("same", 1.0)] * 3, "name string, x double"), "x", "name").collect()
    assert {r.name for r in got} == {"k"} and len(got) == 101
    h = 1.06 * x.std(ddof=1) * len(x) ** -0.2
    direct = lambda g: np.exp(-(((g - x) / h) ** 2) / 2).sum() / (len(x) * h * math.sqrt(2 * math.pi))
    assert all(abs(r.density - direct(r.x)) < 2e-3 * max(direct(v.x) for v in got) for r in got)
    points = sorted((r.x, r.density) for r in got)
    assert np.trapezoid([d for _, d in points], [p for p, _ in points]) == pytest.approx(1, abs=1e-3)
