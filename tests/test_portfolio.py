"""Optimised weights, positions with a path, bitemporal figures and correlations by ranges, on hand-made rows."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from factorloom.operators.backtest import BacktestConfig, Costs
from factorloom.operators.correlate import rank_correlations
from factorloom.operators.optimise import black_litterman, bounded, covariances, optimality, optimised, risk_parity
from factorloom.operators.positions import Portfolio, path_rows, walk
from factorloom.sources.point_in_time import known_figures, members_at

DAY = dt.date


# optimised weights


def test_three_names_in_closed_form():
    cov = np.array([[0.04, 0.006, 0.0], [0.006, 0.09, 0.01], [0.0, 0.01, 0.16]])
    inverse = np.linalg.solve(cov, np.ones(3))
    assert np.allclose(bounded(cov, np.zeros(3), 1.0, 1.0), inverse / inverse.sum(), atol=1e-9)
    # mean-variance without active bounds: w = (inv(cov) (mu - c)) / aversion with the multiplier c that makes it add up to 1
    mu, aversion = np.array([0.05, 0.06, 0.07]), 4.0
    c = (np.linalg.solve(cov, mu).sum() - aversion) / inverse.sum()
    want = np.linalg.solve(cov, mu - c) / aversion
    assert want.min() > 0 and np.allclose(bounded(cov, mu, aversion, 1.0), want, atol=1e-9)
    assert np.allclose(risk_parity(np.diag([0.04, 0.09, 0.16])), np.array([1 / 2, 1 / 3, 1 / 4]) / (1 / 2 + 1 / 3 + 1 / 4), atol=1e-9)
    # with all views equal to what the market implies, nothing moves
    market = np.array([0.5, 0.3, 0.2])
    assert np.allclose(black_litterman(cov, market, 3.0 * cov @ market, 3.0), 3.0 * cov @ market)


def test_bounds_hold_and_bind():
    cov = np.diag([0.01, 1.0, 1.0, 1.0])
    w = bounded(cov, np.zeros(4), 1.0, 0.4)
    assert np.allclose(w, [0.4, 0.2, 0.2, 0.2], atol=1e-9)
    assert np.allclose(bounded(cov, np.array([0, 5.0, 0, 0]), 1.0, 1.0), [0, 1, 0, 0])
    assert np.allclose(bounded(cov, np.zeros(4), 1.0, 0.1), 0.25)  # no weights within such a bound add up to 1


@pytest.fixture(scope="module")
def market(spark):
    rng = np.random.default_rng(3)
    months = [DAY(2000 + m // 12, m % 12 + 1, 1) for m in range(30)]
    rows = [(d, c, float(rng.normal(0.01, 0.02 * (c + 1)))) for d in months for c in range(5)]
    rows.append((months[-1], 9, 0.5))  # too short a history
    returns = spark.createDataFrame(rows, "trade_date date, code long, ret double")
    held = spark.createDataFrame([(d, c, 0.01 * c, 1.0 + c) for d in months[25:28] for c in (*range(5), 9)], "trade_date date, code long, alpha double, market_cap double")
    return rows, months, returns, held


def test_covariances_and_conditions(spark, market):
    rows, months, returns, held = market
    cov = covariances(held, returns, 24, 0.3)
    at = {(r.a, r.b): r["cov"] for r in cov.where(F.col("trade_date") == months[26]).collect()}
    x = np.array([[v for d, c, v in rows if c == k and months[3] <= d <= months[26]] for k in range(5)])
    sample = np.cov(x)
    want = 0.7 * sample + 0.3 * np.diag(sample).mean() * np.eye(5)
    assert set(at) == {(a, b) for a in range(5) for b in range(5)} and np.allclose([[at[a, b] for b in range(5)] for a in range(5)], want)
    weights = optimised(held, cov, most=0.4)
    checked = optimality(weights, cov, held, most=0.4).collect()
    assert len(checked) == 9 and all(r.adds_up and r.in_bounds and r.optimal and r.names == 5 for r in checked)
    assert {r.method for r in weights.collect()} == {"min_variance", "mean_variance", "black_litterman", "risk_parity"}


def test_weights_know_nothing_of_the_future(spark, market):
    _, months, returns, held = market
    whole = covariances(held, returns).where(F.col("trade_date") <= months[26])
    cut = covariances(held, returns.where(F.col("trade_date") <= months[26])).where(F.col("trade_date") <= months[26])
    key = lambda df: {(r.trade_date, r.a, r.b): round(r["cov"], 14) for r in df.collect()}
    assert key(whole) == key(cut) and key(whole)


# positions with a path


def test_ten_days_by_hand(spark):
    """One name at 10, bought for all; falls by 12 % on the fourth day and is stopped; bought again on the next month's last day."""
    days = [DAY(2001, 1, 30), DAY(2001, 1, 31), DAY(2001, 2, 1), DAY(2001, 2, 2), DAY(2001, 2, 27), DAY(2001, 2, 28), DAY(2001, 3, 1), DAY(2001, 3, 2), DAY(2001, 3, 5), DAY(2001, 3, 6)]
    closes = [9.0, 10.0, 9.5, 8.8, 8.0, 8.0, 8.4, 8.4, 7.0, 7.3]
    prices = spark.createDataFrame([(d, 1, p) for d, p in zip(days, closes, strict=True)], "trade_date date, code long, close double")
    weights = spark.createDataFrame([(DAY(2001, m, 1), 1, 1.0) for m in (1, 2)], "month date, code long, weight double")
    rows = path_rows(weights, prices)
    assert [(r.trade_date, r.price, r.weight) for r in rows.orderBy("trade_date").collect()] == [(d, p, 1.0 if d in (days[1], days[5]) else None) for d, p in list(zip(days, closes, strict=True))[1:]]
    config = BacktestConfig(initial_capital=1000.0, costs=Costs(0.0, 5.0, 0.0, 0.0, 1))
    each = rows.withColumn("strategy", F.explode(F.array(F.lit("plain"), F.lit("stock"))))
    variants = spark.createDataFrame([("plain", None, None), ("stock", 0.10, None)], "strategy string, stock_limit double, fund_limit double")
    walked = walk(each, variants, config).collect()
    days_of = lambda s: [(round(r.nav, 6), round(r.cash, 6), r.names, r.stopped) for r in sorted((r for r in walked if r.strategy == s and r.code is None), key=lambda r: r.trade_date)]
    # bought for 1000 with a fee of 5, so cash is -5; 880 less the fee of 5 after the stop: 870 in cash; 870 buys again at 8, less 5
    assert days_of("stock") == [(1000, -5, 1, 0), (945, -5, 1, 0), (875, 870, 0, 1), (870, 870, 0, 0), (870, -5, 1, 0), (908.5, -5, 1, 0), (908.5, -5, 1, 0), (756.25, 751.25, 0, 1), (751.25, 751.25, 0, 0)]
    # never stopped; at the end of February 5 too many are held, and are sold for a fee of 5
    assert days_of("plain")[4] == (795, -5.0, 1, 0)
    held = {(r.strategy, r.trade_date): (round(r.shares, 6), round(r.cost, 6)) for r in walked if r.code is not None}
    assert held[("stock", days[1])] == (100, 10) and held[("stock", days[5])] == (108.75, 8) and held[("plain", days[5])] == (99.375, 10)


def test_average_cost_and_the_fund_stop():
    fund = Portfolio(Costs(0.0, 0.0, 0.0, 0.0, 1), 100.0, None, 0.15)
    fund.day({1: 10.0, 2: 10.0}, {1: 0.5, 2: 0.5})
    fund.day({1: 20.0, 2: 10.0}, {1: 0.2, 2: 0.8})  # 150: sells 70 of the first, buys 70 of the second
    assert fund.held[1] == (1.5, 10.0) and fund.held[2] == (12.0, 10.0)
    fund.day({1: 20.0, 2: 20.0}, {2: 1.0})
    assert fund.held == {2: (13.5, (120.0 + 30.0) / 13.5)} and fund.peak == 270
    fund.day({2: 16.0}, {})  # 216 is 20 % below: half goes
    assert fund.cut and fund.held[2][0] == 6.75 and fund.cash == 108
    fund.day({2: 16.0}, {})
    assert fund.held[2][0] == 6.75
    fund.day({2: 16.0}, {2: 1.0})
    assert fund.held[2][0] * 16 == 108 and fund.cut


# bitemporal figures


def test_a_restatement_changes_nothing_before_it(spark):
    rows = spark.createDataFrame([(DAY(2001, m, 1), c) for m in range(1, 10) for c in (1, 2)], "trade_date date, code long")
    first = [(1, DAY(2001, m, 1), DAY(2001, m + 2, 1), float(m)) for m in range(1, 6)]
    shape = "code long, valid date, published date, profit double"
    known = lambda figures: {(r.trade_date, r.code): (r.valid, r.profit) for r in known_figures(rows, spark.createDataFrame(figures, shape)).collect()}
    plain = known(first)
    assert plain[DAY(2001, 2, 1), 1] == (None, None) and plain[DAY(2001, 5, 1), 1] == (DAY(2001, 3, 1), 3.0) and plain[DAY(2001, 9, 1), 2] == (None, None)
    again = known([*first, (1, DAY(2001, 5, 1), DAY(2001, 9, 1), -5.0), (1, DAY(2001, 1, 1), DAY(2001, 6, 1), -1.0)])
    assert {k for k in plain if plain[k] != again[k]} == {(DAY(2001, 9, 1), 1)} and again[DAY(2001, 9, 1), 1] == (DAY(2001, 5, 1), -5.0)


def test_memberships_that_overlap_or_are_missing(spark):
    rows = spark.createDataFrame([(DAY(2001, m, 1), c) for m in range(1, 7) for c in (1, 2, None)], "trade_date date, code long")
    spans = spark.createDataFrame([(1, DAY(2001, 2, 1), DAY(2001, 3, 1)), (1, DAY(2001, 3, 1), DAY(2001, 4, 30)), (1, DAY(2001, 6, 1), DAY(2001, 6, 1))], "code long, from date, to date")
    assert sorted((r.trade_date.month, r.code) for r in members_at(rows, spans).collect()) == [(2, 1), (3, 1), (4, 1), (6, 1)]


# correlations


@pytest.mark.parametrize("keys", [(), ("year",), ("trade_date",)])
def test_correlations_by_ranges(spark, keys):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"trade_date": [DAY(2000 + i // 40, 1 + i % 2, 1) for i in range(120)], "code": range(120), "a": rng.integers(0, 9, 120).astype(float), "b": rng.normal(size=120), "c": 1.0})
    frame["d"] = frame.a + frame.b
    frame.loc[::7, "b"] = None
    frame["year"] = [d.year for d in frame.trade_date]
    given = spark.createDataFrame([tuple(None if isinstance(v, float) and v != v else v for v in r) for r in frame.astype(object).values.tolist()], "trade_date date, code long, a double, b double, c double, d double, year int")
    got = {(*[r[k] for k in keys], r["first"], r["second"]): (r.rho, r.n) for r in rank_correlations(given, list("abcd"), keys).collect()}
    seen = 0
    for group, part in frame.groupby(list(keys)) if keys else [((), frame)]:
        ranks = part[list("abcd")].rank()
        for i, x in enumerate("abcd"):
            for y in "abcd"[i + 1 :]:
                both = ranks[[x, y]].dropna()
                rho, n = got[(*(group if keys else ()), x, y)]
                want = both[x].corr(both[y]) if both[x].nunique() > 1 and both[y].nunique() > 1 else None
                assert n == len(both) and (rho is None if want is None else abs(rho - want) < 1e-12)
                seen += 1
    assert seen == len(got)


def test_backtests_price_only_what_is_held(spark, sf):
    from factorloom.plans.research import prices, run
    from factorloom.sources.panel import PanelSource, daily_prices

    source = PanelSource(spark, sf)
    run(source, "quarter")
    assert not {"prices", "days"} & set(source.held)
    codes = prices(source).select("code").distinct().limit(3)
    held = [r.code for r in codes.collect()]
    got = daily_prices(source, spark.createDataFrame([(c,) for c in held], codes.schema))
    want = prices(source).where(F.col("code").isin(held))
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_sections_are_those_of_the_columns(spark):
    from factorloom.operators.clean import clean
    from factorloom.operators.evaluate import layer_returns, rank_ic
    from factorloom.operators.factors import LIBRARY
    from factorloom.operators.sections import section_ics, sections

    rng = np.random.default_rng(4)
    some = lambda v: None if rng.random() < 0.1 else round(float(v), 2)
    rows = [(DAY(2001, m, 1), c, None if c == 7 else c % 4, some(rng.random() * 9), some(rng.normal()), some(rng.normal()), some(rng.normal())) for m in (1, 2) for c in range(60)]
    values = spark.createDataFrame(rows, "trade_date date, code long, industry int, market_cap double, fwd double, ep double, momentum20 double")
    made = sections(values, [LIBRARY["ep"], LIBRARY["momentum20"]], chunk=1).cache()
    assert made.count() == 4
    for name in ("ep", "momentum20"):
        one = clean(values, name, LIBRARY[name].neutralize).withColumn(name, F.round(name, 9) + 0.0).where(F.col(name).isNotNull() & F.col("fwd").isNotNull())
        mine = made.where(F.col("factor_name") == name)
        assert sorted(section_ics(mine).select("trade_date", "ic", "n").collect()) == sorted(rank_ic(one, name).collect())
        parts = mine.select("trade_date", F.inline("industries")).select("trade_date", "part", F.round("ic", 11))
        assert sorted(parts.collect()) == sorted(rank_ic(one.where("industry is not null"), name, keys=("trade_date", "industry"), min_names=2).select("trade_date", "industry", F.round("ic", 11)).collect())
        for side, sign in (("up", 1), ("down", -1)):
            want = {(r.trade_date, r.group): (r.ret, r.n) for r in layer_returns(one.withColumn(name, F.col(name) * sign), name).collect()}
            got = {r.trade_date: (r[side], len(r[f"{side}_members"])) for r in mine.collect()}
            assert all(got[d][0][g - 1] == pytest.approx(v) and (g < 5 or got[d][1] == n) for (d, g), (v, n) in want.items()) and len(want) == 10


def test_shares_of_winsorized_values_from_counts(spark):
    from factorloom.functions.expressions import average_rank, clip, percent_rank
    from factorloom.plans.grid import WINSOR, tails, winsorized_share

    rng = np.random.default_rng(6)
    dates = [DAY(2001, m, 1) for m in (1, 2, 3)]
    rows = [(dates[0], c, float(rng.integers(0, 30)), float(rng.normal())) for c in range(80)] + [(dates[1], c, 1.0, float(c // 2)) for c in range(5)] + [(dates[2], 0, 2.0, 3.0)]
    rows = spark.createDataFrame(rows, "trade_date date, code long, ep double, vol double").withColumns({f"{f}_rank": average_rank(F.col(f), "trade_date") for f in ("ep", "vol")}).cache()
    met = rows.join(tails(rows), "trade_date")
    for i, q in enumerate(WINSOR):
        for f in ("ep", "vol"):
            w = Window.partitionBy("trade_date")
            clipped = rows.withColumn("x", clip(F.col(f), F.percentile(f, q).over(w), F.percentile(f, 1 - q).over(w)))
            want = clipped.select("trade_date", "code", percent_rank(F.col("x"), "trade_date").alias("r")).collect()
            assert sorted(met.select("trade_date", "code", winsorized_share(f, i).alias("r")).collect()) == sorted(want)
