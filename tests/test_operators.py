"""Hand-computed cases and properties of the factor operators."""

from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.functions.expressions import average_rank, correlation, quantile_group, safe_div
from factorloom.operators.backtest import Costs, nav_fold, rebalance_dates, stopped_nav, trade_cost
from factorloom.operators.clean import clean, neutralize, standardize, winsorize
from factorloom.operators.combine import banded, dynamic_weights, size_floor, top_n, universe, weigh
from factorloom.operators.evaluate import layers, rank_ic, rolling_ic, streaks, switch
from factorloom.operators.factors import LIBRARY, Factor, Registry, calc_factors
from factorloom.operators.monitor import append_version, breaches, version_steps, VERSION_SCHEMA
from factorloom.operators.performance import drawdown_curve, metrics, recovery

D = [date(2024, m, 1) for m in range(1, 13)]


def one(df):
    return df.collect()[0]


@pytest.mark.parametrize(("value", "buy", "cost"), [(10_000, True, 20), (10_000, False, 30), (100_000, True, 160), (100_000, False, 260), (0, True, 10)])
def test_trade_cost(spark, value, buy, cost):
    assert one(spark.range(1).select(trade_cost(F.lit(float(value)), F.lit(buy)).alias("c")))["c"] == pytest.approx(cost)


def test_safe_div(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (None, 1.0), (float("nan"), 1.0), (1.0, float("inf")), (1.0, 2.0)], "a double, b double")
    assert [r[0] for r in rows.select(safe_div(F.col("a"), F.col("b"))).collect()] == [None, None, None, None, 0.5]


def test_spearman_with_ties_and_constants(spark):
    rows = spark.createDataFrame([(D[0], "a", 1.0, 1.0), (D[0], "b", 1.0, 2.0), (D[0], "c", 2.0, 3.0), (D[1], "a", 1.0, 1.0), (D[1], "b", 1.0, 2.0), (D[1], "c", 1.0, 3.0)], "trade_date date, code string, f double, fwd double")
    got = {r["trade_date"]: r["ic"] for r in rank_ic(rows, "f", min_names=0).collect()}
    assert got[D[0]] == pytest.approx(0.8660254) and got[D[1]] is None


def test_ic_keeps_only_large_cross_sections(spark):
    rows = spark.createDataFrame([(D[k], f"{i}", float(i), float(i)) for k, n in ((0, 20), (1, 21)) for i in range(n)], "trade_date date, code string, f double, fwd double")
    assert [r["trade_date"] for r in rank_ic(rows, "f").collect()] == [D[1]]


def test_quantile_groups_like_pandas(spark):
    values = [1, 1, 1, 1, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9, 10, 11, 12, 13, 14, 15.0, 3.5, 4.5, 6.5, 8.5]
    rows = spark.createDataFrame([(D[0], i, float(v)) for i, v in enumerate(values)], "trade_date date, code long, x double")
    got = [r["group"] for r in layers(rows, "x").orderBy("code").collect()]
    assert got == (pd.qcut(values, 5, labels=False) + 1).tolist()
    flat = spark.createDataFrame([(D[0], i, x) for i, x in enumerate([1.0, 1.0, 1.0, 1.0, 2.0])], "trade_date date, code long, x double")
    assert {r["group"] for r in layers(flat, "x").collect()} == {None}


def panel_of(spark, n=24, dates=3):
    rows = [(D[d], i, float((i * 7919 + d * 104729) % 101), i % 3, float((i * 31 + d) % 17 + 1)) for d in range(dates) for i in range(n)]
    return spark.createDataFrame(rows, "trade_date date, code long, x double, industry int, market_cap double")


def test_cleaning_properties(spark):
    rows = panel_of(spark)
    z = standardize(rows, "x").groupBy("trade_date").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).collect()
    assert all(abs(r["m"]) < 1e-12 and r["s"] == pytest.approx(1) for r in z)
    res = neutralize(rows, "x", ("industry", "market_cap"))
    sums = res.groupBy("trade_date", "industry").agg(F.sum("x").alias("s")).collect()
    assert all(abs(r["s"]) < 1e-9 for r in sums)
    slope = res.groupBy("trade_date").agg(F.sum(F.col("x") * F.col("market_cap")).alias("s")).collect()
    assert all(abs(r["s"]) < 1e-8 for r in slope)
    w = winsorize(rows, "x", 0.1, 0.9).toPandas()
    for d, g in rows.toPandas().groupby("trade_date"):
        lo, hi = g.x.quantile([0.1, 0.9])
        assert w[w.trade_date == d].sort_values("code").x.tolist() == pytest.approx(g.sort_values("code").x.clip(lo, hi).tolist())
    empty = clean(rows.where("false"), "x").collect()
    assert empty == []


def test_nulls_pass_through_cleaning(spark):
    rows = panel_of(spark).withColumn("x", F.when(F.col("code") > 2, F.col("x"))).withColumn("industry", F.when(F.col("code") != 5, F.col("industry")))
    got = {(r["trade_date"], r["code"]): r["x"] for r in clean(rows, "x").collect()}
    assert all(v is None for (_, c), v in got.items() if c in (0, 1, 2, 5))


def test_registry_and_dependencies(spark):
    registry = Registry()
    registry.add(Factor("f", ("close",), lambda: F.col("close")))
    with pytest.raises(ValueError, match="already"):
        registry.add(Factor("f", ("close",), lambda: F.col("close")))
    with pytest.raises(ValueError, match="no column"):
        calc_factors(spark.createDataFrame([(D[0], 1, 2.0)], "trade_date date, code long, open double"), [LIBRARY["mas5"]])


def test_no_look_ahead(spark):
    rows = [(D[d], c, float(100 + (d * 13 + c * 7) % 19)) for d in range(12) for c in range(3)]
    full = spark.createDataFrame(rows, "trade_date date, code long, close double")
    names = ["mas5", "momentum_acceleration"]
    cut = full.where(F.col("trade_date") <= D[8])
    key = lambda df: {(r["trade_date"], r["code"]): tuple(r[n] for n in names) for r in calc_factors(df, [LIBRARY[n] for n in names]).collect()}
    a, b = key(full), key(cut)
    assert all(a[k] == b[k] for k in b)


def test_enhanced_ep(spark):
    rows = spark.createDataFrame([(D[0], 1, 10.0, -5.0, -2.0), (D[0], 2, 10.0, 3.0, 0.0), (D[0], 3, 10.0, 50.0, 1.0)], "trade_date date, code long, pe_ratio double, operating_cash_flow double, net_profit double")
    got = {r["code"]: r["enhanced_ep"] for r in calc_factors(rows, [LIBRARY["enhanced_ep"]]).collect()}
    assert got == {1: pytest.approx(-0.25), 2: 0.0, 3: pytest.approx(1.0)}


def test_drawdown_and_recovery(spark):
    rows = spark.createDataFrame([(D[0], 0.1), (D[1], -0.2), (D[2], 0.05), (D[3], 0.5)], "trade_date date, ret double")
    assert one(drawdown_curve(rows).agg(F.min("drawdown").alias("d")))["d"] == pytest.approx(-0.2)
    first = spark.createDataFrame([(D[0], -0.1), (D[1], 0.0)], "trade_date date, ret double")
    assert one(drawdown_curve(first).agg(F.min("drawdown").alias("d")))["d"] == 0
    assert one(drawdown_curve(first, include_initial=True).agg(F.min("drawdown").alias("d")))["d"] == pytest.approx(-0.1)
    got = one(recovery(drawdown_curve(rows)))
    assert (got["trough_date"], got["recovered_date"], got["days"]) == (D[1], D[3], 60)
    assert one(recovery(drawdown_curve(rows.limit(2))))["days"] is None


def test_metrics_of_nothing_and_of_ruin(spark):
    rows = spark.createDataFrame([(D[0], -2.0, 0.0), (D[1], 0.1, 0.0)], "trade_date date, ret double, bench_ret double")
    assert one(metrics(rows, 12))["annual_return"] is None
    assert one(metrics(rows.where("false"), 12))["n"] == 0


def test_selection(spark):
    rows = spark.createDataFrame([(D[0], c, s, cap) for c, s, cap in ((1, 0.5, 1.0), (2, 0.9, 2.0), (3, 0.5, 3.0), (4, None, 4.0))], "trade_date date, code long, score double, market_cap double")
    assert [r["code"] for r in top_n(rows, 2).orderBy("place").collect()] == [2, 1]
    assert [r["code"] for r in size_floor(rows, 0.5).orderBy("code").collect()] == [3, 4]
    for how in ("equal", "cap", "factor", "inverse_vol"):
        assert one(weigh(rows.where("score is not null"), how).agg(F.sum("weight").alias("s")))["s"] == pytest.approx(1)
    flags = spark.createDataFrame([(1, False, 59, False), (2, False, 60, False), (3, True, 90, False), (4, False, 90, True)], "code long, is_st boolean, list_days int, is_suspend boolean")
    assert [r["code"] for r in universe(flags).collect()] == [2]


def test_band_against_a_fold(spark):
    scores = [(D[d], c, float((c * 37 + d * 53) % 29)) for d in range(12) for c in range(10)]
    got = {(r["trade_date"], r["code"]) for r in banded(spark.createDataFrame(scores, "trade_date date, code long, score double"), 3, 2).collect()}
    held, want = set(), set()
    for d in D:
        order = [c for _, c in sorted((-s, c) for x, c, s in scores if x == d)]
        held = {c for c in range(10) if order.index(c) < 3 or (c in held and order.index(c) < 5)}
        want |= {(d, c) for c in held}
    assert got == want


def test_ic_series(spark):
    rows = spark.createDataFrame([(D[i], x) for i, x in enumerate([0.1, -0.1, -0.2, 0.05, -0.3, None])], "trade_date date, ic double")
    assert sorted((r["length"], round(r["total"], 9)) for r in streaks(rows).collect()) == [(1, -0.3), (2, -0.3)]
    rolled = rolling_ic(rows, 2)
    assert [r["rolling_ic"] is None for r in rolled.orderBy("trade_date").collect()] == [True, False, False, False, False, True]
    series = spark.createDataFrame([(D[0], 0.05), (D[1], -0.03), (D[2], -0.03)], "trade_date date, rolling_ic double")
    assert [r["on"] for r in switch(series).orderBy("trade_date").collect()] == [True, True, False]
    assert [r["on"] for r in switch(series, strict=True).orderBy("trade_date").collect()] == [True, True, True]


def test_dynamic_weights(spark):
    rows = spark.createDataFrame([(0.03, -0.01), (-0.1, -0.2)], "a double, b double")
    got = [(r["a_weight"], r["b_weight"]) for r in dynamic_weights(rows, "a", "b").collect()]
    assert got == [(1.0, 0.0), (0.5, 0.5)]


def test_folds(spark):
    gross = spark.createDataFrame([(D[0], 0.0), (D[1], 0.1)], "trade_date date, gross double")
    traded = spark.createDataFrame([(D[0], "a", 1.0), (D[1], "a", -0.5), (D[1], "b", 0.5)], "trade_date date, code string, change double")
    got = one(nav_fold(gross, traded, 10_000.0, Costs()))
    value = 10_000.0 - 20.0
    cost = (5 * 2 + value / 2 * 0.002) + (5 * 2 + value / 2 * 0.001)
    assert got["value"] == pytest.approx((value - cost) * 1.1) and got["cost"] == pytest.approx(20 + cost)
    stopped = one(stopped_nav(spark.createDataFrame([(D[0], -0.2), (D[1], 0.1)], "trade_date date, ret double")))
    assert stopped["nav"] == pytest.approx(0.8 * 1.05) and stopped["cut_steps"] == 1


def test_rebalance_dates(spark):
    rows = spark.createDataFrame([(date(2024, 1, 30),), (date(2024, 1, 31),), (date(2024, 2, 5),)], "trade_date date")
    assert sorted(r[0] for r in rebalance_dates(rows).collect()) == [date(2024, 1, 31), date(2024, 2, 5)]


def test_monitoring(spark, tmp_path):
    rows = spark.createDataFrame([(0.02, 0.3)], "annual_return double, annual_vol double")
    got = breaches(rows, (("low", "annual_return", "<", 0.05), ("high", "annual_vol", ">", 0.3)))
    assert [r["rule"] for r in got.collect()] == ["low"]
    version = spark.createDataFrame([("v1", D[0], "", None, "{}", (0.1, 0.8, 0.2))], VERSION_SCHEMA)
    append_version(version, str(tmp_path / "log"))
    append_version(version.withColumn("version", F.lit("v2")), str(tmp_path / "log"))
    assert [r["stop"] for r in version_steps(spark.read.parquet(str(tmp_path / "log"))).orderBy("version").collect()] == [False, True]


def test_shared_expressions(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, None), (1, 2.0), (1, 1.0)], "k int, x double")
    assert [r[0] for r in rows.select(average_rank(F.col("x"), "k").alias("r")).orderBy(F.asc_nulls_first("r")).collect()] == [None, 1.0, 2.5, 2.5]
    assert one(rows.agg(correlation(F.col("x"), F.col("x")).alias("c")))["c"] == pytest.approx(1)
    assert quantile_group is not None


def test_no_composite_looks_ahead(spark, tmp_path):
    """Without the lines of the last two years the scores of all earlier months are the same."""
    from pyspark.sql import functions as F

    from factorloom.plans.catalog import PLANS
    from factorloom.sources.panel import PanelSource

    sf = "/root/testdata/sf0.01"
    for t in ("supplier", "nation"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    lines.where(F.col("l_shipdate") < "1997-01-01").write.parquet(str(tmp_path / "lineitem.parquet"))
    for name in ("composite_ic", "composite_icir", "composite_dynamic", "composite_switched"):
        full, cut = (PLANS[name](PanelSource(spark, d)).where("trade_date < '1997-01-01'").toPandas() for d in (sf, str(tmp_path)))
        full, cut = (x.sort_values(["trade_date", "code"]).reset_index(drop=True) for x in (full, cut))
        assert len(cut) > 500 and full[["trade_date", "code"]].equals(cut[["trade_date", "code"]])
        assert (full.score.isna() == cut.score.isna()).all() and (full.score - cut.score).abs().max() < 1e-9


def test_as_of_takes_the_last_published(spark):
    from factorloom.sources.point_in_time import as_of, members_at

    rows = spark.createDataFrame([(d, c) for d in range(1, 7) for c in "ab"], "trade_date int, code string")
    figures = spark.createDataFrame([(2, "a", 10), (4, "a", None), (4, "b", 7)], "published int, code string, x int")
    got = {(r["trade_date"], r["code"]): (r["published"], r["x"]) for r in as_of(rows, figures, "published").collect()}
    assert got == {(d, c): ((None, None) if (c == "b" and d < 4) or d < 2 else ((4, None) if c == "a" else (4, 7)) if d >= 4 else (2, 10)) for d in range(1, 7) for c in "ab"}
    spans = spark.createDataFrame([("a", 2, 3), ("a", 5, 5), ("b", 9, 9)], "code string, from int, to int")
    assert sorted(tuple(r) for r in members_at(rows, spans).collect()) == [(2, "a"), (3, "a"), (5, "a")]


def test_backtest_by_hand(spark):
    """Two names, four days, rebalancing weekly: the first week's drift, then half sold at its costs."""
    from datetime import date

    from factorloom.operators.backtest import BacktestConfig, Costs, Strategy, backtest

    class Both(Strategy):
        def signals(self, panel):
            return panel.selectExpr("trade_date", "code", "1.0 as score")

    days = [date(2024, 1, 30), date(2024, 1, 31), date(2024, 2, 1), date(2024, 2, 2), date(2024, 2, 5), date(2024, 2, 9)]
    close = {"a": [1, 1, 2, 4, 4, 8], "b": [1, 1, 1, 1, 1, 1]}
    prices = spark.createDataFrame([(d, c, float(v)) for c, values in close.items() for d, v in zip(days, values, strict=True)], "trade_date date, code string, close double")
    panel = spark.createDataFrame([(date(2024, 1, 1), "a"), (date(2024, 1, 1), "b")], "trade_date date, code string")
    free = Costs(commission=0.0, minimum=0.0, slippage=0.0, tax=0.0)
    nav, traded = backtest(Both(), panel, prices, BacktestConfig(initial_capital=100.0, rebalance_freq="week", max_holding=2, costs=free))
    assert [(r["trade_date"], r["nav"], r["drawdown"]) for r in nav.orderBy("trade_date").collect()] == [(days[4], 100.0, 0.0), (days[5], 150.0, 0.0)]
    nav, traded = backtest(Both(), panel, prices, BacktestConfig(initial_capital=100.0, rebalance_freq="week", max_holding=2, costs=Costs(commission=0.01, minimum=0.0, slippage=0.0, tax=0.0, sides=1)))
    assert [round(r["nav"], 9) for r in nav.orderBy("trade_date").collect()] == [99.0, 148.5]
    assert round(traded.where("trade_date = '2024-02-09'").agg({"change": "sum"}).first()[0], 9) == -1.0  # no signal of February: all is sold


def test_pandas_factor_and_wide_view(spark):
    from factorloom.operators.factors import pandas_factor, wide_view

    panel = spark.createDataFrame([(d, c, float(d * (c == "a"))) for d in range(1, 4) for c in "ab"], "trade_date int, code string, close double")
    made = pandas_factor(panel, "total", lambda rows: rows["close"].cumsum())
    assert {(r["trade_date"], r["code"]): r["total"] for r in made.collect()} == {(d, c): (d * (d + 1) / 2 if c == "a" else 0.0) for d in range(1, 4) for c in "ab"}
    assert [tuple(r) for r in wide_view(made, "total").orderBy("trade_date").collect()] == [(1, 1.0, 0.0), (2, 3.0, 0.0), (3, 6.0, 0.0)]
