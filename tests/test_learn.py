"""Learned composites: nothing of the future, reruns agree, no generation worse than the one before."""

import datetime as dt

import numpy as np
import pytest

from factorloom.functions.expressions import percent_rank
from factorloom.operators.evaluate import rank_ic
from factorloom.operators.learn import composite_ic, fitness, linear_score, moments_by_date, ranked_features, search_by_year, search_weights, walk_forward, with_label
from factorloom.plans.learned import FEATURES, searched_weights
from factorloom.sources.panel import PanelSource
from pyspark.sql import functions as F

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(8)
    rows = []
    for m in range(48):
        for code in range(25):
            a, b, c = (float(x) for x in rng.normal(size=3))
            rows.append((dt.date(2000 + m // 12, m % 12 + 1, 1), code, a, None if code == 3 else b, c, 0.5 * a - 0.3 * (b if code != 3 else 0) + float(rng.normal())))
    return spark.createDataFrame(rows, "trade_date date, code long, a double, b double, c double, fwd double")


def test_features_are_ranks_of_the_date(panel):
    rows = ranked_features(panel, NAMES)
    r = rows.agg(F.min("a"), F.max("a"), F.max(F.when(F.col("code") == 3, F.abs("b")))).first()
    assert r[1] == 0.5 and r[0] == pytest.approx(1 / 25 - 0.5) and r[2] == 0


def test_ranks_of_more_columns_need_no_more_sorts(panel):
    sorts = lambda names: ranked_features(panel, names)._jdf.queryExecution().executedPlan().toString().count("Sort [")
    assert sorts(NAMES) == sorts(NAMES[:1])
    tied = panel.withColumns({"a": F.floor("a").cast("double"), "fwd": F.when(F.col("code") > 2, F.col("fwd"))})
    want = tied.select("trade_date", "code", *[(percent_rank(F.col(n), "trade_date") - 0.5).alias(n) for n in (*NAMES, "fwd")]).collect()
    got = {(r.trade_date, r.code): r for r in ranked_features(tied, NAMES).collect()}
    assert len(got) == len(want) and all(tuple(got[r.trade_date, r.code])[2:] == (r.a, r.b or 0.0, r.c, r.fwd) for r in want)


def test_forests_know_nothing_of_the_future(panel):
    cut = dt.date(2002, 12, 1)
    key = lambda df: {(r.trade_date, r.code): round(r.score, 12) for r in df.where(F.col("trade_date") <= cut).collect()}
    whole = key(walk_forward(ranked_features(panel, NAMES), NAMES, trees=5))
    past = panel.withColumn("fwd", F.when(F.col("trade_date") < cut, F.col("fwd"))).where(F.col("trade_date") <= cut)
    assert whole == key(walk_forward(ranked_features(past, NAMES), NAMES, trees=5)) and len(whole) == 12 * 25
    assert min(d for d, _ in whole) == dt.date(2002, 1, 1)


def test_fitness_is_that_of_the_composite(panel):
    rows = ranked_features(panel, NAMES)
    moments = moments_by_date(rows, NAMES)
    for weights in ((1, 1, 1), (2, -1, 0)):
        scores = linear_score(rows, NAMES, weights).join(rows.select("trade_date", "code", "label"), ["trade_date", "code"])
        direct = [r.ic for r in scores.groupBy("trade_date").agg(F.corr("score", "label").alias("ic")).collect()]
        assert fitness(moments, [weights])[weights] == pytest.approx(np.mean(direct) / np.std(direct, ddof=1))
    assert moments.select(composite_ic(F.array(F.lit(0), F.lit(0), F.lit(0)), 3).alias("ic")).where("ic is not null").count() == 0


def test_search(panel):
    moments = moments_by_date(ranked_features(panel, NAMES), NAMES)
    start = [(1, 1, 1)]
    best = search_weights(moments, NAMES, start, generations=4, size=8)
    assert best == search_weights(moments, NAMES, start, generations=4, size=8)
    assert all(a[2] <= b[2] for a, b in zip(best, best[1:], strict=False)) and best[-1][2] >= fitness(moments, start)[start[0]]
    assert len(best) == 4 and best[-1][1][0] > 0 > best[-1][1][1]  # what the labels were made from


def test_search_of_a_year_is_that_of_the_years_before(panel):
    moments = moments_by_date(ranked_features(panel, NAMES), NAMES)
    found = search_by_year(moments, NAMES, [(1, 1, 1)], [2001, 2003], generations=3, size=8)
    assert sorted((y, g) for y, g, _, _ in found) == [(y, g) for y in (2001, 2003) for g in range(3)]
    for year in (2001, 2003):
        past = moments.where(F.year("trade_date") < year)
        assert [tuple(f) for y, *f in found if y == year] == search_weights(past, NAMES, [(1, 1, 1)], generations=3, size=8)


@pytest.fixture(scope="module")
def wide(spark):
    """The features of the plan, on four years without a label in the first three months of 2000 and the last of 2003."""
    rng = np.random.default_rng(9)
    rows = []
    for m in range(48):
        for code in range(25):
            x = [float(v) for v in rng.normal(size=len(FEATURES))]
            y = x[0] - 2 * x[-1] + float(rng.normal())  # the last of the features tells most
            rows.append((dt.date(2000 + m // 12, m % 12 + 1, 1), code, *x, y if 3 <= m < 47 else None))
    return spark.createDataFrame(rows, f"trade_date date, code long, {', '.join(f'{n} double' for n in FEATURES)}, fwd double")


def test_searched_weights_look_at_all_years_features_and_generations(spark, wide):
    rows = ranked_features(wide, FEATURES).persist()
    found = sorted(searched_weights(PanelSource(spark, "", {"features": rows})).collect(), key=lambda r: (r.year, r.generation))
    assert [(r.year, r.generation) for r in found] == [(y, g) for y in (2001, 2002, 2003) for g in range(6)]
    assert all(len(r.weights) == len(FEATURES) and r.icir is not None and r.later_ic is not None for r in found)
    assert {r.year: r.later_dates for r in found} == {2001: 35, 2002: 23, 2003: 11}
    assert all(r.weights[-1] < 0 for r in found if r.generation == 5)
    moments = moments_by_date(rows, FEATURES)
    for r in (found[2], found[-1]):
        weights, cut = tuple(r.weights), F.year("trade_date") < r.year
        assert fitness(moments.where(cut), [weights])[weights] == pytest.approx(r.icir)
        direct = rank_ic(with_label(linear_score(rows.where(~cut), FEATURES, weights), rows), "score", "label")
        assert r.later_ic == pytest.approx(direct.agg(F.avg("ic")).first()[0])
    rows.unpersist()


def test_searched_weights_know_nothing_of_the_future(spark, wide):
    cut = dt.date(2001, 12, 1)
    key = lambda df: sorted((r.year, r.generation, tuple(r.weights), r.icir) for r in searched_weights(PanelSource(spark, "", {"features": ranked_features(df, FEATURES)})).where("year <= 2002").collect())
    past = wide.withColumn("fwd", F.when(F.col("trade_date") <= cut, F.col("fwd"))).where("trade_date <= '2002-01-01'")
    assert key(wide) == key(past)


def test_searched_weights_where_the_past_tells_nothing(spark, wide):
    late = wide.withColumn("fwd", F.when(F.year("trade_date") > 2000, F.col("fwd")))
    found = searched_weights(PanelSource(spark, "", {"features": ranked_features(late, FEATURES)})).collect()
    assert {r.year for r in found if r.icir is None} == {2001} and len(found) == 18
    assert searched_weights(PanelSource(spark, "", {"features": ranked_features(wide.where("false"), FEATURES)})).count() == 0
    assert searched_weights(PanelSource(spark, "", {"features": ranked_features(wide.where("trade_date < '2001-01-01'"), FEATURES)})).count() == 0


def test_empty(spark):
    none = spark.createDataFrame([], "trade_date date, code long, a double, b double, c double, fwd double")
    assert walk_forward(ranked_features(none, NAMES), NAMES).count() == 0
