"""Queries on learned composites. They have no SQL: fits and searches iterate."""

from __future__ import annotations

from math import isfinite

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.operators.evaluate import rank_ic
from factorloom.operators.factors import LIBRARY, calc_factors
from factorloom.operators.learn import composite_rank_ics, linear_score, moments_by_date, ranked_features, search_by_year, walk_forward, with_label
from factorloom.plans.catalog import register
from factorloom.plans.market import labelled
from factorloom.sources.panel import PanelSource

FEATURES = ["ep", "bp", "roe", "roa", "enhanced_ep", "intraday", "gap", "momentum20", "volatility20", "amihud", "revenue_growth"]


def features(source: PanelSource) -> DataFrame:
    return source.once("features", lambda: ranked_features(calc_factors(labelled(source), [LIBRARY[n] for n in FEATURES], keep=("fwd",)), FEATURES))


def learned(source: PanelSource) -> DataFrame:
    return source.once("learned", lambda: walk_forward(features(source), FEATURES))


@register("learned_scores")
def learned_scores(source):
    """Scores of each name by a forest of the years before."""
    return learned(source)


@register("learned_ic")
def learned_ic(source):
    """Out-of-sample ICs of the learned composite, beside those of the equal one on the same dates."""
    rows = features(source)
    equal = linear_score(rows, FEATURES, (1,) * len(FEATURES)).join(learned(source).select("trade_date").distinct(), "trade_date", "left_semi")
    both = with_label(learned(source), rows).withColumn("method", F.lit("learned")).unionByName(with_label(equal, rows).withColumn("method", F.lit("equal")))
    return rank_ic(both, "score", "label", ("trade_date", "method"))


@register("searched_weights")
def searched_weights(source):
    """The best weights of each generation for each year that has years before it, by ICs before that year, and how they do from then on.

    All features are searched. The ICIR is null where the years before have no ICs to tell by.
    """
    rows = features(source)
    moments = source.once("moments", lambda: moments_by_date(rows, FEATURES))
    years = sorted(r["year"] for r in rows.select(F.year("trade_date").alias("year")).distinct().collect())  # as many as the calendar has
    best = search_by_year(moments, FEATURES, [(1,) * len(FEATURES)], years[1:])
    since: dict[tuple[int, ...], int] = {}  # of each weights, which several years and generations share, the first year
    for year, _, weights, _ in best:
        since[weights] = min(year, since.get(weights, year))
    ids = {w: i for i, w in enumerate(since)}
    ics = composite_rank_ics(rows, FEATURES, source.spark.createDataFrame([(ids[w], list(w), y) for w, y in since.items()], "id int, weights array<int>, since int"))
    found = source.spark.createDataFrame([(y, g, list(w), f if isfinite(f) else None, ids[w]) for y, g, w, f in best], "year int, generation int, weights array<int>, icir double, of int")
    later = found.join(ics, (F.col("of") == F.col("id")) & (F.year("trade_date") >= F.col("year")), "left")
    return later.groupBy("year", "generation", "weights", "icir").agg(F.round(F.avg("ic"), 12).alias("later_ic"), F.count("ic").alias("later_dates"))
