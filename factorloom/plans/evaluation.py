"""Queries on information coefficients, layers, robustness and screening."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.expressions import correlation, safe_div
from factorloom.operators.evaluate import (
    bucketed,
    forward_return,
    ic_stats,
    layer_returns,
    layers,
    long_short,
    monotonicity,
    rank_ic,
    rolling_ic,
    streaks,
    switch,
)
from factorloom.operators.correlate import rank_correlations
from factorloom.operators.factors import LIBRARY, calc_factors
from factorloom.operators.monitor import welch_t
from factorloom.operators.performance import metrics
from factorloom.plans import sql
from factorloom.plans.catalog import register
from factorloom.plans.market import CLEANED, FACTOR_SQL, FACTOR_WINDOWS, IDIO_VOL, cleaned, labelled

IC = CLEANED + ",\n" + sql.ic("ics", "mom", "cl")
STATS = "count(*) AS months, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg(ic) / nullif(stddev_samp(ic), 0) AS icir, avg(CASE WHEN ic > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS win_rate"


def ics(source) -> DataFrame:
    """Of the cleaned factor."""
    return rank_ic(cleaned(source), "mom")


@register("monthly_ic", sql.query(IC, "SELECT * FROM ics"))
def monthly_ic(source):
    return ics(source)


@register("monthly_ic_all_dates", sql.query(sql.ic("ics", "ep", at_least=0), "SELECT * FROM ics"))
def monthly_ic_all(source):
    return rank_ic(labelled(source), "ep", min_names=0)


@register("ic_stats", sql.query(IC, f"SELECT {STATS} FROM ics WHERE ic IS NOT NULL"))
def stats(source):
    return ic_stats(ics(source))


@register("ic_significance", sql.query(IC, "SELECT trade_date, ic * sqrt((n - 2) / nullif(1 - ic * ic, 0)) AS t, abs(ic * sqrt((n - 2) / nullif(1 - ic * ic, 0))) > 2 AS significant FROM ics"))
def significance(source):
    t = F.col("ic") * F.sqrt(safe_div(F.col("n") - 2, 1 - F.col("ic") * F.col("ic")))
    return ics(source).select("trade_date", t.alias("t"), (F.abs(t) > 2).alias("significant"))


@register("ic_persistence", sql.query(IC, "pairs AS (SELECT ic AS x, lag(ic) OVER (ORDER BY trade_date) AS y FROM ics)", f"SELECT {sql.corr('x', 'y')} AS persistence FROM pairs WHERE x IS NOT NULL AND y IS NOT NULL"))
def persistence(source):
    pairs = ics(source).select(F.col("ic").alias("x"), F.lag("ic").over(Window.orderBy("trade_date")).alias("y"))
    return pairs.agg(correlation(F.col("x"), F.col("y")).alias("persistence"))


_STREAKS = """runs AS (SELECT min(trade_date) AS first_date, max(trade_date) AS last_date, count(*) AS length, sum(ic) AS total FROM (
SELECT *, row_number() OVER (ORDER BY trade_date) - row_number() OVER (PARTITION BY ic < 0 ORDER BY trade_date) AS island FROM ics WHERE ic IS NOT NULL) WHERE ic < 0 GROUP BY island)"""
_EPIC = sql.ic("ics", "ep")


@register("ic_streak", sql.query(_EPIC, _STREAKS, "SELECT * FROM runs"))
def streak(source):
    return streaks(rank_ic(labelled(source), "ep"))


@register("ic_drawdown", sql.query(_EPIC, _STREAKS, "SELECT max(length) AS longest, max(abs(total)) AS deepest FROM runs"))
def ic_drawdown(source):
    return streaks(rank_ic(labelled(source), "ep")).agg(F.max("length").alias("longest"), F.max(F.abs("total")).alias("deepest"))


_ROLLED = """rolled AS (SELECT trade_date, ic, CASE WHEN count(ic) OVER r = 12 THEN avg(ic) OVER r END AS rolling_ic, avg(ic) OVER p AS mean_so_far, stddev_samp(ic) OVER p AS std_so_far FROM ics
WINDOW r AS (ORDER BY trade_date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), p AS (ORDER BY trade_date ROWS UNBOUNDED PRECEDING))"""


@register("rolling_ic", sql.query(_EPIC, _ROLLED, "SELECT *, coalesce(rolling_ic < mean_so_far - 2 * std_so_far, false) AS alarm FROM rolled"))
def rolled(source):
    return rolling_ic(rank_ic(labelled(source), "ep"))


for _name, _strict, _off in (("factor_switch", False, "sum(rolling_ic) OVER t < 0"), ("factor_switch_strict", True, "max(rolling_ic) OVER t < 0")):

    @register(_name, sql.query(_EPIC, _ROLLED, f"SELECT trade_date, rolling_ic, NOT coalesce(count(rolling_ic) OVER t = 3 AND {_off}, false) AS \"on\" FROM rolled WINDOW t AS (ORDER BY trade_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"))
    def _switch(source, strict=_strict):
        return switch(rolling_ic(rank_ic(labelled(source), "ep")), strict)


@register("ic_recent_decay", sql.query(_EPIC, _ROLLED, "SELECT trade_date, rolling_ic < mean_so_far AS below_history, avg(CASE WHEN ic > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER r < 0.4 AS few_wins, max(ic) OVER s < 0 AS six_negative FROM rolled WINDOW r AS (ORDER BY trade_date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), s AS (ORDER BY trade_date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"))
def recent_decay(source):
    w = Window.orderBy("trade_date")
    wins = F.avg(F.when(F.col("ic") > 0, 1.0).otherwise(0.0)).over(w.rowsBetween(-11, 0))
    return rolling_ic(rank_ic(labelled(source), "ep")).select(
        "trade_date", (F.col("rolling_ic") < F.col("mean_so_far")).alias("below_history"), (wins < 0.4).alias("few_wins"), (F.max("ic").over(w.rowsBetween(-5, 0)) < 0).alias("six_negative")
    )


@register("ic_ttest", sql.query(_EPIC, "f AS (SELECT ic, row_number() OVER (ORDER BY trade_date DESC) <= 6 AS r FROM ics)", "SELECT (avg(ic) FILTER (r) - avg(ic) FILTER (NOT r)) / nullif(sqrt(var_samp(ic) FILTER (r) / (count(ic) FILTER (r)) + var_samp(ic) FILTER (NOT r) / (count(ic) FILTER (NOT r))), 0) AS t FROM f"))
def ttest(source):
    flagged = rank_ic(labelled(source), "ep").withColumn("recent", F.row_number().over(Window.orderBy(F.desc("trade_date"))) <= 6)
    return flagged.agg(welch_t(F.col("ic"), F.col("recent")).alias("t"))


@register("ic_by_year", sql.query(IC, f"SELECT year(trade_date)::INT AS year, {STATS} FROM ics WHERE ic IS NOT NULL GROUP BY 1"))
def by_year(source):
    return ic_stats(ics(source).withColumn("year", F.year("trade_date")), "year")


@register("ic_by_size", sql.query(sql.groups("cut", "market_cap", 3, out="size_group"), sql.ic("ics", "mom", "(SELECT * FROM cut WHERE size_group IS NOT NULL)", keys="trade_date, size_group"), f"SELECT size_group, {STATS} FROM ics WHERE ic IS NOT NULL GROUP BY size_group"))
def by_size(source):
    cut = bucketed(labelled(source), "market_cap", 3, "size_group").where("size_group is not null")
    return ic_stats(rank_ic(cut, "mom", keys=("trade_date", "size_group")), "size_group")


for _dimension, _least in (("industry", 2), ("region", 5)):  # an industry has few names on a date

    @register(f"ic_by_{_dimension}", sql.query(sql.ic("ics", "mom", keys=f"trade_date, {_dimension}", at_least=_least), f"SELECT {_dimension}, {STATS} FROM ics WHERE ic IS NOT NULL GROUP BY {_dimension}"))
    def _by_dimension(source, dimension=_dimension, least=_least):
        return ic_stats(rank_ic(labelled(source), "mom", keys=("trade_date", dimension), min_names=least), dimension)


@register("ic_by_regime", sql.query(IC, "b AS (SELECT DISTINCT trade_date, bench FROM lab)", f"SELECT CASE WHEN bench > 0.02 THEN 'up' WHEN bench < -0.02 THEN 'down' ELSE 'flat' END AS regime, {STATS} FROM ics JOIN b USING (trade_date) WHERE ic IS NOT NULL GROUP BY 1"))
def by_regime(source):
    rows = labelled(source)
    bench = rows.groupBy("trade_date").agg(F.first("bench").alias("bench"))
    regime = F.when(F.col("bench") > 0.02, "up").when(F.col("bench") < -0.02, "down").otherwise("flat")
    return ic_stats(ics(source).join(bench, "trade_date").withColumn("regime", regime), "regime")


_DECAY = "h AS (" + " UNION ALL ".join(f"SELECT trade_date, code, {h} AS horizon, mom, lead(close, {h}) OVER (PARTITION BY code ORDER BY trade_date) / nullif(close, 0) - 1 AS fh FROM lab" for h in (1, 2, 3)) + ")"


@register("ic_decay", sql.query(_DECAY, sql.ic("ics", "mom", "h", "fh", "trade_date, horizon"), f"SELECT horizon, {STATS} FROM ics WHERE ic IS NOT NULL GROUP BY horizon"))
def decay(source):
    rows = labelled(source)
    for h in (1, 2, 3):
        rows = forward_return(rows, h, f"h{h}")
    long = rows.select("trade_date", "code", "mom", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"h{h}").alias("fh")) for h in (1, 2, 3)])).alias("x")).select("trade_date", "code", "mom", "x.*")
    return ic_stats(rank_ic(long, "mom", "fh", ("trade_date", "horizon")), "horizon")


@register("ic_half_life", sql.query(_DECAY, sql.ic("ics", "mom", "h", "fh", "trade_date, horizon"), "dc AS (SELECT horizon::DOUBLE AS x, ln(nullif(abs(avg(ic)), 0)) AS y FROM ics WHERE ic IS NOT NULL GROUP BY horizon)", "SELECT regr_slope(y, x) AS slope, CASE WHEN regr_slope(y, x) < 0 THEN -ln(2) / regr_slope(y, x) END AS half_life FROM dc"))
def half_life(source):
    """Months in which the mean IC falls by half, by a straight line through its logarithm over the horizons."""
    means = decay(source).select(F.col("horizon").cast("double").alias("x"), F.log(F.nullif(F.abs("ic_mean"), F.lit(0.0))).alias("y"))
    slope = F.regr_slope("y", "x")
    return means.agg(slope.alias("slope"), F.when(slope < 0, -F.log(F.lit(2.0)) / slope).alias("half_life"))


@register("quantile_groups", sql.query(sql.groups("cut", "mom", 5), 'SELECT trade_date, code, grp AS "group" FROM cut'))
def quantile(source):
    return layers(labelled(source).where("mom is not null"), "mom").select("trade_date", "code", "group")


LAYERS = sql.layers("lay", "mom")
LS = 'ls AS (SELECT trade_date, max(CASE WHEN "group" = 5 THEN ret END) - max(CASE WHEN "group" = 1 THEN ret END) AS ret FROM lay GROUP BY trade_date)'


def lay(source) -> DataFrame:
    return layer_returns(labelled(source), "mom")


@register("layer_returns", sql.query(LAYERS, "SELECT * FROM lay"))
def layered(source):
    return lay(source)


@register("long_short", sql.query(LAYERS, LS, "SELECT * FROM ls"))
def spread(source):
    return long_short(lay(source))


@register("monotonicity", sql.query(LAYERS, 'm AS (SELECT "group", avg(ret) AS mean FROM lay GROUP BY 1)', 's AS (SELECT *, mean - lag(mean) OVER (ORDER BY "group") AS step, rank() OVER (ORDER BY mean)::DOUBLE AS r FROM m)', f'SELECT sum((step > 0)::INT) = 4 OR sum((step < 0)::INT) = 4 AS strict, {sql.corr(chr(34) + "group" + chr(34), "r")} AS rho, abs({sql.corr(chr(34) + "group" + chr(34), "r")}) >= 0.8 AS approximate FROM s'))
def monotone(source):
    return monotonicity(lay(source))


_PERF = "CASE WHEN product(1 + ret) > 0 THEN power(product(1 + ret), 12.0 / count(ret)) - 1 END"


@register("layer_stats", sql.query(LAYERS, f'SELECT "group", {_PERF} AS annual_return, stddev_samp(ret) * sqrt(12) AS annual_vol, (({_PERF}) - 0.03) / nullif(stddev_samp(ret) * sqrt(12), 0) AS sharpe FROM lay GROUP BY 1'))
def layer_stats(source):
    return metrics(lay(source).withColumn("bench_ret", F.lit(0.0)), 12, keys=("group",)).select("group", "annual_return", "annual_vol", "sharpe")


_CURVE = "nav AS (SELECT *, product(1 + ret) OVER (ORDER BY trade_date) AS nav FROM ls), dd AS (SELECT *, (nav - max(nav) OVER (ORDER BY trade_date)) / max(nav) OVER (ORDER BY trade_date) AS drawdown FROM nav)"


@register("long_short_stats", sql.query(LAYERS, LS, _CURVE, f"SELECT {_PERF} AS annual_return, (({_PERF}) - 0.03) / nullif(stddev_samp(ret) * sqrt(12), 0) AS sharpe, min(drawdown) AS max_drawdown FROM dd"))
def long_short_stats(source):
    return metrics(long_short(lay(source)).withColumn("bench_ret", F.lit(0.0)), 12).select("annual_return", "sharpe", "max_drawdown")


@register("top_group_excess", sql.query(LAYERS, "b AS (SELECT trade_date, avg(fwd) AS bench FROM lab GROUP BY trade_date)", 'SELECT power(product(1 + ret), 12.0 / count(ret)) - power(product(1 + bench), 12.0 / count(bench)) AS excess FROM lay JOIN b USING (trade_date) WHERE "group" = 5'))
def top_excess(source):
    rows = labelled(source)
    bench = rows.groupBy("trade_date").agg(F.avg("fwd").alias("bench_ret"))
    return metrics(layer_returns(rows, "mom").where("group = 5").join(bench, "trade_date"), 12).select("excess")


# correlations of all factors of the library

_CORR_NAMES = list(LIBRARY.factors)
_FACTORS = f"fl AS (SELECT trade_date, year(trade_date)::INT AS year, code, {', '.join(f'{FACTOR_SQL.get(n, IDIO_VOL)} AS {n}' for n in _CORR_NAMES)} FROM (SELECT *, CASE WHEN bench IS NOT NULL THEN ret END AS iy, CASE WHEN ret IS NOT NULL THEN bench END AS ix FROM lab) {FACTOR_WINDOWS})"
_LONG = "fr AS (" + " UNION ALL ".join(f"SELECT trade_date, year, code, {i} AS i, '{n}' AS name, {n}::FLOAT AS x FROM fl WHERE {n} IS NOT NULL" for i, n in enumerate(_CORR_NAMES)) + ")"


def _rho_sql(keys: str) -> tuple[str, ...]:
    by = f"{keys + ', ' if keys else ''}i"
    head = f"a.{keys} AS {keys}, " if keys else ""
    return (
        _FACTORS,
        _LONG,
        f"fk AS (SELECT *, {sql.centred('x', by)}::DOUBLE AS r FROM fr)",
        f"rho AS (SELECT {head}a.name AS first, b.name AS second, (count(*) * sum(a.r * b.r) - sum(a.r) * sum(b.r)) / nullif(sqrt(greatest(count(*) * sum(a.r * a.r) - sum(a.r) * sum(a.r), 0.0)) * sqrt(greatest(count(*) * sum(b.r * b.r) - sum(b.r) * sum(b.r), 0.0)), 0) AS rho, count(*) AS n FROM fk a JOIN fk b ON a.trade_date = b.trade_date AND a.code = b.code AND a.i < b.i GROUP BY ALL)",
    )


def correlations(source, *keys: str) -> DataFrame:
    rows = labelled(source)
    values = calc_factors(rows, LIBRARY.factors.values(), returns=True).withColumn("year", F.year("trade_date"))
    return rank_correlations(values, _CORR_NAMES, keys)


@register("factor_corr", sql.query(*_rho_sql(""), "SELECT * FROM rho"))
def corr_matrix(source):
    return correlations(source)


@register("factor_corr_by_date", sql.query(*_rho_sql("trade_date"), "SELECT first, second, avg(rho) AS rho, count(rho) AS dates FROM rho GROUP BY first, second"))
def corr_by_date(source):
    return correlations(source, "trade_date").groupBy("first", "second").agg(F.avg("rho").alias("rho"), F.count("rho").alias("dates"))


@register("factor_corr_by_year", sql.query(*_rho_sql("year"), "SELECT * FROM rho"))
def corr_by_year(source):
    return correlations(source, "year")


@register("factor_corr_drift", sql.query(*_rho_sql("year"), "SELECT first, second, max(rho) - min(rho) AS spread FROM rho GROUP BY first, second"))
def corr_drift(source):
    return correlations(source, "year").groupBy("first", "second").agg((F.max("rho") - F.min("rho")).alias("spread"))


@register("corr_redundant", sql.query(*_rho_sql(""), "SELECT first, second, abs(round(rho, 9)) > 0.7 AS redundant, abs(round(rho, 9)) < 0.5 AS combinable FROM rho"))
def redundant(source):
    rho = F.abs(F.round("rho", 9))
    return correlations(source).select("first", "second", (rho > 0.7).alias("redundant"), (rho < 0.5).alias("combinable"))
