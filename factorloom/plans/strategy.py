"""Queries on composites, holdings, backtests, performance and monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.expressions import correlation, safe_div
from factorloom.operators.backtest import nav_fold, nav_proportional, period_returns, stop_losses, stopped_nav, trade_cost, trades, turnover, vol_target
from factorloom.operators.combine import banded, composite, dynamic_weights, ranks, select_by_size, top_n, universe, weigh, with_inertia, with_penalty
from factorloom.operators.evaluate import rank_ic
from factorloom.operators.monitor import ALERTS, VERSION_SCHEMA, append_version, breaches, version_steps
from factorloom.operators.performance import calendar_returns, drawdown_curve, metrics, recovery, report
from factorloom.plans import sql
from factorloom.plans.catalog import register
from factorloom.plans.market import labelled
from factorloom.sources.panel import calendar
from factorloom.sources.scratch import fresh_path
from factorloom.streaming.alerts import daily_alerts

N = 20
RATE = 0.002
BOTH = f"rk AS (SELECT *, {sql.share_rank('ep', 'trade_date')} AS ep_rank, {sql.share_rank('vol', 'trade_date')} AS vol_rank FROM lab WHERE ep IS NOT NULL AND vol IS NOT NULL)"
SCORED = "sc AS (SELECT *, (ep_rank + vol_rank) / 2.0 AS score FROM rk)"
OK = "ok AS (SELECT * FROM sc WHERE NOT is_st AND list_days >= 60 AND NOT is_suspend)"
PICKED = sql.top("pk", "ok", N, "score")
CAL = "nx AS (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS next_date FROM (SELECT DISTINCT trade_date FROM lab))"
WEIGHTS = "wt AS (SELECT trade_date, code, score, fwd, industry, market_cap, 1.0 / count(*) OVER (PARTITION BY trade_date) AS weight FROM pk)"
GROSS = "gr AS (SELECT trade_date, sum(weight * coalesce(fwd, 0.0)) AS gross FROM wt GROUP BY trade_date)"
TRADES = """dr AS (SELECT n.next_date AS trade_date, code, weight * (1 + coalesce(fwd, 0.0)) / nullif(sum(weight * (1 + coalesce(fwd, 0.0))) OVER (PARTITION BY w.trade_date), 0) AS drifted FROM wt w JOIN nx n USING (trade_date)),
dk AS (SELECT * FROM dr WHERE trade_date IN (SELECT trade_date FROM wt)),
td AS (SELECT coalesce(w.trade_date, d.trade_date) AS trade_date, coalesce(w.code, d.code) AS code, coalesce(weight, 0.0) - coalesce(drifted, 0.0) AS change FROM wt w FULL JOIN dk d ON w.trade_date = d.trade_date AND w.code = d.code)"""
NAV = f"""co AS (SELECT trade_date, sum(abs(change)) * {RATE} AS cost FROM td GROUP BY trade_date),
nt AS (SELECT trade_date, cost, (1 - cost) * (1 + gross) - 1 AS net FROM gr JOIN co USING (trade_date))"""
BENCH = "bn AS (SELECT trade_date, avg(fwd) AS bench_ret FROM lab GROUP BY trade_date), rt AS (SELECT trade_date, net AS ret, bench_ret FROM nt JOIN bn USING (trade_date) WHERE bench_ret IS NOT NULL)"
BASE = (BOTH, SCORED, OK, PICKED, CAL, WEIGHTS, GROSS, TRADES, NAV)


def scored(source) -> DataFrame:
    rows = ranks(labelled(source).where("ep is not null and vol is not null"), "ep", "vol")
    return composite(rows, {"ep_rank": 1.0, "vol_rank": 1.0})


def picked(source) -> DataFrame:
    """The holdings: a few names of each date, written as every plan on them branches."""
    return source.once("picked", lambda: top_n(universe(scored(source)), N))


def book(source) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Weights, labels, gross returns and trades of the example strategy."""
    labels = labelled(source)
    weights = weigh(picked(source), "equal").select("trade_date", "code", "weight")
    return weights, labels, period_returns(weights, labels), trades(weights, labels, calendar(labels))


def strategy_returns(source) -> DataFrame:
    """trade_date, ret after costs, bench_ret."""
    _, labels, gross, traded = book(source)
    bench = labels.groupBy("trade_date").agg(F.avg("fwd").alias("bench_ret")).where("bench_ret is not null")
    return nav_proportional(gross, traded, RATE).select("trade_date", F.col("net").alias("ret")).join(bench, "trade_date")


@register("composite_equal", sql.query(BOTH, SCORED, "SELECT trade_date, code, score FROM sc"))
def composite_equal(source):
    return scored(source).select("trade_date", "code", "score")


_ICS = sql.ic("ea", "ep") + ", " + sql.ic("eb", "vol")
# a date's IC is known when its label is, a date later: weights of a date rest on the ICs before it
_PAST = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_KNOWN = """kn AS (SELECT trade_date, {0} OVER w AS a, {1} OVER w AS b FROM (SELECT DISTINCT trade_date FROM lab) LEFT JOIN (SELECT trade_date, ic AS ia FROM ea) USING (trade_date) LEFT JOIN (SELECT trade_date, ic AS ib FROM eb) USING (trade_date) WINDOW w AS (ORDER BY trade_date {2}))"""


def known_ics(source) -> DataFrame:
    """A row for each date: the ICs of both factors, null where there are too few names."""
    rows = labelled(source)
    dates = rows.select("trade_date").distinct()
    for factor, name in (("ep", "ic_a"), ("vol", "ic_b")):
        dates = dates.join(rank_ic(rows, factor).select("trade_date", F.col("ic").alias(name)), "trade_date", "left")
    return dates


def weighted(source, weights: DataFrame) -> DataFrame:
    """The composite of both ranks under a date's weights ``a`` and ``b``; null where they are not known."""
    both = ranks(labelled(source).where("ep is not null and vol is not null"), "ep", "vol").join(F.broadcast(weights), "trade_date")  # a row for each date
    return both.select("trade_date", "code", safe_div(F.col("ep_rank") * F.col("a") + F.col("vol_rank") * F.col("b"), F.abs("a") + F.abs("b")).alias("score"))


for _name, _w in (("composite_ic", "avg({0})"), ("composite_icir", "avg({0}) OVER w / nullif(stddev_samp({0}) OVER w, 0)")):
    _a, _b = (_w.format(x).removesuffix(" OVER w") for x in ("ia", "ib"))
    _known = _KNOWN.format(_a, _b, _PAST) if _name == "composite_ic" else _KNOWN.replace("{0} OVER w", _a).replace("{1} OVER w", _b).replace("{2}", _PAST)

    @register(_name, sql.query(BOTH, _ICS, _known, "SELECT trade_date, code, (ep_rank * a + vol_rank * b) / nullif(abs(a) + abs(b), 0) AS score FROM rk JOIN kn USING (trade_date)"))
    def _weighted(source, ratio=_name == "composite_icir"):
        """Expanding means (or their ratio to the deviation) of the ICs known on the date, with their sign."""
        past = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, -1)
        stat = lambda c: safe_div(F.avg(c).over(past), F.stddev_samp(c).over(past)) if ratio else F.avg(c).over(past)
        return weighted(source, known_ics(source).select("trade_date", stat("ic_a").alias("a"), stat("ic_b").alias("b")))


_TWELVE = "ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING"
_ROLL = _KNOWN.replace("{0} OVER w", "CASE WHEN count(ia) OVER w = 12 THEN avg(ia) OVER w END").replace("{1} OVER w", "CASE WHEN count(ib) OVER w = 12 THEN avg(ib) OVER w END").replace("{2}", _TWELVE)
_DYNAMIC = "dw AS (SELECT trade_date, CASE WHEN greatest(a, 0) + greatest(b, 0) = 0 THEN 0.5 ELSE greatest(a, 0) / nullif(greatest(a, 0) + greatest(b, 0), 0) END AS a_weight, CASE WHEN greatest(a, 0) + greatest(b, 0) = 0 THEN 0.5 ELSE greatest(b, 0) / nullif(greatest(a, 0) + greatest(b, 0), 0) END AS b_weight FROM kn WHERE a IS NOT NULL AND b IS NOT NULL)"


def rolled_weights(source) -> DataFrame:
    w = Window.orderBy("trade_date").rowsBetween(-12, -1)
    roll = lambda c: F.when(F.count(c).over(w) == 12, F.avg(c).over(w))
    both = known_ics(source).select("trade_date", roll("ic_a").alias("a"), roll("ic_b").alias("b")).where("a is not null and b is not null")
    return dynamic_weights(both, "a", "b").select("trade_date", "a_weight", "b_weight")


@register("dynamic_weights", sql.query(_ICS, _ROLL, _DYNAMIC, "SELECT * FROM dw"))
def dynamic(source):
    return rolled_weights(source)


@register("composite_dynamic", sql.query(BOTH, _ICS, _ROLL, _DYNAMIC, "SELECT trade_date, code, ep_rank * a_weight + vol_rank * b_weight AS score FROM rk JOIN dw USING (trade_date)"))
def composite_dynamic(source):
    return weighted(source, rolled_weights(source).select("trade_date", F.col("a_weight").alias("a"), F.col("b_weight").alias("b")))


_ON = """ro AS (SELECT trade_date, CASE WHEN count(ia) OVER w = 12 THEN avg(ia) OVER w END AS ra, CASE WHEN count(ib) OVER w = 12 THEN avg(ib) OVER w END AS rb FROM (SELECT DISTINCT trade_date FROM lab) LEFT JOIN (SELECT trade_date, ic AS ia FROM ea) USING (trade_date) LEFT JOIN (SELECT trade_date, ic AS ib FROM eb) USING (trade_date) WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
sw AS (SELECT trade_date, CASE WHEN count(ra) OVER t = 3 AND sum(ra) OVER t < 0 THEN 0.0 ELSE 1.0 END AS a, CASE WHEN count(rb) OVER t = 3 AND sum(rb) OVER t < 0 THEN 0.0 ELSE 1.0 END AS b FROM ro WINDOW t AS (ORDER BY trade_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""


@register("composite_switched", sql.query(BOTH, _ICS, _ON, "SELECT trade_date, code, (ep_rank * a + vol_rank * b) / nullif(a + b, 0)::DOUBLE AS score FROM rk JOIN sw USING (trade_date)"))
def composite_switched(source):
    """Equal weights of the factors that are on: those whose last three rolling ICs don't add up below 0."""
    w, t = Window.orderBy("trade_date").rowsBetween(-12, -1), Window.orderBy("trade_date").rowsBetween(-2, 0)
    roll = lambda c: F.when(F.count(c).over(w) == 12, F.avg(c).over(w))
    rolled = known_ics(source).select("trade_date", roll("ic_a").alias("ra"), roll("ic_b").alias("rb"))
    on = lambda c: F.when((F.count(c).over(t) == 3) & (F.sum(c).over(t) < 0), 0.0).otherwise(1.0)
    return weighted(source, rolled.select("trade_date", on("ra").alias("a"), on("rb").alias("b")))


@register("select_top_n", sql.query(BOTH, SCORED, OK, PICKED, "SELECT trade_date, code, score, place::INT AS place FROM pk"))
def select_top(source):
    return picked(source).select("trade_date", "code", "score", "place")


@register("select_by_size", sql.query(BOTH, SCORED, sql.groups("cut", "market_cap", 3, "sc", "size_group"), sql.top("bs", "(SELECT * FROM cut WHERE size_group IS NOT NULL)", 5, "score", "size_group"), "SELECT trade_date, code, size_group, place::INT AS place FROM bs"))
def by_size(source):
    return select_by_size(scored(source), 5).select("trade_date", "code", "size_group", "place")


@register("industry_cap", sql.query(BOTH, SCORED, sql.top("ic", "sc", 2, "score", "industry"), "SELECT trade_date, code, industry, place::INT AS place FROM ic"))
def industry_cap(source):
    return top_n(scored(source), 2, "industry").select("trade_date", "code", "industry", "place")


_HELD = "hd AS (SELECT n.next_date AS trade_date, code, true AS held FROM pk JOIN nx n USING (trade_date))"


def held(source) -> DataFrame:
    rows = picked(source)
    return rows.join(calendar(labelled(source)), "trade_date").where("next_date is not null").select(F.col("next_date").alias("trade_date"), "code")


@register("inertia", sql.query(*BASE[:5], _HELD, "sb AS (SELECT o.* EXCLUDE (score), score + CASE WHEN held THEN 0.1 ELSE 0.0 END AS score FROM ok o LEFT JOIN hd USING (trade_date, code))", sql.top("ti", "sb", N, "score"), "SELECT trade_date, code, score FROM ti"))
def inertia(source):
    return top_n(with_inertia(universe(scored(source)), held(source), 0.1), N).select("trade_date", "code", "score")


@register("turnover_penalty", sql.query(*BASE[:5], _HELD, "sb AS (SELECT o.* EXCLUDE (score), score - 0.05 + CASE WHEN held THEN 0.05 ELSE 0.0 END AS score FROM ok o LEFT JOIN hd USING (trade_date, code))", sql.top("ti", "sb", N, "score"), "SELECT trade_date, code, score FROM ti"))
def penalty(source):
    return top_n(with_penalty(universe(scored(source)), held(source), 0.05), N).select("trade_date", "code", "score")


@register("buffer_band", sql.query(BOTH, SCORED, "pl AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC NULLS LAST, code) AS place FROM sc)", "el AS (SELECT *, max(CASE WHEN place <= 20 THEN trade_date END) OVER w AS entered, max(CASE WHEN place > 30 THEN trade_date END) OVER w AS left_at FROM pl WINDOW w AS (PARTITION BY code ORDER BY trade_date ROWS UNBOUNDED PRECEDING))", "SELECT trade_date, code, place::INT AS place FROM el WHERE coalesce(entered > left_at, entered IS NOT NULL)"))
def band(source):
    return banded(scored(source), 20, 10).select("trade_date", "code", "place")


for _how, _raw in (("equal", "1.0"), ("cap", "market_cap"), ("factor", "score - min(score) OVER (PARTITION BY trade_date) + 1.0"), ("inverse_vol", "1.0 / nullif(abs(vol), 0)")):

    @register(f"weights_{_how}", sql.query(BOTH, SCORED, OK, PICKED, f"rw AS (SELECT *, {_raw} AS raw FROM pk)", "SELECT trade_date, code, raw / nullif(sum(raw) OVER (PARTITION BY trade_date), 0)::DOUBLE AS weight FROM rw"))
    def _weigh(source, how=_how):
        return weigh(picked(source), how, "vol" if how == "inverse_vol" else "score").select("trade_date", "code", "weight")


@register("trades", sql.query(*BASE, "SELECT * FROM td"))
def trade_list(source):
    return book(source)[3]


@register("turnover", sql.query(*BASE, "SELECT trade_date, 0.5 * sum(abs(change)) AS turnover FROM td GROUP BY trade_date"))
def turned(source):
    return turnover(book(source)[3])


@register("trade_cost", sql.query(*BASE, "vl AS (SELECT trade_date, change * 1e6 AS v FROM td)", "SELECT trade_date, sum(greatest(abs(v) * 0.0003, 5.0) * 2 + abs(v) * 0.001 + CASE WHEN v > 0 THEN 0.0 ELSE abs(v) * 0.001 END) AS cost FROM vl GROUP BY trade_date"))
def cost(source):
    value = F.col("change") * 1e6
    return book(source)[3].groupBy("trade_date").agg(F.sum(trade_cost(value, value > 0)).alias("cost"))


@register("sold_names", sql.query(*BASE, "SELECT trade_date, code FROM dk WHERE (trade_date, code) NOT IN (SELECT (trade_date, code) FROM wt)"))
def sold(source):
    weights, labels, _, _ = book(source)
    before = weights.join(calendar(labels), "trade_date").where("next_date is not null").select(F.col("next_date").alias("trade_date"), "code")
    return before.join(weights.select("trade_date").distinct(), "trade_date", "left_semi").join(weights, ["trade_date", "code"], "left_anti")


@register("concentration", sql.query(BOTH, SCORED, OK, PICKED, "cw AS (SELECT trade_date, market_cap / sum(market_cap) OVER (PARTITION BY trade_date) AS weight, row_number() OVER (PARTITION BY trade_date ORDER BY market_cap DESC, code) AS r FROM pk)", "SELECT trade_date, sum(weight) AS top5 FROM cw WHERE r <= 5 GROUP BY trade_date"))
def concentration(source):
    place = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("market_cap"), "code"))
    return weigh(picked(source), "cap").withColumn("r", place).where("r <= 5").groupBy("trade_date").agg(F.sum("weight").alias("top5"))


@register("attribution", sql.query(*BASE[:6], "SELECT industry, trade_date, sum(weight * coalesce(fwd, 0.0)) AS contribution FROM wt GROUP BY GROUPING SETS ((industry), (trade_date), ())"))
def attribution(source):
    rows = weigh(picked(source), "equal").select("trade_date", "industry", (F.col("weight") * F.coalesce("fwd", F.lit(0.0))).alias("x"))
    return rows.groupingSets([[F.col("industry")], [F.col("trade_date")], []], "industry", "trade_date").agg(F.sum("x").alias("contribution"))


@register("holdings_profile", sql.query(*BASE[:6], "SELECT trade_date, count(*) AS names, count(DISTINCT industry) AS industries, quantile_cont(market_cap, 0.25) AS cap_q1, quantile_cont(market_cap, 0.5) AS cap_median, quantile_cont(market_cap, 0.75) AS cap_q3 FROM wt GROUP BY trade_date"))
def profile(source):
    q = F.percentile("market_cap", [0.25, 0.5, 0.75])
    rows = picked(source).groupBy("trade_date").agg(F.count("*").alias("names"), F.countDistinct("industry").alias("industries"), q.alias("q"))
    return rows.select("trade_date", "names", "industries", F.col("q")[0].alias("cap_q1"), F.col("q")[1].alias("cap_median"), F.col("q")[2].alias("cap_q3"))


@register("nav_proportional", sql.query(*BASE, "SELECT trade_date, cost, net, product(1 + net) OVER (ORDER BY trade_date) AS nav FROM nt"))
def nav(source):
    _, _, gross, traded = book(source)
    return nav_proportional(gross, traded, RATE)


_FOLD = """dy AS (SELECT g.trade_date, gross, chg, row_number() OVER (ORDER BY g.trade_date) AS k FROM gr g JOIN (SELECT trade_date, list(change ORDER BY code) AS chg FROM td GROUP BY trade_date) USING (trade_date)),
fo(k, value, cost) AS (SELECT 0::BIGINT, {0}::DOUBLE, 0.0::DOUBLE UNION ALL
SELECT d.k, (f.value - c.fee) * (1 + gross), f.cost + c.fee FROM fo f JOIN dy d ON d.k = f.k + 1,
LATERAL (SELECT list_sum(list_transform(d.chg, lambda x: CASE WHEN x = 0 THEN 0.0 ELSE greatest(abs(x * f.value) * 0.0003, 5.0) * 2 + abs(x * f.value) * 0.001 + CASE WHEN x > 0 THEN 0.0 ELSE abs(x * f.value) * 0.001 END END)) AS fee) c)"""


@register("nav_fold", sql.query(*BASE, _FOLD.format("1000000.0"), "SELECT value, cost FROM fo ORDER BY k DESC LIMIT 1"))
def folded(source):
    _, _, gross, traded = book(source)
    return nav_fold(gross, traded, 1_000_000.0)


@register("nav_stop", sql.query(*BASE, BENCH, "dy AS (SELECT ret, row_number() OVER (ORDER BY trade_date) AS k FROM rt)", "fo(k, nav, peak, cut) AS (SELECT 0::BIGINT, 1.0::DOUBLE, 1.0::DOUBLE, 0 UNION ALL SELECT d.k, f.nav * (1 + CASE WHEN f.nav / f.peak - 1 < -0.15 THEN 0.5 ELSE 1.0 END * ret), greatest(f.peak, f.nav * (1 + CASE WHEN f.nav / f.peak - 1 < -0.15 THEN 0.5 ELSE 1.0 END * ret)), f.cut + (f.nav / f.peak - 1 < -0.15)::INT FROM fo f JOIN dy d ON d.k = f.k + 1)", "SELECT nav, peak, cut AS cut_steps FROM fo ORDER BY k DESC LIMIT 1"))
def nav_stop(source):
    return stopped_nav(strategy_returns(source))


@register("stop_loss", sql.query("pr AS (SELECT code, trade_date, close, date_trunc('quarter', trade_date)::DATE AS period FROM lab WHERE close IS NOT NULL)", "cs AS (SELECT *, first_value(close) OVER (PARTITION BY code, period ORDER BY trade_date) AS cost FROM pr)", "SELECT code, period, min(CASE WHEN close / cost - 1 < -0.1 THEN trade_date END) AS stop_date FROM cs GROUP BY code, period"))
def stops(source):
    rows = labelled(source).where("close is not null").select("code", "trade_date", "close", F.trunc("trade_date", "quarter").alias("period"))
    return stop_losses(rows.withColumn("cost", F.first("close").over(Window.partitionBy("code", "period").orderBy("trade_date"))))


@register("vol_target", sql.query("b AS (SELECT DISTINCT trade_date, bench FROM lab)", "v AS (SELECT trade_date, CASE WHEN count(bench) OVER w = 12 THEN stddev_samp(bench) OVER w * sqrt(12) END AS vol FROM b WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))", "SELECT trade_date, vol, CASE WHEN vol > 0.1 THEN 0.1 / vol ELSE 1.0 END AS position FROM v"))
def target_vol(source):
    bench = labelled(source).groupBy("trade_date").agg(F.first("bench").alias("bench"))
    w = Window.orderBy("trade_date").rowsBetween(-11, 0)
    vol = F.when(F.count("bench").over(w) == 12, F.stddev_samp("bench").over(w) * F.sqrt(F.lit(12.0)))
    return bench.select("trade_date", vol.alias("vol")).withColumn("position", vol_target(F.col("vol"), 0.1))


_M = "n, cumulative, annual_return, bench_annual, annual_vol, downside_vol, upside_vol, information_ratio, max_drawdown, win_rate, profit_loss"
_CURVE = "nv AS (SELECT *, product(1 + ret) OVER (ORDER BY trade_date) AS nav FROM rt), dd AS (SELECT *, max(nav) OVER (ORDER BY trade_date) AS peak, (nav - max(nav) OVER (ORDER BY trade_date)) / max(nav) OVER (ORDER BY trade_date) AS drawdown FROM nv)"
_METRICS = """mt AS (SELECT count(*) AS n, product(1 + ret) - 1 AS cumulative, power(product(1 + ret), 12.0 / count(ret)) - 1 AS annual_return, power(product(1 + bench_ret), 12.0 / count(bench_ret)) - 1 AS bench_annual,
stddev_samp(ret) * sqrt(12) AS annual_vol, stddev_samp(CASE WHEN ret < 0 THEN ret END) * sqrt(12) AS downside_vol, stddev_samp(CASE WHEN ret > 0 THEN ret END) * sqrt(12) AS upside_vol,
avg(ret - bench_ret) / nullif(stddev_samp(ret - bench_ret), 0) * sqrt(12) AS information_ratio, min(drawdown) AS max_drawdown, avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS win_rate,
avg(CASE WHEN ret > 0 THEN ret END) / nullif(abs(avg(CASE WHEN ret < 0 THEN ret END)), 0) AS profit_loss FROM dd)"""
_RATIOS = "mr AS (SELECT *, annual_return - bench_annual AS excess, (annual_return - 0.03) / nullif(annual_vol, 0) AS sharpe, (annual_return - 0.03) / nullif(downside_vol, 0) AS sortino, annual_return / nullif(abs(max_drawdown), 0) AS calmar FROM mt)"
PERF = (*BASE, BENCH, _CURVE, _METRICS, _RATIOS)


@register("perf_metrics", sql.query(*PERF, f"SELECT {_M}, excess, sharpe, sortino, calmar FROM mr"))
def perf(source):
    return metrics(strategy_returns(source), 12)


@register("perf_report", sql.query(*PERF, "SELECT format('{:.2f}%', annual_return * 100) AS annual_return, format('{:.2f}%', annual_vol * 100) AS annual_vol, format('{:.2f}', sharpe) AS sharpe, format('{:.2f}', information_ratio) AS information_ratio, format('{:.2f}%', max_drawdown * 100) AS max_drawdown, format('{:.2f}', calmar) AS calmar FROM mr"))
def perf_report(source):
    return report(metrics(strategy_returns(source), 12))


@register("drawdown_curve", sql.query(*BASE, BENCH, _CURVE, "SELECT trade_date, nav, peak, drawdown FROM dd"))
def curve(source):
    return drawdown_curve(strategy_returns(source)).select("trade_date", "nav", "peak", "drawdown")


@register("drawdown_with_start", sql.query(*BASE, BENCH, _CURVE, "SELECT trade_date, (nav - greatest(peak, 1.0)) / greatest(peak, 1.0) AS drawdown FROM dd"))
def curve_from_start(source):
    return drawdown_curve(strategy_returns(source), include_initial=True).select("trade_date", "drawdown")


@register("recovery_time", sql.query(*BASE, BENCH, _CURVE, "tr AS (SELECT arg_min(trade_date, (drawdown, trade_date)) AS trough_date, arg_min(peak, (drawdown, trade_date)) AS old_peak FROM dd)", "f AS (SELECT any_value(trough_date) AS trough_date, max(CASE WHEN trade_date <= trough_date AND drawdown = 0 THEN trade_date END) AS peak_date, min(CASE WHEN trade_date > trough_date AND nav >= old_peak THEN trade_date END) AS recovered_date FROM dd, tr)", "SELECT *, (recovered_date - trough_date)::INT AS days FROM f"))
def recovery_time(source):
    return recovery(drawdown_curve(strategy_returns(source)))


for _unit in ("month", "quarter", "year"):

    @register(f"{_unit}ly_returns", sql.query(*BASE, BENCH, f"SELECT date_trunc('{_unit}', trade_date)::DATE AS period, product(1 + ret) - 1 AS ret, count(*) AS n FROM rt GROUP BY 1"))
    def _calendar(source, unit=_unit):
        return calendar_returns(strategy_returns(source), unit)


@register("out_of_sample", sql.query(*BASE, BENCH, "SELECT trade_date >= DATE '2000-01-01' AS out_of_sample, avg(ret) AS mean, stddev_samp(ret) AS std FROM rt GROUP BY 1"))
def out_of_sample(source):
    return strategy_returns(source).groupBy((F.col("trade_date") >= F.lit("2000-01-01").cast("date")).alias("out_of_sample")).agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"))


@register("cost_share", sql.query(*BASE, "SELECT sum(cost) / nullif(sum(gross), 0) AS cost_share FROM nt JOIN gr USING (trade_date)"))
def share(source):
    _, _, gross, traded = book(source)
    return nav_proportional(gross, traded, RATE).join(gross, "trade_date").agg(safe_div(F.sum("cost"), F.sum("gross")).alias("cost_share"))


@register("style_drift", sql.query(*BASE[:4], "SELECT trade_date, avg(ep_rank) AS ep_exposure, avg(vol_rank) AS vol_exposure FROM pk GROUP BY trade_date"))
def drift(source):
    return picked(source).groupBy("trade_date").agg(F.avg("ep_rank").alias("ep_exposure"), F.avg("vol_rank").alias("vol_exposure"))


@register("behind_benchmark", sql.query(*BASE, BENCH, "f AS (SELECT trade_date, ret < bench_ret AS behind FROM rt)", "SELECT trade_date, bool_and(behind) OVER w AND count(*) OVER w = 3 AS three_behind FROM f WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"))
def behind(source):
    w = Window.orderBy("trade_date").rowsBetween(-2, 0)
    return strategy_returns(source).select("trade_date", (F.bool_and(F.col("ret") < F.col("bench_ret")).over(w) & (F.count("*").over(w) == 3)).alias("three_behind"))


def _rules_sql(rules, source: str, keep: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {keep}'{name}' AS rule, {m}::DOUBLE AS value, {limit}::DOUBLE AS \"limit\" FROM {source} WHERE {m} {op} {limit}" for name, m, op, limit in rules)


_LIVE = """tv AS (SELECT trade_date, 0.5 * sum(abs(change)) AS turnover FROM td GROUP BY trade_date),
cw AS (SELECT trade_date, market_cap / sum(market_cap) OVER (PARTITION BY trade_date) AS weight, row_number() OVER (PARTITION BY trade_date ORDER BY market_cap DESC, code) AS r FROM pk),
t5 AS (SELECT trade_date, sum(weight) AS top5 FROM cw WHERE r <= 5 GROUP BY trade_date),
al AS (SELECT trade_date, ic, turnover, drawdown, top5 FROM dd JOIN tv USING (trade_date) JOIN t5 USING (trade_date) LEFT JOIN ics USING (trade_date))"""


def live(source) -> DataFrame:
    rows = drawdown_curve(strategy_returns(source)).select("trade_date", "drawdown")
    return rows.join(turned(source), "trade_date").join(concentration(source), "trade_date").join(rank_ic(labelled(source), "ep").select("trade_date", "ic"), "trade_date", "left")


@register("alerts", sql.query(*BASE, BENCH, _CURVE, sql.ic("ics", "ep"), _LIVE, _rules_sql(ALERTS, "al", "trade_date, ")))
def alerts(source):
    return breaches(live(source), ALERTS, "trade_date")


@register("daily_alerts", "SELECT user_id, ts::DATE AS day, sum(value) AS total FROM events GROUP BY ALL HAVING sum(value) > 100")
def event_alerts(source):
    return daily_alerts(source.table("events").withColumn("ts", F.col("ts").cast("timestamp")), 100.0)


_VERSIONS = (
    *BASE, BENCH,
    "vy AS (SELECT *, year(trade_date) AS y, product(1 + ret) OVER (PARTITION BY year(trade_date) ORDER BY trade_date) AS nav FROM rt)",
    "vd AS (SELECT *, (nav - max(nav) OVER w) / max(nav) OVER w AS drawdown FROM vy WINDOW w AS (PARTITION BY y ORDER BY trade_date))",
    "vm AS (SELECT 'v' || y AS version, make_date(y, 12, 31) AS date, CASE WHEN product(1 + ret) > 0 THEN power(product(1 + ret), 12.0 / count(ret)) - 1 END AS annual_return, stddev_samp(ret) * sqrt(12) AS vol, abs(min(drawdown)) AS max_dd FROM vd GROUP BY y)",
    "v AS (SELECT version, date, annual_return, (annual_return - 0.03) / nullif(vol, 0) AS sharpe, max_dd FROM vm)",
)


@register("version_compare", sql.query(*_VERSIONS, "SELECT version, date, annual_return - lag(annual_return) OVER w AS annual_return_gain, sharpe - lag(sharpe) OVER w AS sharpe_gain, max_dd - lag(max_dd) OVER w AS max_dd_gain, coalesce(sharpe - lag(sharpe) OVER w < 0.05, false) AS stop FROM v WINDOW w AS (ORDER BY version)"))
def versions(source):
    """Each year's review is a version that is appended to the log, with the year's figures; the log is read back and compared."""
    year = F.year("trade_date")
    rets = strategy_returns(source).select("trade_date", "ret", "bench_ret", F.concat(F.lit("v"), year.cast("string")).alias("version"), F.make_date(year, F.lit(12), F.lit(31)).alias("date"))
    figures = F.struct("annual_return", "sharpe", F.abs("max_drawdown").alias("max_dd")).alias("performance")
    reviewed = metrics(rets, 12, keys=("version", "date"))
    path = fresh_path(source.spark, "versions")
    append_version(reviewed.select("version", "date", F.lit("yearly review").alias("description"), F.array().cast("array<string>").alias("changes"), F.lit("{}").alias("params"), figures), path)
    return version_steps(source.spark.read.schema(VERSION_SCHEMA).parquet(path))


@register("strategy_gap", sql.query(*BASE, sql.layers("lay", "ep"), 'SELECT trade_date, ret - net AS gap FROM lay JOIN nt USING (trade_date) WHERE "group" = 5'))
def gap(source):
    from factorloom.operators.evaluate import layer_returns

    _, labels, gross, traded = book(source)
    top = layer_returns(labels, "ep").where("group = 5").select("trade_date", "ret")
    return top.join(nav_proportional(gross, traded, RATE), "trade_date").select("trade_date", (F.col("ret") - F.col("net")).alias("gap"))


@register("mc_bootstrap")
def bootstrap(source):
    """Resampled annual returns: each path draws its months by hash, so reruns agree; rows only."""
    rets = strategy_returns(source).select("ret").agg(F.array_sort(F.collect_list("ret")).alias("rets"))
    paths = source.spark.range(200).select(F.col("id").alias("path")).join(F.broadcast(rets))
    draw = lambda k: F.element_at("rets", (F.pmod(F.xxhash64(F.col("path"), k), F.size("rets")) + 1).cast("int"))
    growth = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(1.0), lambda total, k: total * (1 + draw(k)))
    return paths.where("size(rets) > 0").select("path", (growth - 1).alias("annual_return"))


@register("market_correlation", sql.query("b AS (SELECT code, ret, bench FROM lab WHERE ret IS NOT NULL AND bench IS NOT NULL)", f"SELECT code, {sql.corr('ret', 'bench')} AS rho FROM b GROUP BY code"))
def market_correlation(source):
    return labelled(source).groupBy("code").agg(correlation(F.col("ret"), F.col("bench")).alias("rho"))
