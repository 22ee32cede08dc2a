"""Queries on daily backtests, point-in-time data, the parameter grid, reviews and diagnosis."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.expressions import safe_div
from factorloom.operators.backtest import BacktestConfig, Strategy, hold
from factorloom.operators.combine import composite, ranks, universe, weigh
from factorloom.operators.evaluate import moments
from factorloom.operators.factors import LIBRARY, pandas_factor
from factorloom.operators.monitor import DAILY_ALERTS, WEEKLY_ALERTS, breaches
from factorloom.operators.performance import drawdown_curve, metrics
from factorloom.plans import sql
from factorloom.plans.catalog import register
from factorloom.plans.market import FACTOR_SQL, FACTOR_WINDOWS, labelled
from factorloom.plans.strategy import BASE, BENCH, BOTH, N, OK, PICKED, SCORED, book, picked, strategy_returns, turned
from factorloom.sources.panel import PanelSource, daily_prices, monthly_panel, trading_days
from factorloom.sources.point_in_time import as_of, members_at
from factorloom.sources.scratch import written


@dataclass(frozen=True)
class ValueLowVol(Strategy):
    """The ranks of earnings yield and of low volatility, weighted, of names that may be bought.

    A name that rose by ``max_rise`` or more stands at its limit, so no order to buy it is filled: it is no
    candidate, and the next best takes its place. None: all may be bought.
    """

    value: float = 1.0
    low_vol: float = 1.0
    max_rise: float | None = None

    def signals(self, panel: DataFrame) -> DataFrame:
        both = ranks(panel.where("ep is not null and vol is not null"), "ep", "vol")
        able = universe(composite(both, {"ep_rank": self.value, "vol_rank": self.low_vol}))
        return able if self.max_rise is None else able.where(F.coalesce(F.col("ret") < self.max_rise, F.lit(True)))


def prices(source: PanelSource) -> DataFrame:
    return source.once("prices", lambda: daily_prices(source))


def prices_of(source: PanelSource, held: DataFrame) -> DataFrame:
    """Daily prices of the names of ``held``, a written table, on the days of all."""
    return written(daily_prices(source, held.select("code").distinct()), "prices")


DAYS = """px AS (SELECT l_suppkey AS code, l_shipdate::DATE AS day, sum(l_extendedprice::DECIMAL(18,4))::DOUBLE AS amount, sum(l_extendedprice::DECIMAL(18,4))::DOUBLE / nullif(sum(l_quantity::DECIMAL(18,4))::DOUBLE, 0) AS close FROM lineitem GROUP BY ALL),
dp AS (SELECT c.code, d.day AS trade_date, last_value(p.close IGNORE NULLS) OVER (PARTITION BY c.code ORDER BY d.day) AS close, p.close IS NOT NULL AS traded, p.amount AS amount FROM (SELECT DISTINCT code FROM px) c CROSS JOIN (SELECT DISTINCT day FROM px) d LEFT JOIN px p ON p.code = c.code AND p.day = d.day)"""


def _backtest_sql(unit: str, chosen: tuple[str, ...] = (BOTH, SCORED, OK, PICKED)) -> tuple[str, ...]:
    return (
        *chosen,
        "wt AS (SELECT trade_date AS month, code, 1.0 / count(*) OVER (PARTITION BY trade_date) AS weight FROM pk)",
        DAYS,
        f"dy AS (SELECT trade_date, trade_date = max(trade_date) OVER (PARTITION BY {unit}) AS turn, trade_date = max(trade_date) OVER (PARTITION BY date_trunc('month', trade_date)) AS ends FROM (SELECT DISTINCT trade_date FROM dp))",
        "mk AS (SELECT trade_date, turn, max(CASE WHEN ends THEN date_trunc('month', trade_date)::DATE END) OVER (ORDER BY trade_date) AS month, max(CASE WHEN turn THEN trade_date END) OVER (ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bought FROM dy)",
        "hl AS (SELECT m.trade_date AS bought, w.code, weight, close AS cost FROM mk m JOIN wt w USING (month) LEFT JOIN dp d ON d.trade_date = m.trade_date AND d.code = w.code WHERE turn)",
        "pt AS (SELECT m.trade_date, m.bought, m.turn, h.code, weight * coalesce(d.close / nullif(cost, 0), 1.0) AS value FROM mk m JOIN hl h USING (bought) LEFT JOIN dp d ON d.trade_date = m.trade_date AND d.code = h.code)",
        "gw AS (SELECT bought, trade_date, turn, sum(value) AS growth FROM pt GROUP BY ALL)",
        "df AS (SELECT trade_date, code, value / sum(value) OVER (PARTITION BY trade_date) AS drifted FROM pt WHERE turn)",
        "tr AS (SELECT coalesce(h.bought, d.trade_date) AS trade_date, coalesce(h.code, d.code) AS code, coalesce(weight, 0.0) - coalesce(drifted, 0.0) AS change FROM hl h FULL JOIN df d ON h.bought = d.trade_date AND h.code = d.code)",
        "tc AS (SELECT *, abs(change) * (0.0003 * 2 + 0.001 + CASE WHEN change < 0 THEN 0.001 ELSE 0.0 END) AS cost FROM tr)",
        "bs AS (SELECT trade_date AS bought, product((1 - cost) * coalesce(growth, 1.0)) OVER (ORDER BY trade_date) AS base FROM (SELECT trade_date, sum(cost) AS cost FROM tc GROUP BY trade_date) k LEFT JOIN (SELECT trade_date, growth FROM gw WHERE turn) g USING (trade_date))",
        "nv AS (SELECT trade_date, 10000000.0 * base * growth AS nav FROM gw JOIN bs USING (bought))",
        "dd AS (SELECT trade_date, nav, (nav - max(nav) OVER (ORDER BY trade_date)) / max(nav) OVER (ORDER BY trade_date) AS drawdown FROM nv)",
    )


_UNITS = {"week": "date_trunc('week', trade_date)", "biweekly": "floor((trade_date - DATE '1970-01-05') / 14)", "month": "date_trunc('month', trade_date)", "quarter": "date_trunc('quarter', trade_date)"}


def run(source: PanelSource, freq: str = "month", strategy: Strategy = ValueLowVol()) -> tuple[DataFrame, DataFrame]:
    config = BacktestConfig(rebalance_freq=freq, max_holding=N)
    weights = written(strategy.weights(strategy.signals(labelled(source)), config), "weights")
    return hold(weights, prices_of(source, weights), config)


for _freq, _unit in _UNITS.items():

    @register(f"backtest_{_freq}", sql.query(*_backtest_sql(_unit), "SELECT * FROM dd"))
    def _backtest(source, freq=_freq):
        return run(source, freq)[0]


@register("backtest_trades", sql.query(*_backtest_sql(_UNITS["quarter"]), "SELECT * FROM tc"))
def backtest_trades(source):
    return run(source, "quarter")[1]


@register("backtest_holdings", sql.query(*_backtest_sql(_UNITS["quarter"]), "SELECT bought AS trade_date, map_from_entries(list((code, round(weight, 9)) ORDER BY code))::VARCHAR AS holdings FROM hl GROUP BY bought"))
def backtest_holdings(source):
    """The holdings that each rebalancing left, as a text of code=weight."""
    bought = ValueLowVol().weights(ValueLowVol().signals(labelled(source)), BacktestConfig(max_holding=N))
    ends = trading_days(source).groupBy(F.trunc("trade_date", "MM").alias("month"), F.trunc("trade_date", "quarter").alias("quarter")).agg(F.max("trade_date").alias("day"))
    turns = ends.groupBy("quarter").agg(F.max("day").alias("day")).join(ends, ["quarter", "day"])
    named = bought.withColumnRenamed("trade_date", "month").join(turns, "month")
    pair = F.concat(F.col("code").cast("string"), F.lit("="), F.round("weight", 9).cast("string"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("code", pair.alias("pair")))), lambda s: s["pair"])
    return named.groupBy(F.col("day").alias("trade_date")).agg(F.concat(F.lit("{"), F.array_join(texts, ", "), F.lit("}")).alias("holdings"))


@register("daily_quotes", sql.query(DAYS, "SELECT code, close, traded FROM dp WHERE trade_date = (SELECT max(trade_date) FROM dp)"))
def daily_quotes(source):
    rows = prices(source)
    last = rows.agg(F.max("trade_date").alias("trade_date"))
    return rows.join(F.broadcast(last), "trade_date").select("code", "close", "traded")


_DBENCH = "db AS (SELECT trade_date, avg(r) AS bench FROM (SELECT trade_date, close / nullif(lag(close) OVER (PARTITION BY code ORDER BY trade_date), 0) - 1 AS r FROM dp) GROUP BY trade_date)"


@register("bench_vol20", sql.query(DAYS, _DBENCH, "SELECT trade_date, CASE WHEN count(bench) OVER w = 20 THEN stddev_samp(bench) OVER w * sqrt(252) END AS vol FROM db WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"))
def bench_vol20(source):
    back = F.lag("close").over(Window.partitionBy("code").orderBy("trade_date"))
    bench = prices(source).select("trade_date", (safe_div(F.col("close"), back) - 1).alias("r")).groupBy("trade_date").agg(F.avg("r").alias("bench"))
    w = Window.orderBy("trade_date").rowsBetween(-19, 0)
    return bench.select("trade_date", F.when(F.count("bench").over(w) == 20, F.stddev_samp("bench").over(w) * F.sqrt(F.lit(252.0))).alias("vol"))


_DRET = "rd AS (SELECT trade_date, nav / lag(nav) OVER (ORDER BY trade_date) - 1 AS day_return, drawdown FROM dd), rw AS (SELECT date_trunc('week', trade_date)::DATE AS trade_date, product(1 + day_return) - 1 AS week_return FROM rd GROUP BY 1)"


@register("alerts_daily", sql.query(*_backtest_sql(_UNITS["month"]), _DRET, "SELECT trade_date, 'day loss' AS rule, day_return AS value, -0.03::DOUBLE AS \"limit\" FROM rd WHERE day_return < -0.03 UNION ALL SELECT trade_date, 'drawdown', drawdown, -0.15::DOUBLE FROM rd WHERE drawdown < -0.15 UNION ALL SELECT trade_date, 'week loss', week_return, -0.05::DOUBLE FROM rw WHERE week_return < -0.05"))
def alerts_daily(source):
    """Loss of a day, loss of a week, and drawdown of a day, each beyond its limit."""
    nav = source.once("nav", lambda: run(source)[0])  # a row for each day
    days = nav.withColumn("day_return", F.col("nav") / F.lag("nav").over(Window.orderBy("trade_date")) - 1)
    weeks = days.groupBy(F.trunc("trade_date", "week").alias("trade_date")).agg((F.product(1 + F.col("day_return")) - 1).alias("week_return"))
    return breaches(days, DAILY_ALERTS, "trade_date").unionByName(breaches(weeks, WEEKLY_ALERTS, "trade_date"))


# point in time


@register("published_roe", sql.query("pb AS (SELECT code, (trade_date + INTERVAL 2 MONTH)::DATE AS published, roe FROM panel WHERE roe IS NOT NULL)", "SELECT p.trade_date, p.code, b.roe AS known_roe, b.published FROM panel p ASOF LEFT JOIN pb b ON p.code = b.code AND p.trade_date >= b.published"))
def published_roe(source):
    """What was published by each date: figures of a month come out two months later."""
    panel = monthly_panel(source)
    published = panel.where("roe is not null").select("code", F.add_months("trade_date", 2).alias("published"), F.col("roe").alias("known_roe"))
    return as_of(panel.select("trade_date", "code"), published, "published")


_MEMBERS = """qe AS (SELECT date_trunc('quarter', trade_date)::DATE AS q, code, market_cap FROM panel WHERE month(trade_date) % 3 = 0),
ix AS (SELECT code, (q + INTERVAL 3 MONTH)::DATE AS "from", (q + INTERVAL 6 MONTH)::DATE - 1 AS "to" FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY market_cap DESC NULLS LAST, code) AS r FROM qe) WHERE r <= 30)"""


@register("index_members", sql.query(_MEMBERS, 'SELECT p.trade_date, p.code, p.close FROM panel p JOIN ix ON p.code = ix.code AND p.trade_date BETWEEN "from" AND "to"'))
def index_members(source):
    """Members of an index on each date: the 30 largest of a quarter, from the start of the next one to its end."""
    panel = monthly_panel(source)
    quarter = panel.where("month(trade_date) % 3 = 0").withColumn("q", F.trunc("trade_date", "quarter"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc_nulls_last("market_cap"), "code"))
    named = quarter.withColumn("r", place).where("r <= 30").select("code", F.add_months("q", 3).alias("from"), F.date_sub(F.add_months("q", 6), 1).alias("to"))
    return members_at(panel.select("trade_date", "code", "close"), named)


@register("tradable", sql.query(*BASE[:4], "SELECT trade_date, code, NOT is_suspend AND coalesce(ret < 0.1, true) AS tradable FROM pk"))
def tradable(source):
    """Whether a pick could be bought: it trades, and has not risen by its limit of a tenth."""
    return picked(source).select("trade_date", "code", (~F.col("is_suspend") & F.coalesce(F.col("ret") < 0.1, F.lit(True))).alias("tradable"))


_CAREFUL = ValueLowVol(value=2.0, low_vol=1.0, max_rise=0.1)
_CAREFUL_SQL = (BOTH, "sc AS (SELECT *, (2.0 * ep_rank + vol_rank) / 3.0 AS score FROM rk)", f"{OK[:-1]} AND coalesce(ret < 0.1, true))", PICKED)


@register("tradable_picks", sql.query(*_CAREFUL_SQL, "SELECT trade_date, code, 1.0 / count(*) OVER (PARTITION BY trade_date) AS weight FROM pk"))
def tradable_picks(source):
    """What a strategy with parameters of its own picks, of names whose orders can be filled."""
    return _CAREFUL.weights(_CAREFUL.signals(labelled(source)), BacktestConfig(max_holding=N))


@register("backtest_tradable", sql.query(*_backtest_sql(_UNITS["month"], _CAREFUL_SQL), "SELECT * FROM dd"))
def backtest_tradable(source):
    """Value and drawdown of the same strategy over daily prices."""
    return run(source, "month", _CAREFUL)[0]


@register("dropped_rows", sql.query("SELECT trade_date, count(*) AS n, count(*) - count(ep) AS no_ep, count(*) - count(mom) AS no_mom, count(*) - count(fwd) AS no_label FROM lab GROUP BY trade_date"))
def dropped_rows(source):
    """What guarded divisions and short histories leave out, so that nothing vanishes unseen."""
    missing = lambda c, name: (F.count("*") - F.count(c)).alias(name)
    return labelled(source).groupBy("trade_date").agg(F.count("*").alias("n"), missing("ep", "no_ep"), missing("mom", "no_mom"), missing("fwd", "no_label"))


@register("factor_pandas", sql.query(f"SELECT trade_date, code, {FACTOR_SQL['mas5']} AS mean5 FROM rets {FACTOR_WINDOWS}"))
def factor_pandas(source):
    """The escape hatch: five-row means by pandas, a security at a time."""
    return pandas_factor(monthly_panel(source).select("trade_date", "code", "close"), "mean5", lambda rows: rows["close"].astype(float).rolling(5).mean())


# holdings


@register("holdings_liquidity", sql.query(*BASE[:4], "SELECT trade_date, avg(amount) AS mean_amount, avg(market_cap) AS mean_cap FROM pk GROUP BY trade_date"))
def holdings_liquidity(source):
    return picked(source).groupBy("trade_date").agg(F.avg("amount").alias("mean_amount"), F.avg("market_cap").alias("mean_cap"))


@register("holdings_industries", sql.query(*BASE[:6], "SELECT trade_date, industry, sum(weight) AS share FROM wt GROUP BY ALL"))
def holdings_industries(source):
    return weigh(picked(source), "equal").groupBy("trade_date", "industry").agg(F.sum("weight").alias("share"))


@register("holdings_summary", sql.query(*BASE, "SELECT (SELECT avg(n) FROM (SELECT count(*) AS n FROM pk GROUP BY trade_date)) AS mean_names, (SELECT avg(t) FROM (SELECT 0.5 * sum(abs(change)) AS t FROM td GROUP BY trade_date)) AS mean_turnover"))
def holdings_summary(source):
    names = picked(source).groupBy("trade_date").agg(F.count("*").alias("n")).agg(F.avg("n").alias("mean_names"))
    return names.join(F.broadcast(turned(source).agg(F.avg("turnover").alias("mean_turnover"))))


@register("capacity", sql.query(*BASE, "SELECT t.trade_date, max(abs(change) * 1e6 / nullif(amount, 0)) AS largest_share FROM td t JOIN lab l ON l.trade_date = t.trade_date AND l.code = t.code GROUP BY t.trade_date"))
def capacity(source):
    """The largest share that a trade has of its security's amount, at a million of capital."""
    _, labels, _, traded = book(source)
    share = safe_div(F.abs("change") * 1e6, F.col("amount"))
    return traded.join(labels.select("trade_date", "code", "amount"), ["trade_date", "code"]).groupBy("trade_date").agg(F.max(share).alias("largest_share"))


@register("attribution_by_stock", sql.query(*BASE[:6], "SELECT code, sum(weight * coalesce(fwd, 0.0)) AS contribution FROM wt GROUP BY code"))
def attribution_by_stock(source):
    return weigh(picked(source), "equal").groupBy("code").agg(F.sum(F.col("weight") * F.coalesce("fwd", F.lit(0.0))).alias("contribution"))


_FATTR = "fc AS (SELECT trade_date, regr_slope(fwd, ep_rank) AS ep_slope, regr_slope(fwd, vol_rank) AS vol_slope, avg(ep_rank) AS ep_mean, avg(vol_rank) AS vol_mean FROM rk WHERE fwd IS NOT NULL GROUP BY trade_date), fx AS (SELECT trade_date, avg(ep_rank) AS ep, avg(vol_rank) AS vol FROM pk GROUP BY trade_date)"


@register("attribution_by_factor", sql.query(*BASE[:4], _FATTR, "SELECT trade_date, (ep - ep_mean) * ep_slope AS ep, (vol - vol_mean) * vol_slope AS vol FROM fx JOIN fc USING (trade_date)"))
def attribution_by_factor(source):
    """What each factor's exposure earned: the holdings' mean rank over the market's, times the rank's slope."""
    both = ranks(labelled(source).where("ep is not null and vol is not null"), "ep", "vol").where("fwd is not null")
    market = both.groupBy("trade_date").agg(*[e for f in ("ep", "vol") for e in (F.regr_slope("fwd", f"{f}_rank").alias(f"{f}_slope"), F.avg(f"{f}_rank").alias(f"{f}_mean"))])
    held = picked(source).groupBy("trade_date").agg(F.avg("ep_rank").alias("ep"), F.avg("vol_rank").alias("vol"))
    return held.join(market, "trade_date").select("trade_date", *[((F.col(f) - F.col(f"{f}_mean")) * F.col(f"{f}_slope")).alias(f) for f in ("ep", "vol")])


_CURVE = "nq AS (SELECT *, product(1 + ret) OVER (ORDER BY trade_date) AS nav FROM rt), dq AS (SELECT *, (nav - max(nav) OVER (ORDER BY trade_date)) / max(nav) OVER (ORDER BY trade_date) AS drawdown FROM nq), tq AS (SELECT arg_min(trade_date, (drawdown, trade_date)) AS trough FROM dq), pq AS (SELECT trough, max(CASE WHEN trade_date <= trough AND drawdown = 0 THEN trade_date END) AS peak FROM dq, tq GROUP BY trough)"


@register("drawdown_holdings", sql.query(*BASE, BENCH, _CURVE, "SELECT industry, count(*) AS held, avg(market_cap) AS mean_cap, avg(fwd) AS mean_return FROM pk, pq WHERE trade_date >= peak AND trade_date <= trough GROUP BY industry"))
def drawdown_holdings(source):
    """What was held between the peak and the trough of the deepest drawdown."""
    curve = drawdown_curve(strategy_returns(source))
    trough = curve.agg(F.min_by("trade_date", F.struct("drawdown", "trade_date")).alias("trough"))
    span = curve.join(F.broadcast(trough)).agg(F.first("trough").alias("trough"), F.max(F.when((F.col("trade_date") <= F.col("trough")) & (F.col("drawdown") == 0), F.col("trade_date"))).alias("peak"))
    rows = picked(source).join(F.broadcast(span), F.col("trade_date").between(F.col("peak"), F.col("trough")))  # one row
    return rows.groupBy("industry").agg(F.count("*").alias("held"), F.avg("market_cap").alias("mean_cap"), F.avg("fwd").alias("mean_return"))


@register("return_skew", sql.query(*BASE, BENCH, "SELECT skewness(ret) AS skew, kurtosis(ret) AS kurt FROM rt"))
def return_skew(source):
    return strategy_returns(source).agg(*[m.alias(k) for k, m in moments(F.col("ret")).items()])


YEARS = (1994, 1996, 1998)


@register("extreme_years", sql.query(*BASE, BENCH, "SELECT year(trade_date)::INT AS year, product(1 + ret) - 1 AS ret, product(1 + bench_ret) - 1 AS bench, min(ret) AS worst_month FROM rt WHERE year(trade_date) IN (1994, 1996, 1998) GROUP BY 1"))
def extreme_years(source):
    """A review of chosen years."""
    rows = strategy_returns(source).withColumn("year", F.year("trade_date")).where(F.col("year").isin(*YEARS))
    return rows.groupBy("year").agg((F.product(1 + F.col("ret")) - 1).alias("ret"), (F.product(1 + F.col("bench_ret")) - 1).alias("bench"), F.min("ret").alias("worst_month"))


for _unit in ("month", "quarter", "year"):

    @register(f"review_{_unit}", sql.query(*BASE, BENCH, f"rr AS (SELECT date_trunc('{_unit}', trade_date)::DATE AS period, product(1 + ret) - 1 AS ret, product(1 + bench_ret) - 1 AS bench FROM rt GROUP BY 1), ri AS (SELECT date_trunc('{_unit}', trade_date)::DATE AS period, industry, sum(weight * coalesce(fwd, 0.0)) AS c FROM wt GROUP BY ALL)", "SELECT period, any_value(ret) AS ret, any_value(bench) AS bench, max(c) AS best_industry, min(c) AS worst_industry FROM rr JOIN ri USING (period) GROUP BY period"))
    def _review(source, unit=_unit):
        """Returns of the period with the largest and least contribution of an industry."""
        period = F.trunc("trade_date", unit).alias("period")
        rets = strategy_returns(source).groupBy(period).agg((F.product(1 + F.col("ret")) - 1).alias("ret"), (F.product(1 + F.col("bench_ret")) - 1).alias("bench"))
        parts = weigh(picked(source), "equal").groupBy(period, "industry").agg(F.sum(F.col("weight") * F.coalesce("fwd", F.lit(0.0))).alias("c"))
        return rets.join(parts.groupBy("period").agg(F.max("c").alias("best_industry"), F.min("c").alias("worst_industry")), "period")


@register("report_markdown", sql.query(*BASE, BENCH, "mm AS (SELECT product(1 + ret) - 1 AS cumulative, power(product(1 + ret), 12.0 / count(ret)) - 1 AS annual_return, stddev_samp(ret) * sqrt(12) AS annual_vol, avg((ret > 0)::INT) AS win_rate FROM rt)", "SELECT '# Strategy' || chr(10) || chr(10) || '| metric | value |' || chr(10) || '|-|-|' || chr(10) || '| cumulative return | ' || format('{:.2f}%', cumulative * 100) || ' |' || chr(10) || '| annual return | ' || format('{:.2f}%', annual_return * 100) || ' |' || chr(10) || '| annual volatility | ' || format('{:.2f}%', annual_vol * 100) || ' |' || chr(10) || '| win rate | ' || format('{:.2f}%', win_rate * 100) || ' |' AS report FROM mm"))
def report_markdown(source):
    """One row of metrics as a Markdown table."""
    rows = metrics(strategy_returns(source), 12)
    lines = [F.format_string(f"| {label} | %.2f%% |", F.col(c) * 100) for label, c in (("cumulative return", "cumulative"), ("annual return", "annual_return"), ("annual volatility", "annual_vol"), ("win rate", "win_rate"))]
    return rows.select(F.concat_ws("\n", F.lit("# Strategy"), F.lit(""), F.lit("| metric | value |"), F.lit("|-|-|"), *lines).alias("report"))


# diagnosis

# Symptom, metric, comparison, limit. Where the sources name a symptom without a figure the limit is ours.
SYMPTOMS = (
    ("low return", "annual_return", "<", 0.05),
    ("unstable return", "annual_vol", ">", 0.25),
    ("negative excess", "excess", "<", 0.0),
    ("a year far behind", "worst_year_excess", "<", -0.10),
    ("deep drawdown", "max_drawdown", "<", -0.30),
    ("slow recovery", "longest_under", ">", 12.0),
    ("high downside", "downside_ratio", ">", 1.0),
    ("weak in extreme years", "worst_year", "<", -0.20),
    ("high turnover", "turnover", ">", 0.80),
    ("high cost share", "cost_share", ">", 0.30),
    ("thin holdings", "largest_trade_share", ">", 0.10),
    ("cannot be bought", "blocked", ">", 0.0),
)
_DIAG = (
    *BASE, BENCH,
    "nq AS (SELECT *, product(1 + ret) OVER (ORDER BY trade_date) AS nav FROM rt), dq AS (SELECT *, (nav - max(nav) OVER (ORDER BY trade_date)) / max(nav) OVER (ORDER BY trade_date) AS drawdown FROM nq)",
    "yq AS (SELECT year(trade_date) AS y, product(1 + ret) - 1 AS ret, product(1 + bench_ret) - 1 AS bench FROM rt GROUP BY 1)",
    "uq AS (SELECT count(*) AS under FROM (SELECT *, sum((drawdown = 0)::INT) OVER (ORDER BY trade_date) AS island FROM dq) WHERE drawdown < 0 GROUP BY island)",
    """dg AS (SELECT (SELECT power(product(1 + ret), 12.0 / count(ret)) - 1 FROM rt) AS annual_return, (SELECT stddev_samp(ret) * sqrt(12) FROM rt) AS annual_vol,
(SELECT power(product(1 + ret), 12.0 / count(ret)) - power(product(1 + bench_ret), 12.0 / count(bench_ret)) FROM rt) AS excess, (SELECT min(ret - bench) FROM yq) AS worst_year_excess,
(SELECT min(drawdown) FROM dq) AS max_drawdown, (SELECT coalesce(max(under), 0) FROM uq)::DOUBLE AS longest_under, (SELECT stddev_samp(CASE WHEN ret < 0 THEN ret END) / nullif(stddev_samp(CASE WHEN ret > 0 THEN ret END), 0) FROM rt) AS downside_ratio,
(SELECT min(ret) FROM yq) AS worst_year, (SELECT avg(t) FROM (SELECT 0.5 * sum(abs(change)) AS t FROM td GROUP BY trade_date)) AS turnover, (SELECT sum(cost) / nullif(sum(gross), 0) FROM nt JOIN gr USING (trade_date)) AS cost_share,
(SELECT max(abs(change) * 1e6 / nullif(amount, 0)) FROM td t JOIN lab l ON l.trade_date = t.trade_date AND l.code = t.code) AS largest_trade_share, (SELECT avg((is_suspend OR coalesce(ret >= 0.1, false))::INT) FROM pk) AS blocked,
(SELECT avg((ret > bench_ret)::INT) FROM rt) AS months_ahead, (SELECT skewness(ret) FROM rt) AS skew, (SELECT avg(top5) FROM (SELECT sum(w) AS top5 FROM (SELECT trade_date, market_cap / sum(market_cap) OVER (PARTITION BY trade_date) AS w, row_number() OVER (PARTITION BY trade_date ORDER BY market_cap DESC, code) AS r FROM pk) WHERE r <= 5 GROUP BY trade_date)) AS top5,
(SELECT max(n) * 1.0 / nullif(sum(n), 0) FROM (SELECT industry, count(*) AS n FROM pk GROUP BY industry)) AS industry_share, (SELECT avg(market_cap) FROM pk) / nullif((SELECT avg(market_cap) FROM lab), 0) AS size_ratio, (SELECT stddev_samp(e) FROM (SELECT avg(ep_rank) AS e FROM pk GROUP BY trade_date)) AS style_drift)""",
)


def symptoms(source: PanelSource) -> DataFrame:
    """One row of everything that the rules and the questions look at."""
    rets = source.once("strategy", lambda: strategy_returns(source))
    overall = metrics(rets, 12).select("annual_return", "annual_vol", "excess", "max_drawdown", safe_div(F.col("downside_vol"), F.col("upside_vol")).alias("downside_ratio"))
    more = rets.agg(F.avg(F.when(F.col("ret") > F.col("bench_ret"), 1.0).otherwise(0.0)).alias("months_ahead"), moments(F.col("ret"))["skew"].alias("skew"))
    years = rets.groupBy(F.year("trade_date")).agg((F.product(1 + F.col("ret")) - 1).alias("ret"), (F.product(1 + F.col("bench_ret")) - 1).alias("bench"))
    years = years.agg(F.min(F.col("ret") - F.col("bench")).alias("worst_year_excess"), F.min("ret").alias("worst_year"))
    curve = drawdown_curve(rets)
    island = F.sum((F.col("drawdown") == 0).cast("int")).over(Window.orderBy("trade_date"))
    under = curve.withColumn("island", island).where("drawdown < 0").groupBy("island").count().agg(F.coalesce(F.max("count"), F.lit(0)).cast("double").alias("longest_under"))
    _, labels, gross, traded = book(source)
    turnover = turned(source).agg(F.avg("turnover").alias("turnover"))
    rows = picked(source)
    blocked = F.avg(F.when(F.col("is_suspend") | F.coalesce(F.col("ret") >= 0.1, F.lit(False)), 1.0).otherwise(0.0)).alias("blocked")
    held = rows.agg(blocked, F.avg("market_cap").alias("held_cap")).join(F.broadcast(labels.agg(F.avg("market_cap").alias("all_cap"))))
    held = held.select("blocked", safe_div(F.col("held_cap"), F.col("all_cap")).alias("size_ratio"))
    industries = rows.groupBy("industry").agg(F.count("*").alias("n")).agg(safe_div(F.max("n"), F.sum("n")).alias("industry_share"))
    style = rows.groupBy("trade_date").agg(F.avg("ep_rank").alias("e")).agg(F.stddev_samp("e").alias("style_drift"))
    share = capacity(source).agg(F.max("largest_share").alias("largest_trade_share"))
    from factorloom.plans.strategy import concentration, share as cost_share

    top5 = concentration(source).agg(F.avg("top5").alias("top5"))
    for one_row in (more, years, under, turnover, cost_share(source), held, industries, style, share, top5):
        overall = overall.join(F.broadcast(one_row))
    return overall


@register("diagnosis", sql.query(*_DIAG, " UNION ALL ".join(f"SELECT '{name}' AS rule, {m}::DOUBLE AS value, {limit!r}::DOUBLE AS \"limit\" FROM dg WHERE {m} {op} {limit!r}" for name, m, op, limit in SYMPTOMS)))
def diagnosis(source):
    """The twelve symptoms that the strategy shows."""
    return breaches(symptoms(source), SYMPTOMS)


# The sixteen questions, and when the answer is yes. Four on the factors follow from their ICs.
QUESTIONS = (
    ("return reached", "annual_return >= 0.05"),
    ("excess steady", "months_ahead > 0.5"),
    ("no losing year", "worst_year_excess > -0.1"),
    ("not left skewed", "skew >= 0"),
    ("drawdown acceptable", "max_drawdown > -0.3"),
    ("no common feature", "industry_share < 0.5"),
    ("no concentrated tail", "top5 < 0.4"),
    ("downside not above upside", "downside_ratio <= 1"),
    ("turnover low", "turnover < 0.5"),
    ("cost share low", "cost_share < 0.2"),
    ("size sufficient", "size_ratio >= 1"),
    ("liquid", "largest_trade_share < 0.1"),
    ("recent ic holds", "recent_ic >= ic_mean"),
    ("works in most industries", "industry_agreement > 0.5"),
    ("correlation stable", "correlation_spread < 0.3"),
    ("no style drift", "style_drift < 0.1"),
)
_QSQL = (
    *_DIAG,
    sql.ic("qe", "ep"),
    "qr AS (SELECT avg(ic) AS ic_mean, (SELECT avg(ic) FROM (SELECT ic FROM qe ORDER BY trade_date DESC LIMIT 12)) AS recent_ic FROM qe)",
    sql.ic("qi", "ep", keys="trade_date, industry", at_least=2),
    "qa AS (SELECT avg((round(m, 9) > 0)::INT) AS industry_agreement FROM (SELECT industry, avg(ic) AS m FROM qi WHERE industry IS NOT NULL GROUP BY industry) WHERE m IS NOT NULL)",
    f"""qx AS (SELECT trade_date, code, year(trade_date) AS y, {sql.centred('ep::FLOAT', 'year(trade_date)')} AS f FROM lab WHERE ep IS NOT NULL), qv AS (SELECT trade_date, code, {sql.centred('vol::FLOAT', 'year(trade_date)')} AS g FROM lab WHERE vol IS NOT NULL),
qc AS (SELECT max(rho) - min(rho) AS correlation_spread FROM (SELECT y, {sql.corr('f', 'g')} AS rho FROM qx JOIN qv USING (trade_date, code) GROUP BY y))""",
    "qq AS (SELECT * FROM dg, qr, qa, qc)",
)


@register("diagnosis_questions", sql.query(*_QSQL, " UNION ALL ".join(f"SELECT '{q}' AS question, coalesce({test}, false) AS yes FROM qq" for q, test in QUESTIONS)))
def diagnosis_questions(source):
    """All sixteen questions with yes or no; what is unknown is a no."""
    from factorloom.operators.correlate import rank_correlations
    from factorloom.operators.evaluate import agreement, rank_ic

    rows = labelled(source)
    ics = source.once("ep-ics", lambda: rank_ic(rows, "ep"))
    recent = ics.withColumn("r", F.row_number().over(Window.orderBy(F.desc("trade_date")))).where("r <= 12").agg(F.avg("ic").alias("recent_ic"))
    by_industry = rank_ic(rows.where("industry is not null"), "ep", keys=("trade_date", "industry"), min_names=2)
    agree = agreement(by_industry, "industry").select(F.col("share").alias("industry_agreement"))
    spread = rank_correlations(rows.select("trade_date", "code", "ep", "vol", F.year("trade_date").alias("year")), ["ep", "vol"], ("year",)).agg((F.max("rho") - F.min("rho")).alias("correlation_spread"))
    one = symptoms(source)
    for one_row in (ics.agg(F.avg("ic").alias("ic_mean")), recent, agree, spread):
        one = one.join(F.broadcast(one_row))
    answers = F.array(*[F.struct(F.lit(q).alias("question"), F.coalesce(F.expr(test), F.lit(False)).alias("yes")) for q, test in QUESTIONS])
    return one.select(F.inline(answers))


@register("failure_signals", sql.query(*_DIAG, sql.ic("fe", "ep"), "ff AS (SELECT ic, row_number() OVER (ORDER BY trade_date DESC) <= 6 AS r FROM fe)", "lb AS (SELECT *, row_number() OVER (ORDER BY trade_date DESC) AS k FROM dq)", "SELECT (SELECT (avg(ic) FILTER (r) - avg(ic) FILTER (NOT r)) / nullif(sqrt(var_samp(ic) FILTER (r) / (count(ic) FILTER (r)) + var_samp(ic) FILTER (NOT r) / (count(ic) FILTER (NOT r))), 0) FROM ff) AS t, (SELECT bool_and(ret < bench_ret) AND count(*) = 3 FROM lb WHERE k <= 3) AS three_behind, (SELECT min(drawdown) FILTER (k = 1) <= min(drawdown) FROM lb) AS record_drawdown"))
def failure_signals(source):
    """One row: the t of the last six ICs, three months behind the benchmark, and a drawdown that is the deepest so far."""
    from factorloom.operators.evaluate import rank_ic
    from factorloom.operators.monitor import welch_t

    latest = F.row_number().over(Window.orderBy(F.desc("trade_date")))
    ics = rank_ic(labelled(source), "ep").withColumn("recent", latest <= 6)
    curve = drawdown_curve(strategy_returns(source)).withColumn("k", latest)
    three = curve.where("k <= 3").agg((F.bool_and(F.col("ret") < F.col("bench_ret")) & (F.count("*") == 3)).alias("three_behind"))
    record = curve.agg((F.min(F.when(F.col("k") == 1, F.col("drawdown"))) <= F.min("drawdown")).alias("record_drawdown"))
    return ics.agg(welch_t(F.col("ic"), F.col("recent")).alias("t")).join(F.broadcast(three)).join(F.broadcast(record))
