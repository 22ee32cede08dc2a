"""Queries on sources, filters, joins, windows, factors and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions.expressions import average_rank, by_date, clip, safe_div
from factorloom.operators.clean import clean, neutralize, standardize, winsorize
from factorloom.operators.combine import size_floor, universe
from factorloom.operators.evaluate import asof_return, forward_return, histogram, moments
from factorloom.operators.factors import LIBRARY, Factor, calc_factors, long_form, momentum, volatility, with_market
from factorloom.operators.backtest import rebalance_dates
from factorloom.plans import sql
from factorloom.plans.catalog import register
from factorloom.sources.panel import PanelSource, daily_closes, monthly_panel


def labelled(source: PanelSource) -> DataFrame:
    """The panel with returns, the benchmark, the label and three factors; written, as most plans branch from it."""

    def build() -> DataFrame:
        rows = forward_return(with_market(monthly_panel(source)))
        return rows.withColumns({"mom": momentum(3)(), "ep": safe_div(F.lit(1.0), F.col("pe_ratio")), "vol": volatility(6)()})

    return source.once("labelled", build)


ID = "trade_date, code"
MOM3 = Factor("mom", ("close",), momentum(3), 4, family="momentum")


@register("panel", sql.query(f"SELECT {ID}, open, high, low, close, volume, amount, pe_ratio, roe, market_cap, is_st, is_suspend, list_days, industry FROM panel"))
def panel(source):
    return monthly_panel(source).select("trade_date", "code", "open", "high", "low", "close", "volume", "amount", "pe_ratio", "roe", "market_cap", "is_st", "is_suspend", "list_days", "industry")


@register("month_ends", "SELECT max(l_shipdate::DATE) AS trade_date FROM lineitem GROUP BY date_trunc('month', l_shipdate)")
def month_ends(source):
    return rebalance_dates(source.lines().select(F.col("ship").alias("trade_date")), "month")


@register("quarter_ends", "SELECT max(l_shipdate::DATE) AS trade_date FROM lineitem GROUP BY date_trunc('quarter', l_shipdate)")
def quarter_ends(source):
    return rebalance_dates(source.lines().select(F.col("ship").alias("trade_date")), "quarter")


@register("week_ends", "SELECT max(l_shipdate::DATE) AS trade_date FROM lineitem GROUP BY date_trunc('week', l_shipdate)")
def week_ends(source):
    return rebalance_dates(source.lines().select(F.col("ship").alias("trade_date")), "week")


@register("biweekly_ends", "SELECT max(l_shipdate::DATE) AS trade_date FROM lineitem GROUP BY floor((l_shipdate::DATE - DATE '1970-01-05') / 14)")
def biweekly_ends(source):
    return rebalance_dates(source.lines().select(F.col("ship").alias("trade_date")), "biweekly")


@register("universe_filter", sql.query(f"SELECT {ID} FROM panel WHERE NOT is_st AND list_days >= 60 AND NOT is_suspend"))
def universe_filter(source):
    return universe(monthly_panel(source)).select("trade_date", "code")


@register("date_range", sql.query(f"SELECT {ID}, close FROM panel WHERE trade_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"))
def date_range(source):
    return monthly_panel(source).where("trade_date between '1996-01-01' and '1999-12-31'").select("trade_date", "code", "close")


@register("st_filter", sql.query(f"SELECT {ID} FROM panel WHERE NOT is_st"))
def st_filter(source):
    return monthly_panel(source).where("not is_st").select("trade_date", "code")


for _name, _q in (("size_floor", 0.2), ("size_floor_10", 0.1)):

    @register(_name, sql.query(f"SELECT {ID}, market_cap FROM (SELECT *, quantile_cont(market_cap, {_q}) OVER (PARTITION BY trade_date) AS least FROM panel) WHERE market_cap > least"))
    def _floor(source, q=_q):
        return size_floor(monthly_panel(source), q).select("trade_date", "code", "market_cap")


@register("sanitize", sql.query(f"SELECT {ID}, 1.0 / nullif(pe_ratio, 0) AS dropped, coalesce(1.0 / nullif(pe_ratio, 0), 0.0) AS filled, CASE WHEN pe_ratio IS NOT NULL THEN greatest(-10.0, least(10.0, pe_ratio)) END AS clipped FROM panel"))
def sanitize(source):
    inverse = safe_div(F.lit(1.0), F.col("pe_ratio"))
    return monthly_panel(source).select("trade_date", "code", inverse.alias("dropped"), F.coalesce(inverse, F.lit(0.0)).alias("filled"), clip(F.col("pe_ratio"), -10, 10).alias("clipped"))


@register("benchmark_series", sql.query("SELECT trade_date, avg(ret) AS bench FROM rets GROUP BY trade_date"))
def benchmark_series(source):
    return with_market(monthly_panel(source)).groupBy("trade_date").agg(F.avg("ret").alias("bench"))


@register("forward_return", sql.query(f"SELECT {ID}, fwd FROM lab"))
def forward(source):
    return labelled(source).select("trade_date", "code", "fwd")


@register(
    "asof_return",
    """WITH px AS (SELECT l_suppkey AS code, l_shipdate::DATE AS trade_date, sum(l_extendedprice::DECIMAL(18,4))::DOUBLE / nullif(sum(l_quantity::DECIMAL(18,4))::DOUBLE, 0) AS close FROM lineitem GROUP BY ALL),
q AS (SELECT DISTINCT date_trunc('quarter', trade_date)::DATE AS s FROM px)
SELECT s AS start, code, arg_max(close, trade_date) / nullif(arg_min(close, trade_date), 0) - 1 AS ret FROM px JOIN q ON trade_date >= s AND trade_date < s + INTERVAL 3 MONTH GROUP BY s, code HAVING count(*) >= 2""",
)
def asof(source):
    prices = source.once("days", lambda: daily_closes(source))
    starts = prices.select(F.trunc("trade_date", "quarter").alias("start")).distinct()
    periods = starts.select("start", F.date_sub(F.add_months("start", 3), 1).alias("end"))
    return asof_return(prices, periods)


FACTOR_SQL = {
    "mas5": "CASE WHEN count(close) OVER w5 = 5 THEN avg(close) OVER w5 END",
    "intraday": "close / nullif(open, 0) - 1",
    "ep": "1.0 / nullif(pe_ratio, 0)",
    "bp": "1.0 / nullif(pb_ratio, 0)",
    "sp": "amount / nullif(market_cap, 0)",
    "dp": "dividends / nullif(market_cap, 0)",
    "ep_ex_items": "profit_ex_items / nullif(amount, 0)",
    "gross_margin": "(amount - operating_cash_flow) / nullif(amount, 0)",
    "roe": "roe",
    "roa": "net_profit / nullif(amount, 0)",
    "cash_quality": "operating_cash_flow / nullif(net_profit, 0)",
    "earnings_stability": "CASE WHEN count(roe) OVER w12 = 12 THEN 1.0 / nullif(stddev_samp(roe) OVER w12, 0) END",
    "momentum20": "close / nullif(lag(close, 20) OVER w, 0) - 1",
    "momentum60": "close / nullif(lag(close, 60) OVER w, 0) - 1",
    "momentum120": "close / nullif(lag(close, 120) OVER w, 0) - 1",
    "momentum_acceleration": "(close / nullif(lag(close, 6) OVER w, 0) - 1) - (lag(close, 6) OVER w / nullif(lag(close, 12) OVER w, 0) - 1)",
    "enhanced_ep": "coalesce(1.0 / nullif(pe_ratio, 0), 0.0) * greatest(-10.0, least(10.0, coalesce(operating_cash_flow / nullif(abs(net_profit), 0), 0.0)))",
    "gap": "(open - lag(close) OVER w) / nullif(lag(close) OVER w, 0)",
    "volatility20": "CASE WHEN count(ret) OVER w20 = 20 THEN -(stddev_samp(ret) OVER w20 * sqrt(252)) END",
    "downside_vol": "-(stddev_samp(CASE WHEN ret < 0 THEN ret END) OVER w20)",
    "amplitude20": "CASE WHEN count(high) OVER w20 = 20 THEN max(high) OVER w20 / nullif(min(low) OVER w20, 0) - 1 END",
    "turnover20": "CASE WHEN count(volume) OVER w20 = 20 THEN avg(volume) OVER w20 END",
    "amount20": "CASE WHEN count(amount) OVER w20 = 20 THEN avg(amount) OVER w20 END",
    "amihud": "CASE WHEN count(abs(ret) / nullif(amount, 0)) OVER w20 = 20 THEN avg(abs(ret) / nullif(amount, 0)) OVER w20 END",
    "revenue_growth": "amount / nullif(lag(amount, 12) OVER w, 0) - 1",
    "profit_growth": "(net_profit - lag(net_profit, 12) OVER w) / nullif(abs(lag(net_profit, 12) OVER w), 0)",
}
FACTOR_WINDOWS = "WINDOW w AS (PARTITION BY code ORDER BY trade_date)" + "".join(f", w{n} AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (5, 12, 20))
_IDIO = """SELECT trade_date, code, CASE WHEN n = 20 THEN -sqrt(greatest(0.0, (vy - cov * cov / nullif(vx, 0)) * n / (n - 2))) END AS idio_vol FROM (
SELECT trade_date, code, count(y) OVER w AS n, var_pop(y) OVER w AS vy, covar_pop(y, x) OVER w AS cov, var_pop(x) OVER w AS vx FROM (
SELECT trade_date, code, CASE WHEN bench IS NOT NULL THEN ret END AS y, CASE WHEN ret IS NOT NULL THEN bench END AS x FROM lab)
WINDOW w AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""

# from lab with iy and ix, the returns of the name and of the market where both are known
IDIO_VOL = "CASE WHEN count(iy) OVER w20 = 20 THEN -sqrt(greatest(0.0, (var_pop(iy) OVER w20 - pow(covar_pop(iy, ix) OVER w20, 2) / nullif(var_pop(ix) OVER w20, 0)) * 20 / 18.0)) END"

for _name in LIBRARY.factors:
    _text = sql.query(_IDIO) if _name == "idio_vol" else sql.query(f"SELECT {ID}, {FACTOR_SQL[_name]} AS {_name} FROM rets {FACTOR_WINDOWS}")

    @register(f"factor_{_name}", _text)
    def _one(source, name=_name):
        return calc_factors(monthly_panel(source), [LIBRARY[name]])


@register(
    "factor_ep_classical",
    sql.query("v AS (SELECT trade_date, code, 1.0 / nullif(pe_ratio, 0) AS x FROM panel WHERE pe_ratio IS NOT NULL AND pe_ratio <> 0)", "b AS (SELECT *, greatest(quantile_cont(x, 0.01) OVER w, least(quantile_cont(x, 0.99) OVER w, x)) AS y FROM v WINDOW w AS (PARTITION BY trade_date))", f"SELECT {ID}, (y - avg(y) OVER w) / nullif(stddev_samp(y) OVER w, 0) AS ep FROM b WINDOW w AS (PARTITION BY trade_date)"),
)
def ep_classical(source):
    rows = monthly_panel(source).select("trade_date", "code", safe_div(F.lit(1.0), F.col("pe_ratio")).alias("ep")).where("ep is not null")
    return standardize(winsorize(rows, "ep", 0.01, 0.99), "ep")


@register("calc_factors", sql.query(f"SELECT * FROM (SELECT {ID}, {FACTOR_SQL['ep']} AS ep, {FACTOR_SQL['roe']} AS roe, {FACTOR_SQL['momentum20']} AS momentum20 FROM rets {FACTOR_WINDOWS}) WHERE trade_date BETWEEN DATE '1998-01-01' AND DATE '2000-12-31'"))
def several(source):
    return calc_factors(monthly_panel(source), [LIBRARY[n] for n in ("ep", "roe", "momentum20")], start="1998-01-01", end="2000-12-31")


# the factors of the sources with their cleaning: winsorized, neutral to industry (and size), standardized
_WINSORED = "wz AS (SELECT *, CASE WHEN f IS NOT NULL THEN greatest(quantile_cont(f, 0.025) OVER w, least(quantile_cont(f, 0.975) OVER w, f)) END AS x FROM fa WINDOW w AS (PARTITION BY trade_date))"
_BY_INDUSTRY = "nz AS (SELECT *, CASE WHEN industry IS NOT NULL THEN x - avg(x) OVER (PARTITION BY trade_date, industry) END AS y FROM wz)"
_BY_BOTH = """sz AS (SELECT *, CASE WHEN x IS NOT NULL AND market_cap IS NOT NULL AND industry IS NOT NULL THEN x END AS x1, CASE WHEN x IS NOT NULL AND market_cap IS NOT NULL AND industry IS NOT NULL THEN {size} END AS z1 FROM wz),
dm AS (SELECT *, x1 - avg(x1) OVER w AS xd, z1 - avg(z1) OVER w AS zd FROM sz WINDOW w AS (PARTITION BY trade_date, industry)),
nz AS (SELECT *, xd - coalesce(sum(xd * zd) OVER w / nullif(sum(zd * zd) OVER w, 0), 0.0) * zd AS y FROM dm WINDOW w AS (PARTITION BY trade_date))"""
# residuals of 0 leave traces, so scores are rounded
_SCORED = "round((y - avg(y) OVER w) / nullif(stddev_samp(y) OVER w, 0), 9) + 0.0"


def cleaned_sql(name: str, size: str = "market_cap") -> tuple[str, ...]:
    neutral = _BY_BOTH.format(size=size) if LIBRARY[name].neutralize == ("industry", "market_cap") else _BY_INDUSTRY
    return f"fa AS (SELECT trade_date, code, industry, market_cap, fwd, {FACTOR_SQL[name]} AS f FROM lab {FACTOR_WINDOWS})", _WINSORED, neutral


for _name in ("intraday", "ep", "roe", "momentum20", "enhanced_ep", "gap", "volatility20"):

    @register(f"clean_{_name}", sql.query(*cleaned_sql(_name), f"SELECT {ID}, {_SCORED} AS {_name} FROM nz WINDOW w AS (PARTITION BY trade_date)"))
    def _clean(source, name=_name):
        return calc_factors(monthly_panel(source), [LIBRARY[name]], cleaned=True).select("trade_date", "code", (F.round(name, 9) + 0.0).alias(name))


@register("clean_log_size", sql.query(*cleaned_sql("gap", "ln(market_cap)"), f"SELECT {ID}, {_SCORED} AS gap FROM nz WINDOW w AS (PARTITION BY trade_date)"))
def clean_log_size(source):
    rows = monthly_panel(source)
    made = rows.select("trade_date", "code", "industry", "market_cap", LIBRARY["gap"].calc().alias("gap"))
    return standardize(neutralize(winsorize(made, "gap"), "gap", ("industry", "market_cap"), log_size=True), "gap").select("trade_date", "code", (F.round("gap", 9) + 0.0).alias("gap"))


@register("factors_adjusted", sql.query(f"SELECT {ID}, close * factor / nullif(lag(close * factor, 3) OVER w, 0) - 1 AS mom FROM (SELECT *, CASE WHEN trade_date < DATE '1996-01-01' THEN 0.5 ELSE 1.0 END AS factor FROM panel) WINDOW w AS (PARTITION BY code ORDER BY trade_date)"))
def adjusted(source):
    """Prices times an adjustment factor, here that of a split of each share into two."""
    rows = monthly_panel(source).withColumn("factor", F.when(F.col("trade_date") < "1996-01-01", 0.5).otherwise(1.0))
    return calc_factors(rows, [MOM3], adjust="factor")


@register("factors_skip_paused", sql.query(f"SELECT {ID}, close / nullif(lag(close, 3) OVER w, 0) - 1 AS mom FROM panel WHERE NOT is_suspend WINDOW w AS (PARTITION BY code ORDER BY trade_date)"))
def skip_paused(source):
    return calc_factors(monthly_panel(source), [MOM3], skip_paused=True)


@register("factors_long", sql.query(f"SELECT {ID}, 'ep' AS factor_name, ep AS factor FROM lab UNION ALL SELECT {ID}, 'mom', mom FROM lab UNION ALL SELECT {ID}, 'vol', vol FROM lab"))
def long(source):
    return long_form(labelled(source).select("trade_date", "code", "ep", "mom", "vol"), ["ep", "mom", "vol"])


_WINSOR = "wz AS (SELECT *, CASE WHEN mom IS NOT NULL THEN greatest(quantile_cont(mom, {0}) OVER w, least(quantile_cont(mom, {1}) OVER w, mom)) END AS x FROM lab WINDOW w AS (PARTITION BY trade_date))"
_NEUTRAL = "nz AS (SELECT *, x - avg(x) OVER (PARTITION BY trade_date, industry) AS y FROM {0})"
_SIZED = """sz AS (SELECT *, CASE WHEN x IS NOT NULL AND market_cap IS NOT NULL THEN x END AS x1, CASE WHEN x IS NOT NULL AND market_cap IS NOT NULL THEN market_cap END AS z1 FROM {0}),
dm AS (SELECT *, x1 - avg(x1) OVER w AS xd, z1 - avg(z1) OVER w AS zd FROM sz WINDOW w AS (PARTITION BY trade_date, industry)),
nz AS (SELECT *, xd - coalesce(sum(xd * zd) OVER w / nullif(sum(zd * zd) OVER w, 0), 0.0) * zd AS y FROM dm WINDOW w AS (PARTITION BY trade_date))"""
_RAW = "rw AS (SELECT *, mom AS x FROM lab)"
_Z = "SELECT trade_date, code, ({0} - avg({0}) OVER w) / nullif(stddev_samp({0}) OVER w, 0) AS mom FROM {1} WINDOW w AS (PARTITION BY trade_date)"


def _cleaned(step) -> DataFrame:
    return lambda source: step(labelled(source).select("trade_date", "code", "industry", "region", "market_cap", "mom")).select("trade_date", "code", "mom")


register("winsorize", sql.query(_WINSOR.format(0.025, 0.975), f"SELECT {ID}, x AS mom FROM wz"))(_cleaned(lambda d: winsorize(d, "mom")))
register("winsorize_1pct", sql.query(_WINSOR.format(0.01, 0.99), f"SELECT {ID}, x AS mom FROM wz"))(_cleaned(lambda d: winsorize(d, "mom", 0.01, 0.99)))
register("neutralize_industry", sql.query(_RAW, _NEUTRAL.format("rw"), f"SELECT {ID}, y AS mom FROM nz"))(_cleaned(lambda d: neutralize(d, "mom")))
register("neutralize_industry_size", sql.query(_RAW, _SIZED.format("rw"), f"SELECT {ID}, y AS mom FROM nz"))(_cleaned(lambda d: neutralize(d, "mom", ("industry", "market_cap"))))
register("standardize", sql.query(_RAW, _Z.format("x", "rw")))(_cleaned(lambda d: standardize(d, "mom")))
register("clean_pipeline", sql.query(_WINSOR.format(0.025, 0.975), _SIZED.format("wz").replace("industry", "region"), _Z.format("y", "nz")))(_cleaned(lambda d: clean(d, "mom", ("region", "market_cap"))))
register("rank_transform", sql.query(f"SELECT {ID}, {sql.rank('mom', 'trade_date')} AS mom FROM lab WHERE mom IS NOT NULL"))(_cleaned(lambda d: d.where("mom is not null").withColumn("mom", average_rank(F.col("mom"), "trade_date"))))


# the factor that ICs are taken of: three months' momentum of names not under special treatment, neutral to region and size
CLEANED = ", ".join([
    _WINSOR.format(0.025, 0.975).replace("wz AS", "cw AS").replace("FROM lab", "FROM lab WHERE NOT is_st"),
    _SIZED.format("cw").replace("industry", "region").replace("sz AS", "cs AS").replace("FROM sz", "FROM cs").replace("dm AS", "cd AS").replace("FROM dm", "FROM cd").replace("nz AS", "cn AS"),
    "cl AS (SELECT * REPLACE (round((y - avg(y) OVER w) / nullif(stddev_samp(y) OVER w, 0), 9) + 0.0 AS mom) FROM cn WINDOW w AS (PARTITION BY trade_date))",
])


def cleaned(source: PanelSource) -> DataFrame:
    """The labelled panel with its momentum winsorized, neutral to region and size, and standardized; without names under special treatment.

    Residuals of 0 leave traces, so values are rounded before they are ranked.
    """
    rows = clean(labelled(source).where("not is_st"), "mom", ("region", "market_cap"))
    return rows.withColumn("mom", F.round("mom", 9) + 0.0)


@register(
    "neutralize_compare",
    sql.query(_RAW, _NEUTRAL.format("rw"), "SELECT industry, avg(x) AS raw_mean, avg(abs(x)) AS raw_abs, avg(abs(y)) AS neutral_abs, count(y) AS n FROM nz WHERE x IS NOT NULL GROUP BY industry"),
)
def neutralize_compare(source):
    rows = neutralize(labelled(source), "mom", out="y").where("mom is not null")
    return rows.groupBy("industry").agg(F.avg("mom").alias("raw_mean"), F.avg(F.abs("mom")).alias("raw_abs"), F.avg(F.abs("y")).alias("neutral_abs"), F.count("y").alias("n"))


@register("skew_kurt", sql.query("SELECT trade_date, skewness(mom) AS skew, kurtosis(mom) AS kurt, count(mom) AS n FROM lab GROUP BY trade_date"))
def skew_kurt(source):
    return labelled(source).groupBy("trade_date").agg(*[m.alias(k) for k, m in moments(F.col("mom")).items()], F.count("mom").alias("n"))


@register("histogram", sql.query("SELECT CASE WHEN mom < -1 THEN 0 WHEN mom >= 1 THEN 21 ELSE floor((mom + 1) / 0.1)::INT + 1 END AS bin, count(*) AS n FROM lab WHERE mom IS NOT NULL GROUP BY 1"))
def histogram_of(source):
    return histogram(labelled(source), "mom", -1, 1, 20).withColumn("bin", F.col("bin").cast("int"))


@register("listing_age", sql.query("SELECT code, max(list_days) AS age, sum(is_suspend::INT)::BIGINT AS suspended FROM panel GROUP BY code"))
def listing_age(source):
    return monthly_panel(source).groupBy("code").agg(F.max("list_days").alias("age"), F.sum(F.col("is_suspend").cast("int")).alias("suspended"))


@register("industry_extremes", sql.query(f"SELECT {ID}, mom FROM (SELECT *, max(mom) OVER w AS hi, min(mom) OVER w AS lo FROM lab WINDOW w AS (PARTITION BY trade_date, industry)) WHERE mom = hi OR mom = lo"))
def extremes(source):
    w = by_date("industry")
    rows = labelled(source).withColumns({"hi": F.max("mom").over(w), "lo": F.min("mom").over(w)})
    return rows.where("mom = hi or mom = lo").select("trade_date", "code", "mom")


