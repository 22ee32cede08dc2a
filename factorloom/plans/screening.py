"""Screening: every factor of the library through the same metrics, grades, checklist and score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.expressions import correlation
from factorloom.operators.evaluate import agreement, grade, ic_stats, long_short, membership_change, points, signs, streaks
from factorloom.operators.factors import LIBRARY, calc_factors
from factorloom.operators.performance import metrics
from factorloom.operators.sections import section_ics, sections
from factorloom.plans import sql
from factorloom.plans.catalog import register
from factorloom.plans.evaluation import STATS
from factorloom.plans.market import FACTOR_SQL, FACTOR_WINDOWS, IDIO_VOL, labelled
from factorloom.sources.panel import PanelSource

NAMES = list(LIBRARY.factors)
KEYS = ("trade_date", "factor_name")

# Metric, weight, acceptable and excellent value. The bounds of stability and robustness are ours.
SCORES = (
    ("ic_mean", 0.15, 0.03, 0.05),
    ("icir", 0.20, 0.3, 0.5),
    ("win_rate", 0.10, 0.5, 0.55),
    ("monotonicity", 0.15, 0.8, 1.0),
    ("long_short_return", 0.15, 0.08, 0.15),
    ("long_short_sharpe", 0.10, 0.5, 1.0),
    ("stability", 0.05, 0.5, 0.75),
    ("robustness", 0.10, 0.6, 0.8),
)


def sectioned(source: PanelSource) -> DataFrame:
    """A row for each date and factor, with all that the metrics rest on."""
    ids = ("industry", "market_cap", "fwd")
    factors = list(LIBRARY.factors.values())
    return source.once("sections", lambda: sections(calc_factors(labelled(source), factors, keep=ids), factors))


def profile(source: PanelSource) -> DataFrame:
    """A row for each factor with all metrics. A factor of negative mean IC is flipped first."""
    made = sectioned(source)
    raw_ics = section_ics(made)
    sign = F.broadcast(signs(raw_ics, "factor_name"))  # a row for each factor
    rows = made.join(sign, "factor_name").withColumns({"rets": F.when(F.col("sign") > 0, F.col("up")).otherwise(F.col("down")), "members": F.when(F.col("sign") > 0, F.col("up_members")).otherwise(F.col("down_members"))})
    within = lambda parts: rows.select("factor_name", "sign", F.inline(parts)).withColumn("ic", F.col("ic") * F.col("sign"))
    ics = raw_ics.join(sign, "factor_name").withColumn("ic", F.col("ic") * F.col("sign"))
    runs = streaks(ics, "factor_name").groupBy("factor_name").agg(F.max("length").alias("longest"), F.max(F.abs("total")).alias("deepest"))
    sizes = agreement(within("sizes"), "part", "factor_name").withColumnRenamed("share", "size_share")
    trades = agreement(within("industries"), "part", "factor_name").withColumnRenamed("share", "industry_share")

    layered = rows.select(*KEYS, F.posexplode("rets").alias("place", "ret")).where("ret is not null").select(*KEYS, (F.col("place") + 1).alias("group"), "ret")
    spreads = metrics(long_short(layered, keys=KEYS).withColumn("bench_ret", F.lit(0.0)), 12, keys=("factor_name",))
    spreads = spreads.select("factor_name", F.col("annual_return").alias("long_short_return"), F.col("sharpe").alias("long_short_sharpe"), F.abs("max_drawdown").alias("long_short_drawdown"))
    bench = labelled(source).groupBy("trade_date").agg(F.avg("fwd").alias("bench_ret"))
    excess = metrics(layered.where("group = 5").join(bench, "trade_date"), 12, keys=("factor_name",)).select("factor_name", "excess")
    turnover = membership_change(rows.select(*KEYS, F.explode("members").alias("code")), "factor_name")
    w = Window.partitionBy("factor_name")
    means = layered.groupBy("factor_name", "group").agg(F.avg("ret").alias("mean"))
    means = means.withColumns({"r": F.rank().over(w.orderBy("mean")).cast("double"), "step": F.col("mean") - F.lag("mean").over(w.orderBy("group"))})
    up, down = F.sum((F.col("step") > 0).cast("int")), F.sum((F.col("step") < 0).cast("int"))
    mono = means.groupBy("factor_name").agg(F.abs(correlation(F.col("group").cast("double"), F.col("r"))).alias("monotonicity"), ((up == 4) | (down == 4)).alias("strict"))

    out = ic_stats(ics, "factor_name").join(sign, "factor_name").join(spreads, "factor_name").join(excess, "factor_name").join(mono, "factor_name")
    for more in (runs, sizes, trades, turnover):
        out = out.join(more, "factor_name", "left")
    robust = (F.coalesce("size_share", F.lit(0.0)) + F.coalesce("industry_share", F.lit(0.0))) / 2
    return out.withColumns({"longest": F.coalesce("longest", F.lit(0).cast("bigint")), "ic_drawdown": F.coalesce("deepest", F.lit(0.0)), "stability": 1 - F.col("turnover"), "robustness": robust, "flipped": F.col("sign") < 0})


_LIB = f"lib AS (SELECT trade_date, code, industry, market_cap, fwd, {', '.join(f'{FACTOR_SQL.get(n, IDIO_VOL)} AS {n}' for n in NAMES)} FROM (SELECT *, CASE WHEN bench IS NOT NULL THEN ret END AS iy, CASE WHEN ret IS NOT NULL THEN bench END AS ix FROM lab) {FACTOR_WINDOWS})"
# all factors in rows: winsorized; within industries; less the slope on size for those that are neutral to both; standardized
_RAW = (
    "lr AS (" + " UNION ALL ".join(f"SELECT trade_date, code, industry, market_cap, fwd, '{n}' AS factor_name, {str(LIBRARY[n].neutralize == ('industry', 'market_cap')).lower()} AS sized, {n} AS f FROM lib WHERE {n} IS NOT NULL" for n in NAMES) + """),
lw AS (SELECT *, greatest(quantile_cont(f, 0.025) OVER w, least(quantile_cont(f, 0.975) OVER w, f)) AS x FROM lr WINDOW w AS (PARTITION BY trade_date, factor_name)),
lu AS (SELECT *, CASE WHEN industry IS NOT NULL AND (market_cap IS NOT NULL OR NOT sized) THEN x END AS x1, CASE WHEN industry IS NOT NULL AND sized THEN market_cap END AS z1 FROM lw),
ld AS (SELECT *, x1 - avg(x1) OVER w AS xd, z1 - avg(z1) OVER w AS zd FROM lu WINDOW w AS (PARTITION BY trade_date, factor_name, industry)),
ln AS (SELECT *, xd - CASE WHEN sized THEN coalesce(sum(xd * zd) OVER w / nullif(sum(zd * zd) OVER w, 0), 0.0) * zd ELSE 0.0 END AS y FROM ld WINDOW w AS (PARTITION BY trade_date, factor_name)),
lz AS (SELECT * EXCLUDE (x), round((y - avg(y) OVER w) / nullif(stddev_samp(y) OVER w, 0), 9) + 0.0 AS factor FROM ln WINDOW w AS (PARTITION BY trade_date, factor_name)),
raw AS (SELECT trade_date, code, industry, market_cap, fwd, factor_name, factor FROM lz WHERE factor IS NOT NULL AND fwd IS NOT NULL)"""
)
_ANNUAL = "CASE WHEN product(1 + ret) > 0 THEN power(product(1 + ret), 12.0 / count(ret)) - 1 END"
_PROFILE = (
    _LIB,
    _RAW,
    sql.ic("rics", "factor", "raw", keys="trade_date, factor_name"),
    "sg AS (SELECT factor_name, CASE WHEN avg(ic) < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sign FROM rics GROUP BY factor_name)",
    "tidy AS (SELECT raw.* EXCLUDE (factor), factor * sign AS factor FROM raw JOIN sg USING (factor_name))",
    "tics AS (SELECT trade_date, factor_name, ic * sign AS ic FROM rics JOIN sg USING (factor_name))",
    f"st AS (SELECT factor_name, {STATS} FROM tics WHERE ic IS NOT NULL GROUP BY factor_name)",
    """rn AS (SELECT factor_name, max(length) AS longest, max(abs(total)) AS deepest FROM (SELECT factor_name, count(*) AS length, sum(ic) AS total FROM (
SELECT *, row_number() OVER (PARTITION BY factor_name ORDER BY trade_date) - row_number() OVER (PARTITION BY factor_name, ic < 0 ORDER BY trade_date) AS island FROM tics WHERE ic IS NOT NULL) WHERE ic < 0 GROUP BY factor_name, island) GROUP BY factor_name)""",
    sql.groups("csz", "market_cap", 3, out="size_group"),
    sql.ic("sics", "factor", "(SELECT tidy.*, size_group FROM tidy JOIN (SELECT trade_date, code, size_group FROM csz) USING (trade_date, code) WHERE size_group IS NOT NULL)", keys="trade_date, factor_name, size_group", at_least=5),
    sql.ic("iics", "factor", "(SELECT * FROM tidy WHERE industry IS NOT NULL)", keys="trade_date, factor_name, industry", at_least=2),
    "sz AS (SELECT factor_name, avg((round(m, 9) > 0)::INT) AS size_share FROM (SELECT factor_name, size_group, avg(ic) AS m FROM sics GROUP BY ALL) WHERE m IS NOT NULL GROUP BY factor_name)",
    "ix AS (SELECT factor_name, avg((round(m, 9) > 0)::INT) AS industry_share FROM (SELECT factor_name, industry, avg(ic) AS m FROM iics GROUP BY ALL) WHERE m IS NOT NULL GROUP BY factor_name)",
    sql.groups("tcut", "factor", 5, "tidy", keys="trade_date, factor_name"),
    "tlay AS (SELECT trade_date, factor_name, grp, avg(fwd) AS ret FROM tcut WHERE grp IS NOT NULL GROUP BY ALL)",
    "tls AS (SELECT trade_date, factor_name, max(CASE WHEN grp = 5 THEN ret END) - max(CASE WHEN grp = 1 THEN ret END) AS ret FROM tlay GROUP BY ALL)",
    "tnv AS (SELECT *, product(1 + ret) OVER (PARTITION BY factor_name ORDER BY trade_date) AS nav FROM tls)",
    "tdd AS (SELECT *, (nav - max(nav) OVER w) / max(nav) OVER w AS dd FROM tnv WINDOW w AS (PARTITION BY factor_name ORDER BY trade_date))",
    f"lss AS (SELECT factor_name, {_ANNUAL} AS long_short_return, (({_ANNUAL}) - 0.03) / nullif(stddev_samp(ret) * sqrt(12), 0) AS long_short_sharpe, abs(min(dd)) AS long_short_drawdown FROM tdd GROUP BY factor_name)",
    "bm AS (SELECT trade_date, avg(fwd) AS bench FROM lab GROUP BY trade_date)",
    "ex AS (SELECT factor_name, power(product(1 + ret), 12.0 / count(ret)) - power(product(1 + bench), 12.0 / count(bench)) AS excess FROM tlay JOIN bm USING (trade_date) WHERE grp = 5 GROUP BY factor_name)",
    "mb AS (SELECT factor_name, trade_date, coalesce(lag(trade_date) OVER (PARTITION BY factor_name, code ORDER BY trade_date) = (trade_date - INTERVAL 1 MONTH)::DATE, false) AS stays, min(trade_date) OVER (PARTITION BY factor_name) AS first FROM tcut WHERE grp = 5)",
    "tu AS (SELECT factor_name, avg(new) AS turnover FROM (SELECT factor_name, trade_date, avg(1 - stays::INT) AS new FROM mb WHERE trade_date > first GROUP BY ALL) GROUP BY factor_name)",
    f"mo AS (SELECT factor_name, abs({sql.corr('grp::DOUBLE', 'r')}) AS monotonicity, sum((step > 0)::INT) = 4 OR sum((step < 0)::INT) = 4 AS strict FROM (SELECT factor_name, grp, rank() OVER (PARTITION BY factor_name ORDER BY mean)::DOUBLE AS r, mean - lag(mean) OVER (PARTITION BY factor_name ORDER BY grp) AS step FROM (SELECT factor_name, grp, avg(ret) AS mean FROM tlay GROUP BY ALL)) GROUP BY factor_name)",
    """pf AS (SELECT *, coalesce(rn.longest, 0) AS long_run, coalesce(deepest, 0.0) AS ic_drawdown, 1 - turnover AS stability, (coalesce(size_share, 0.0) + coalesce(industry_share, 0.0)) / 2 AS robustness, sign < 0 AS flipped
FROM st JOIN sg USING (factor_name) JOIN lss USING (factor_name) JOIN ex USING (factor_name) JOIN mo USING (factor_name) LEFT JOIN rn USING (factor_name) LEFT JOIN sz USING (factor_name) LEFT JOIN ix USING (factor_name) LEFT JOIN tu USING (factor_name))""",
)


def _points(m: str, low: str, high: str) -> str:
    return f"coalesce(CASE WHEN {m} IS NOT NULL THEN greatest(0.0::DOUBLE, least(10.0::DOUBLE, CASE WHEN {m} >= {low} THEN 6 + 4 * ({m} - {low}) / ({high} - {low}) ELSE 6 * {m} / {low} END)) END, 0.0)"


# The score once more, written out: the oracle shares no constant with the plan.
_SCORE = f"""10 * (0.15 * {_points("ic_mean", "0.03", "0.05")} + 0.20 * {_points("icir", "0.3", "0.5")} + 0.10 * {_points("win_rate", "0.5", "0.55")} + 0.15 * {_points("monotonicity", "0.8", "1.0")}
+ 0.15 * {_points("long_short_return", "0.08", "0.15")} + 0.10 * {_points("long_short_sharpe", "0.5", "1.0")} + 0.05 * {_points("stability", "0.5", "0.75")} + 0.10 * {_points("robustness", "0.6", "0.8")})"""
_COLUMNS = "factor_name, flipped, ic_mean, icir, win_rate, long_short_return, long_short_sharpe, monotonicity, stability, robustness"


def scored(source: PanelSource) -> DataFrame:
    """Weighted points of the eight items, out of 100; an unknown metric gives no points."""
    parts = [F.lit(w) * F.coalesce(points(F.col(m), low, high), F.lit(0.0)) for m, w, low, high in SCORES]
    core = (points(F.col("icir"), 0.3, 0.5) >= 6) & (points(F.col("monotonicity"), 0.8, 1.0) >= 6)
    rows = profile(source).withColumn("score", 10 * sum(parts[1:], parts[0]))
    return rows.withColumns({"pass_simple": F.col("score") >= 70, "pass": (F.col("score") >= 70) & F.coalesce(core, F.lit(False))})


@register("screening", sql.query(*_PROFILE, f"SELECT {_COLUMNS}, {_SCORE} AS score, {_SCORE} >= 70 AS pass_simple, {_SCORE} >= 70 AND {_points('icir', '0.3', '0.5')} >= 6 AND {_points('monotonicity', '0.8', '1.0')} >= 6 AS pass FROM pf ORDER BY score DESC"))
def screening(source):
    return scored(source).select(*_COLUMNS.split(", "), "score", "pass_simple", "pass").orderBy(F.desc_nulls_last("score"))


@register("best_factors", sql.query(*_PROFILE, f"SELECT factor_name FROM pf ORDER BY round({_SCORE}, 9) DESC, factor_name LIMIT 2"))
def best(source):
    return scored(source).orderBy(F.desc(F.round("score", 9)), "factor_name").limit(2).select("factor_name")


def _grade_sql(name: str, m: str, low: str, high: str, more: str = ">") -> str:
    return f"CASE WHEN {m} {more} {high} THEN 'excellent' WHEN {m} {more} {low} THEN 'pass' ELSE 'fail' END AS {name}_grade"


_GRADES = ", ".join(
    [
        _grade_sql("ic_mean", "ic_mean", "0.03", "0.05"),
        _grade_sql("ic_std", "ic_std", "0.20", "0.15", "<"),
        _grade_sql("icir", "icir", "0.3", "0.5"),
        _grade_sql("win_rate", "win_rate", "0.50", "0.55"),
        _grade_sql("ic_drawdown", "ic_drawdown", "0.50", "0.30", "<"),
        _grade_sql("long_short_return", "long_short_return", "0.08", "0.15"),
        _grade_sql("long_short_sharpe", "long_short_sharpe", "0.5", "1.0"),
        _grade_sql("long_short_drawdown", "long_short_drawdown", "0.25", "0.15", "<"),
        _grade_sql("excess", "excess", "0.04", "0.08"),
        "CASE WHEN strict THEN 'excellent' WHEN monotonicity >= 0.8 THEN 'pass' ELSE 'fail' END AS monotonicity_grade",
    ]
)


@register("scorecard", sql.query(*_PROFILE, f"SELECT factor_name, {_GRADES} FROM pf"))
def scorecard(source):
    """All ten metrics of the threshold table; of the last four of these less is better."""
    more = {"ic_mean": (0.03, 0.05), "icir": (0.3, 0.5), "win_rate": (0.50, 0.55), "long_short_return": (0.08, 0.15), "long_short_sharpe": (0.5, 1.0), "excess": (0.04, 0.08)}
    less = {"ic_std": (0.20, 0.15), "ic_drawdown": (0.50, 0.30), "long_short_drawdown": (0.25, 0.15)}
    graded = [grade(F.col(m), *bounds).alias(f"{m}_grade") for m, bounds in more.items()]
    graded += [grade(-F.col(m), -low, -high).alias(f"{m}_grade") for m, (low, high) in less.items()]
    shape = F.when(F.col("strict"), "excellent").when(F.col("monotonicity") >= 0.8, "pass").otherwise("fail")
    return profile(source).select("factor_name", *graded, shape.alias("monotonicity_grade"))


_ITEMS = {
    "ic_ok": "ic_mean > 0.03",
    "icir_ok": "icir > 0.3",
    "win_ok": "win_rate > 0.5",
    "streak_ok": "long_run <= 6",
    "monotone_ok": "strict OR monotonicity >= 0.8",
    "return_ok": "long_short_return > 0.08",
    "sharpe_ok": "long_short_sharpe > 0.5",
    "turnover_ok": "turnover < 0.5",
    "size_ok": "size_share > 0.5",
    "industry_ok": "industry_share > 0.5",
}


@register("checklist", sql.query(*_PROFILE, f"SELECT factor_name, {', '.join(f'coalesce({test}, false) AS {name}' for name, test in _ITEMS.items())}, {' + '.join(f'coalesce({test}, false)::INT' for test in _ITEMS.values())} AS passed FROM pf"))
def checklist(source):
    """Ten items; the last two want the sign of the whole in most size groups and in most industries."""
    c = F.col
    items = {
        "ic_ok": c("ic_mean") > 0.03,
        "icir_ok": c("icir") > 0.3,
        "win_ok": c("win_rate") > 0.5,
        "streak_ok": c("longest") <= 6,
        "monotone_ok": c("strict") | (c("monotonicity") >= 0.8),
        "return_ok": c("long_short_return") > 0.08,
        "sharpe_ok": c("long_short_sharpe") > 0.5,
        "turnover_ok": c("turnover") < 0.5,
        "size_ok": c("size_share") > 0.5,
        "industry_ok": c("industry_share") > 0.5,
    }
    items = {n: F.coalesce(test, F.lit(False)) for n, test in items.items()}
    return profile(source).select("factor_name", *[test.alias(n) for n, test in items.items()], sum((test.cast("int") for test in items.values()), F.lit(0)).alias("passed"))


@register("factor_comparison", sql.query(*_PROFILE, "SELECT factor_name, ic_mean, icir, win_rate, monotonicity, long_short_sharpe, long_short_drawdown FROM pf"))
def comparison(source):
    return profile(source).select("factor_name", "ic_mean", "icir", "win_rate", "monotonicity", "long_short_sharpe", "long_short_drawdown")


@register("sign_aligned", sql.query(*_PROFILE[:6], "SELECT factor_name, avg(ic) AS ic_mean, min(sign) < 0 AS flipped FROM tics JOIN sg USING (factor_name) GROUP BY factor_name"))
def sign_aligned(source):
    """Mean IC of each factor after those of negative mean were flipped."""
    series = section_ics(sectioned(source))
    sign = F.broadcast(signs(series, "factor_name"))
    return series.join(sign, "factor_name").groupBy("factor_name").agg(F.avg(F.col("ic") * F.col("sign")).alias("ic_mean"), (F.min("sign") < 0).alias("flipped"))
