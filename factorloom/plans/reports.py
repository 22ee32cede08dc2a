"""Reports in Markdown: of a factor, of its evaluation, and of the strategy; and the data of their charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators.factors import LIBRARY
from factorloom.operators.performance import drawdown_curve, metrics
from factorloom.plans import sql
from factorloom.plans.catalog import register
from factorloom.plans.evaluation import IC, LAYERS, ics, lay
from factorloom.plans.screening import _PROFILE, _SCORE, _points, profile, scored
from factorloom.plans.strategy import BASE, BENCH, N, picked, strategy_returns, turned

#: A line of a report: its text with a place for the figure, the figure, and how it is shown: plain, percent, number or text.
Line = tuple[str, str | None, str]


def shown(name: str, kind: str) -> Column:
    """A figure as text; n/a where it is not known. Figures are rounded first, so a half goes up everywhere."""
    c = F.col(name)
    made = {"plain": F.format_string("%.4f", F.round(c, 4)), "percent": F.format_string("%.2f%%", F.round(c * 100, 2)), "number": c.cast("bigint").cast("string"), "text": c.cast("string"), "yes": F.when(c, "yes").otherwise("no")}[kind]
    return F.when(c.isNotNull(), made).otherwise("n/a")


def shown_sql(expr: str, kind: str) -> str:
    expr = f"({expr})"
    made = {"plain": f"format('{{:.4f}}', round({expr}, 4))", "percent": f"format('{{:.2f}}%', round({expr} * 100, 2))", "number": f"({expr})::BIGINT::VARCHAR", "text": f"({expr})::VARCHAR", "yes": f"CASE WHEN {expr} THEN 'yes' ELSE 'no' END"}[kind]
    return f"CASE WHEN ({expr}) IS NULL THEN 'n/a' ELSE {made} END"


def report(lines: list[Line]) -> Column:
    """Lines one below the other; a line without a figure is taken as it is."""
    return F.concat_ws("\n", *[F.lit(text) if name is None else F.concat(F.lit(text), shown(name, kind)) for text, name, kind in lines]).alias("report")


def report_sql(lines: list[Line], names: dict[str, str] | None = None) -> str:
    parts = [f"'{text}'" if name is None else f"'{text}' || {shown_sql((names or {}).get(name, name), kind)}" for text, name, kind in lines]
    return "concat_ws(chr(10), " + ", ".join(parts) + ") AS report"


def title(text: str) -> Line:
    return text, None, ""


_FACTOR_LINES: list[Line] = [
    ("# Factor report: ", "factor_name", "text"),
    title(""),
    title("## 1 Overview"),
    ("- family: ", "family", "text"),
    ("- expected direction: ", "direction", "text"),
    ("- neutral to: ", "neutral", "text"),
    ("- rows looked back: ", "rows_back", "number"),
    title("## 2 Preparation"),
    title("- winsorized to 2.5 and 97.5 percent of the date, neutralized, standardized"),
    title("## 3 Information coefficient"),
    ("- months: ", "months", "number"),
    ("- mean: ", "ic_mean", "plain"),
    ("- deviation: ", "ic_std", "plain"),
    ("- ratio: ", "icir", "plain"),
    ("- months above 0: ", "win_rate", "percent"),
    ("- longest run below 0: ", "longest", "number"),
    title("## 4 Layers"),
    title("- groups: 5"),
    ("- long-short annual return: ", "long_short_return", "percent"),
    ("- long-short Sharpe ratio: ", "long_short_sharpe", "plain"),
    ("- long-short deepest drawdown: ", "long_short_drawdown", "percent"),
    ("- monotonicity: ", "monotonicity", "plain"),
    ("- strictly monotone: ", "strict", "yes"),
    title("## 5 Risks"),
    ("- deepest run of the coefficient: ", "ic_drawdown", "plain"),
    ("- turnover of the top group: ", "turnover", "percent"),
    ("- size groups with the same sign: ", "size_share", "percent"),
    ("- industries with the same sign: ", "industry_share", "percent"),
]
_DECLARED = [(n, f.family, {1: "high is good", -1: "low is good"}[f.direction], " and ".join(f.neutralize or ("nothing",)).replace("market_cap", "size"), f.max_window) for n, f in LIBRARY.factors.items()]
_DECLARED_SQL = "dc(factor_name, family, direction, neutral, rows_back) AS (VALUES " + ", ".join(str(row) for row in _DECLARED) + ")"


def declared(rows: DataFrame) -> DataFrame:
    """The rows with what a factor's declaration says, as columns."""
    known = F.create_map(*[x for n, *more in _DECLARED for x in (F.lit(n), F.struct(*[F.lit(v).alias(c) for c, v in zip(("family", "direction", "neutral", "rows_back"), more, strict=True)]))])
    return rows.withColumn("__d", known[F.col("factor_name")]).select("*", "__d.*").drop("__d")


@register("report_factor", sql.query(*_PROFILE, _DECLARED_SQL, f"SELECT factor_name, {report_sql(_FACTOR_LINES, {'longest': 'long_run'})} FROM pf JOIN dc USING (factor_name)"))
def report_factor(source):
    """A report on each factor of the library."""
    return declared(profile(source)).select("factor_name", report(_FACTOR_LINES))


_EVALUATION_LINES: list[Line] = [
    ("# Evaluation report: ", "factor_name", "text"),
    title(""),
    title("## 1 Summary"),
    ("- score of 100: ", "score", "plain"),
    ("- passed: ", "pass", "yes"),
    ("- used with the opposite sign: ", "flipped", "yes"),
    title("## 2 Information coefficient"),
    title("| mean | ratio | months above 0 |"),
    title("|-|-|-|"),
    ("| ", "ic_mean", "plain"),
    ("| ", "icir", "plain"),
    ("| ", "win_rate", "percent"),
    title("## 3 Layers"),
    ("- long-short annual return: ", "long_short_return", "percent"),
    ("- long-short Sharpe ratio: ", "long_short_sharpe", "plain"),
    ("- annual excess of the top group: ", "excess", "percent"),
    ("- share of names that stay: ", "stability", "percent"),
    title("## 4 Robustness"),
    ("- by size: ", "size_share", "percent"),
    ("- by industry: ", "industry_share", "percent"),
    title("## 5 Conclusion"),
    ("- kept in the library: ", "pass", "yes"),
]
_PASS = f"({_SCORE} >= 70 AND coalesce({_points('icir', '0.3', '0.5')} >= 6 AND {_points('monotonicity', '0.8', '1.0')} >= 6, false))"


@register("report_evaluation", sql.query(*_PROFILE, f"SELECT factor_name, {report_sql(_EVALUATION_LINES, {'score': _SCORE, 'pass': _PASS})} FROM pf"))
def report_evaluation(source):
    """A report on how each factor was evaluated."""
    return scored(source).select("factor_name", report(_EVALUATION_LINES))


_STRATEGY_LINES: list[Line] = [
    title("# Strategy report: value and low volatility"),
    title(""),
    title("## 1 Overview"),
    title("- two factors, rebalanced monthly, against the mean of all names"),
    title("## 2 Factors"),
    title("- earnings yield: weight one half"),
    title("- low volatility: weight one half"),
    title("- combined by mean ranks"),
    title("## 3 Backtest"),
    ("- first month: ", "first", "text"),
    ("- last month: ", "last", "text"),
    ("- names held at most: ", "most", "number"),
    ("- cost of a traded unit: ", "rate", "percent"),
    title("## 4 Results"),
    title("### Return"),
    ("- annual return: ", "annual_return", "percent"),
    ("- annual excess: ", "excess", "percent"),
    ("- cumulative return: ", "cumulative", "percent"),
    title("### Risk"),
    ("- annual volatility: ", "annual_vol", "percent"),
    ("- deepest drawdown: ", "max_drawdown", "percent"),
    ("- month of the deepest drawdown: ", "trough", "text"),
    title("### Return for risk"),
    ("- Sharpe ratio: ", "sharpe", "plain"),
    ("- information ratio: ", "information_ratio", "plain"),
    ("- Calmar ratio: ", "calmar", "plain"),
    title("## 5 Holdings"),
    ("- names held on average: ", "names", "plain"),
    ("- turnover on average: ", "turnover", "percent"),
    ("- industries held on average: ", "industries", "plain"),
    title("## 6 Years"),
    ("- best year: ", "best_year", "percent"),
    ("- worst year: ", "worst_year", "percent"),
]


@register(
    "report_strategy",
    sql.query(
        *BASE, BENCH,
        "rn AS (SELECT *, product(1 + ret) OVER (ORDER BY trade_date) AS nav FROM rt), rd AS (SELECT *, (nav - max(nav) OVER (ORDER BY trade_date)) / max(nav) OVER (ORDER BY trade_date) AS drawdown FROM rn)",
        "ra AS (SELECT min(trade_date) AS first, max(trade_date) AS last, product(1 + ret) - 1 AS cumulative, power(product(1 + ret), 12.0 / count(ret)) - 1 AS annual_return, power(product(1 + bench_ret), 12.0 / count(bench_ret)) - 1 AS bench_annual, stddev_samp(ret) * sqrt(12) AS annual_vol, avg(ret - bench_ret) / nullif(stddev_samp(ret - bench_ret), 0) * sqrt(12) AS information_ratio, min(drawdown) AS max_drawdown, arg_min(trade_date, (drawdown, trade_date)) AS trough FROM rd)",
        "rh AS (SELECT avg(n) AS names, avg(i) AS industries FROM (SELECT count(*) AS n, count(DISTINCT industry) AS i FROM pk GROUP BY trade_date))",
        "ry AS (SELECT max(r) AS best_year, min(r) AS worst_year FROM (SELECT product(1 + ret) - 1 AS r FROM rt GROUP BY year(trade_date)))",
        "ru AS (SELECT avg(t) AS turnover FROM (SELECT 0.5 * sum(abs(change)) AS t FROM td GROUP BY trade_date))",
        f"SELECT {report_sql(_STRATEGY_LINES, {'most': str(N), 'rate': '0.002', 'excess': 'annual_return - bench_annual', 'sharpe': '(annual_return - 0.03) / nullif(annual_vol, 0)', 'calmar': 'annual_return / nullif(abs(max_drawdown), 0)'})} FROM ra, rh, ry, ru",
    ),
)
def report_strategy(source):
    """The strategy's report. One row: each part is an aggregate over dates."""
    from factorloom.plans.strategy import RATE

    rets = source.once("strategy", lambda: strategy_returns(source))
    one = metrics(rets, 12).select("annual_return", "excess", "cumulative", "annual_vol", "max_drawdown", "sharpe", "information_ratio", "calmar")
    spans = drawdown_curve(rets).agg(F.min("trade_date").alias("first"), F.max("trade_date").alias("last"), F.min_by("trade_date", F.struct("drawdown", "trade_date")).alias("trough"))
    rows = picked(source).groupBy("trade_date").agg(F.count("*").alias("n"), F.count_distinct("industry").alias("i")).agg(F.avg("n").alias("names"), F.avg("i").alias("industries"))
    years = rets.groupBy(F.year("trade_date")).agg((F.product(1 + F.col("ret")) - 1).alias("r")).agg(F.max("r").alias("best_year"), F.min("r").alias("worst_year"))
    for part in (spans, rows, years, turned(source).agg(F.avg("turnover").alias("turnover"))):
        one = one.join(F.broadcast(part))  # one row each
    return one.withColumns({"most": F.lit(N), "rate": F.lit(RATE)}).select(report(_STRATEGY_LINES))


# the data of charts


@register("chart_ic_histogram", sql.query(IC, "SELECT (floor(ic / 0.05) * 0.05)::DOUBLE AS low, count(*) AS n FROM ics WHERE ic IS NOT NULL GROUP BY 1"))
def chart_ic_histogram(source):
    """How many months' ICs fall into each twentieth."""
    return ics(source).where("ic is not null").groupBy((F.floor(F.col("ic") / 0.05) * F.lit(0.05)).alias("low")).agg(F.count("*").alias("n"))


@register("chart_group_nav", sql.query(LAYERS, 'SELECT trade_date, "group", product(1 + ret) OVER (PARTITION BY "group" ORDER BY trade_date) AS nav FROM lay'))
def chart_group_nav(source):
    """The value of each layer over time."""
    w = Window.partitionBy("group").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    return lay(source).select("trade_date", "group", F.product(1 + F.col("ret")).over(w).alias("nav"))


@register("chart_monthly_heat", sql.query(*BASE, BENCH, "SELECT year(trade_date)::INT AS year, month(trade_date)::INT AS month, product(1 + ret) - 1 AS ret FROM rt GROUP BY ALL"))
def chart_monthly_heat(source):
    """Returns by year and month."""
    return strategy_returns(source).groupBy(F.year("trade_date").alias("year"), F.month("trade_date").alias("month")).agg((F.product(1 + F.col("ret")) - 1).alias("ret"))
