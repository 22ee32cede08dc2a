"""Queries on several strategies at once, attribution at all levels, factors by family and date, and densities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.expressions import safe_div
from factorloom.operators.attribution import effects, levels
from factorloom.operators.combine import universe
from factorloom.operators.evaluate import density
from factorloom.operators.factors import LIBRARY
from factorloom.operators.sections import section_ics
from factorloom.operators.several import combined, netting, risk_allocation, strategy_gross, strategy_weights
from factorloom.plans import sql
from factorloom.plans.catalog import register
from factorloom.plans.market import labelled
from factorloom.plans.screening import _PROFILE, sectioned
from factorloom.plans.strategy import BOTH, CAL, N, OK, PICKED, SCORED, picked
from factorloom.sources.panel import PanelSource, calendar

# several strategies

STRATEGIES = ("ep", "mom", "vol")
_SEVERAL = (
    "va AS (" + " UNION ALL ".join(f"SELECT trade_date, code, fwd, '{s}' AS strategy, {s} AS score FROM lab WHERE {s} IS NOT NULL AND NOT is_st AND list_days >= 60 AND NOT is_suspend" for s in STRATEGIES) + ")",
    sql.top("vt", "va", N, "score", "strategy"),
    "vw AS (SELECT trade_date, strategy, code, fwd, 1.0::DOUBLE / count(*) OVER (PARTITION BY trade_date, strategy) AS weight FROM vt)",
    "vg AS (SELECT trade_date, strategy, sum(weight * coalesce(fwd, 0.0)) AS gross FROM vw GROUP BY ALL)",
    "vi AS (SELECT *, CASE WHEN count(gross) OVER w = 12 THEN 1.0 / nullif(stddev_samp(gross) OVER w, 0) END AS inverse FROM vg WINDOW w AS (PARTITION BY strategy ORDER BY trade_date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))",
    "vs AS (SELECT trade_date, strategy, CASE WHEN count(inverse) OVER w = count(*) OVER w THEN inverse / sum(inverse) OVER w ELSE 1.0::DOUBLE / count(*) OVER w END AS share FROM vi WINDOW w AS (PARTITION BY trade_date))",
    "vp AS (SELECT trade_date, strategy, code, weight * share AS weight FROM vw JOIN vs USING (trade_date, strategy))",
)


def several(source: PanelSource) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(weights, returns, shares) of the strategies."""

    def build() -> DataFrame:
        rows = universe(labelled(source)).unpivot(["trade_date", "code", "fwd"], list(STRATEGIES), "strategy", "score")
        return strategy_weights(rows.where("score is not null"), N)

    weights = source.once("strategies", build)
    gross = strategy_gross(weights)
    return weights, gross, risk_allocation(gross)


@register("multi_allocation", sql.query(*_SEVERAL, "SELECT * FROM vs"))
def multi_allocation(source):
    """Each strategy's share of the whole, by the risk that is known on the date."""
    return several(source)[2]


@register("multi_weights", sql.query(*_SEVERAL, "SELECT trade_date, code, sum(weight) AS weight, count(*) AS strategies FROM vp GROUP BY ALL"))
def multi_weights(source):
    """What is held of a name by all strategies together, and how many hold it."""
    weights, _, shares = several(source)
    return combined(weights, shares).groupBy("trade_date", "code").agg(F.sum("weight").alias("weight"), F.count("*").alias("strategies"))


@register("multi_netting", sql.query(*_SEVERAL, CAL, "vc AS (SELECT trade_date, strategy, code, sum(d) AS d FROM (SELECT trade_date, strategy, code, weight AS d FROM vp UNION ALL SELECT next_date, strategy, code, -weight FROM vp JOIN nx USING (trade_date) WHERE next_date IS NOT NULL) GROUP BY ALL)", "SELECT trade_date, round(sum(apart), 12) + 0.0 AS apart, round(sum(net), 12) + 0.0 AS net FROM (SELECT trade_date, code, sum(abs(d)) AS apart, abs(sum(d)) AS net FROM vc WHERE trade_date IN (SELECT trade_date FROM vp) GROUP BY ALL) GROUP BY trade_date"))
def multi_netting(source):
    """What the strategies would trade apart, and what is left when trades of one name are netted."""
    weights, _, shares = several(source)
    return netting(combined(weights, shares), calendar(labelled(source)))


@register("multi_returns", sql.query(*_SEVERAL, "vr AS (SELECT trade_date, sum(share * gross) AS gross FROM vs JOIN vg USING (trade_date, strategy) GROUP BY trade_date)", "SELECT trade_date, gross, product(1 + gross) OVER (ORDER BY trade_date) AS nav FROM vr"))
def multi_returns(source):
    """Return and value of all strategies together: the sum of the parts, before costs."""
    _, gross, shares = several(source)
    whole = shares.join(gross, ["trade_date", "strategy"]).groupBy("trade_date").agg(F.sum(F.col("share") * F.col("gross")).alias("gross"))
    return whole.withColumn("nav", F.product(1 + F.col("gross")).over(Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)))  # a row for each date


# attribution

_EFFECTS = (
    BOTH, SCORED, OK, PICKED,
    "ao AS (SELECT trade_date, industry, count(*) AS n, sum(fwd) AS r FROM pk WHERE fwd IS NOT NULL AND industry IS NOT NULL GROUP BY ALL)",
    "aw AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY trade_date) AS w FROM ao)",
    "am AS (SELECT trade_date, industry, region, count(*) AS n, sum(fwd) AS r FROM lab WHERE fwd IS NOT NULL AND industry IS NOT NULL GROUP BY ALL)",
    "aa AS (SELECT *, n::DOUBLE / sum(n) OVER w AS w, sum(r) OVER w / sum(n) OVER w AS whole FROM am WINDOW w AS (PARTITION BY trade_date))",
    """af AS (SELECT a.trade_date, a.industry, a.region, (coalesce(o.w, 0.0) - a.w) * (a.r / a.n - whole) AS allocation, a.w * (coalesce(o.r / o.n, a.r / a.n) - a.r / a.n) AS selection,
  (coalesce(o.w, 0.0) - a.w) * (coalesce(o.r / o.n, a.r / a.n) - a.r / a.n) AS interaction FROM aa a LEFT JOIN aw o ON o.trade_date = a.trade_date AND o.industry = a.industry WHERE a.trade_date IN (SELECT trade_date FROM ao))""",
)


def attributed(source: PanelSource) -> DataFrame:
    return effects(picked(source), labelled(source), "industry", "region")


@register("attribution_by_date", sql.query(*_EFFECTS, "SELECT trade_date, sum(allocation) AS allocation, sum(selection) AS selection, sum(interaction) AS interaction, sum(allocation + selection + interaction) AS excess FROM af GROUP BY trade_date"))
def attribution_by_date(source):
    """The excess of each date in its three parts."""
    total = F.sum(F.col("allocation") + F.col("selection") + F.col("interaction")).alias("excess")
    return attributed(source).groupBy("trade_date").agg(*[F.sum(p).alias(p) for p in ("allocation", "selection", "interaction")], total)


@register("attribution_levels", sql.query(*_EFFECTS, "SELECT year, region, industry, (3 - grouping(year) - grouping(region) - grouping(industry))::INT AS level, sum(allocation) AS allocation, sum(selection) AS selection, sum(interaction) AS interaction, sum(allocation + selection + interaction) AS excess FROM (SELECT *, year(trade_date)::INT AS year FROM af) GROUP BY GROUPING SETS ((year, region, industry), (year, region), (year), ())"))
def attribution_levels(source):
    """The parts by year, region and industry, and at each level above; all levels in one pass."""
    return levels(attributed(source).withColumn("year", F.year("trade_date")), "year", "region", "industry")


# factors by family

_FAMILY = ", ".join(f"('{n}', '{f.family}')" for n, f in LIBRARY.factors.items())
_FAMILIES = (
    *_PROFILE[:3],
    f"fam(factor_name, family) AS (VALUES {_FAMILY})",
    "fd AS (SELECT DISTINCT trade_date FROM rics)",
    "fi AS (SELECT d.trade_date, f.factor_name, f.family, round(r.ic * 1e6)::BIGINT AS x FROM fd d CROSS JOIN fam f LEFT JOIN rics r ON r.trade_date = d.trade_date AND r.factor_name = f.factor_name)",
    "fk AS (SELECT *, (sum(x) OVER p)::BIGINT AS total, count(x) OVER p AS n, CASE WHEN count(x) OVER t = 12 THEN (sum(x) OVER t)::BIGINT END AS twelve FROM fi WINDOW p AS (PARTITION BY factor_name ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), t AS (PARTITION BY factor_name ORDER BY trade_date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))",
    "fs AS (SELECT *, coalesce(count(twelve) OVER w = 3 AND sign(total) * (sum(twelve) OVER w)::BIGINT < 0, false) AS failed FROM fk WINDOW w AS (PARTITION BY factor_name ORDER BY trade_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))",
    "fr AS (SELECT *, row_number() OVER (PARTITION BY trade_date, family ORDER BY failed, abs(total)::DOUBLE / n DESC, factor_name) AS r FROM fs WHERE n >= 12)",
    "fc AS (SELECT trade_date, family, factor_name, failed, coalesce(lag(factor_name) OVER (PARTITION BY family ORDER BY trade_date) <> factor_name, false) AS replaced FROM fr WHERE r = 1)",
)


def chosen(source: PanelSource) -> DataFrame:
    """trade_date, family, factor_name, failed, replaced: of each family one factor, from the ICs known before the date.

    A factor has failed if its last three rolling sums of twelve ICs together have the other sign than all its ICs before. Of those that
    have not failed the one of the greatest mean IC is taken, of a family that has wholly failed the greatest of all.
    ICs count as whole millionths, so the choice is the same in any run.
    """
    ics = section_ics(sectioned(source))
    names = F.array(*[F.struct(F.lit(n).alias("factor_name"), F.lit(f.family).alias("family")) for n, f in LIBRARY.factors.items()])
    grid = ics.select("trade_date").distinct().select("trade_date", F.inline(names))
    rows = grid.join(ics, ["trade_date", "factor_name"], "left").withColumn("x", F.round(F.col("ic") * 1e6).cast("bigint"))
    order = Window.partitionBy("factor_name").orderBy("trade_date")
    past, twelve = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(-12, -1)
    rows = rows.withColumns({"total": F.sum("x").over(past), "n": F.count("x").over(past), "twelve": F.when(F.count("x").over(twelve) == 12, F.sum("x").over(twelve))})
    three = order.rowsBetween(-2, 0)
    failed = F.coalesce((F.count("twelve").over(three) == 3) & (F.signum("total") * F.sum("twelve").over(three) < 0), F.lit(False))
    known = rows.withColumn("failed", failed).where("n >= 12")
    place = F.row_number().over(Window.partitionBy("trade_date", "family").orderBy("failed", F.desc(safe_div(F.abs("total"), F.col("n"))), "factor_name"))
    best = known.withColumn("r", place).where("r = 1")
    before = F.lag("factor_name").over(Window.partitionBy("family").orderBy("trade_date"))
    return best.select("trade_date", "family", "factor_name", "failed", F.coalesce(before != F.col("factor_name"), F.lit(False)).alias("replaced"))


@register("family_choice", sql.query(*_FAMILIES, "SELECT * FROM fc"))
def family_choice(source):
    """One factor of each family on each date, so that no two of one family are stacked, and a failed one gives way to another."""
    return chosen(source)


@register("family_replacements", sql.query(*_FAMILIES, "SELECT family, count(*) AS dates, sum(replaced::INT)::BIGINT AS replaced, sum(failed::INT)::BIGINT AS all_failed, count(DISTINCT factor_name) AS factors FROM fc GROUP BY family"))
def family_replacements(source):
    """How often a family's factor was replaced, and on how many dates all of it had failed."""
    count = lambda c: F.sum(F.col(c).cast("int"))
    return chosen(source).groupBy("family").agg(F.count("*").alias("dates"), count("replaced").alias("replaced"), count("failed").alias("all_failed"), F.count_distinct("factor_name").alias("factors"))


# densities

_DENSITY = (
    "ds AS (SELECT factor_name, avg(x) AS mean, stddev_samp(x) AS std, count(*) AS n, 1.06 * stddev_samp(x) * power(count(*), -0.2) AS h FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS factor_name, {n} AS x FROM lab WHERE {n} IS NOT NULL" for n in STRATEGIES) + ") GROUP BY factor_name)",
    "db AS (SELECT factor_name, floor((x - mean) / (std / 50))::INT AS bin, count(*) AS c FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS factor_name, {n} AS x FROM lab WHERE {n} IS NOT NULL" for n in STRATEGIES) + ") JOIN ds USING (factor_name) WHERE std > 0 GROUP BY ALL)",
    "dg AS (SELECT factor_name, k::INT AS point, mean + k * std / 10 AS x, sum(c * exp(-power((k * std / 10 - (bin + 0.5) * std / 50) / h, 2) / 2)) / (n * h * sqrt(2 * pi())) AS density FROM db JOIN ds USING (factor_name), (SELECT unnest(range(-50, 51)) AS k) GROUP BY factor_name, k, mean, std, n, h)",
)


@register("density", sql.query(*_DENSITY, "SELECT factor_name, point, x, density FROM dg"))
def densities(source):
    """The density of each factor from its mean less five to its mean plus five deviations."""
    return density(labelled(source).unpivot(["trade_date", "code"], list(STRATEGIES), "factor_name", "factor"), "factor", "factor_name")
