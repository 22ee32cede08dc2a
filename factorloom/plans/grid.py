"""The parameter grid: 480 strategies as keys of one plan, on daily prices and after costs.

What decides a rank is exact in any order: information coefficients are whole millionths, and their means and deviations
come from whole sums. So a run differs from another in no holding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.expressions import by_code, safe_div
from factorloom.operators.backtest import rebalance_dates
from factorloom.operators.combine import universe
from factorloom.operators.performance import metrics
from factorloom.plans import sql
from factorloom.plans.catalog import register
from factorloom.plans.market import labelled
from factorloom.plans.research import _UNITS, DAYS
from factorloom.plans.strategy import _ICS, RATE, known_ics
from factorloom.sources.panel import PanelSource, daily_closes, trading_days

# The ranges of the parameters. What a set's penalty is worth is ours.
COUNTS = (20, 30, 50, 80, 100)
WINSOR = (0.005, 0.01, 0.02, 0.05)
PENALTY = 0.05
YEARLY = {"week": 52, "biweekly": 26, "month": 12, "quarter": 4}
SETS = ["winsor", "weighting", "top", "penalty", "freq"]


def exact_weights(known: DataFrame) -> DataFrame:
    """trade_date, a, b (mean), ra, rb (mean over deviation) of the ICs before the date, from whole sums."""
    past = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, -1)
    rows = known.select("trade_date", *[F.round(F.col(f"ic_{x}") * 1e6).cast("bigint").alias(x) for x in "ab"])

    def mean(x: str) -> Column:
        return safe_div(F.sum(x).over(past), F.count(x).over(past))

    def deviation(x: str) -> Column:
        n, s, q = F.count(x).over(past), F.sum(x).over(past), F.sum(F.col(x) * F.col(x)).over(past)
        return F.sqrt(safe_div(n * q - s * s, n * (n - 1)))

    return rows.select("trade_date", *[mean(x).alias(x) for x in "ab"], *[safe_div(mean(x), deviation(x)).alias(f"r{x}") for x in "ab"])


def ranked(source: PanelSource) -> DataFrame:
    """A row for each name and date with both factors: its ranks before winsorizing, and whether it may be held."""

    def build() -> DataFrame:
        rows = labelled(source).where("ep is not null and vol is not null").select("trade_date", "code", "ep", "vol", "is_st", "list_days", "is_suspend")
        for f in ("ep", "vol"):
            w = Window.partitionBy("trade_date").orderBy(f)
            rows = rows.withColumn(f"{f}_rank", F.rank().over(w) + (F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2.0)
        return rows

    return source.once("grid-ranks", build)


def tails(rows: DataFrame) -> DataFrame:
    """A row for each date: n, and for each factor and level of winsorizing both bounds and how many values lie at or beyond each."""
    shares = [*WINSOR, *[1 - q for q in WINSOR]]
    bounds = rows.groupBy("trade_date").agg(F.count("*").alias("n"), *[F.percentile(f, shares).alias(f"{f}_at") for f in ("ep", "vol")])
    beyond = lambda f, i: F.sum((F.col(f) <= F.col(f"{f}_at")[i] if i < len(WINSOR) else F.col(f) >= F.col(f"{f}_at")[i]).cast("bigint"))
    met = rows.join(F.broadcast(bounds), "trade_date").groupBy("trade_date").agg(*[F.array(*[beyond(f, i) for i in range(len(shares))]).alias(f"{f}_beyond") for f in ("ep", "vol")])
    return bounds.join(met, "trade_date")


def winsorized_share(f: str, i: int) -> Column:
    """The share rank of a winsorized value: those pulled back to a bound share their ranks, no other's changes."""
    low, high, n = F.col(f"{f}_at")[i], F.col(f"{f}_at")[i + len(WINSOR)], F.col("n")
    below, above = F.col(f"{f}_beyond")[i], F.col(f"{f}_beyond")[i + len(WINSOR)]
    rank = F.when(low >= high, (n + 1) / 2.0).when(F.col(f) <= low, (below + 1) / 2.0).when(F.col(f) >= high, (2 * n - above + 1) / 2.0).otherwise(F.col(f"{f}_rank"))
    return safe_div(rank, n)


def scores(source: PanelSource) -> DataFrame:
    """winsor, weighting, trade_date, code, score of the names that may be held."""
    rows = ranked(source)
    dated = source.once("grid-dates", lambda: tails(rows).join(exact_weights(known_ics(source)), "trade_date"))  # a row for each date
    dealt = F.array(*[F.struct(F.lit(q).alias("winsor"), winsorized_share("ep", i).alias("xr"), winsorized_share("vol", i).alias("yr")) for i, q in enumerate(WINSOR)])
    shares = universe(rows).join(F.broadcast(dated), "trade_date").select("trade_date", "code", "a", "b", "ra", "rb", F.inline(dealt))
    under = lambda a, b: safe_div(F.col("xr") * F.col(a) + F.col("yr") * F.col(b), F.abs(a) + F.abs(b))
    kinds = F.array(*[F.struct(F.lit(n).alias("weighting"), s.alias("score")) for n, s in (("equal", (F.col("xr") + F.col("yr")) / 2), ("ic", under("a", "b")), ("icir", under("ra", "rb")))])
    return shares.select("winsor", "trade_date", "code", F.inline(kinds)).where("score is not null")


def selections(source: PanelSource) -> DataFrame:
    """month, code, sets: the sets that a name is held under, one row for each name and month; and how many names each set holds.

    A set with a penalty holds names of the first places or names that it held the month before: a name that is neither stays behind
    as many names as it was behind. So only these are ranked again, and their number doesn't grow with the market.
    """
    scored, most = scores(source), max(COUNTS)
    by = ["winsor", "weighting", "trade_date", "code"]
    first = Window.partitionBy("winsor", "weighting", "trade_date").orderBy(F.desc("score"), "code")
    best = source.once("grid-best", lambda: scored.withColumn("place", F.row_number().over(first)).where(F.col("place") <= most).select(*by, "score", "place"))
    # a place below the count is enough without a penalty; with one, ranks differ by count
    by_place = F.transform(F.filter(F.array(*map(F.lit, COUNTS)), lambda n: F.col("place") <= n), lambda n: F.struct(n.alias("top"), F.lit(False).alias("penalty")))
    plain = best.select(*by, F.inline(by_place))
    before = best.select("winsor", "weighting", F.add_months("trade_date", 1).alias("trade_date"), "code", F.col("place").alias("last_place"))
    again = scored.join(F.broadcast(before), by).select(*by, "score", "last_place")  # at most as many as the first places
    fresh = best.join(before, by, "left_anti").select(*by, "score", F.lit(None).cast("int").alias("last_place"))
    bonus = F.when(F.col("last_place") <= F.col("top"), PENALTY).otherwise(0.0)
    held = fresh.unionByName(again).select("*", F.explode(F.array(*map(F.lit, COUNTS))).alias("top"))
    r = F.row_number().over(Window.partitionBy("winsor", "weighting", "top", "trade_date").orderBy(F.desc(F.col("score") + bonus), "code"))
    held = held.withColumn("r", r).where("r <= top").select(*by, "top", F.lit(True).alias("penalty"))
    sets = F.struct("winsor", "weighting", "top", "penalty")
    return plain.unionByName(held).groupBy(F.col("trade_date").alias("month"), "code").agg(F.collect_list(sets).alias("sets"))


def moves(source: PanelSource) -> DataFrame:
    """freq, bought, sold, month, code, ret: each name from one rebalancing to the next, for all frequencies in one pass over the prices.

    ``month`` is the last one that has ended on the day of buying. Names are priced on rebalancing days only, each by its last
    price up to the day, so no row is made for a day between them.
    """
    days = trading_days(source)
    turns = None
    for freq in YEARLY:
        one = rebalance_dates(days, freq).withColumn("freq", F.lit(freq))
        turns = one if turns is None else turns.unionByName(one)
    ends = rebalance_dates(days, "month").select(F.col("trade_date").alias("ends"), F.trunc("trade_date", "MM").alias("month"))
    # calendars: a row for each day or rebalancing
    known = F.last("month", ignorenulls=True).over(Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0))
    dated = days.join(ends, F.col("trade_date") == F.col("ends"), "left").select("trade_date", known.alias("month"))
    turns = source.once("turns", lambda: turns.join(dated, "trade_date").withColumn("sold", F.lead("trade_date").over(Window.partitionBy("freq").orderBy("trade_date"))))
    stops = turns.select("trade_date").distinct()
    after_day = F.min("stop").over(Window.orderBy("trade_date").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    stop_of = days.join(stops.withColumn("stop", F.col("trade_date")), "trade_date", "left").select(F.col("trade_date").alias("day"), after_day.alias("trade_date"))
    cells = daily_closes(source).select("code", F.col("trade_date").alias("day"), "close").join(F.broadcast(stop_of), "day")
    closes = source.once("stop-closes", lambda: cells.groupBy("code", "trade_date").agg(F.max_by("close", F.when(F.col("close").isNotNull(), F.col("day"))).alias("close")))
    grid = closes.select("code").distinct().join(F.broadcast(stops.agg(F.collect_set("trade_date").alias("stops")))).select("code", F.explode("stops").alias("trade_date"))
    last = F.last("close", ignorenulls=True).over(by_code().rowsBetween(Window.unboundedPreceding, 0))
    priced = grid.join(closes, ["code", "trade_date"], "left").select("trade_date", "code", last.alias("close"))
    at = priced.join(F.broadcast(turns), "trade_date")
    after = F.lead("close").over(Window.partitionBy("freq", "code").orderBy("trade_date"))
    return at.withColumn("ret", F.coalesce(safe_div(after, F.col("close")) - 1, F.lit(0.0))).where("sold is not null and month is not null").select("freq", F.col("trade_date").alias("bought"), "sold", "month", "code", "ret")


_WINSORED = "UNION ALL ".join(f"SELECT {q} AS winsor, trade_date, code, is_st, list_days, is_suspend, greatest(quantile_cont(ep, {q}) OVER w, least(quantile_cont(ep, {1 - q}) OVER w, ep)) AS x, greatest(quantile_cont(vol, {q}) OVER w, least(quantile_cont(vol, {1 - q}) OVER w, vol)) AS y FROM lab WHERE ep IS NOT NULL AND vol IS NOT NULL WINDOW w AS (PARTITION BY trade_date) " for q in WINSOR)
_MEAN = "(sum({0}) OVER w)::BIGINT::DOUBLE / nullif(count({0}) OVER w, 0)"
_DEVIATION = "sqrt((count({0}) OVER w * sum({0} * {0}) OVER w - sum({0}) OVER w * sum({0}) OVER w)::BIGINT::DOUBLE / nullif(count({0}) OVER w * (count({0}) OVER w - 1), 0))"
_TURNS = " UNION ALL ".join(f"SELECT '{freq}' AS freq, max(trade_date) AS bought FROM dy GROUP BY {unit}" for freq, unit in _UNITS.items())
_KEYS = "winsor, weighting, n, penalty, freq"
_GRID = (
    _ICS,
    "gi AS (SELECT trade_date, round(e.ic * 1e6)::BIGINT AS x, round(v.ic * 1e6)::BIGINT AS y FROM (SELECT DISTINCT trade_date FROM lab) LEFT JOIN ea e USING (trade_date) LEFT JOIN eb v USING (trade_date))",
    f"gk AS (SELECT trade_date, {_MEAN.format('x')} AS a, {_MEAN.format('y')} AS b, {_DEVIATION.format('x')} AS da, {_DEVIATION.format('y')} AS db FROM gi WINDOW w AS (ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
    "gn AS (SELECT trade_date, a, b, a / nullif(da, 0) AS ra, b / nullif(db, 0) AS rb FROM gk)",
    f"g1 AS ({_WINSORED})",
    f"g2 AS (SELECT *, {sql.share_rank('x', 'winsor, trade_date')} AS xr, {sql.share_rank('y', 'winsor, trade_date')} AS yr FROM g1)",
    "g3 AS (SELECT g2.*, 'equal' AS weighting, (xr + yr) / 2 AS score FROM g2 UNION ALL SELECT g2.*, 'ic', (xr * a + yr * b) / nullif(abs(a) + abs(b), 0) FROM g2 JOIN gn USING (trade_date) UNION ALL SELECT g2.*, 'icir', (xr * ra + yr * rb) / nullif(abs(ra) + abs(rb), 0) FROM g2 JOIN gn USING (trade_date))",
    "g4 AS (SELECT winsor, weighting, trade_date, code, score, row_number() OVER (PARTITION BY winsor, weighting, trade_date ORDER BY score DESC, code) AS place FROM g3 WHERE score IS NOT NULL AND NOT is_st AND list_days >= 60 AND NOT is_suspend)",
    "g5 AS (SELECT g4.*, lag(place) OVER w AS last_place, lag(trade_date) OVER w = (trade_date - INTERVAL 1 MONTH)::DATE AS follows FROM g4 WINDOW w AS (PARTITION BY winsor, weighting, code ORDER BY trade_date))",
    f"g6 AS (SELECT g5.*, n, p AS penalty, row_number() OVER (PARTITION BY winsor, weighting, n, p, trade_date ORDER BY score + CASE WHEN p AND follows AND last_place <= n THEN {PENALTY}::DOUBLE ELSE 0.0::DOUBLE END DESC, code) AS r FROM g5, (SELECT unnest([{', '.join(map(str, COUNTS))}]) AS n), (SELECT unnest([false, true]) AS p))",
    "g7 AS (SELECT winsor, weighting, n, penalty, trade_date AS month, code FROM g6 WHERE r <= n)",
    DAYS,
    "dy AS (SELECT DISTINCT trade_date FROM dp)",
    f"tn AS ({_TURNS})",
    "me AS (SELECT max(trade_date) AS ends, date_trunc('month', trade_date)::DATE AS month FROM dy GROUP BY 2)",
    "tm AS (SELECT freq, bought, lead(bought) OVER (PARTITION BY freq ORDER BY bought) AS sold, (SELECT max(month) FROM me WHERE ends <= bought) AS month FROM tn)",
    "mv AS (SELECT t.freq, t.bought, t.sold, t.month, p.code, coalesce(q.close / nullif(p.close, 0) - 1, 0.0) AS ret FROM tm t JOIN dp p ON p.trade_date = t.bought JOIN dp q ON q.trade_date = t.sold AND q.code = p.code WHERE t.month IS NOT NULL)",
    f"g8 AS (SELECT {_KEYS}, bought, sold, code, 1.0::DOUBLE / count(*) OVER w AS weight, ret, (1 + ret) / sum(1 + ret) OVER w AS drifted FROM g7 JOIN mv USING (month, code) WINDOW w AS (PARTITION BY {_KEYS}, bought))",
    f"ga AS (SELECT {_KEYS}, bought, sum(weight * ret) AS gross FROM g8 GROUP BY ALL)",
    f"gb AS (SELECT {_KEYS}, bought, sum(abs(d)) AS traded FROM (SELECT {_KEYS}, bought, code, sum(d) AS d FROM (SELECT {_KEYS}, bought, code, weight AS d FROM g8 UNION ALL SELECT {_KEYS}, sold, code, -drifted FROM g8) GROUP BY ALL) GROUP BY ALL)",
    "gm AS (SELECT freq, bought, avg(ret) AS bench_ret FROM mv GROUP BY ALL)",
    f"gc AS (SELECT {_KEYS}, bought, (1 - traded * {RATE}) * (1 + gross) - 1 AS ret, bench_ret FROM ga JOIN gb USING ({_KEYS}, bought) JOIN gm USING (freq, bought))",
    f"gd AS (SELECT *, product(1 + ret) OVER (PARTITION BY {_KEYS} ORDER BY bought) AS nav FROM gc)",
    f"ge AS (SELECT *, (nav - max(nav) OVER w) / max(nav) OVER w AS drawdown, CASE freq WHEN 'week' THEN 52.0::DOUBLE WHEN 'biweekly' THEN 26.0 WHEN 'month' THEN 12.0 ELSE 4.0 END AS y FROM gd WINDOW w AS (PARTITION BY {_KEYS} ORDER BY bought))",
    f"gf AS (SELECT {_KEYS}, y, CASE WHEN product(1 + ret) > 0 THEN power(product(1 + ret), y / count(ret)) - 1 END AS annual_return, stddev_samp(ret) * sqrt(y) AS vol, min(drawdown) AS max_drawdown, avg(ret - bench_ret) / nullif(stddev_samp(ret - bench_ret), 0) * sqrt(y) AS information_ratio FROM ge GROUP BY {_KEYS}, y)",
)


@register("param_grid", sql.query(*_GRID, "SELECT winsor::DOUBLE AS winsor, weighting, n::INT AS top, penalty, freq, annual_return, (annual_return - 0.03) / nullif(vol, 0) AS sharpe, max_drawdown, information_ratio FROM gf"))
def param_grid(source):
    """Holding count, weighting, winsorizing, penalty and frequency: 480 sets in one job, after costs on drifted weights.

    A name carries the sets that it is held under, so each price is joined once for all sets. Penalised, a name
    that its own set did not hold the month before is behind those it held. On each rebalancing day the
    names of the last month that has ended are bought at equal weights; they drift until the next.
    """
    moved = source.once("moves", lambda: moves(source))
    held = source.once("grid", lambda: moved.join(selections(source), ["month", "code"]).select("freq", "bought", "sold", "code", "ret", F.inline("sets")))
    w = Window.partitionBy(*SETS, "bought")
    held = held.withColumns({"weight": F.lit(1.0) / F.count("*").over(w), "drifted": (1 + F.col("ret")) / F.sum(1 + F.col("ret")).over(w)})
    gross = held.groupBy(*SETS, "bought").agg(F.sum(F.col("weight") * F.col("ret")).alias("gross"))
    both = held.select(*SETS, "bought", "code", F.col("weight").alias("d")).unionByName(held.select(*SETS, F.col("sold").alias("bought"), "code", (-F.col("drifted")).alias("d")))
    traded = both.groupBy(*SETS, "bought", "code").agg(F.sum("d").alias("d")).groupBy(*SETS, "bought").agg(F.sum(F.abs("d")).alias("traded"))
    bench = moved.groupBy("freq", "bought").agg(F.avg("ret").alias("bench_ret"))
    net = ((1 - F.col("traded") * RATE) * (1 + F.col("gross")) - 1).alias("ret")
    rets = gross.join(traded, [*SETS, "bought"]).join(F.broadcast(bench), ["freq", "bought"]).select(*SETS, F.col("bought").alias("trade_date"), net, "bench_ret")
    out = None
    for freq, periods in YEARLY.items():
        one = metrics(rets.where(F.col("freq") == freq), periods, keys=tuple(SETS))
        out = one if out is None else out.unionByName(one)
    return out.select(*SETS, "annual_return", "sharpe", "max_drawdown", "information_ratio")
