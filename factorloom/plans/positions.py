"""Queries on positions with a path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators.backtest import BacktestConfig
from factorloom.operators.positions import path_rows, walk
from factorloom.plans import sql
from factorloom.plans.catalog import register
from factorloom.plans.market import labelled
from factorloom.plans.research import DAYS, ValueLowVol, prices_of
from factorloom.plans.strategy import BOTH, N, OK, PICKED, SCORED
from factorloom.sources.panel import PanelSource
from factorloom.sources.scratch import written
from factorloom.streaming.monitoring import replayed

# A name is sold below -10 % of its cost, half of everything below -15 % of the highest value.
VARIANTS = [("both", 0.10, 0.15), ("fund", None, 0.15), ("plain", None, None), ("stock", 0.10, None)]


def walked(source: PanelSource) -> DataFrame:
    """Four variants of the strategy, with and without the two stops, side by side."""

    def build() -> DataFrame:
        config = BacktestConfig(max_holding=N)
        weights = written(ValueLowVol().weights(ValueLowVol().signals(labelled(source)), config).withColumnRenamed("trade_date", "month"), "weights")
        variants = source.spark.createDataFrame(VARIANTS, "strategy string, stock_limit double, fund_limit double")
        rows = path_rows(weights, prices_of(source, weights), "month")
        return walk(rows.select("*", F.explode(F.array(*[F.lit(n) for n, _, _ in VARIANTS])).alias("strategy")), variants, config)

    return source.once("positions", build)


# One recursive step for each day; holdings are a list in order of code.
_FEE = "(greatest(abs({0}) * 0.0003, 5.0) * 2 + abs({0}) * 0.001 + CASE WHEN {0} < 0 THEN abs({0}) * 0.001 ELSE 0.0 END)"
_PATH = (
    BOTH, SCORED, OK, PICKED, DAYS,
    "pw AS (SELECT trade_date AS month, code, 1.0::DOUBLE / count(*) OVER (PARTITION BY trade_date) AS weight FROM pk)",
    "py AS (SELECT trade_date, max(trade_date) OVER (PARTITION BY date_trunc('month', trade_date)) = trade_date AS turn FROM (SELECT DISTINCT trade_date FROM dp))",
    "pb AS (SELECT trade_date, turn, max(CASE WHEN turn THEN trade_date END) OVER (ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bought FROM py)",
    "pn AS (SELECT b.trade_date, w.code, w.weight FROM pb b JOIN pw w ON w.month = date_trunc('month', b.trade_date)::DATE WHERE turn)",
    "pa AS (SELECT trade_date, code, max(weight) AS weight FROM (SELECT * FROM pn UNION ALL SELECT b.trade_date, n.code, NULL FROM pb b JOIN pn n ON n.trade_date = b.bought) GROUP BY ALL)",
    """pd AS (SELECT row_number() OVER (ORDER BY trade_date) AS d, trade_date, map_from_entries(list((code, close) ORDER BY code)) AS px, map_from_entries(list((code, weight) ORDER BY code) FILTER (weight IS NOT NULL)) AS tg,
  list(code ORDER BY code) AS codes, count(weight) > 0 AS turn FROM pa JOIN dp USING (trade_date, code) WHERE close > 0 GROUP BY trade_date)""",
    "pv(strategy, sl, fl) AS (VALUES ('both', 0.10::DOUBLE, 0.15::DOUBLE), ('fund', NULL, 0.15), ('plain', NULL, NULL), ('stock', 0.10, NULL))",
    f"""walk(strategy, d, cash, held, peak, cut, nav, fees, stopped) AS (
  SELECT strategy, 0::BIGINT, 10000000.0::DOUBLE, []::STRUCT(code BIGINT, shares DOUBLE, cost DOUBLE)[], 0.0::DOUBLE, false, 0.0::DOUBLE, 0.0::DOUBLE, 0::BIGINT FROM pv
  UNION ALL
  SELECT strategy, d, cash - coalesce(list_sum(list_transform(trades, lambda t: t.v + t.fee)), 0.0),
    list_transform(list_filter(trades, lambda t: t.stays), lambda t: struct_pack(code := t.code, shares := t.shares + t.v / t.price, cost := CASE WHEN t.v > 0 THEN (t.shares * t.cost + t.v) / (t.shares + t.v / t.price) ELSE t.cost END)),
    peak, cut_now, nav, coalesce(list_sum(list_transform(trades, lambda t: t.fee)), 0.0), len(list_filter(trades, lambda t: t.hit))
  FROM (SELECT *, list_transform(orders, lambda t: struct_pack(code := t.code, shares := t.shares, cost := t.cost, price := t.price, stays := t.stays, hit := t.hit, v := CASE WHEN abs(t.v) > 1e-6 THEN t.v ELSE 0.0 END, fee := CASE WHEN abs(t.v) > 1e-6 THEN {_FEE.format('t.v')} ELSE 0.0 END)) AS trades
  FROM (SELECT *, CASE WHEN turn THEN below ELSE cut OR below END AS cut_now, CASE WHEN turn THEN
      list_transform(list_filter(codes, lambda c: tg[c] IS NOT NULL OR list_contains(list_transform(held, lambda h: h.code), c)), lambda c: struct_pack(code := c,
        shares := coalesce(list_filter(held, lambda h: h.code = c)[1].shares, 0.0), cost := coalesce(list_filter(held, lambda h: h.code = c)[1].cost, 0.0), price := px[c], stays := tg[c] IS NOT NULL, hit := false,
        v := coalesce(tg[c], 0.0) * nav * CASE WHEN below THEN 0.5 ELSE 1.0 END - coalesce(list_filter(held, lambda h: h.code = c)[1].shares, 0.0) * px[c]))
    ELSE list_transform(held, lambda h: struct_pack(code := h.code, shares := h.shares, cost := h.cost, price := px[h.code], stays := NOT coalesce(px[h.code] / h.cost - 1 < -sl, false), hit := coalesce(px[h.code] / h.cost - 1 < -sl, false),
        v := CASE WHEN coalesce(px[h.code] / h.cost - 1 < -sl, false) THEN -h.shares * px[h.code] WHEN below AND NOT cut THEN -h.shares * px[h.code] / 2 ELSE 0.0 END)) END AS orders
  FROM (SELECT *, coalesce(nav / peak - 1 < -fl, false) AS below
  FROM (SELECT w.strategy, p.d, w.cash, w.held, w.cut, p.px, p.tg, p.codes, p.turn, v.sl, v.fl, w.cash + coalesce(list_sum(list_transform(w.held, lambda h: h.shares * p.px[h.code])), 0.0) AS nav,
      greatest(w.peak, w.cash + coalesce(list_sum(list_transform(w.held, lambda h: h.shares * p.px[h.code])), 0.0)) AS peak
    FROM walk w JOIN pd p ON p.d = w.d + 1 JOIN pv v USING (strategy)))))
)""",
)


@register("positions_daily", sql.query(*_PATH, "SELECT strategy, trade_date, nav, cash, fees, len(held)::INT AS names, stopped::INT AS stopped, cut FROM walk JOIN pd USING (d)"))
def positions_daily(source):
    """Value, cash, fees, names, stops and cuts of each day for each variant."""
    return walked(source).where("code is null").select("strategy", "trade_date", "nav", "cash", "fees", "names", "stopped", "cut")


@register("positions_held", sql.query(*_PATH, "SELECT strategy, trade_date, h.code, h.shares, h.cost, px[h.code] AS price FROM (SELECT strategy, d, unnest(held) AS h FROM walk) JOIN pd USING (d) WHERE turn"))
def positions_held(source):
    """Shares, average cost and price of each holding after each rebalancing."""
    return walked(source).where("code is not null").select("strategy", "trade_date", "code", "shares", "cost", "price")


@register("positions_stops", sql.query(*_PATH, "SELECT strategy, year(trade_date)::INT AS year, sum(stopped)::BIGINT AS stopped, sum((cut AND NOT last)::INT)::BIGINT AS cuts, sum(fees) AS fees FROM (SELECT strategy, trade_date, stopped, cut, fees, coalesce(lag(cut) OVER (PARTITION BY strategy ORDER BY trade_date), false) AS last FROM walk JOIN pd USING (d)) GROUP BY ALL"))
def positions_stops(source):
    """Names stopped out, times that the position was cut, and fees, by year."""
    days = positions_daily(source).withColumn("last", F.coalesce(F.lag("cut").over(Window.partitionBy("strategy").orderBy("trade_date")), F.lit(False)))
    return days.groupBy("strategy", F.year("trade_date").alias("year")).agg(F.sum("stopped").alias("stopped"), F.sum((F.col("cut") & ~F.col("last")).cast("int")).alias("cuts"), F.sum("fees").alias("fees"))


@register("alerts_stream", sql.query(*_PATH, """rd AS (SELECT strategy, trade_date, nav / lag(nav) OVER w - 1 AS day_return, (nav - max(nav) OVER w) / max(nav) OVER w AS drawdown FROM walk JOIN pd USING (d) WINDOW w AS (PARTITION BY strategy ORDER BY trade_date))""",
    "rw AS (SELECT strategy, date_trunc('week', trade_date)::DATE AS trade_date, product(1 + day_return) - 1 AS week_return FROM rd GROUP BY ALL)",
    "SELECT strategy, trade_date, 'day loss' AS rule, day_return AS value, -0.03::DOUBLE AS \"limit\" FROM rd WHERE day_return < -0.03 UNION ALL SELECT strategy, trade_date, 'drawdown', drawdown, -0.15::DOUBLE FROM rd WHERE drawdown < -0.15 UNION ALL SELECT strategy, trade_date, 'week loss', week_return, -0.05::DOUBLE FROM rw WHERE week_return < -0.05"))
def alerts_stream(source):
    """Alerts of all variants from a stream with keyed state that stops and is restarted in the middle of the history."""
    return replayed(positions_daily(source).select("strategy", "trade_date", "nav"))
