"""Pieces of DuckDB SQL that the oracles share. The panel is built from the tables once more, in SQL."""

from __future__ import annotations

PANEL = """
li AS (SELECT l_suppkey AS code, date_trunc('month', l_shipdate)::DATE AS trade_date, l_shipdate::DATE AS ship, l_orderkey, l_linenumber,
  l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_tax AS t, l_returnflag AS rf FROM lineitem),
cells AS (SELECT code, trade_date, first(p / q ORDER BY ship, l_orderkey, l_linenumber) AS open, max(p / q) AS high, min(p / q) AS low,
  sum(p::DECIMAL(18,4))::DOUBLE AS amount, sum(q::DECIMAL(18,4))::DOUBLE AS volume, sum(d::DECIMAL(18,4))::DOUBLE AS discounts,
  sum((p * (d - t))::DECIMAL(18,4))::DOUBLE AS net_profit, sum((p * d)::DECIMAL(18,4))::DOUBLE AS operating_cash_flow,
  sum((p * t)::DECIMAL(18,4))::DOUBLE AS dividends, sum((CASE WHEN rf <> 'R' THEN p * (d - t) ELSE 0.0 END)::DECIMAL(18,4))::DOUBLE AS profit_ex_items,
  count(*) AS lines, sum((rf = 'R')::INT) AS returned FROM li GROUP BY code, trade_date),
cal AS (SELECT unnest(generate_series(min(trade_date)::TIMESTAMP, max(trade_date)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS trade_date FROM cells),
dense AS (SELECT c.code, k.trade_date, x.* EXCLUDE (code, trade_date) FROM (SELECT DISTINCT code FROM cells) c CROSS JOIN cal k
  LEFT JOIN cells x ON x.code = c.code AND x.trade_date = k.trade_date),
panel AS (SELECT trade_date, d.code, open, high, low, amount / nullif(volume, 0) AS close, volume, amount, net_profit, operating_cash_flow, dividends, profit_ex_items,
  amount / nullif(net_profit, 0) AS pe_ratio, amount / nullif(operating_cash_flow + net_profit, 0) AS pb_ratio, discounts / nullif(lines, 0) AS roe,
  sum(amount) OVER (PARTITION BY d.code ORDER BY trade_date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS market_cap,
  coalesce(returned::DOUBLE / nullif(lines, 0) > 0.5, false) AS is_st, lines IS NULL AS is_suspend,
  trade_date - min(CASE WHEN lines > 0 THEN trade_date END) OVER (PARTITION BY d.code) AS list_days, s_nationkey AS industry, n_regionkey AS region
  FROM dense d LEFT JOIN supplier ON s_suppkey = d.code LEFT JOIN nation ON n_nationkey = s_nationkey),
rets AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS ret, lead(close) OVER w / nullif(close, 0) - 1 AS fwd FROM panel WINDOW w AS (PARTITION BY code ORDER BY trade_date)),
lab AS (SELECT *, avg(ret) OVER (PARTITION BY trade_date) AS bench, close / nullif(lag(close, 3) OVER w, 0) - 1 AS mom, 1.0 / nullif(pe_ratio, 0) AS ep,
  CASE WHEN count(ret) OVER w6 = 6 THEN -(stddev_samp(ret) OVER w6 * sqrt(252)) END AS vol
  FROM rets WINDOW w AS (PARTITION BY code ORDER BY trade_date), w6 AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
"""


def query(*parts: str) -> str:
    """The last part selects; those before are further common table expressions on the panel."""
    return "WITH RECURSIVE " + ",\n".join([PANEL.strip(), *parts[:-1]]) + "\n" + parts[-1]


def rank(x: str, keys: str) -> str:
    return f"(rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0)"


def share_rank(x: str, keys: str) -> str:
    return f"({rank(x, keys)} / count(*) OVER (PARTITION BY {keys}))"


def corr(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def centred(x: str, keys: str) -> str:
    """Twice the average rank less its mean, a whole number."""
    return f"(2 * rank() OVER (PARTITION BY {keys} ORDER BY {x}) + count(*) OVER (PARTITION BY {keys}, {x}) - count(*) OVER (PARTITION BY {keys}) - 2)"


def rank_corr(x: str, y: str) -> str:
    """Of centred ranks; sums of whole numbers are the same in any order."""
    return f"sum(({x} * {y})::HUGEINT)::DOUBLE / nullif(sqrt(sum(({x} * {x})::HUGEINT)::DOUBLE) * sqrt(sum(({y} * {y})::HUGEINT)::DOUBLE), 0)"


def ic(name: str, factor: str, source: str = "lab", label: str = "fwd", keys: str = "trade_date", at_least: int = 20) -> str:
    """A table of rank ICs by ``keys``."""
    return (
        f"{name} AS (SELECT {keys}, round({rank_corr('f', 'r')}, 12) + 0.0 AS ic, count(*) AS n FROM (SELECT {keys}, {centred(factor, keys)} AS f, {centred(label, keys)} AS r "
        f"FROM {source} WHERE {factor} IS NOT NULL AND {label} IS NOT NULL) GROUP BY {keys} HAVING count(*) > {at_least})"
    )


def groups(name: str, x: str, n: int, source: str = "lab", out: str = "grp", keys: str = "trade_date") -> str:
    """``source`` rows with a value, and their equal-frequency group; rows of degenerate dates get null."""
    edges = ", ".join(str(i / n) for i in range(n + 1))
    above = " + ".join(f"(v.{x} > q[{i + 1}])::INT" for i in range(1, n))
    strict = " AND ".join(f"q[{i + 1}] < q[{i + 2}]" for i in range(n))
    on = " AND ".join(f"v.{k} = e.{k}" for k in keys.split(", "))
    return f"{name} AS (SELECT v.*, CASE WHEN {strict} THEN {above} + 1 END AS {out} FROM (SELECT * FROM {source} WHERE {x} IS NOT NULL) v JOIN (SELECT {keys}, quantile_cont({x}, [{edges}]) AS q FROM {source} WHERE {x} IS NOT NULL GROUP BY {keys}) e ON {on})"


def layers(name: str, factor: str, n: int = 5) -> str:
    return groups(f"{name}_cut", factor, n, "(SELECT * FROM lab WHERE fwd IS NOT NULL)") + f',\n{name} AS (SELECT trade_date, grp AS "group", avg(fwd) AS ret, count(*) AS n FROM {name}_cut WHERE grp IS NOT NULL GROUP BY trade_date, grp)'


def top(name: str, source: str, n: int, score: str, strata: str = "") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_date{', ' + strata if strata else ''} ORDER BY {score} DESC NULLS LAST, code) AS place FROM {source} WHERE {score} IS NOT NULL) WHERE place <= {n})"
