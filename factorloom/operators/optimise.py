"""Weights that an optimiser finds: minimum variance, mean-variance, Black-Litterman, equal risk contribution.

Covariances are sums of products in the JVM over the months up to the date, for the names that are held on it. What a
solver gets is one date's matrix, as many rows squared as names are held; it never grows with the panel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METHODS = ("min_variance", "mean_variance", "black_litterman", "risk_parity")
#: How far weights may be from the conditions of optimality.
TOLERANCE = 1e-12


def covariances(held: DataFrame, returns: DataFrame, months: int = 24, shrink: float = 0.3) -> DataFrame:
    """trade_date, a, b, cov of each two names of ``held`` (trade_date, code) by ``returns`` (trade_date, code, ret).

    Over the ``months`` up to the date; names without a return in one of them are left out. The sample matrix is pulled by
    ``shrink`` to a diagonal of its mean variance, so it can be inverted with more names than months.
    """
    back = F.explode(F.sequence(F.lit(0), F.lit(months - 1))).alias("back")
    asked = held.select("trade_date", "code", back).select("trade_date", "code", F.add_months("trade_date", -F.col("back")).alias("month"))
    known = asked.join(returns.where("ret is not null").select(F.col("trade_date").alias("month"), "code", "ret"), ["month", "code"])
    w = Window.partitionBy("trade_date", "code")
    known = known.withColumns({"n": F.count("*").over(w), "x": F.col("ret") - F.avg("ret").over(w)}).where(F.col("n") == months)
    # the names of one date only, so pairs are bounded by the number held
    one, two = known.select("trade_date", "month", F.col("code").alias("a"), F.col("x").alias("xa")), known.select("trade_date", "month", F.col("code").alias("b"), F.col("x").alias("xb"))
    sums = one.join(two, ["trade_date", "month"]).groupBy("trade_date", "a", "b").agg((F.sum(F.col("xa") * F.col("xb")) / (months - 1)).alias("s"))
    mean = F.avg(F.when(F.col("a") == F.col("b"), F.col("s"))).over(Window.partitionBy("trade_date"))
    return sums.select("trade_date", "a", "b", ((1 - shrink) * F.col("s") + F.when(F.col("a") == F.col("b"), shrink * mean).otherwise(0.0)).alias("cov"))


def bounded(cov: np.ndarray, mu: np.ndarray, aversion: float, most: float) -> np.ndarray:
    """Weights from 0 to ``most`` that add up to 1 and have the greatest mu'w - aversion / 2 w'cov w.

    Weight goes from the name of the least marginal gain to the one of the greatest, as much as pays, until none differ.
    """
    n = len(mu)
    most = max(most, 1.0 / n)
    w = np.full(n, 1.0 / n)
    scale = max(np.abs(mu).max(initial=0), aversion * np.abs(cov).max(initial=0), 1e-300)
    for _ in range(200_000):
        gain = mu - aversion * (cov @ w)
        up, down = np.where(w < most, gain, -np.inf), np.where(w > 0, gain, np.inf)
        i, j = int(up.argmax()), int(down.argmin())
        if up[i] - down[j] <= TOLERANCE * scale:
            break
        curve = aversion * (cov[i, i] + cov[j, j] - 2 * cov[i, j])
        step = min(most - w[i], w[j], (gain[i] - gain[j]) / curve if curve > 0 else np.inf)
        w[i], w[j] = (most if step == most - w[i] else w[i] + step), (0.0 if step == w[j] else w[j] - step)
    return w


def risk_parity(cov: np.ndarray) -> np.ndarray:
    """Weights whose shares of the variance are equal, by one name after another."""
    n = len(cov)
    x = 1 / np.sqrt(np.diag(cov))
    for _ in range(10_000):
        last = x.copy()
        for i in range(n):
            rest = cov[i] @ x - cov[i, i] * x[i]
            x[i] = (-rest + np.sqrt(rest * rest + 4 * cov[i, i] / n)) / (2 * cov[i, i])
        if np.abs(x - last).max() <= TOLERANCE * np.abs(x).max():
            break
    return x / x.sum()


def black_litterman(cov: np.ndarray, market: np.ndarray, views: np.ndarray, aversion: float, tau: float = 0.05) -> np.ndarray:
    """Expected returns: those that the market's weights imply, moved to the views as far as both are sure."""
    implied = aversion * cov @ market
    unsure = np.diag(np.diag(tau * cov))
    return implied + tau * cov @ np.linalg.solve(tau * cov + unsure, views - implied)


def solve(method: str, cov: np.ndarray, alpha: np.ndarray, cap: np.ndarray, aversion: float, most: float) -> np.ndarray:
    if method == "risk_parity":
        return risk_parity(cov)
    if method == "min_variance":
        return bounded(cov, np.zeros(len(cov)), 1.0, most)
    mu = alpha if method == "mean_variance" else black_litterman(cov, cap / cap.sum(), alpha, aversion)
    return bounded(cov, mu, aversion, most)


def optimised(held: DataFrame, cov: DataFrame, methods: tuple[str, ...] = METHODS, aversion: float = 3.0, most: float = 0.15) -> DataFrame:
    """trade_date, method, code, weight. ``held`` has trade_date, code, alpha (expected return), market_cap; ``cov`` is of ``covariances``.

    A date's weights add up to 1 and lie between 0 and ``most`` (risk parity's have no upper bound); a date without a matrix has no rows.
    """
    rows = cov.join(held.select("trade_date", F.col("code").alias("a"), F.coalesce("alpha", F.lit(0.0)).alias("alpha"), F.coalesce("market_cap", F.lit(1.0)).cast("double").alias("cap")), ["trade_date", "a"])
    kinds = {f.name: f.dataType.simpleString() for f in cov.schema}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("a", "ascending"), ("b", "ascending")])
        matrix = table.column("cov").to_numpy()
        n = int(round(len(matrix) ** 0.5))
        matrix, first = matrix.reshape(n, n), np.arange(n) * n
        codes, alpha, cap = (table.column(c).take(pa.array(first)) for c in ("a", "alpha", "cap"))
        weights = [solve(m, matrix, alpha.to_numpy(), cap.to_numpy(), aversion, most) for m in methods]
        dates = table.column("trade_date").slice(0, 1).to_pylist() * (n * len(methods))
        return pa.table({"trade_date": pa.array(dates, table.schema.field("trade_date").type), "method": pa.array([m for m in methods for _ in range(n)]), "code": pa.array(codes.to_pylist() * len(methods), codes.type), "weight": pa.array(np.concatenate(weights))})

    return rows.groupBy("trade_date").applyInArrow(run, f"trade_date {kinds['trade_date']}, method string, code {kinds['a']}, weight double")


def optimality(weights: DataFrame, cov: DataFrame, held: DataFrame, aversion: float = 3.0, most: float = 0.15) -> DataFrame:
    """trade_date, method, names, adds_up, in_bounds, optimal: the conditions of optimality, from the weights and the matrix alone.

    Of minimum variance and mean-variance no name that could grow gains more at the margin than one that could shrink; of risk parity all
    names have equal shares of the variance. To 1e-8 of the greatest gain or share.
    """
    names = F.count("*").over(Window.partitionBy("trade_date", "method"))
    marginal = cov.join(weights.withColumnRenamed("code", "b"), ["trade_date", "b"]).groupBy("trade_date", "method", F.col("a").alias("code")).agg(F.sum(F.col("cov") * F.col("weight")).alias("risk"))
    rows = weights.join(marginal, ["trade_date", "method", "code"]).join(held.select("trade_date", "code", F.coalesce("alpha", F.lit(0.0)).alias("alpha")), ["trade_date", "code"])
    lean = F.when(F.col("method") == "mean_variance", F.col("alpha") - aversion * F.col("risk")).otherwise(-F.col("risk"))
    rows = rows.withColumns({"gain": lean, "share": F.col("weight") * F.col("risk"), "most": F.greatest(F.lit(most), 1.0 / names)})
    best, worst = F.max(F.when(F.col("weight") < F.col("most"), F.col("gain"))), F.min(F.when(F.col("weight") > 0, F.col("gain")))
    settled = F.coalesce(best - worst, F.lit(0.0)) <= 1e-8 * F.max(F.abs("gain"))
    even = F.max("share") - F.min("share") <= 1e-8 * F.max("share")
    return rows.where("method != 'black_litterman'").groupBy("trade_date", "method").agg(
        F.count("*").alias("names"),
        (F.abs(F.sum("weight") - 1) < 1e-9).alias("adds_up"),
        (F.min("weight") >= 0).alias("in_bounds") if most >= 1 else ((F.min("weight") >= 0) & ((F.max(F.col("weight") - F.col("most")) <= 1e-12) | (F.first("method") == "risk_parity"))).alias("in_bounds"),
        F.when(F.col("method") == "risk_parity", even).otherwise(settled).alias("optimal"),
    )
