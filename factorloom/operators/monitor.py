"""Diagnosis, alerts and versions: thresholds over metric rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.expressions import safe_div

# Symptom, metric, comparison, limit.
ALERTS = (
    ("month ic", "ic", "<", 0.0),
    ("turnover", "turnover", ">", 0.60),
    ("drawdown", "drawdown", "<", -0.15),
    ("concentration", "top5", ">", 0.40),
)
DAILY_ALERTS = (("day loss", "day_return", "<", -0.03), ("drawdown", "drawdown", "<", -0.15))
WEEKLY_ALERTS = (("week loss", "week_return", "<", -0.05),)


def breaches(rows: DataFrame, rules: tuple[tuple[str, str, str, float], ...], *keep: str) -> DataFrame:
    """A row for each rule that a row breaks: ``keep``, rule, value, limit."""
    broken = lambda m, op, limit: (F.col(m) < limit) if op == "<" else (F.col(m) > limit)
    found = [F.when(broken(m, op, limit), F.struct(F.lit(name).alias("rule"), F.col(m).cast("double").alias("value"), F.lit(limit).alias("limit"))) for name, m, op, limit in rules]
    return rows.select(*keep, F.explode(F.array_compact(F.array(*found))).alias("b")).select(*keep, "b.*")


def welch_t(x: Column, recent: Column) -> Column:
    """t of the recent values' mean against the others'."""
    parts = []
    for flag in (recent, ~recent):
        v = F.when(flag, x)
        parts.append((F.avg(v), safe_div(F.var_samp(v), F.count(v))))
    (a, va), (b, vb) = parts
    return safe_div(a - b, F.sqrt(va + vb))


def version_steps(versions: DataFrame, least_gain: float = 0.05) -> DataFrame:
    """Each version with its gains over the one before; ``stop`` where the Sharpe gain is too small."""
    w = Window.orderBy("version")
    gain = lambda m: F.col(f"performance.{m}") - F.lag(f"performance.{m}").over(w)
    steps = versions.select("version", "date", *[gain(m).alias(f"{m}_gain") for m in ("annual_return", "sharpe", "max_dd")])
    return steps.withColumn("stop", F.coalesce(F.col("sharpe_gain") < least_gain, F.lit(False)))


VERSION_SCHEMA = "version string, date date, description string, changes array<string>, params string, performance struct<annual_return:double,sharpe:double,max_dd:double>"


def append_version(row: DataFrame, path: str) -> None:
    """Adds to the log of versions, which only grows."""
    row.write.mode("append").parquet(path)
