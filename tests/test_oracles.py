"""A part of the registered queries against DuckDB; the others are run by the driver."""

import math

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events".split()
NAMES = ["panel", "universe_filter", "factor_momentum20", "winsorize", "monthly_ic_all_dates", "ic_by_industry", "select_top_n", "trades", "nav_fold", "perf_metrics", "daily_alerts", "asof_return", "published_roe", "index_members", "backtest_quarter", "clean_gap", "checklist", "diagnosis_questions", "factor_corr_by_year", "positions_daily", "alerts_stream", "tradable_picks", "backtest_tradable", "figures_known", "multi_netting", "attribution_levels", "optimised_weights_check"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows_of(frame):
    plain = lambda v: None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)[:10] if hasattr(v, "year") else v
    out = [[plain(v) for v in row] for row in frame[sorted(frame.columns)].astype(object).where(frame.notna(), None).values.tolist()]
    return sorted(out, key=lambda r: [f"{v:.6e}" if isinstance(v, float) else str(v) for v in r])


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, sf, name):
    got, want = __spark_entry__.queries()[name](spark, sf).toPandas(), duck.execute(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for a, b in zip(rows_of(got), rows_of(want), strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12)) for x, y in zip(a, b, strict=True)), (a, b)


def test_every_query_but_those_that_draw_or_iterate_has_sql():
    from factorloom.plans import registry

    assert set(registry.queries()) - set(registry.oracle_sql()) == {"mc_bootstrap", "optimised_weights", "optimised_returns", "learned_scores", "learned_ic", "searched_weights"}


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_alerts_as_a_stream(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    from factorloom.streaming.alerts import daily_alerts

    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.select("ts", "user_id", "value").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, user_id long, value double").parquet(str(tmp_path / "in"))
    query = daily_alerts(stream, 50.0).writeStream.format("memory").queryName("alerts").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    last = events.agg(F.max("ts")).first()[0]
    batch = {(r["user_id"], r["day"]) for r in daily_alerts(events, 50.0).collect()}
    live = {(r["user_id"], r["day"]) for r in spark.table("alerts").collect()}
    assert live <= batch and batch - live <= {(u, d) for u, d in batch if (last.date() - d).days <= 2}
