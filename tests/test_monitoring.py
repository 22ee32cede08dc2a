"""Monitoring as keyed state: restarts, late and repeated values, timers."""

import datetime as dt
import random

from pyspark.sql import functions as F

from factorloom.streaming.monitoring import DAY_MS, Watch, replayed, strategy_alerts

FIRST = dt.date(2001, 1, 3)
VALUES = "strategy string, trade_date date, nav double"


def path(seed, n=90):
    """Working days of a value that falls often."""
    draw, nav, out = random.Random(seed), 100.0, []
    for k in range(n):
        day = FIRST + dt.timedelta(days=k)
        if day.weekday() < 5:
            nav *= 1 + draw.gauss(-0.003, 0.025)
            out.append((day, nav))
    return out


def by_hand(days):
    out, peak, weeks = set(), 0.0, {}
    for k, (day, nav) in enumerate(days):
        peak = max(peak, nav)
        if k:
            gain = nav / days[k - 1][1] - 1
            monday = day - dt.timedelta(days=day.weekday())
            weeks[monday] = weeks.get(monday, 1.0) * (1 + gain)
            if gain < -0.03:
                out.add((day, "day loss", round(gain, 9)))
        if nav / peak - 1 < -0.15:
            out.add((day, "drawdown", round((nav - peak) / peak, 9)))
    return out | {(m, "week loss", round(g - 1, 9)) for m, g in weeks.items() if g - 1 < -0.05}


def told(df):
    out = {}
    rows = df.collect()
    for r in rows:
        out.setdefault(r["strategy"], set()).add((r["trade_date"], r["rule"], round(r["value"], 9)))
    assert sum(map(len, out.values())) == len(rows)  # nothing is told twice
    return out


def test_restarts_change_nothing(spark):
    paths = {"a": path(1), "b": path(2), None: path(3, 40)}
    want = {s: by_hand(p) for s, p in paths.items()}
    assert all({rule for _, rule, _ in w} == {"day loss", "drawdown", "week loss"} for w in want.values())
    values = spark.createDataFrame([(s, d, v) for s, p in paths.items() for d, v in p], VALUES)
    for parts in (1, 2, 5):
        assert told(replayed(values, parts)) == want
    assert replayed(values.limit(0)).count() == 0


def test_late_repeated_and_missing_values(spark, tmp_path):
    days = path(4, 30)
    rows = spark.createDataFrame([("a", d, v) for d, v in days], VALUES).select("strategy", F.col("trade_date").cast("timestamp").alias("ts"), "nav")

    def step(*batch):
        spark.createDataFrame([(s, dt.datetime.combine(d, dt.time(hour)), v) for s, d, hour, v in batch], rows.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        run = strategy_alerts(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
        return told(spark.read.parquet(str(tmp_path / "out"))).get("a", set())

    (d0, v0), (d1, v1), (d2, v2) = days[:3]
    assert step(("a", d2, 0, v2 * 0.5), ("a", d0, 0, v0)) == set()  # the watermark has passed neither
    assert step(("a", d2, 5, v2), ("a", d2, 9, v2 * 0.9), ("a", d1, 0, v1), ("a", d1, 3, None)) == set()  # a gap is filled, a day corrected, a null ignored
    later = d2 + dt.timedelta(days=40)
    got = step(("", later, 0, None))  # only tells the time; timers close the days and the week of "a"
    assert got == by_hand([(d0, v0), (d1, v1), (d2, v2)])
    assert step(("a", d2, 0, v2 * 0.1), ("", later, 1, None)) == got  # too late


def test_state_goes_round_and_orders_days():
    days = path(5)
    number = lambda d: (d - dt.date(1970, 1, 1)).days
    waiting, watch, out = [*days], Watch(), set()
    for k in range(0, len(waiting), 7):  # a week's days in any order, the state written and read between
        chunk = waiting[k : k + 7]
        random.Random(k).shuffle(chunk)
        watch = Watch.of(watch.state())
        watch.waiting |= {number(d): v for d, v in chunk}
        out |= {(dt.date(1970, 1, 1) + dt.timedelta(days=d), rule, round(v, 9)) for d, rule, v in watch.settle(number(max(d for d, _ in chunk)) + 1)}
    assert watch.next_close() == watch.week + 7
    out |= {(dt.date(1970, 1, 1) + dt.timedelta(days=d), rule, round(v, 9)) for d, rule, v in watch.settle(watch.week + 7)}
    assert out == by_hand(days) and watch.next_close() is None and DAY_MS == 86_400_000
