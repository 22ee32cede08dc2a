"""Monitoring of strategies as keyed state: value, peak and the week's growth of each, and alerts from them.

Values may come late and out of order: those of a day wait in the state until the watermark has passed the day, and are
then taken in order, so alerts are those of the whole history, whatever the batches were and wherever the stream was
restarted. A day or a week closes by a timer too, without a further value of its strategy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factorloom.operators.monitor import DAILY_ALERTS, WEEKLY_ALERTS
from factorloom.sources.scratch import fresh_path

DAY_MS = 86_400_000
STATE = "days array<bigint>, navs array<double>, last double, peak double, week bigint, growth double"
ALERT = "strategy string, trade_date date, rule string, value double, limit double"
_LIMITS = {name: limit for name, _, _, limit in DAILY_ALERTS + WEEKLY_ALERTS}


@dataclass
class Watch:
    """What is known of one strategy. Days are numbers since 1970, a Thursday; weeks begin on Mondays."""

    waiting: dict[int, float] = field(default_factory=dict)
    last: float | None = None
    peak: float | None = None
    week: int | None = None
    growth: float | None = None

    @classmethod
    def of(cls, state: tuple) -> Watch:
        days, navs, *rest = state
        return cls(dict(zip(days, navs, strict=True)), *rest)

    def state(self) -> tuple:
        return (list(self.waiting), list(self.waiting.values()), self.last, self.peak, self.week, self.growth)

    def next_close(self) -> int | None:
        """The day at whose beginning something waiting is complete."""
        ends = [d + 1 for d in self.waiting] + ([self.week + 7] if self.week is not None else [])
        return min(ends, default=None)

    def settle(self, today: int) -> Iterator[tuple[int, str, float]]:
        """Alerts (day, rule, value) of the days before ``today``, and of the weeks that ended before it."""
        for day in sorted(d for d in self.waiting if d < today):
            nav, monday = self.waiting.pop(day), day - (day + 3) % 7
            if monday != self.week:
                yield from self._close_week()
                self.week = monday
            if self.last:
                gain = nav / self.last - 1
                self.growth = (1.0 if self.growth is None else self.growth) * (1 + gain)
                if gain < _LIMITS["day loss"]:
                    yield day, "day loss", gain
            self.last, self.peak = nav, nav if self.peak is None else max(self.peak, nav)
            fall = (nav - self.peak) / self.peak if self.peak else 0.0
            if fall < _LIMITS["drawdown"]:
                yield day, "drawdown", fall
        if self.week is not None and self.week + 7 <= today:
            yield from self._close_week()

    def _close_week(self) -> Iterator[tuple[int, str, float]]:
        if self.growth is not None and self.growth - 1 < _LIMITS["week loss"]:
            yield self.week, "week loss", self.growth - 1
        self.week = self.growth = None


def _watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    watch = Watch.of(state.get) if state.exists else Watch()
    fresh: dict[int, float] = {}
    if not state.hasTimedOut:
        for rows in batches:
            for day, nav in zip(rows["day"].tolist(), rows["nav"].tolist(), strict=True):
                if nav == nav:
                    fresh[day] = max(nav, fresh.get(day, nav))
    watch.waiting |= fresh
    now = state.getCurrentWatermarkMs()
    found = [(*key, pd.Timestamp(day, unit="D").date(), rule, value, _LIMITS[rule]) for day, rule, value in watch.settle(now // DAY_MS)]
    state.update(watch.state())
    if (close := watch.next_close()) is not None:
        state.setTimeoutTimestamp(max(close * DAY_MS - 1, now + 1))
    if found:
        yield pd.DataFrame(found, columns=["strategy", "trade_date", "rule", "value", "limit"])


def strategy_alerts(values: DataFrame, late: str = "7 days") -> DataFrame:
    """``ALERT`` rows of a stream of strategy, ts and nav: loss of a day, drawdown, loss of a week (dated by its Monday).

    Days are UTC's, from 1970 on. Of several values of a day a later batch's counts, and within a batch the largest.
    A null value only tells the time. Rows later than ``late`` are dropped; rows without a strategy are one strategy's.
    """
    timed = values.withWatermark("ts", late)
    keyed = timed.select("strategy", "ts", F.floor(F.unix_millis("ts") / DAY_MS).alias("day"), F.col("nav").cast("double").alias("nav"))
    return keyed.groupBy("strategy").applyInPandasWithState(_watch, ALERT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def replayed(values: DataFrame, parts: int = 2) -> DataFrame:
    """The alerts of a history (strategy, trade_date, nav) that arrives in ``parts`` of time, the stream being restarted for each.

    Each run goes on from the checkpoint of the one before. In the end a value of no strategy tells that the last week is over.
    """
    spark = values.sparkSession
    inbox, outbox, checkpoint = (fresh_path(spark, f"monitor-{what}") for what in ("in", "out", "state"))
    rows = values.select("strategy", F.col("trade_date").cast("timestamp").alias("ts"), F.col("nav").cast("double").alias("nav"))
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    if first is None:
        return spark.createDataFrame([], ALERT)
    piece = F.least(F.floor((F.unix_millis("ts") - F.unix_millis(F.lit(first))) * parts / F.greatest(F.unix_millis(F.lit(last)) - F.unix_millis(F.lit(first)), F.lit(1))), F.lit(parts - 1))
    for k in range(parts):
        rows.where(piece == k).write.mode("append").parquet(inbox)
        if k == parts - 1:
            over = spark.range(1).select(F.lit("").alias("strategy"), (F.lit(last) + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(None).cast("double").alias("nav"))
            over.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(rows.schema).parquet(inbox)
        run = strategy_alerts(stream).writeStream.format("parquet").option("path", outbox).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(ALERT).parquet(outbox)
