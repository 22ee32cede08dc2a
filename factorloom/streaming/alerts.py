"""The daily alert as a stream: values of a day summed under a watermark, days over a limit kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_alerts(events: DataFrame, limit: float, late: str = "1 day") -> DataFrame:
    """user_id, day, total for each user and day whose total exceeds ``limit``.

    Works on a streaming or a batch DataFrame of ts, user_id and value. A day is given out once its
    window is behind the watermark; later rows are dropped.
    """
    days = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "user_id").agg(F.sum("value").alias("total"))
    return days.where(F.col("total") > limit).select("user_id", F.to_date("window.start").alias("day"), "total")
