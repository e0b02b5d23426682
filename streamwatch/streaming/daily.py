"""Streaming twins of the daily aggregation, the cooldown and the run writer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def complete_days(hourly: DataFrame, late: str = "6 hours") -> DataFrame:
    """Days of a live feed of (entity_id, ts, precip); closed when the watermark passes. NULL unless all 24 hours came."""
    # one row an hour is kept by the hourly window, before the day is built on it
    hours = hourly.withWatermark("ts", late).groupBy("entity_id", F.window("ts", "1 hour")).agg(F.max("precip").alias("precip"))
    days = hours.groupBy("entity_id", F.window(F.window_time("window"), "1 day"))
    out = days.agg(F.count("precip").alias("n_hours"), F.sum("precip").alias("_s"), F.max("precip").alias("_m"))
    whole = F.col("n_hours") == 24
    return out.select("entity_id", F.to_date("window.start").alias("date"), "n_hours", F.when(whole, F.col("_s")).alias("precip_mm"), F.when(whole, F.col("_m")).alias("precip_max_hourly"))


def cooled(alerts: DataFrame, hours: int = 72) -> DataFrame:
    """Alerts of a live stream (entity_id, issued_at, severity) with `suppressed`: one passed less than the cooldown before."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0]) if state.exists else None
        for df in frames:
            df = df.sort_values("issued_at")
            flags = []
            for at, severity in zip(df["issued_at"], df["severity"], strict=True):
                hold = last is not None and pd.Timedelta(0) <= at - last < pd.Timedelta(hours=hours)
                flags.append(hold)
                if not hold and severity in ("ALERT", "WATCH"):
                    last = at
            yield pd.DataFrame({"entity_id": df["entity_id"], "issued_at": df["issued_at"], "severity": df["severity"], "suppressed": flags})
        if last is not None:
            state.update((last.isoformat(),))

    return alerts.groupBy("entity_id").applyInPandasWithState(step, "entity_id long, issued_at timestamp, severity string, suppressed boolean", "last string", "append", GroupStateTimeout.NoTimeout)


def run_writer(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: replaces the partitions of the issue dates in the batch, so that a repeated batch changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("issued_date").parquet(path)

    return write
