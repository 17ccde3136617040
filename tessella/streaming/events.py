"""Structured Streaming over events: windows with watermarks, sessions, token buckets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return w.select("window.start", "window.end", "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n_events"))
    return s.select("user_id", "session_window.start", "session_window.end", "n_events")


def token_bucket(events: DataFrame, capacity: float, per_second: float) -> DataFrame:
    """(event_id, allowed): every user's bucket is kept as state across batches."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, last = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for t in rows["ts"].astype("int64") / 1e9:
            level = capacity if last is None else min(capacity, level + max(0.0, t - last) * per_second)
            last = t
            out.append(level >= 1)
            level -= level >= 1
        state.update((float(level), float(last)))
        yield pd.DataFrame({"event_id": rows["event_id"], "allowed": out})

    grouped = events.select("event_id", "ts", "user_id").groupBy("user_id")
    return grouped.applyInPandasWithState(run, "event_id long, allowed boolean", "level double, last double", "append", GroupStateTimeout.NoTimeout)
