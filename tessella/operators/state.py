"""Limits, sessions, queues and caches over events(event_id, ts, user_id, event_type, value)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts) -> Column:
    """Microseconds since 1970 of a wall-clock time, whatever the session's time zone."""
    c = (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), c)


def fixed_window_limit(events: DataFrame, limit: int, seconds: int = 3600) -> DataFrame:
    """Per user and aligned window, the first ``limit`` events are allowed."""
    slot = F.floor(micros("ts") / (seconds * 1_000_000))
    order = Window.partitionBy("user_id", "slot").orderBy("ts", "event_id")
    return events.withColumn("slot", slot).withColumn("allowed", F.row_number().over(order) <= limit).groupBy("user_id", "slot").agg(F.sum(F.col("allowed").cast("long")).alias("n_allowed"), F.sum((~F.col("allowed")).cast("long")).alias("n_refused"))


def trailing_count(events: DataFrame, seconds: int) -> DataFrame:
    """Events of the user in the trailing window, this one included."""
    w = Window.partitionBy("user_id").orderBy(micros("ts")).rangeBetween(-seconds * 1_000_000, 0)
    return events.select("event_id", F.count("*").over(w).alias("n"))


def sessions(events: DataFrame, gap: int = 1800) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce((micros("ts") - micros(F.lag("ts").over(w)) > gap * 1_000_000).cast("int"), F.lit(1))
    marked = events.withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return marked.groupBy("user_id", "session").agg(F.count("*").alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


#: Where a null time counts, as it did in pandas: after all others in order, and before them in value.
_NEVER = -(2**63) // 1000


def _folded(events: DataFrame, key: str, flag: str, step: Callable) -> DataFrame:
    """(event_id, flag): ``step`` folds the events of each key in order of time, then event_id: from the state (None at first) and the microseconds to the next state and the flag.

    Sorted rows pass batch by batch: a pandas group for each key takes a
    millisecond however few its events, and holds all of them however many.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = batches, None
        for batch in batches:
            out = []
            for k, t in zip(batch.column("key").to_pylist(), batch.column("t").to_pylist(), strict=True):
                if last is batches or k != last:
                    last, state = k, None
                state, found = step(state, _NEVER if t is None else t)
                out.append(found)
            yield pa.RecordBatch.from_arrays([batch.column("event_id"), pa.array(out, pa.bool_())], names=["event_id", flag])

    rows = events.select(F.col(key).alias("key"), micros("ts").alias("t"), F.col("event_id").cast("long").alias("event_id"))
    return rows.repartition("key").sortWithinPartitions("key", F.asc_nulls_last("t"), "event_id").mapInArrow(fold, f"event_id long, {flag} boolean")


def token_bucket(events: DataFrame, capacity: float, per_second: float) -> DataFrame:
    """(event_id, allowed) by a refilling bucket for every user, in order of time; an exact fold."""

    def step(bucket: tuple[float, float] | None, t: int) -> tuple[tuple[float, float], bool]:
        now = t * 1000 / 1e9
        level = capacity if bucket is None else min(capacity, bucket[0] + (now - bucket[1]) * per_second)
        return (level - (level >= 1), now), level >= 1

    return _folded(events, "user_id", "allowed", step)


def queue_order(items: DataFrame) -> DataFrame:
    """Dequeue order: priority descending, then time scheduled, created and sequence."""
    return items.withColumn("position", F.row_number().over(Window.partitionBy("queue").orderBy(F.desc("priority"), "scheduled_at", "created_at", "seq")))


def retry_schedule(items: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Delay before the next attempt, min(2^attempts, 60) seconds, or dead letter."""
    dead = F.col("attempts") >= max_attempts
    return items.withColumn("delay_s", F.when(~dead, F.least(F.pow(F.lit(2.0), F.col("attempts")), F.lit(60.0)))).withColumn("dead_letter", dead)


def cache_hits(requests: DataFrame, ttl: int) -> DataFrame:
    """Whether a request finds an entry: the key was asked for within ``ttl`` seconds after its last miss.

    A miss stores the entry until ``ttl`` later; hits do not extend it, so the
    fold runs per key.
    """

    def step(until: int | None, t: int) -> tuple[int, bool]:
        hit = until is not None and t < until
        return until if hit else t + ttl * 1_000_000, hit

    return _folded(requests, "key", "hit", step)


def lru_keep(entries: DataFrame, size: int) -> DataFrame:
    """The ``size`` entries accessed last."""
    return entries.orderBy(F.desc("last_access"), "key").limit(size)


def histogram(values: DataFrame, column: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts for every upper bound and infinity, with sum and count."""
    edges = [*bounds, float("inf")]
    one = values.agg(*[F.sum((F.col(column) <= b).cast("long")).alias(f"b{i}") for i, b in enumerate(edges)], F.round(F.sum(column), 4).alias("total"), F.count(column).alias("n"))
    rows = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(edges)])
    return one.select(F.explode(rows).alias("r"), "total", "n").select("r.le", "r.cumulative", "total", "n")
