"""Structured Streaming over ``events``: windows, sessions, duplicates, and a token bucket as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, with an event time that carries a zone."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "events*.parquet").parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts and sums per window and type; works on a stream and on a table alike."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return marked.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def deduplicated(events: DataFrame, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def bucket_decisions(events: DataFrame, capacity: float = 10.0, rate: float = 1.0, late: str = "1 day", keep_ms: int = 86_400_000) -> DataFrame:
    """Token bucket per user as streaming state: ``event_id, user_id, allowed``. State is one level and one time per user, dropped when the watermark is ``keep_ms`` beyond a user's last event."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        level, last = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        allowed = []
        for t in rows["ts"].map(lambda x: x.timestamp()):
            level = min(capacity, level + (0.0 if last is None else max(0.0, t - last) * rate))
            last = t
            allowed.append(level >= 1.0)
            level -= 1.0 if allowed[-1] else 0.0
        state.update((level, last))
        state.setTimeoutTimestamp(max(int(last * 1000) + keep_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "allowed": allowed})

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, allowed boolean", "level double, last double", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_end(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there into a memory table; for tests and small reports."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
