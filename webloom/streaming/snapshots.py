"""Structured Streaming over performance events and rank snapshots (an extension: batch operators cover the rest).

Watermarks bound the state; late rows past them are dropped, as streams do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
RANKS = "keyword string, position double, checked_at timestamp"


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Events from Parquet files as they arrive."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events and their value per type and tumbling window."""
    w = F.window("ts", window)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return g.select(F.col("w.start").alias("start"), "event_type", "events", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions per user: events without a pause longer than the gap."""
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("events"))
    return g.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")


def _changes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(frames)).sort_values(["checked_at", "position"])
    if not len(rows):
        return
    before = [last, *rows["position"].tolist()[:-1]]
    state.update((float(rows["position"].iloc[-1]),))
    change = [None if b is None else round(b - p, 1) for b, p in zip(before, rows["position"], strict=True)]
    yield pd.DataFrame({"keyword": key[0], "position": rows["position"], "checked_at": rows["checked_at"], "change": pd.Series(change, dtype="float64", index=rows.index)})


def rank_changes(snapshots: DataFrame) -> DataFrame:
    """Each snapshot with its change from the one before; the state is one number per keyword."""
    return snapshots.groupBy("keyword").applyInPandasWithState(_changes, f"{RANKS}, change double", "position double", "append", GroupStateTimeout.NoTimeout)


def append_ranks(changes: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write a stream as Parquet, once for all files that are there; the checkpoint makes it exactly once."""
    return changes.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
