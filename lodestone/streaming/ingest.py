"""Structured Streaming into a store: one micro-batch, one snapshot.  An extension; the store itself has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.store import KnowledgeStore


def register_stream(store: KnowledgeStore, sources: DataFrame, checkpoint: str, trigger: dict | None = None):
    """sources: a stream (bytes, media_type).  Registration is idempotent, so a replayed batch adds nothing."""

    def batch(rows: DataFrame, _epoch: int) -> None:
        if not rows.isEmpty():
            store.register(rows)

    writer = sources.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """events: a stream (ts, event_type).  Counts by window, late events beyond the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"))
