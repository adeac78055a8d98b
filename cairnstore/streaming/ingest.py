"""Structured Streaming: files that arrive are backed up batch by batch; counters and duplicates over event time."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..repo import SnapshotRepo


def backup_stream(files: DataFrame, repo: SnapshotRepo, checkpoint: str, keep_older: bool = True, max_batches: bool = True) -> StreamingQuery:
    """Each micro-batch becomes a snapshot of what it brings and, with keep_older, of what the newest one has.

    Kept files come without content, by their path, size and time alone; nothing of the store is read for them. A
    batch that is run again finds all its files unchanged and writes no snapshot."""

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(["path"])
        if keep_older:
            old = repo.files().select("path", "size", "mtime_ms", F.lit(None).cast("binary").alias("content"))
            rows = rows.unionByName(old.join(rows.select("path"), "path", "left_anti"), allowMissingColumns=True)
        repo.backup(rows, at=datetime.now(UTC))

    writer = files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if max_batches else writer).start()


def distinct_chunks(chunks: DataFrame, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """A stream of chunks without those whose hash came before, as far back as the watermark."""
    return chunks.withWatermark(time, late).dropDuplicatesWithinWatermark(["hash"])


def rates(events: DataFrame, seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """Gain of every counter by sliding window: what a time left is computed from."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds", f"{max(1, seconds // 6)} seconds").alias("w"), "event_type")
    return rows.agg(F.sum("value").alias("gained"), F.count(F.lit(1)).alias("events")).select("w.start", "event_type", "gained", "events")
