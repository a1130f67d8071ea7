"""Streams: windowed counts with late data, changes of batches' states, and finished rows appended to a folder."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def read(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 50) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "30 minutes", key: str = "event_type") -> DataFrame:
    """Events and their values by window and type; works on a stream (with a watermark) and on a table alike."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", size).alias("w"), key).agg(F.count("*").alias("events"), F.sum("value").alias("total"), F.max("value").alias("most"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "events", "total", "most")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    """Sessions of each user: events apart by less than the gap."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def state_changes(updates: DataFrame) -> DataFrame:
    """updates(batch_id, doc_id, status, event_ts) as a stream -> (batch_id, status, change): by how much a batch's count of a
    status changes.

    The state is one row for each document of a batch (its last time and status), so it never grows with a batch; an update
    older than the one held is ignored. A batch's counts are the sum of its changes (see batch_counts).
    """

    def step(key: tuple, frames: Iterator, state) -> Iterator:  # noqa: ANN001
        import pandas as pd

        at, held = state.get if state.exists else ("", None)
        before = held
        for frame in frames:
            for status, ts in zip(frame["status"], frame["event_ts"], strict=True):
                t = "" if pd.isna(ts) else pd.Timestamp(ts).isoformat()
                if held is None or t >= at:
                    at, held = t, str(status).lower()
        state.update((at, held))
        rows = [] if held == before else [(key[0], held, 1)] + ([(key[0], before, -1)] if before is not None else [])
        yield pd.DataFrame(rows, columns=["batch_id", "status", "change"])

    return updates.withColumn("doc_id", F.lower("doc_id")).groupBy("batch_id", "doc_id").applyInPandasWithState(
        step, "batch_id string, status string, change long", "at string, status string", "append", "NoTimeout"
    )


def batch_counts(changes: DataFrame) -> DataFrame:
    """(batch_id, total, pending, processing, completed, failed) from the changes written so far."""
    n = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("change"))), F.lit(0)).alias(s)
    return changes.groupBy("batch_id").agg(F.sum("change").alias("total"), *(n(s) for s in ("pending", "processing", "completed", "failed")))


def append_stream(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write a stream's finished rows to a folder, once, for what is there now."""
    return df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
