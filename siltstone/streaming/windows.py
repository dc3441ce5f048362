"""Event streams: tumbling windows and sessions with a watermark, the same code on a stream and on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, event_type, n, total by window of event time; rows later than ``late`` are dropped on a stream."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", size)
    return marked.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, stop, n of runs of a user's events without a longer gap."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.session_window("ts", gap)
    return marked.groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def write(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished windows to Parquet, each once; takes all that is there and stops."""
    return df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
