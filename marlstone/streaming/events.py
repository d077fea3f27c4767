"""Event-time windows that work alike on a table and on a stream (an extension beyond parity)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _marked(events: DataFrame, watermark: str) -> DataFrame:
    """Watermarks need an instant; a stream's plain timestamps are read in the session's time zone."""
    if not events.isStreaming:
        return events
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def _summed(grouped) -> DataFrame:
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def _flat(df: DataFrame) -> DataFrame:
    others = [c for c in df.columns if c != "window"]
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *others)


def tumbling(events: DataFrame, size: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Events and values per type in windows that do not overlap; late rows beyond the watermark are dropped on streams."""
    return _flat(_summed(_marked(events, watermark).groupBy(F.window("ts", size).alias("window"), "event_type")))


def sliding(events: DataFrame, size: str = "6 hours", slide: str = "3 hours", watermark: str = "10 minutes") -> DataFrame:
    return _flat(_summed(_marked(events, watermark).groupBy(F.window("ts", size, slide).alias("window"), "event_type")))


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "10 minutes") -> DataFrame:
    """A user's events with no pause of ``gap`` or more between them."""
    return _flat(_summed(_marked(events, watermark).groupBy(F.session_window("ts", gap).alias("window"), "user_id")))


def upsert(batch: DataFrame, held: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key among what is held and a new batch; for ``foreachBatch`` sinks."""
    rows = held.unionByName(batch)
    newest = F.max_by(F.struct(*rows.columns), F.col(order)).alias("row")
    return rows.groupBy(key).agg(newest).select("row.*")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is available of an append stream as Parquet, exactly once across restarts."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
