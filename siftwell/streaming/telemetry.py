"""Telemetry as a stream: windowed counts with late data (an extension), and incremental learning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events and value by window and type; works on a stream (late data up to ``late``) and on a batch."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def learn_incrementally(feedback: DataFrame, history_path: str, checkpoint: str, derive: Callable[[DataFrame], None]) -> StreamingQuery:
    """Each micro-batch is written under its number, so that a repeated batch replaces itself; then patterns are derived anew."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{history_path}/batch={number}")
        derive(batch.sparkSession.read.parquet(history_path))

    return feedback.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
