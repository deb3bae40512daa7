"""Windows over event tables; the same functions serve batch and stream DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _time(events: DataFrame) -> Column:
    """The time column; a timestamp stays as it is, with the watermark it may carry."""
    return F.col("ts") if dict(events.dtypes)["ts"] == "timestamp" else F.col("ts").cast("timestamp")


def windowed(events: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """start, event_type, n, total per tumbling or sliding window."""
    ts = _time(events)
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    rows = events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """user_id, start, n, total per session; a session ends after ``gap`` without an event."""
    w = F.session_window(_time(events), gap)
    rows = events.groupBy(w.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select("user_id", F.col("w.start").alias("start"), "n", "total")


def event_stream(spark: SparkSession, folder: str, schema: str, delay: str = "1 hour", files_per_trigger: int = 1) -> DataFrame:
    """A stream over Parquet files with a watermark on ts; rows later than ``delay`` are dropped by stateful operators."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withColumn("ts", _time(rows)).withWatermark("ts", delay)


def run_once(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process all available input into Parquet files and stop."""
    query = df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
