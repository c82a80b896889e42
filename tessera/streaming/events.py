"""Windowed counts of event streams; the same functions serve batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import round6
from tessera.operators.numbering import running_sums


def timed(events: DataFrame, column: str = "ts") -> DataFrame:
    """``events`` with a time that watermarks take: zoneless times are read as UTC."""
    if dict(events.dtypes)[column] == "timestamp_ntz":
        zone = events.sparkSession.conf.get("spark.sql.session.timeZone")
        return events.withColumn(column, F.convert_timezone(F.lit("UTC"), F.lit(zone), column).cast("timestamp"))
    return events


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    rows = timed(events).withWatermark("ts", late) if events.isStreaming else events
    done = rows.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return done.select(F.col("w.start").alias("window_start"), "event_type", "n", round6(F.col("total")).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A user's events that follow each other within the gap."""
    rows = timed(events).withWatermark("ts", late) if events.isStreaming else events
    done = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return done.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def running_progress(events: DataFrame) -> DataFrame:
    """How many events, and how many errors, a user has had so far; :func:`live_progress` is the stream's form."""
    rows = events.select("event_id", "user_id", "ts", "event_type")
    sums = {"seen": F.lit(1).cast("long"), "errors": F.coalesce((F.col("event_type") == "error").cast("long"), F.lit(0))}
    return running_sums(rows, "user_id", ["ts", "event_id"], sums).select("event_id", "user_id", "seen", "errors")


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write all that is there as Parquet and stop.

    In append mode windows that the watermark has not passed are not written: they wait for later
    rows, in a later run from the same checkpoint.
    """
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
