"""Stream health: tumbling windows and capture sessions. The same functions serve batch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LATENESS = "20 seconds"


def stamp(t_ns: Column) -> Column:
    """Event time at the microsecond a timestamp can hold; nanoseconds stay beside it."""
    return F.timestamp_micros((t_ns / 1000).cast("long"))


def _timed(rows: DataFrame, lateness: str | None) -> DataFrame:
    timed = rows.withColumn("_at", stamp(F.col("t_ns")))
    return timed.withWatermark("_at", lateness) if lateness and rows.isStreaming else timed


def tumbling_health(rows: DataFrame, width: str = "1 minute", lateness: str | None = LATENESS) -> DataFrame:
    """Samples, span, rate and missing numbers per recording, sensor and window.

    rows(recording, sensor, t_ns, n). All parts merge, so a busy recording is combined before its shuffle.
    """
    grouped = _timed(rows, lateness).groupBy(F.window("_at", width).alias("_w"), "recording", "sensor").agg(
        F.count("*").alias("samples"), F.min("t_ns").alias("first_ns"), F.max("t_ns").alias("last_ns"), F.min("n").alias("_lo"), F.max("n").alias("_hi")
    )
    span = (F.col("last_ns") - F.col("first_ns")) / 1e9
    return grouped.select(
        "recording", "sensor", F.unix_micros("_w.start").alias("window_us"), "samples", "first_ns", "last_ns",
        F.when(span > 0, (F.col("samples") - 1) / span).alias("rate_hz"),
        (F.col("_hi") - F.col("_lo") + 1 - F.col("samples")).alias("missing"),
    )


def capture_sessions(rows: DataFrame, quiet: str = LATENESS, lateness: str | None = LATENESS) -> DataFrame:
    """Sessions split by inactivity, with the kind of the row that ended each."""
    grouped = _timed(rows, lateness).groupBy(F.session_window("_at", quiet).alias("_w"), "recording").agg(
        F.count("*").alias("messages"), F.min("t_ns").alias("first_ns"), F.max("t_ns").alias("last_ns"),
        F.max_by("sensor", F.struct("t_ns", "n")).alias("end_reason"),
    )
    return grouped.select("recording", "first_ns", "last_ns", "messages", "end_reason")
