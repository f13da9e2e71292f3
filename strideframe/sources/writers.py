"""Sinks: surfaces, per-frame timelines and exported sensor streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import HOUR_NS, carried
from ..operators.timejoin import bracket


def timeline_offsets(points: DataFrame, keys: Sequence[str], seq: str, chunk: int = 4096) -> DataFrame:
    """Per frame, how many points it holds and where they start when frames are laid end to end."""
    counts = points.groupBy(*keys, seq).agg(F.count("*").alias("points"))
    placed = carried(counts, keys, [seq], F.floor(F.col(seq) / chunk), running={"_upto": "points"})
    return placed.withColumn("point_offset", F.col("_upto") - F.col("points")).drop("_upto")


def write_timeline(points: DataFrame, path: str, keys: Sequence[str], seq: str) -> None:
    offsets = timeline_offsets(points, keys, seq)
    points.join(offsets.select(*keys, seq, "point_offset"), [*keys, seq]).sortWithinPartitions(
        *keys, seq
    ).write.mode("errorifexists").partitionBy(*keys).parquet(path)


def write_surface(surface: DataFrame, path: str) -> None:
    """Surface points by recording and stage; an existing path is refused."""
    surface.write.mode("errorifexists").partitionBy("recording", "stage").parquet(path)


def write_records(records: DataFrame, path: str) -> None:
    """One JSON document per row; an existing path is refused."""
    records.select(F.to_json(F.struct("*")).alias("value")).write.mode("errorifexists").text(path)


def resample_linear(
    times: DataFrame, signal: DataFrame, keys: Sequence[str], time: str, values: Sequence[str],
    chunk_ns: int = HOUR_NS,
) -> DataFrame:
    """`signal` linearly interpolated at `times`, only inside the signal's span."""
    both = bracket(times, signal, keys, time, values, chunk_ns=chunk_ns)
    both = both.where("next is not null and (prev is not null or next.%s = %s)" % (time, time))
    weight = (F.col(time) - F.col(f"prev.{time}")) / (F.col(f"next.{time}") - F.col(f"prev.{time}"))
    weight = F.when(F.col(f"next.{time}") == F.col(time), F.lit(1.0)).otherwise(weight)
    blend: dict[str, Column] = {
        v: F.when(weight == 1.0, F.col(f"next.{v}")).otherwise(
            (1 - weight) * F.col(f"prev.{v}") + weight * F.col(f"next.{v}")
        )
        for v in values
    }
    return both.select(*times.columns, *[c.alias(f"{n}_at") for n, c in blend.items()])


def write_imu_csv(resampled: DataFrame, path: str) -> None:
    resampled.write.mode("errorifexists").option("header", True).csv(path)
