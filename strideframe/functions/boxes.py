"""Axis-aligned box arithmetic on (x1, y1, x2, y2) columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# COCO area bands in square pixels, fixed values
SMALL_AREA = 32.0 * 32.0
MEDIUM_AREA = 96.0 * 96.0


def box(prefix: str = "", suffix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{n}{suffix}") for n in ("x1", "y1", "x2", "y2")]


def area(b: Sequence[Column]) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection(a: Sequence[Column], b: Sequence[Column]) -> Column:
    wide = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    high = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    return wide * high


def iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    shared = intersection(a, b)
    return shared / (area(a) + area(b) - shared)


def valid(b: Sequence[Column], width: float, height: float) -> Column:
    return (b[0] >= 0) & (b[1] >= 0) & (b[2] <= width) & (b[3] <= height) & (b[2] > b[0]) & (b[3] > b[1])


def size_band(size: Column) -> Column:
    return F.when(size < SMALL_AREA, "small").when(size < MEDIUM_AREA, "medium").otherwise("large")


def touches_edge(b: Sequence[Column], width: float, height: float, margin: float = 2.0) -> Column:
    return (b[0] <= margin) | (b[1] <= margin) | (b[2] >= width - margin) | (b[3] >= height - margin)


def holds_pixel(b: Sequence[Column], row: Column, col: Column) -> Column:
    """Whether the pixel's centre lies in the half-open box."""
    return (col + 0.5 >= b[0]) & (col + 0.5 < b[2]) & (row + 0.5 >= b[1]) & (row + 0.5 < b[3])
