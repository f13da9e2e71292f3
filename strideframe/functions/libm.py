"""Logarithm and exponential of the C library, bit for bit.

The JVM's own differ from it in the last place for one value in twelve. Where a decision compares two sides that are
equal in exact arithmetic, as a depth just on its margin, that place decides.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _exp(value: float) -> float:
    try:
        return math.exp(value)
    except OverflowError:
        return math.inf


@F.arrow_udf(T.DoubleType())
def log(x: pa.Array) -> pa.Array:
    """Natural logarithm; null where there is none."""
    return pa.array([None if v is None or v <= 0 else math.log(v) for v in x.to_pylist()], pa.float64())


@F.arrow_udf(T.DoubleType())
def exp(x: pa.Array) -> pa.Array:
    return pa.array([None if v is None else _exp(v) for v in x.to_pylist()], pa.float64())
