"""Table functions for SQL: samples along a sight line, and each row beside earlier ones of an ordered table.

    register(spark)
    spark.sql("SELECT p.id, s.* FROM points p, LATERAL ray_samples(0D, 0D, 0D, p.x, p.y, p.z, 0.3D, 0.04D) s")
    spark.sql("SELECT * FROM lag_rows(TABLE(frames), array('recording', 'segment'), 'seq', array(1, 5))")

Both stream: a row goes out as soon as it is made, and `lag_rows` keeps only the rows inside its longest lag.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, isfinite, sqrt

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

END_MARGIN_M, END_MARGIN_SHARE = 0.15, 0.05


@udtf
class RaySamples:
    """Points along the line from (ox, oy, oz) to (x, y, z), from `start` on, `step` apart, short of its end.

    The end margin is the larger of 0.15 m and 5 % of the length. A null, non-finite or zero-length line has no samples.
    """

    @staticmethod
    def analyze(
        ox: AnalyzeArgument, oy: AnalyzeArgument, oz: AnalyzeArgument, x: AnalyzeArgument, y: AnalyzeArgument, z: AnalyzeArgument,
        start: AnalyzeArgument, step: AnalyzeArgument,
    ) -> AnalyzeResult:
        if not step.isConstantExpression or not step.value or step.value <= 0:
            raise ValueError("the step must be a positive constant")
        return AnalyzeResult(T.StructType().add("i", "long").add("x", "double").add("y", "double").add("z", "double"))

    def eval(self, ox, oy, oz, x, y, z, start, step) -> Iterator[tuple]:
        if any(v is None or not isfinite(v) for v in (ox, oy, oz, x, y, z, start)):
            return
        dx, dy, dz = x - ox, y - oy, z - oz
        length = sqrt(dx * dx + dy * dy + dz * dz)
        if length == 0:
            return
        for i in range(ceil((length - max(END_MARGIN_M, END_MARGIN_SHARE * length) - start) / step)):
            along = start + i * step
            yield i, ox + along * dx / length, oy + along * dy / length, oz + along * dz / length


@udtf
class LagRows:
    """Every row once per lag, with the earlier rows of its keys whose order value is smaller by that lag.

    `earlier` is null where there is none; repeated order values give one row each, as a join would. Spark
    partitions the table by the keys and sorts it by the order column, as `analyze` asks.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, keys: AnalyzeArgument, order: AnalyzeArgument, lags: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument is a table: lag_rows(TABLE(name), ...)")
        named = {field.name: field.dataType for field in rows.dataType}
        for name in (*keys.value, order.value):
            if name not in named:
                raise ValueError(f"the table has no column {name}")
        if not isinstance(named[order.value], T.IntegralType):
            raise ValueError(f"{order.value} must hold whole numbers")
        if not lags.value or any(lag is None or lag <= 0 for lag in lags.value):
            raise ValueError("lags are positive whole numbers")
        return AnalyzeResult(
            T.StructType([*rows.dataType.fields, T.StructField("lag", T.IntegerType()), T.StructField("earlier", rows.dataType)]),
            partitionBy=[PartitioningColumn(name) for name in keys.value], orderBy=[OrderingColumn(order.value)],
        )

    def __init__(self) -> None:
        self.held: dict[int, list[Row]] = {}   # in ascending order of the order value

    def eval(self, row: Row, keys: list, order: str, lags: list) -> Iterator[tuple]:
        at = row[order]
        if at is not None:
            oldest = at - max(lags)
            for passed in [n for n in self.held if n < oldest]:
                del self.held[passed]
            self.held.setdefault(at, []).append(row)
        for lag in lags:
            for earlier in (self.held.get(at - lag) if at is not None else None) or [None]:
                yield (*row, lag, earlier)


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL as ray_samples and lag_rows."""
    spark.udtf.register("ray_samples", RaySamples)
    spark.udtf.register("lag_rows", LagRows)
