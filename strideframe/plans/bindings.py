"""How the driver's tables stand in for walk recordings, once for Spark and once as SQL text.

Every view is a row-wise projection of one driver table, so filters and column pruning still reach
the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL_BINDINGS = {
    # motion-sensor stream: one recording per user, one sensor per event type
    "stamps": """
        SELECT user_id AS recording, event_type AS sensor, event_id, epoch_us(ts) * 1000 AS t_ns,
               value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
    # frames: 256 orders make one recording; pose from the order's own numbers
    "frame_keys": """
        SELECT o_orderkey // 256 AS recording, o_orderkey % 256 AS seq,
               CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderstatus AS status,
               o_orderpriority AS priority, o_custkey AS device FROM orders""",
    "frames": """
        SELECT recording, seq, seq * 33333333 + (cents % 1000) * 1000 AS t_ns, cents, status, priority, device,
               seq * 3e-2 + (cents % 97) / 1e3 AS x, (cents % 89) / 1e3 AS y, (cents % 83) / 1e3 AS z,
               cos((seq * 1e-2 + (cents % 71) / 1e3) / 2) * sin((cents % 61) / 1e3 / 2) AS qx,
               sin((seq * 1e-2 + (cents % 71) / 1e3) / 2) * cos((cents % 61) / 1e3 / 2) AS qy,
               -sin((seq * 1e-2 + (cents % 71) / 1e3) / 2) * sin((cents % 61) / 1e3 / 2) AS qz,
               cos((seq * 1e-2 + (cents % 71) / 1e3) / 2) * cos((cents % 61) / 1e3 / 2) AS qw
        FROM frame_keys""",
    # depth pixels on a 64 x 48 image: 64 orders make one frame, 32 frames one recording
    "pixels": """
        SELECT l_orderkey // 2048 AS recording, l_orderkey // 64 AS frame,
               (((l_orderkey % 64) * 8 + l_linenumber) * 10000000 + l_partkey) * 100000 + l_suppkey AS sample,
               l_partkey % 48 AS prow, l_suppkey % 64 AS pcol, l_extendedprice / 1e4 AS learned,
               l_extendedprice / 1e4 * (1 + l_quantity / 1e2) AS target,
               (l_partkey * 7 + l_suppkey) % 256 AS confidence, l_returnflag AS source,
               l_linestatus AS half, l_quantity AS quantity, l_discount AS discount FROM lineitem""",
    "pixel_map": """
        SELECT recording, frame, prow, pcol, max(learned) AS learned, max(target) AS target
        FROM pixels GROUP BY recording, frame, prow, pcol""",
    "coarse_map": """
        SELECT recording, frame, prow // 4 AS prow, pcol // 4 AS pcol, max(learned) AS learned, max(target) AS target
        FROM pixels GROUP BY recording, frame, prow // 4, pcol // 4""",
    "views": """
        SELECT DISTINCT o_orderkey // 2048 AS recording, o_orderkey // 64 AS frame,
               (o_orderkey // 64 % 32) * 5e-2 AS tx, (o_orderkey // 64 % 7) * 1e-2 AS ty,
               ((o_orderkey // 64 % 5) - 2) * 2e-2 AS yaw FROM orders""",
    # surface points and descriptors
    "points": """
        SELECT vec_id AS point, CAST(label AS BIGINT) AS recording, vec_id // 50 AS fragment,
               CAST(embedding[1] AS DOUBLE) * 4 AS x, CAST(embedding[2] AS DOUBLE) * 4 AS y,
               CAST(embedding[3] AS DOUBLE) * 4 AS z, CAST(embedding[4] AS DOUBLE) AS nx,
               CAST(embedding[5] AS DOUBLE) AS ny, CAST(embedding[6] AS DOUBLE) AS nz FROM embeddings""",
    # boxes: 16 orders make one image; fulfilled lines are references, open lines are detections
    "boxes": """
        SELECT l_orderkey // 16 AS image, l_returnflag AS cls, l_linestatus AS half,
               (((l_orderkey % 16) * 8 + l_linenumber) * 10000000 + l_partkey) * 100000 + l_suppkey AS item,
               CAST((l_partkey % 8) * 70 + l_linenumber * 3 AS DOUBLE) AS x1,
               CAST((l_suppkey % 6) * 60 + (l_partkey % 7) * 2 AS DOUBLE) AS y1,
               (l_partkey % 8) * 70 + l_linenumber * 3 + 20 + l_quantity * 2 AS x2,
               (l_suppkey % 6) * 60 + (l_partkey % 7) * 2 + 30 + (l_suppkey % 5) * 15e0 AS y2,
               5e-2 + l_discount * 9 AS confidence, l_tax AS tax, l_extendedprice AS price FROM lineitem""",
    # capture messages with turn numbers
    "messages": """
        SELECT conv_id AS recording, turn AS n, role AS kind, length(text) AS bytes FROM conversations""",
}


class Tables:
    """The driver's Parquet tables and the walk tables projected from them."""

    NAMES = (
        "region nation customer supplier part orders lineitem events documents embeddings pages "
        "benchmark labels conversations"
    ).split()

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, df: DataFrame, small_bytes: int = 1 << 30) -> DataFrame:
        """Rows dealt out over all cores, only where the input is one small file.

        A file of one row group is one task, and everything up to the first shuffle would stay in it.
        Large inputs already come in many splits and are left as they are.
        """
        if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() >= small_bytes:
            return df
        return df.repartition(self.spark.sparkContext.defaultParallelism)

    def __getattr__(self, name: str) -> DataFrame:
        if name in self.NAMES:
            return self.read(name)
        raise AttributeError(name)

    @property
    def stamps(self) -> DataFrame:
        return self.events.select(
            F.col("user_id").alias("recording"),
            F.col("event_type").alias("sensor"),
            "event_id",
            # the stored stamp has no zone; count from an epoch without one
            F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) * 1000").alias("t_ns"),
            "value",
            F.get_json_object("props", "$.k").cast("long").alias("k"),
        )

    @property
    def frames(self) -> DataFrame:
        keys = self.orders.selectExpr(
            "o_orderkey div 256 as recording", "o_orderkey % 256 as seq",
            "cast(round(o_totalprice * 100) as bigint) as cents", "o_orderstatus as status",
            "o_orderpriority as priority", "o_custkey as device",
        )
        yaw, pitch = "((seq * 1e-2 + (cents % 71) / 1e3) / 2)", "((cents % 61) / 1e3 / 2)"
        return keys.selectExpr(
            "recording", "seq", "seq * 33333333 + (cents % 1000) * 1000 as t_ns", "cents", "status",
            "priority", "device", "seq * 3e-2 + (cents % 97) / 1e3 as x", "(cents % 89) / 1e3 as y",
            "(cents % 83) / 1e3 as z", f"cos{yaw} * sin{pitch} as qx", f"sin{yaw} * cos{pitch} as qy",
            f"-sin{yaw} * sin{pitch} as qz", f"cos{yaw} * cos{pitch} as qw",
        )

    @property
    def pixels(self) -> DataFrame:
        return self.lineitem.selectExpr(
            "l_orderkey div 2048 as recording", "l_orderkey div 64 as frame",
            "(((l_orderkey % 64) * 8 + l_linenumber) * 10000000 + l_partkey) * 100000 + l_suppkey as sample",
            "l_partkey % 48 as prow", "l_suppkey % 64 as pcol", "l_extendedprice / 1e4 as learned",
            "l_extendedprice / 1e4 * (1 + l_quantity / 1e2) as target",
            "(l_partkey * 7 + l_suppkey) % 256 as confidence", "l_returnflag as source",
            "l_linestatus as half", "l_quantity as quantity", "l_discount as discount",
        )

    @property
    def pixel_map(self) -> DataFrame:
        return self.pixels.groupBy("recording", "frame", "prow", "pcol").agg(
            F.max("learned").alias("learned"), F.max("target").alias("target")
        )

    @property
    def coarse_map(self) -> DataFrame:
        """The depth map on 4 x 4 pixel blocks, dense enough for neighbour work."""
        return self.pixels.groupBy(
            "recording", "frame", F.expr("prow div 4").alias("prow"), F.expr("pcol div 4").alias("pcol")
        ).agg(F.max("learned").alias("learned"), F.max("target").alias("target"))

    @property
    def views(self) -> DataFrame:
        return self.orders.selectExpr(
            "o_orderkey div 2048 as recording", "o_orderkey div 64 as frame"
        ).distinct().selectExpr(
            "recording", "frame", "(frame % 32) * 5e-2 as tx", "(frame % 7) * 1e-2 as ty",
            "((frame % 5) - 2) * 2e-2 as yaw",
        )

    @property
    def points(self) -> DataFrame:
        return self.embeddings.selectExpr(
            "vec_id as point", "cast(label as bigint) as recording", "vec_id div 50 as fragment",
            "cast(embedding[0] as double) * 4 as x", "cast(embedding[1] as double) * 4 as y",
            "cast(embedding[2] as double) * 4 as z", "cast(embedding[3] as double) as nx",
            "cast(embedding[4] as double) as ny", "cast(embedding[5] as double) as nz",
        )

    @property
    def boxes(self) -> DataFrame:
        return self.lineitem.selectExpr(
            "l_orderkey div 16 as image", "l_returnflag as cls", "l_linestatus as half",
            "(((l_orderkey % 16) * 8 + l_linenumber) * 10000000 + l_partkey) * 100000 + l_suppkey as item",
            "cast((l_partkey % 8) * 70 + l_linenumber * 3 as double) as x1",
            "cast((l_suppkey % 6) * 60 + (l_partkey % 7) * 2 as double) as y1",
            "(l_partkey % 8) * 70 + l_linenumber * 3 + 20 + l_quantity * 2 as x2",
            "(l_suppkey % 6) * 60 + (l_partkey % 7) * 2 + 30 + (l_suppkey % 5) * 15e0 as y2",
            "5e-2 + l_discount * 9 as confidence", "l_tax as tax", "l_extendedprice as price",
        )

    @property
    def messages(self) -> DataFrame:
        return self.conversations.selectExpr(
            "conv_id as recording", "turn as n", "role as kind", "cast(length(text) as bigint) as bytes"
        )
