"""Batch twins of the streaming operators, and the plug-in hook."""

import uuid

from pyspark.sql import functions as F

from ..functions import tables
from ..operators import plugins
from ..operators import support as sup
from ..session import checkpointed, shared_folder
from ..streaming import health
from ..streaming.fragments import FragmentStore
from .registry import query
from .identity import object_detections


@query("stream_windows", """
    SELECT recording, sensor, t_ns // 3600000000000 * 3600000000 AS window_us, count(*) AS samples, min(t_ns) AS first_ns, max(t_ns) AS last_ns,
           CASE WHEN max(t_ns) > min(t_ns) THEN (count(*) - 1) / ((max(t_ns) - min(t_ns)) / 1e9) END AS rate_hz, max(event_id) - min(event_id) + 1 - count(*) AS missing FROM stamps GROUP BY ALL""", doubles="rate_hz")
def stream_windows(t):
    """STR-02: stream health per recording, sensor and hour."""
    return health.tumbling_health(t.stamps.withColumnRenamed("event_id", "n"), "1 hour")


@query("session_windows", """
    WITH g AS (SELECT *, CASE WHEN t_ns - lag(t_ns) OVER w < 21600000000000 THEN 0 ELSE 1 END AS fresh FROM stamps WINDOW w AS (PARTITION BY recording ORDER BY t_ns, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY recording ORDER BY t_ns, event_id) AS session FROM g)
    SELECT recording, min(t_ns) AS first_ns, max(t_ns) AS last_ns, count(*) AS messages, arg_max(sensor, (t_ns, event_id)) AS end_reason FROM s GROUP BY recording, session""")
def session_windows(t):
    """STR-06: capture sessions by inactivity, with the row that ended each."""
    return health.capture_sessions(t.stamps.withColumnRenamed("event_id", "n"), "6 hours")


@query("incremental_surface", """
    SELECT recording, fragment, CAST(floor(x / 5e-1) AS BIGINT) AS ix, CAST(floor(y / 5e-1) AS BIGINT) AS iy, CAST(floor(z / 5e-1) AS BIGINT) AS iz,
           count(*) AS samples, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM points GROUP BY ALL""", doubles="x y z")
def incremental_surface(t):
    """STR-05: all points merged in three batches into a fragment store, and the surface it ends with."""
    spark = t.points.sparkSession
    store = FragmentStore(f"{shared_folder(spark)}/fragments-{uuid.uuid4().hex}", 0.5, span=4096)
    rows = t.points.select("recording", "fragment", "x", "y", "z", F.pmod(F.xxhash64("point"), F.lit(3)).alias("batch"))
    landing = f"{store.path}/landing"
    rows.write.partitionBy("batch").parquet(landing)
    try:
        for batch in range(3):
            store(spark.read.schema(rows.schema).parquet(landing).where(F.col("batch") == batch), batch)
        return checkpointed(store.surface(spark))
    finally:
        store.drop(spark)


@query("ray_samples", """
    WITH l AS (SELECT recording, point AS line, x, y, z, sqrt(x*x + y*y + z*z) AS len FROM points),
    s AS (SELECT *, unnest(range(0, greatest(CAST(ceil((len - greatest(15e-2, 5e-2 * len) - 3e-1) / 4e-2) AS BIGINT), 0))) AS i FROM l)
    SELECT recording, line, i, (3e-1 + i * 4e-2) * x / len AS x, (3e-1 + i * 4e-2) * y / len AS y, (3e-1 + i * 4e-2) * z / len AS z FROM s""", doubles="x y z")
def ray_samples(t):
    """UDF-06: samples of every sight line by a table function in a lateral join."""
    tables.register(t.spark)
    return t.spark.sql(
        "SELECT p.recording, p.point AS line, s.i, s.x, s.y, s.z FROM {points} p, LATERAL ray_samples(0D, 0D, 0D, p.x, p.y, p.z, 0.3D, 0.04D) s",
        points=t.points,
    )


@query("lag_rows", """
    WITH f AS (SELECT recording, seq // 64 AS segment, seq, x, y, z FROM frames), l AS (SELECT * FROM (VALUES (1), (5), (10)) AS v(lag))
    SELECT f.recording, f.segment, f.seq, CAST(l.lag AS INTEGER) AS lag, sqrt((f.x-e.x)**2 + (f.y-e.y)**2 + (f.z-e.z)**2) AS moved
    FROM f CROSS JOIN l LEFT JOIN f e ON e.recording = f.recording AND e.segment = f.segment AND e.seq = f.seq - l.lag""", doubles="moved")
def lag_rows(t):
    """UDF-06: frames beside earlier ones of their segment, by a table function over a partitioned, sorted table."""
    tables.register(t.spark)
    return t.spark.sql(
        """SELECT recording, segment, seq, lag, sqrt(power(x - earlier.x, 2) + power(y - earlier.y, 2) + power(z - earlier.z, 2)) AS moved
           FROM lag_rows(TABLE({frames}), array('recording', 'segment'), 'seq', array(1, 5, 10))""",
        frames=t.frames.select("recording", F.expr("seq div 64").alias("segment"), "seq", "x", "y", "z"),
    )


@query("plugin_depth", """
    SELECT recording, frame, count(*) AS pixels_n, sum(learned * 2) AS depth_sum FROM pixels WHERE learned * 2 < 10 GROUP BY recording, frame""", doubles="depth_sum")
def plugin_depth(t):
    """UDF-01: a caller's depth function applied to frame batches, loaded once per worker."""
    frames = t.pixels.select("recording", "frame", "sample", "learned")
    rows = plugins.apply_model(frames, make_doubler, {"value": "learned"}, "depth double, valid boolean")
    return rows.where("valid").groupBy("recording", "frame").agg(F.count("*").alias("pixels_n"), F.sum("depth").alias("depth_sum"))


def make_doubler():
    """A stand-in model: depth twice its input, valid below 10 m."""
    return lambda value: (value * 2, value * 2 < 10)


@query("support_identity")
def support_identity(t):
    """UDF-04: association by depth-layer supports, decisions counted per reason."""
    d = object_detections(t).where("x is not null")
    spots = F.array(*[F.struct(
        (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), (F.col("z") + dz).alias("z"), (F.col("z") + dz).alias("depth")
    ) for dx, dy, dz in ((0.0, 0.0, 0.0), (0.02, 0.0, 0.01), (0.0, 0.02, 0.02), (0.01, 0.01, 0.03))])
    # every seventh object also shows a background layer
    behind = F.when(F.col("item") % 7 == 0, F.concat(spots, F.array(F.struct(
        F.col("x").alias("x"), F.col("y").alias("y"), (F.col("z") + 1).alias("z"), (F.col("z") + 1).alias("depth"))))).otherwise(spots)
    rows = d.select(
        "recording", "cls", "seq", F.col("item").alias("observation_id"), (F.col("item") % 500).cast("double").alias("x1"), F.lit(0.0).alias("y1"),
        (F.col("item") % 500 + 40).cast("double").alias("x2"), F.lit(40.0).alias("y2"), behind.alias("samples"),
    )
    return sup.associate_supports(rows, ["recording"], "cls").groupBy("recording", "decision", "reason").agg(F.count("*").alias("n"))
