"""Queries over sources and sinks."""

from pyspark.sql import functions as F

from .. import schemas
from ..operators.ordered import HOUR_NS, carried
from ..operators.timejoin import time_chunk
from ..sources import readers, writers
from .registry import query

DAY_NS = 24 * HOUR_NS


@query("scan_events", """
    SELECT recording, row_number() OVER (PARTITION BY recording ORDER BY t_ns, event_id) - 1 AS seq,
           t_ns, sensor, value FROM stamps""", doubles="value")
def scan_events(t):
    """SRC-01: one frame-shaped row per event, numbered in file order."""
    rows = carried(
        t.stamps, ["recording"], ["t_ns", "event_id"], time_chunk("t_ns", DAY_NS),
        running={"upto": F.lit(1).cast("long")},
    )
    return rows.select("recording", (F.col("upto") - 1).alias("seq"), "t_ns", "sensor", "value")


@query("flatten_props", """
    SELECT user_id AS recording, event_id AS seq,
           CASE WHEN event_type = 'error' THEN 'ABSENT' WHEN event_type = 'signup' THEN 'PAUSED' ELSE 'TRACKING' END AS tracking,
           CASE WHEN event_type = 'error' THEN 'NO_ARCORE' WHEN event_type = 'signup' THEN 'INSUFFICIENT' ELSE 'NONE' END AS failure,
           CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS tracker_t_ns,
           CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS INTEGER) AS point_count,
           CASE WHEN event_type NOT IN ('error', 'signup') THEN value END AS tx FROM events""", doubles="tx tracker_t_ns")
def flatten_props(t):
    """SRC-02: nested tracker JSON flattened; an absent record reads NO_ARCORE."""
    k = F.get_json_object("props", "$.k").cast("long")
    lost = F.col("event_type") == "signup"
    record = F.to_json(F.struct(
        k.alias("t_ns"),
        F.when(lost, "PAUSED").otherwise("TRACKING").alias("tracking"),
        F.when(lost, "INSUFFICIENT").otherwise("NONE").alias("failure"),
        F.when(~lost, F.array("value", *[F.lit(0.0)] * 5, F.lit(1.0))).alias("pose"),
        F.array(F.array(k.cast("double"), *[F.lit(0.0)] * 6)).alias("points"),
    ))
    frames = t.events.select(
        F.col("user_id").alias("recording"), F.col("event_id").alias("seq"),
        F.from_json(F.when(F.col("event_type") != "error", record), schemas.TRACKER).alias("arcore"),
    )
    flat = readers.flatten_tracker(frames)
    return flat.select(
        "recording", "seq", "tracking", "failure", "tracker_t_ns", "point_count", F.col("pose")[0].alias("tx")
    )


@query("imu_by_sensor", """
    SELECT recording, sensor, count(*) AS samples, min(t_ns) AS first_ns, max(t_ns) AS last_ns, avg(value) AS mean
    FROM stamps GROUP BY recording, sensor""", doubles="mean")
def imu_by_sensor(t):
    """SRC-03: motion samples split per sensor."""
    return t.stamps.groupBy("recording", "sensor").agg(
        F.count("*").alias("samples"), F.min("t_ns").alias("first_ns"), F.max("t_ns").alias("last_ns"),
        F.avg("value").alias("mean"),
    )


@query("telemetry_complete", """
    SELECT o_custkey AS recording, o_orderkey AS n,
           CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 0 END AS INTEGER) AS missing,
           o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AS complete FROM orders""")
def telemetry_complete(t):
    """SRC-04: records lacking any of the 13 counters; an explicit null is present."""
    urgent, high = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "2-HIGH"
    fields = []
    for name in schemas.TELEMETRY_FIELDS:
        value = F.col("o_totalprice").cast("string")
        if name == "battery_pct":
            value = F.when(~urgent & ~high, value)
        elif name == "queue_bytes":
            value = F.when(~high, value)
        # an absent counter is left out of the text; arcore_update_ms is written as an explicit null
        text = F.lit("null") if name == "arcore_update_ms" else value
        fields.append(F.concat(F.lit(f'"{name}":'), text))
    lines = t.orders.select(
        F.col("o_custkey").alias("recording"), F.col("o_orderkey").alias("n"),
        F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("line"),
    )
    return readers.missing_counters(lines, "line").drop("line")


@query("committed_only", """
    WITH last_turn AS (SELECT recording, max(n) AS last_n FROM messages GROUP BY recording),
    through AS (SELECT m.recording, max(m.n) AS through FROM messages m JOIN last_turn l USING (recording)
                WHERE NOT (m.n = l.last_n AND m.kind = 'assistant') GROUP BY m.recording)
    SELECT m.recording, m.n, m.bytes FROM messages m JOIN through t USING (recording) WHERE m.n <= t.through""")
def committed_only(t):
    """SRC-05: rows covered by the last readable commit line; a cut last line does not commit."""
    messages = t.messages
    last = messages.groupBy("recording").agg(F.max("n").alias("last_n"))
    line = F.to_json(F.struct("n", "bytes"))
    cut = (F.col("n") == F.col("last_n")) & (F.col("kind") == "assistant")
    commits = messages.join(last, "recording").select(
        "recording", F.when(cut, F.expr("substring(to_json(struct(n, bytes)), 1, 4)")).otherwise(line).alias("line")
    )
    return readers.committed_rows(messages, commits, "line").select("recording", "n", "bytes")


def pose_lines(t):
    """Frames written as trajectory text, with the paused ones as comments and some rules broken."""
    frames = t.frames
    stamp = F.concat(
        F.expr("t_ns div 1000000000").cast("string"), F.lit("."),
        F.lpad((F.col("t_ns") % 1_000_000_000).cast("string"), 9, "0"),
    )
    turn = F.when(F.col("cents") % 50 == 0, F.col("qw") * 1.1).otherwise(F.col("qw"))
    body = F.concat_ws(" ", stamp, "x", "y", "z", "qx", "qy", "qz", turn, F.lit("extra"))
    return frames.select(
        "recording", F.col("seq").alias("line_no"),
        F.when(F.col("status") == "P", F.concat(F.lit("# "), body))
        .when(F.col("cents") % 41 == 0, stamp).otherwise(body).alias("line"),
    )


@query("tum_text", """
    SELECT recording, seq AS line_no, t_ns, CASE WHEN cents % 41 <> 0 THEN x END AS x,
           CASE WHEN cents % 41 <> 0 THEN qx END AS qx,
           CASE WHEN cents % 41 = 0 THEN 'columns'
                WHEN cents % 50 = 0 AND abs(sqrt(qx*qx + qy*qy + qz*qz + 1.21e0*qw*qw) - 1) >= 1e-3 THEN 'quaternion' END AS problem
    FROM frames WHERE status <> 'P'""", doubles="x qx")
def tum_text(t):
    """SRC-07: trajectory text parsed back with exact nanoseconds and rule violations."""
    parsed = readers.parse_tum(pose_lines(t), ["recording"])
    return parsed.select("recording", "line_no", "t_ns", "x", "qx", "problem")


@query("wide_csv_pose", """
    SELECT recording, seq, t_ns * 1e-9 AS t_s, x AS tx, z AS tz,
           1 - 2 * (qy*qy + qz*qz) AS r00, 2 * (qx*qy - qz*qw) AS r01, 2 * (qy*qz + qx*qw) AS r21 FROM frames""",
       doubles="t_s tx tz r00 r01 r21")
def wide_csv_pose(t):
    """SRC-08: chosen columns of a wide CSV with w-first quaternions."""
    lines = t.frames.select(
        "recording", "seq", F.concat_ws(",", "t_ns", "cents", "x", "y", "z", "device", "qw", "qx", "qy", "qz").alias("line")
    )
    rows = readers.parse_wide_csv(lines, [0, 2, 3, 4, 6, 7, 8, 9], quaternion="wxyz")
    p = F.col("pose")
    return rows.select(
        "recording", "seq", "t_s", p[3].alias("tx"), p[11].alias("tz"), p[0].alias("r00"), p[1].alias("r01"), p[9].alias("r21")
    )


@query("lost_rows", """
    SELECT recording, seq, seq * 5e-1 AS t_s, CASE WHEN priority <> '1-URGENT' THEN cents % 5 END AS segment,
           CASE WHEN priority <> '1-URGENT' THEN x END AS tx,
           CASE WHEN priority <> '1-URGENT' THEN 1 - 2 * (qx*qx + qz*qz) END AS r11 FROM frames""",
       doubles="t_s tx r11 segment")
def lost_rows(t):
    """SRC-09: per-frame tracker output where lost frames keep their time."""
    stamp = F.col("seq") * 0.5
    lines = t.frames.select(
        "recording", "seq",
        F.when(F.col("priority") == "1-URGENT", F.concat_ws(" ", stamp, F.lit("lost")))
        .otherwise(F.concat_ws(" ", stamp, F.col("cents") % 5, "x", "y", "z", "qx", "qy", "qz", "qw")).alias("line"),
    )
    rows = readers.parse_slam(lines)
    return rows.select("recording", "seq", "t_s", "segment", F.col("pose")[3].alias("tx"), F.col("pose")[5].alias("r11"))


@query("timestamp_table", """
    WITH rows_in AS (
        SELECT page_id // 64 AS recording, page_id AS line_no, page_id * 25e-2 AS t_s,
               page_id % 7 = 0 AS absolute, page_id % 11 = 0 AS escaping, page_id % 13 = 0 AS three,
               page_id % 17 = 0 AS stuck, regexp_replace(url, '^https?://', '') AS rest FROM pages)
    SELECT recording, line_no, CASE WHEN stuck THEN -1e0 ELSE t_s END AS t_s,
           CASE WHEN three THEN 'columns' WHEN absolute OR escaping OR contains(rest, '\\')
                     OR regexp_matches(rest, '(^|/)\\.\\.(/|$)') THEN 'path'
                WHEN stuck AND line_no % 64 > 0 THEN 'order' END AS problem FROM rows_in""", doubles="t_s")
def timestamp_table(t):
    """SRC-10: two-column tables with unsafe paths and time order checked."""
    rest = F.regexp_replace("url", "^https?://", "")
    key = F.col("page_id")
    path = F.when(key % 7 == 0, F.concat(F.lit("/"), rest)).when(key % 11 == 0, F.concat(F.lit("../"), rest)).otherwise(rest)
    stamp = F.when(key % 17 == 0, F.lit("-1.0")).otherwise((key * 0.25).cast("string"))
    lines = t.pages.select(
        F.expr("page_id div 64").alias("recording"), key.alias("line_no"),
        F.concat_ws(" ", stamp, path, F.when(key % 13 == 0, F.lit("third"))).alias("line"),
    )
    return readers.parse_timestamp_table(lines, ["recording"]).select("recording", "line_no", "t_s", "problem")


@query("rigid_check", """
    SELECT recording, seq, CASE WHEN cents % 9 = 0 THEN 'camera' WHEN cents % 4 >= 2 THEN 'rotation' END AS problem FROM frames""")
def rigid_check(t):
    """SRC-11: calibration records with bad cameras or transforms that are not rigid."""
    from ..functions import geometry as g

    q = g.columns("qx", "qy", "qz", "qw")
    stretch = 1 + (F.col("cents") % 4) * 4e-6
    rotation = [c * stretch for c in g.quaternion_rotation(*q)]
    rows = t.frames.select(
        "recording", "seq", "cents", g.pose(rotation, g.columns("x", "y", "z")).alias("imu_from_camera")
    )
    fx = F.when(F.col("cents") % 9 == 0, F.lit(0.0)).otherwise(F.lit(500.0))
    problem = readers.calibration_problem(fx, F.lit(500.0), F.lit(640), F.lit(480), F.col("imu_from_camera"))
    return rows.select("recording", "seq", problem.alias("problem"))


@query("image_records", """
    SELECT o_orderkey AS image_id, count(l_orderkey) FILTER (WHERE l_returnflag <> 'R') AS n_references,
           count(l_orderkey) FILTER (WHERE l_returnflag = 'R') AS n_crowds,
           coalesce(sum(l_quantity * l_tax) FILTER (WHERE l_returnflag <> 'R'), 0) AS reference_area,
           count(l_orderkey) FILTER (WHERE l_linestatus = 'O') AS open_class
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""", doubles="reference_area")
def image_records(t):
    """SRC-12: references and crowds of every image, categories mapped by name; nested, then measured."""
    images = t.orders.select(F.col("o_orderkey").alias("image_id"))
    annotations = t.lineitem.select(
        F.col("l_orderkey").alias("image_id"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("instance_id"),
        F.when(F.col("l_linestatus") == "O", 7).otherwise(8).alias("category_id"),
        (F.col("l_partkey") % 500).cast("double").alias("x"), (F.col("l_suppkey") % 300).cast("double").alias("y"),
        F.col("l_quantity").alias("w"), F.col("l_tax").alias("h"),
        (F.col("l_quantity") * F.col("l_tax")).alias("area"), (F.col("l_returnflag") == "R").alias("iscrowd"),
    )
    spark = t.spark
    categories = spark.createDataFrame([(7, "open"), (8, "fulfilled")], "category_id int, category string")
    detector = spark.createDataFrame([(0, "fulfilled"), (1, "open")], "class_id int, category string")
    nested = readers.image_records(readers.image_annotations(images, annotations, categories, detector))
    is_open = lambda e: e["category"] == "open"
    return nested.groupBy("image_id").agg(
        F.sum(F.size("references")).alias("n_references"), F.sum(F.size("crowds")).alias("n_crowds"),
        F.sum(F.aggregate("references", F.lit(0.0), lambda s, e: s + e["area"])).alias("reference_area"),
        F.sum(F.size(F.filter("references", is_open)) + F.size(F.filter("crowds", is_open))).alias("open_class"),
    )


@query("run_filter", """
    SELECT doc_id, lang AS recording, source AS tool FROM documents
    WHERE lang = 'en' AND contains(text, 'the') AND contains(CAST(n_chars AS VARCHAR), '1')""")
def run_filter(t):
    """SRC-13: run records by recording, label text and a setting compared as text, newest first."""
    runs = t.documents.select(
        "doc_id", F.col("lang").alias("recording"), F.col("source").alias("tool"), F.col("text").alias("label"),
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("folder"),
        F.create_map(F.lit("n_chars"), F.col("n_chars").cast("string")).alias("settings"),
    )
    found = readers.filter_runs(runs, recording="en", grep="the", where=["n_chars=1"])
    return found.select("doc_id", "recording", "tool")


@query("explode_updates", """
    WITH parts AS (SELECT doc_id, unnest(CASE WHEN len(x) = 0 THEN [NULL] ELSE x END) AS part FROM (
        SELECT doc_id, list_filter(string_split(text, chr(10)), lambda p: length(p) >= 200) AS x FROM documents))
    SELECT doc_id AS update_id, count(part) AS detections, max(length(part)) AS longest FROM parts GROUP BY doc_id""", doubles="longest")
def explode_updates(t):
    """SRC-14: nested detections exploded; an update without any stays as an empty one."""
    updates = t.documents.select(
        F.lit("run").alias("run"), F.col("doc_id").alias("update"),
        F.transform(
            F.filter(F.split("text", "\n", -1), lambda p: F.length(p) >= 200),
            lambda p: F.struct(p.alias("label"), F.length(p).cast("long").alias("size")),
        ).alias("detections"),
    )
    rows = readers.explode_updates(updates)
    return rows.groupBy(F.col("update").alias("update_id")).agg(
        F.count("label").alias("detections"), F.max("size").alias("longest")
    )


@query("timeline_offsets", """
    WITH counts AS (SELECT recording, frame, count(*) AS points FROM pixels GROUP BY recording, frame)
    SELECT recording, frame, points, CAST(sum(points) OVER (PARTITION BY recording ORDER BY frame) - points AS BIGINT) AS point_offset
    FROM counts""")
def timeline_offsets(t):
    """SNK-01: where each frame's points start when a recording's frames are laid end to end."""
    return writers.timeline_offsets(t.pixels, ["recording"], "frame")


@query("resample_linear", """
    WITH g AS (SELECT recording, event_id, t_ns FROM stamps WHERE sensor = 'click'),
    a AS (SELECT recording, t_ns, value FROM stamps WHERE sensor = 'view'),
    p AS (SELECT g.*, a.t_ns AS t0, a.value AS v0 FROM g ASOF LEFT JOIN a ON g.recording = a.recording AND g.t_ns > a.t_ns),
    n AS (SELECT p.*, a.t_ns AS t1, a.value AS v1 FROM p ASOF LEFT JOIN a ON p.recording = a.recording AND p.t_ns <= a.t_ns)
    SELECT recording, event_id, t_ns, CASE WHEN t1 = t_ns THEN v1 ELSE
           (1 - (t_ns - t0) / (t1 - t0)) * v0 + (t_ns - t0) / (t1 - t0) * v1 END AS value_at
    FROM n WHERE t1 IS NOT NULL AND (t0 IS NOT NULL OR t1 = t_ns)""", doubles="value_at")
def resample_linear(t):
    """SNK-03: one sensor interpolated on another's times inside its span."""
    gyro = t.stamps.where("sensor = 'click'").select("recording", "event_id", "t_ns")
    accel = t.stamps.where("sensor = 'view'").select("recording", "t_ns", "value")
    return writers.resample_linear(gyro, accel, ["recording"], "t_ns", ["value"], chunk_ns=DAY_NS)
