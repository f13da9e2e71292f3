"""Queries over path accuracy, links and run reports."""

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import linking, paths, reports
from .registry import query
from .scalars import frame_pose

UNIT = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)


def matched_paths(t, turned=False):
    """Estimated and reference poses of posed frames; segments of 64 frames."""
    unit = [F.lit(c) for c in UNIT]
    drift = F.col("seq") * 2e-3
    est = g.pose(unit, [F.col("x") * 1.1 + drift, F.col("y"), F.col("z")])
    ref = g.pose(unit, g.columns("x", "y", "z"))
    if turned:
        est = frame_pose()
        ref = g.pose_from_quaternion([F.col("x") * 1.1 + drift, F.col("z"), F.col("y")], g.columns("qx", "qy", "qz", "qw"))
    return t.frames.where("status <> 'P'").select(
        "recording", F.expr("seq div 64").alias("segment"), "seq", "t_ns", est.alias("est"), ref.alias("ref"), (F.col("status") == "F").alias("tracked")
    )


@query("path_error", """
    WITH m AS (SELECT recording, seq // 64 AS segment, seq, x * 11e-1 + seq * 2e-3 AS ex, x, status = 'F' AS tracked FROM frames WHERE status <> 'P'),
    f AS (SELECT recording, segment, arg_min(ex - x, seq) AS off, count(*) AS n, bool_or(tracked) AS t FROM m GROUP BY ALL HAVING count(*) >= 2 AND bool_or(tracked))
    SELECT recording, segment, seq, abs(ex - off - x) AS error_m FROM m JOIN f USING (recording, segment)""", doubles="error_m")
def path_error(t):
    """AGG-32: position errors after aligning each segment at its first matched pose."""
    rows = paths.first_pose_errors(matched_paths(t), ["recording", "segment"], "seq")
    return rows.select("recording", "segment", "seq", "error_m")


@query("path_fit", doubles="position_rmse_m rigid_rmse_m sized_rmse_m size tracked_fraction")
def path_fit(t):
    """AGG-32: pooled errors per run with best rigid and sized fits."""
    rows = matched_paths(t, turned=True)
    keys = ["recording", "segment"]
    return paths.pooled_path(paths.first_pose_errors(rows, keys, "seq"), paths.best_fits(rows, keys), ["recording"], rows)


@query("relative_1s", """
    WITH m AS (SELECT recording, seq // 64 AS segment, seq, t_ns, x * 11e-1 + seq * 2e-3 AS ex, x FROM frames WHERE status <> 'P'),
    p AS (SELECT a.recording, a.segment, a.seq, b.ex - a.ex - (b.x - a.x) AS d, row_number() OVER (PARTITION BY a.recording, a.segment, a.seq ORDER BY abs(b.t_ns - a.t_ns - 1000000000), b.t_ns) AS k
          FROM m a JOIN m b ON b.recording = a.recording AND b.segment = a.segment AND abs(b.t_ns - a.t_ns - 1000000000) <= 100000000)
    SELECT recording, segment, count(*) AS pairs, sqrt(avg(d * d)) AS translation_rmse_m FROM p WHERE k = 1 GROUP BY ALL""", doubles="translation_rmse_m")
def relative_1s(t):
    """AGG-33: motion error over the frame nearest a second later."""
    rows = paths.relative_motion(matched_paths(t), ["recording", "segment"], "seq", "t_ns")
    return rows.groupBy("recording", "segment").agg(
        F.count("*").alias("pairs"), F.sqrt(F.avg(F.col("translation_m") ** 2)).alias("translation_rmse_m")
    )


@query("mean_rotation", doubles="qx qy qz qw spread_deg")
def mean_rotation(t):
    """AGG-34: mean rotation of each recording and the widest angle to it."""
    rows = paths.mean_rotation(t.frames, ["recording"])
    return rows.select("recording", "n", *[F.col("mean")[i].alias(n) for i, n in enumerate(("qx", "qy", "qz", "qw"))], "spread_deg")


@query("walk_accuracy", """
    WITH f AS (SELECT recording, seq, t_ns, x, y, z, status <> 'P' AS posed, cents % 2 AS corrections FROM frames WHERE priority <> '5-LOW'),
    s AS (SELECT *, lag(posed) OVER w AS pp, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz, lag(seq) OVER w AS ps, lag(t_ns) OVER w AS pt FROM f WINDOW w AS (PARTITION BY recording ORDER BY seq))
    SELECT recording, count(*) AS frames_n, avg(CASE WHEN posed THEN 1e0 ELSE 0e0 END) AS tracked_fraction, count(*) FILTER (WHERE NOT posed AND pp) AS lost_events,
           sum(sqrt((x-px)**2 + (y-py)**2 + (z-pz)**2)) FILTER (WHERE posed AND pp) AS path_m, CAST(sum(corrections) AS BIGINT) AS corrections, CAST(sum(seq - ps - 1) AS BIGINT) AS missing_numbers, max(t_ns - pt) / 1e9 AS longest_gap_s FROM s GROUP BY recording""",
       doubles="tracked_fraction path_m longest_gap_s")
def walk_accuracy(t):
    """AGG-35: tracking facts of each walk."""
    rows = t.frames.where("priority <> '5-LOW'").select(
        "recording", "seq", "t_ns", "x", "y", "z", (F.col("status") != "P").alias("posed"), (F.col("cents") % 2).alias("corrections")
    )
    return reports.walk_accuracy(rows, "recording")


@query("loop_closure", """
    WITH l AS (SELECT recording, min(seq) AS a, max(seq) AS b, count(*) / 1e1 AS tape FROM frames GROUP BY recording), p AS (SELECT * FROM frames WHERE status <> 'P')
    SELECT l.recording, sqrt((e.x-s.x)**2 + (e.y-s.y)**2 + (e.z-s.z)**2) * 1000 AS closure_mm, sqrt((e.x-s.x)**2 + (e.y-s.y)**2 + (e.z-s.z)**2) / tape * 100 AS closure_percent,
           degrees(2 * acos(least(abs(e.qx*s.qx + e.qy*s.qy + e.qz*s.qz + e.qw*s.qw), 1e0))) AS turn_error_deg, CASE WHEN s.seq IS NULL OR e.seq IS NULL THEN 'checkpoint not tracked' END AS reason
    FROM l LEFT JOIN p s ON s.recording = l.recording AND s.seq = a LEFT JOIN p e ON e.recording = l.recording AND e.seq = b""", doubles="closure_mm closure_percent turn_error_deg")
def loop_closure(t):
    """AGG-35: distance and turn left when a walk returns to its start."""
    loops = t.frames.groupBy("recording").agg(F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), (F.count("*") / 10).alias("tape_m"))
    return reports.loop_closure(t.frames.withColumn("posed", F.col("status") != "P"), loops)


@query("tape_distances", """
    WITH p AS (SELECT * FROM frames WHERE status <> 'P')
    SELECT a.recording, a.seq AS from_seq, a.seq + 20 AS to_seq, 7e-1 AS tape_m, sqrt((b.x-a.x)**2 + (b.y-a.y)**2 + (b.z-a.z)**2) AS estimated_m,
           (sqrt((b.x-a.x)**2 + (b.y-a.y)**2 + (b.z-a.z)**2) - 7e-1) * 1000 AS signed_error_mm, abs(sqrt((b.x-a.x)**2 + (b.y-a.y)**2 + (b.z-a.z)**2) - 7e-1) / 7e-1 * 100 AS absolute_error_percent
    FROM p a JOIN p b ON b.recording = a.recording AND b.seq = a.seq + 20""", doubles="tape_m estimated_m signed_error_mm absolute_error_percent")
def tape_distances(t):
    """AGG-35: estimated against taped distances."""
    tapes = t.frames.select("recording", F.col("seq").alias("from_seq"), (F.col("seq") + 20).alias("to_seq"), F.lit(0.7).alias("tape_m"))
    return reports.tape_distances(t.frames.withColumn("posed", F.col("status") != "P"), tapes)


def part_measures(t, changed):
    unit = F.when(F.col("p_type") == "SMALL", "mm").otherwise("m") if changed else F.lit("m")
    value = F.avg("p_retailprice" if not changed else F.col("p_retailprice") + (F.col("p_size") % 3 - 1))
    kept = t.part.where("p_brand <> 'Brand#1'") if changed else t.part.where("p_brand <> 'Brand#2'")
    rows = kept.groupBy(F.col("p_brand").alias("stage"), F.col("p_type").alias("method"), F.col("p_name").alias("name"), unit.alias("unit")).agg(value.alias("v"), F.count("*").alias("n"))
    better = F.when(F.length("method") % 3 == 0, "lower").when(F.length("method") % 3 == 1, "higher").otherwise("neither")
    return rows.select(
        "stage", "method", "name", F.when(F.col("n") > 1, F.col("v")).alias("value"), "unit", better.alias("better"),
        *[F.lit("same").alias(c) for c in ("dataset", "input_mode", "scope_sha", "reference_sha", "coverage")],
    )


@query("report_compare", """
    WITH a AS (SELECT p_brand AS stage, p_type AS method, p_name AS name, CASE WHEN count(*) > 1 THEN avg(p_retailprice) END AS v, 'm' AS unit FROM part WHERE p_brand <> 'Brand#2' GROUP BY ALL),
    b AS (SELECT p_brand AS stage, p_type AS method, p_name AS name, CASE WHEN count(*) > 1 THEN avg(p_retailprice + (p_size % 3 - 1)) END AS v, CASE WHEN p_type = 'SMALL' THEN 'mm' ELSE 'm' END AS unit FROM part WHERE p_brand <> 'Brand#1' GROUP BY ALL),
    j AS (SELECT coalesce(a.stage, b.stage) AS stage, coalesce(a.method, b.method) AS method, coalesce(a.name, b.name) AS name, a.v AS av, b.v AS bv, length(coalesce(a.method, b.method)) % 3 AS better,
                 concat_ws(', ', CASE WHEN a.stage IS NULL THEN 'not in baseline' END, CASE WHEN b.stage IS NULL THEN 'not in candidate' END, CASE WHEN a.stage IS NOT NULL AND b.stage IS NOT NULL AND a.v IS NULL THEN 'no baseline value' END,
                           CASE WHEN a.stage IS NOT NULL AND b.stage IS NOT NULL AND b.v IS NULL THEN 'no candidate value' END, CASE WHEN a.unit <> b.unit THEN 'unit' END) AS reasons
          FROM a FULL JOIN b ON a.stage = b.stage AND a.method = b.method AND a.name = b.name)
    SELECT stage, method, name, CASE WHEN reasons = '' THEN bv - av END AS change, CASE WHEN reasons <> '' THEN 'not comparable' WHEN abs(bv - av) < 1e-9 THEN 'same' WHEN better = 2 THEN 'changed'
           WHEN (better = 0 AND bv < av) OR (better = 1 AND bv > av) THEN 'better' ELSE 'worse' END AS verdict, reasons FROM j""", doubles="change")
def report_compare(t):
    """JOIN-20: two measure tables compared; verdict or the reasons against comparing."""
    rounded = lambda df: df.withColumn("value", F.round("value", 9))  # noqa: E731 - equal values must meet exactly
    rows = reports.compare_measures(rounded(part_measures(t, False)), rounded(part_measures(t, True)))
    return rows.select("stage", "method", "name", "change", "verdict", "reasons")


@query("stage_measures", """
    WITH s AS (SELECT l_returnflag AS run, l_linestatus AS stage, avg(l_quantity) AS error_m, CASE WHEN count(*) FILTER (WHERE l_tax > 1) > 0 THEN max(l_tax) END AS spread FROM lineitem GROUP BY ALL),
    m AS (SELECT run, stage, 'error_m' AS name, error_m AS value, 'm' AS unit FROM s UNION ALL SELECT run, stage, 'spread', spread, 'share' FROM s),
    r AS (SELECT DISTINCT run, st.stage FROM s, (VALUES ('F'), ('O'), ('mapping')) st(stage))
    SELECT r.run, r.stage, m.name, m.value, m.unit, CASE WHEN m.name IS NULL THEN 'stage unavailable' WHEN m.value IS NULL THEN 'no samples' END AS reason FROM r LEFT JOIN m ON m.run = r.run AND m.stage = r.stage""", doubles="value")
def stage_measures(t):
    """AGG-55: scores as stage measures with a reason for every missing value and stage."""
    scored = t.lineitem.groupBy(F.col("l_returnflag").alias("run"), F.col("l_linestatus").alias("stage")).agg(
        F.avg("l_quantity").alias("error_m"), F.max(F.when(F.col("l_tax") > 1, F.col("l_tax"))).alias("spread")
    )
    return reports.stage_measures(scored, ["run"], {"error_m": "m", "spread": "share"}, ["F", "O", "mapping"], F.lit("no samples"))


@query("link_frames")
def link_frames(t):
    """JOIN-19: detections linked from frame to frame; why the others were not."""
    d = t.boxes.select(
        "image", F.col("cls").alias("label"), "item", ((F.col("x1") + F.col("x2")) / 2).alias("u"), ((F.col("y1") + F.col("y2")) / 2).alias("v"),
        F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("diagonal"), (F.col("half") == "O").alias("linkable"),
    )
    previous = d.where("linkable").select("image", "label", F.col("item").alias("i"), "u", "v", "diagonal")
    current = d.select((F.col("image") - 1).alias("image"), "label", F.col("item").alias("j"), "u", "v", "linkable")
    links, unlinked = linking.link_frames(previous, current, ["image"])
    node = lambda image, item: F.struct(image.alias("image"), F.col(item).alias("item"))
    nodes = d.where("linkable").select(node(F.col("image"), "item").alias("id"))
    edges = links.select(node(F.col("image"), "i").alias("a"), node(F.col("image") + 1, "j").alias("b"))
    lengths = linking.chains(nodes, edges).groupBy("track").agg(F.count("*").alias("n"))
    tracks = lengths.groupBy(F.concat(F.lit("track of "), F.col("n").cast("string")).alias("outcome")).agg(F.count("*").alias("n"))
    return unlinked.groupBy("outcome").agg(F.count("*").alias("n")).unionByName(tracks)
