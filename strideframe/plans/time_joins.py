"""Queries over joins on time and sequence."""

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import references as refs
from ..operators import timejoin as tj
from ..operators.ordered import HOUR_NS
from .registry import query
from .scalars import ANCHOR_SQL, PIXEL_WORLD_SQL, anchor_tables, frame_pose, intrinsics, view_pose

DAY_NS = 24 * HOUR_NS
REACH_NS = 6 * HOUR_NS


@query("associate_times", f"""
    WITH RECURSIVE c AS (SELECT a.recording, a.event_id AS click, b.event_id AS seen, abs(a.t_ns - b.t_ns) AS gap, a.t_ns AS ta, b.t_ns AS tb
        FROM stamps a JOIN stamps b ON a.recording = b.recording AND a.sensor = 'click' AND b.sensor = 'view' AND abs(a.t_ns - b.t_ns) <= {REACH_NS}),
    o AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY gap, ta, tb) AS k FROM c),
    walk AS (SELECT recording, k, [click] AS ua, [seen] AS ub, click, seen, gap, true AS taken FROM o WHERE k = 1
        UNION ALL SELECT o.recording, o.k, CASE WHEN list_contains(ua, o.click) OR list_contains(ub, o.seen) THEN ua ELSE list_append(ua, o.click) END,
                         CASE WHEN list_contains(ua, o.click) OR list_contains(ub, o.seen) THEN ub ELSE list_append(ub, o.seen) END,
                         o.click, o.seen, o.gap, NOT (list_contains(ua, o.click) OR list_contains(ub, o.seen))
        FROM walk w JOIN o ON o.recording = w.recording AND o.k = w.k + 1)
    SELECT recording, click, seen, gap FROM walk WHERE taken""")
def associate_times(t):
    """JOIN-01: greedy one-to-one nearest-time pairs by rounds of mutually best rows."""
    a = t.stamps.where("sensor = 'click'").withColumnRenamed("event_id", "click")
    c = t.stamps.where("sensor = 'view'").withColumnRenamed("event_id", "seen")
    return tj.associate_times(a, c, ["recording"], "t_ns", ("click", "seen"), REACH_NS, chunk_ns=DAY_NS)


@query("nearest_within", f"""
    WITH a AS (SELECT recording, event_id, t_ns FROM stamps WHERE sensor = 'click'), b AS (SELECT recording, t_ns, value FROM stamps WHERE sensor = 'error'),
    p AS (SELECT a.*, b.t_ns AS t0, b.value AS v0 FROM a ASOF LEFT JOIN b ON a.recording = b.recording AND a.t_ns > b.t_ns),
    n AS (SELECT p.*, b.t_ns AS t1, b.value AS v1 FROM p ASOF LEFT JOIN b ON p.recording = b.recording AND p.t_ns <= b.t_ns)
    SELECT recording, event_id, CASE WHEN least(t_ns - t0, t1 - t_ns) <= {REACH_NS} THEN
        CASE WHEN t1 IS NULL OR t_ns - t0 <= t1 - t_ns THEN v0 ELSE v1 END END AS value FROM n""", doubles="value")
def nearest_within(t):
    """JOIN-02: nearest reference inside a tolerance, many to one."""
    a = t.stamps.where("sensor = 'click'").select("recording", "event_id", "t_ns")
    c = t.stamps.where("sensor = 'error'").select("recording", "t_ns", "value")
    rows = tj.nearest_within(a, c, ["recording"], "t_ns", ["value"], REACH_NS, chunk_ns=DAY_NS)
    return rows.select("recording", "event_id", F.col("match.value").alias("value"))


@query("interpolate_asof", """
    WITH s AS (SELECT recording, seq, t_ns + (cents % 50) * 1000000 AS t_ns FROM frames), p AS (SELECT * FROM frames WHERE status <> 'P'),
    b AS (SELECT s.*, p.t_ns AS t0, p.x AS x0, p.qx AS a0, p.qy AS b0, p.qz AS c0, p.qw AS d0 FROM s ASOF LEFT JOIN p ON s.recording = p.recording AND s.t_ns > p.t_ns),
    n AS (SELECT b.*, p.t_ns AS t1, p.x AS x1, p.qx AS a1, p.qy AS b1, p.qz AS c1, p.qw AS d1 FROM b ASOF LEFT JOIN p ON b.recording = p.recording AND b.t_ns <= p.t_ns),
    h AS (SELECT *, CASE WHEN t_ns - t0 <= 1000 THEN 0 WHEN t1 - t_ns <= 1000 THEN 1 WHEN t1 - t0 <= 100000000 THEN 2 END AS how,
                 (t_ns - t0) / (t1 - t0) AS w, a0*a1 + b0*b1 + c0*c1 + d0*d1 AS dd FROM n),
    th AS (SELECT *, acos(least(abs(dd), 1e0)) AS theta, CASE WHEN dd < 0 THEN -1 ELSE 1 END AS sg FROM h),
    f AS (SELECT *, CASE WHEN sin(theta) < 1e-9 THEN 1 - w ELSE sin((1 - w) * theta) / sin(theta) END AS wa, CASE WHEN sin(theta) < 1e-9 THEN w ELSE sin(w * theta) / sin(theta) END AS wb FROM th),
    q AS (SELECT *, sqrt((wa*a0 + sg*wb*a1)**2 + (wa*b0 + sg*wb*b1)**2 + (wa*c0 + sg*wb*c1)**2 + (wa*d0 + sg*wb*d1)**2) AS nn FROM f)
    SELECT recording, seq, CASE how WHEN 0 THEN x0 WHEN 1 THEN x1 WHEN 2 THEN (1 - w) * x0 + w * x1 END AS px,
           CASE how WHEN 0 THEN b0 WHEN 1 THEN b1 WHEN 2 THEN (wa*b0 + sg*wb*b1) / nn END AS pqy,
           CASE WHEN how = 2 THEN 'between' WHEN how IS NOT NULL THEN 'exact' END AS how FROM q""", doubles="px pqy")
def interpolate_asof(t):
    """JOIN-03: poses at sample times between close neighbours, exact within a microsecond."""
    samples = t.frames.select("recording", "seq", (F.col("t_ns") + (F.col("cents") % 50) * 1_000_000).alias("t_ns"))
    poses = t.frames.where("status <> 'P'")
    rows = tj.interpolate_poses(samples, poses, ["recording"], "t_ns")
    return rows.select("recording", "seq", F.col("p_x").alias("px"), F.col("p_qy").alias("pqy"), "how")


@query("exact_match_share", """
    WITH tr AS (SELECT recording, t_ns + CASE WHEN cents % 3 = 0 THEN 7 ELSE 0 END AS t FROM frames WHERE status = 'F')
    SELECT tr.recording, avg(CASE WHEN f.t_ns IS NULL THEN 0e0 ELSE 1e0 END) AS share, count(*) FILTER (WHERE f.t_ns IS NULL) AS unmatched
    FROM tr LEFT JOIN frames f ON f.recording = tr.recording AND f.t_ns = tr.t GROUP BY tr.recording""", doubles="share")
def exact_match_share(t):
    """JOIN-04: share of tracker stamps that are exactly an image's stamp."""
    stamps = t.frames.where("status = 'F'").select(
        "recording", (F.col("t_ns") + F.when(F.col("cents") % 3 == 0, 7).otherwise(0)).alias("t_ns")
    )
    rows = tj.exact_matches(stamps, t.frames, ["recording"], "t_ns")
    return rows.groupBy("recording").agg(
        F.avg(F.col("matched").cast("double")).alias("share"), F.count(F.when(~F.col("matched"), 1)).alias("unmatched")
    )


@query("last_keyframe", f"""
    WITH {ANCHOR_SQL} SELECT recording, seq, keyframe FROM keyed""", doubles="keyframe")
def last_keyframe(t):
    """JOIN-05: the newest anchor created at or before each frame."""
    frames = t.frames.select("recording", "seq")
    return tj.last_anchor(frames, anchor_tables(t), ["recording"], "seq").select("recording", "seq", "keyframe")


@query("latest_anchors", f"""
    WITH {ANCHOR_SQL} SELECT recording, anchor_id, ax, ay, az, events FROM latest""", doubles="ax ay az")
def latest_anchors(t):
    """JOIN-05: newest pose of each known anchor; corrections of unknown ones are ignored."""
    rows = tj.latest_anchor_poses(anchor_tables(t), ["recording"], "seq")
    return rows.select("recording", "anchor_id", *[F.col("pose_now")[i].alias(n) for i, n in enumerate(("ax", "ay", "az"))], "events")


@query("keyframe_refs", f"""
    WITH kf AS (SELECT recording, seq, x, y, z, {{rotation}}, row_number() OVER (PARTITION BY recording ORDER BY seq) AS ord FROM frames WHERE priority = '1-URGENT'),
    f AS (SELECT recording, seq, x, y, z, {{rotation}}, (SELECT count(*) FROM kf WHERE kf.recording = frames.recording AND kf.seq < frames.seq) AS upto FROM frames),
    c AS (SELECT f.recording, f.seq, kf.seq AS keyframe, f.upto - kf.ord AS age, sqrt((f.x-kf.x)**2 + (f.y-kf.y)**2 + (f.z-kf.z)**2) AS baseline,
                 degrees(acos(least(greatest(f.r02*kf.r02 + f.r12*kf.r12 + f.r22*kf.r22, -1e0), 1e0))) AS angle
          FROM f JOIN kf ON kf.recording = f.recording AND kf.ord BETWEEN f.upto - 7 AND f.upto),
    k AS (SELECT *, row_number() OVER (PARTITION BY recording, seq ORDER BY age) AS rank FROM c WHERE baseline BETWEEN 5e-2 AND 1e0 AND angle <= 30)
    SELECT recording, seq, keyframe, rank, baseline FROM k WHERE rank <= 3""".replace("{rotation}", """2 * (qx*qz + qy*qw) AS r02, 2 * (qy*qz - qx*qw) AS r12, 1 - 2 * (qx*qx + qy*qy) AS r22"""), doubles="baseline")
def keyframe_refs(t):
    """JOIN-07: up to three newest usable keyframes of the last eight."""
    frames = t.frames.select("recording", "seq", "priority", frame_pose().alias("pose"))
    return refs.keyframe_references(frames, F.col("priority") == "1-URGENT").select(
        "recording", "seq", "keyframe", "rank", "baseline"
    )


@query("mutual_ratio_match", """
    WITH e AS (SELECT vec_id, vec_id // 50 AS frame, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    d AS (SELECT a.frame, a.vec_id AS i, b.vec_id AS j, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON b.frame = a.frame + 1),
    f AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rf, lead(d) OVER (PARTITION BY i ORDER BY d, j) AS d2, row_number() OVER (PARTITION BY frame, j ORDER BY d, i) AS rb FROM d)
    SELECT frame, i, j, d AS distance FROM f WHERE rf = 1 AND rb = 1 AND d < 98e-2 * d2""", doubles="distance")
def mutual_ratio_match(t):
    """JOIN-08: mutually best descriptor matches that beat the second best by a ratio."""
    rows = t.embeddings.select(
        F.col("vec_id").alias("feature"), F.expr("vec_id div 50").alias("frame"), F.col("embedding").cast("array<double>").alias("vector")
    )
    return refs.mutual_matches(
        rows, rows.withColumn("frame", F.col("frame") - 1), ["frame"], ratio=0.98
    ).select("frame", "i", "j", "distance")


@query("lag_pairs", """
    WITH f AS (SELECT recording, seq // 64 AS segment, seq, x, y, z FROM frames), l AS (SELECT * FROM (VALUES (1), (5), (10)) AS v(lag))
    SELECT f.recording, f.segment, f.seq, CAST(l.lag AS INTEGER) AS lag, sqrt((f.x-e.x)**2 + (f.y-e.y)**2 + (f.z-e.z)**2) AS moved
    FROM f CROSS JOIN l LEFT JOIN f e ON e.recording = f.recording AND e.segment = f.segment AND e.seq = f.seq - l.lag""", doubles="moved")
def lag_pairs(t):
    """JOIN-13: each frame beside earlier ones of the same origin; null across origins."""
    frames = t.frames.select("recording", F.expr("seq div 64").alias("segment"), "seq", "x", "y", "z")
    rows = tj.lag_pairs(frames, ["recording", "segment"], "seq", [1, 5, 10], ["x", "y", "z"])
    moved = g.length(g.minus(g.columns("x", "y", "z"), g.columns("earlier.x", "earlier.y", "earlier.z")))
    return rows.select("recording", "segment", "seq", "lag", moved.alias("moved"))


@query("borrow_nearest", """
    WITH f AS (SELECT recording, seq, CASE WHEN cents % 3 = 0 THEN x END AS size FROM frames), k AS (SELECT recording, seq AS s, size AS v FROM f WHERE size IS NOT NULL),
    p AS (SELECT f.*, k.s AS s0, k.v AS v0 FROM f ASOF LEFT JOIN k ON f.recording = k.recording AND f.seq >= k.s),
    n AS (SELECT p.*, k.s AS s1, k.v AS v1 FROM p ASOF LEFT JOIN k ON p.recording = k.recording AND p.seq <= k.s)
    SELECT recording, seq, CASE WHEN s1 IS NULL OR seq - s0 <= s1 - seq THEN v0 ELSE v1 END AS borrowed,
           CASE WHEN s0 IS NULL THEN v1 WHEN s1 IS NULL THEN v0 WHEN s0 = s1 THEN v0 ELSE v0 + (v1 - v0) * (seq - s0) / (s1 - s0) END AS filled FROM n""",
       doubles="borrowed filled")
def borrow_nearest(t):
    """JOIN-21: sizes borrowed from the nearest fitted frame, and filled by interpolation."""
    rows = t.frames.select("recording", "seq", F.when(F.col("cents") % 3 == 0, F.col("x")).alias("size"))
    both = tj.interpolate_missing(tj.borrow_nearest(rows, ["recording"], "seq", "size"), ["recording"], "seq", "size")
    return both.select("recording", "seq", "borrowed", "filled")


@query("largest_model", """
    WITH m AS (SELECT DISTINCT l_orderkey // 2048 AS recording, l_orderkey AS frame, l_suppkey % 12 AS model FROM lineitem WHERE l_returnflag = 'A'),
    s AS (SELECT recording, model, count(*) AS n FROM m GROUP BY ALL),
    b AS (SELECT frame, arg_min(model, (-n, model)) AS model FROM m JOIN s USING (recording, model) GROUP BY frame),
    p AS (SELECT l_orderkey AS frame, count(*) AS points FROM lineitem WHERE l_quantity % 10 >= 3 AND l_tax * 40 <= 2 GROUP BY l_orderkey)
    SELECT o_orderkey AS frame, b.model, coalesce(p.points, 0) AS points FROM orders LEFT JOIN b ON b.frame = o_orderkey LEFT JOIN p ON p.frame = o_orderkey""", doubles="model")
def largest_model(t):
    """JOIN-23: a frame's pose in the largest model that holds it; unplaced frames stay."""
    placed = t.lineitem.where("l_returnflag = 'A'").selectExpr(
        "l_orderkey div 2048 as recording", "l_orderkey as frame", "l_suppkey % 12 as model"
    ).distinct()
    points = t.lineitem.selectExpr("l_orderkey as frame", "l_quantity % 10 as track_length", "l_tax * 40 as error_px")
    frames = t.orders.selectExpr("o_orderkey as frame")
    return refs.largest_model(frames, placed, points).select("frame", "model", "points")


@query("corner_residuals", """
    WITH w AS (SELECT a.recording, a.frame, a.prow, a.pcol, quantile_cont(b.learned, 0.5) AS m, max(b.learned) AS hi, min(b.learned) AS lo
        FROM coarse_map a JOIN coarse_map b ON b.recording = a.recording AND b.frame = a.frame AND abs(b.prow - a.prow) <= 3 AND abs(b.pcol - a.pcol) <= 3 GROUP BY ALL),
    z AS (SELECT w.* FROM w JOIN coarse_map n ON n.recording = w.recording AND n.frame = w.frame + 1 AND n.prow = w.prow AND n.pcol = w.pcol WHERE hi - lo <= 3 * m),
    c AS (SELECT z.recording, z.frame, z.prow, z.pcol, z.m, cos(a.yaw) * ((pcol - 315e-1) * m / 5e1) + sin(a.yaw) * m + a.tx AS wx, (prow - 235e-1) * m / 5e1 + a.ty AS wy,
                 -sin(a.yaw) * ((pcol - 315e-1) * m / 5e1) + cos(a.yaw) * m AS wz, b.tx, b.ty, b.yaw
          FROM z JOIN views a ON a.recording = z.recording AND a.frame = z.frame JOIN views b ON b.recording = z.recording AND b.frame = z.frame + 1),
    d AS (SELECT *, cos(yaw) * (wx - tx) - sin(yaw) * wz AS cx, wy - ty AS cy, sin(yaw) * (wx - tx) + cos(yaw) * wz AS cz FROM c)
    SELECT recording, frame, prow, pcol, m AS depth_m, pcol - (5e1 * cx / cz + 315e-1) AS dx, prow - (5e1 * cy / cz + 235e-1) AS dy FROM d""", doubles="depth_m dx dy")
def corner_residuals(t):
    """JOIN-25: window-median depth of a corner, predicted against observed pixel in the next frame."""
    views = t.views.select("recording", "frame", view_pose().alias("pose"))
    maps = t.coarse_map
    corners = refs.window_depth(maps, "learned", 3, max_range=3.0)
    matched = maps.select("recording", (F.col("frame") - 1).alias("frame"), "prow", "pcol")
    rows = corners.join(matched, ["recording", "frame", "prow", "pcol"])
    return refs.pair_residuals(rows, views, intrinsics()).select("recording", "frame", "prow", "pcol", "depth_m", "dx", "dy")


@query("grid_nearest_fill", """
    WITH g AS (SELECT r, c FROM range(0, 4) a(r), range(0, 6) b(c)),
    s AS (SELECT recording, frame, sample, pcol, prow, target FROM pixels WHERE confidence >= 250),
    n AS (SELECT recording, frame, count(*) AS n FROM s GROUP BY ALL),
    d AS (SELECT recording, frame, r, c, arg_min(target, ((pcol - (c + 5e-1) * 64 / 6)**2 + (prow - (r + 5e-1) * 48 / 4)**2, sample)) AS depth_m FROM s, g GROUP BY ALL)
    SELECT d.recording, d.frame, r AS grid_row, c AS grid_col, CASE WHEN n >= 4 THEN depth_m END AS depth_m FROM d JOIN n USING (recording, frame)""", doubles="depth_m")
def grid_nearest_fill(t):
    """JOIN-26: a coarse grid filled from scattered points; null under four points."""
    scattered = t.pixels.where("confidence >= 250")
    return refs.grid_nearest(scattered, "target", "sample", (48, 64), (4, 6), minimum=4).select(
        "recording", "frame", "grid_row", "grid_col", "depth_m"
    )


@query("zbuffer_gap", f"""
    WITH {PIXEL_WORLD_SQL},
    c AS (SELECT w.recording, v.frame, cos(yaw) * (wx - tx) - sin(yaw) * wz AS cx, wy - ty AS cy, sin(yaw) * (wx - tx) + cos(yaw) * wz AS cz
          FROM world w JOIN views v ON v.recording = w.recording AND v.frame = w.frame - 1),
    p AS (SELECT recording, frame, CAST(round_even(5e1 * cx / cz + 315e-1, 0) AS BIGINT) AS pcol, CAST(round_even(5e1 * cy / cz + 235e-1, 0) AS BIGINT) AS prow, cz FROM c WHERE cz > 5e-2),
    b AS (SELECT recording, frame, prow, pcol, min(cz) AS z FROM p WHERE pcol BETWEEN 0 AND 63 AND prow BETWEEN 0 AND 47 GROUP BY ALL),
    g AS (SELECT b.recording, b.frame, b.z - m.target AS gap FROM b JOIN pixel_map m ON m.recording = b.recording AND m.frame = b.frame AND m.prow = b.prow AND m.pcol = b.pcol),
    total AS (SELECT recording, frame - 1 AS frame, count(*) AS n FROM pixels GROUP BY ALL)
    SELECT v.recording, v.frame, coalesce(q.n, 0) AS overlap_pixels, q.signed_m, q.abs_m, coalesce(q.n, 0) / t.n AS overlap
    FROM views v JOIN total t USING (recording, frame) LEFT JOIN (SELECT recording, frame, count(*) AS n, quantile_cont(gap, 0.5) AS signed_m, quantile_cont(abs(gap), 0.5) AS abs_m FROM g GROUP BY ALL) q USING (recording, frame)""",
       doubles="signed_m abs_m overlap")
def zbuffer_gap(t):
    """JOIN-12: nearest later point per pixel against the earlier frame's depth."""
    views = t.views.select("recording", "frame", view_pose().alias("pose"))
    return refs.surface_gaps(t.spread(t.pixels), t.pixel_map, views, "target", intrinsics(), 48, 64, lags=[1]).select(
        "recording", "frame", "overlap_pixels", "signed_m", "abs_m", "overlap"
    )


@query("assemble_observations", """
    WITH sup AS (SELECT recording, frame, quantile_cont(target, 0.5) AS z, count(*) AS n FROM pixels WHERE confidence >= 128 GROUP BY ALL)
    SELECT b.image, b.item, CASE WHEN v.frame IS NOT NULL AND b.image % 5 <> 0 THEN cos(yaw) * ((x1 + x2) / 2 / 10 - 315e-1) * sup.z / 5e1 + sin(yaw) * sup.z + tx END AS wx,
           sup.z AS depth_m, e.x AS descriptor_x FROM boxes b LEFT JOIN views v ON v.frame = b.image // 4 LEFT JOIN sup ON sup.frame = b.image // 4
    LEFT JOIN points e ON e.point = b.item // 100000 % 10000000 WHERE b.half = 'O'""", doubles="wx depth_m descriptor_x")
def assemble_observations(t):
    """JOIN-24: detection, pose, depth support and descriptor side by side; what is missing stays null."""
    detections = t.boxes.where("half = 'O'").selectExpr(
        "image", "item", "x1", "y1", "x2", "y2", "image div 4 as frame", "item div 100000 % 10000000 as point"
    )
    poses = t.views.select("recording", "frame", view_pose().alias("pose"))
    descriptors = t.points.select("point", F.col("x").alias("descriptor_x"))
    support = t.pixels.where("confidence >= 128").select("frame", "target")
    rows = refs.assemble_observations(detections, poses, support, descriptors, intrinsics(), has_pose=F.col("image") % 5 != 0)
    return rows.select("image", "item", "wx", "depth_m", "descriptor_x")
