"""Queries over per-recording sequences, picks and event order."""

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import sequences as sq
from ..operators import spatial as sp
from .registry import query
from .scalars import anchor_tables, frame_pose
from .space_joins import small_boxes

NUMBERED = "row_number() OVER (PARTITION BY recording ORDER BY seq) AS i"


@query("anchor_every", f"""
    WITH RECURSIVE f AS (SELECT recording, seq, t_ns, status <> 'P' AS ok, {NUMBERED} FROM frames),
    w AS (SELECT recording, seq, i, ok, CASE WHEN ok THEN t_ns END AS last, CASE WHEN ok THEN 0 ELSE -1 END AS num, ok AS created FROM f WHERE i = 1
        UNION ALL SELECT f.recording, f.seq, f.i, f.ok, CASE WHEN f.ok AND (w.last IS NULL OR f.t_ns - w.last >= 1000000000) THEN f.t_ns ELSE w.last END,
                         CASE WHEN f.ok AND (w.last IS NULL OR f.t_ns - w.last >= 1000000000) THEN w.num + 1 ELSE w.num END, f.ok AND (w.last IS NULL OR f.t_ns - w.last >= 1000000000)
        FROM w JOIN f ON f.recording = w.recording AND f.i = w.i + 1)
    SELECT recording, seq, CASE WHEN ok THEN num END AS anchor, created FROM w""", doubles="anchor")
def anchor_every(t):
    """WIN-01: a new anchor on a posed frame at least a second after the last one."""
    rows = t.frames.select("recording", "seq", "t_ns", (F.col("status") != "P").alias("posed"))
    return sq.anchor_every(rows, ["recording"], "seq", "t_ns", "posed")


@query("keyframe_steps", f"""
    WITH RECURSIVE f AS (SELECT recording, seq, x, y, z, 2 * (qx*qz + qy*qw) AS ax, 2 * (qy*qz - qx*qw) AS ay, 1 - 2 * (qx*qx + qy*qy) AS az, {NUMBERED} FROM frames),
    w AS (SELECT recording, seq, i, x, y, z, ax, ay, az, true AS keyframe FROM f WHERE i = 1
        UNION ALL SELECT recording, seq, i, CASE WHEN k THEN fx ELSE x END, CASE WHEN k THEN fy ELSE y END, CASE WHEN k THEN fz ELSE z END, CASE WHEN k THEN bx ELSE ax END, CASE WHEN k THEN by_ ELSE ay END, CASE WHEN k THEN bz ELSE az END, k
        FROM (SELECT f.recording, f.seq, f.i, w.x, w.y, w.z, w.ax, w.ay, w.az, f.x AS fx, f.y AS fy, f.z AS fz, f.ax AS bx, f.ay AS by_, f.az AS bz,
                     sqrt((f.x-w.x)**2 + (f.y-w.y)**2 + (f.z-w.z)**2) >= 1e-1 OR degrees(acos(greatest(-1e0, least(1e0, f.ax*w.ax + f.ay*w.ay + f.az*w.az)))) >= 15 AS k
              FROM w JOIN f ON f.recording = w.recording AND f.i = w.i + 1))
    SELECT recording, seq, keyframe FROM w""")
def keyframe_steps(t):
    """WIN-02: keyframes by distance moved or angle turned since the last one."""
    posed = t.frames.select("recording", "seq", "x", "y", "z", frame_pose().alias("p"))
    rows = posed.select("recording", "seq", "x", "y", "z", *[F.col("p")[i].alias(n) for i, n in ((2, "ax"), (6, "ay"), (10, "az"))])
    return sq.keyframe_steps(rows, ["recording"], "seq")


@query("scale_jumps", f"""
    WITH RECURSIVE f AS (SELECT recording, seq, 1 + (cents % 100) / 200e0 AS s, {NUMBERED} FROM frames),
    w AS (SELECT recording, seq, i, [s] AS kept, true AS accepted FROM f WHERE i = 1
        UNION ALL SELECT recording, seq, i, CASE WHEN a THEN list_append(kept, s) ELSE kept END, a
        FROM (SELECT f.recording, f.seq, f.i, f.s, w.kept, len(w.kept) < 5 OR f.s / list_median(w.kept[-15:]) BETWEEN 1 / 12e-1 AND 12e-1 AS a
              FROM w JOIN f ON f.recording = w.recording AND f.i = w.i + 1))
    SELECT recording, seq, accepted FROM w""")
def scale_jumps(t):
    """WIN-04: scales far from the median of the recently accepted ones are dropped."""
    rows = t.frames.select("recording", "seq", (1 + (F.col("cents") % 100) / 200.0).alias("scale"))
    return sq.scale_jumps(rows, ["recording"], "seq", "scale", 1.2)


@query("gap_segments", f"""
    WITH RECURSIVE f AS (SELECT recording, seq, t_ns + (seq // 40) * 200000000 AS t, cents % 29 <> 0 AS has_depth, cents % 17 <> 0 AS ok, (cents % 71) / 1e3 AS yaw, (cents % 97) / 1e3 AS tx, (cents % 83) / 1e3 AS tz, {NUMBERED} FROM frames),
    w AS (SELECT recording, seq, i, CASE WHEN has_depth THEN t END AS prev, CASE WHEN has_depth THEN 0 ELSE -1 END AS segment, 0e0 AS a, 0e0 AS x, 0e0 AS z, CASE WHEN has_depth THEN 'initialized' ELSE 'failed' END AS status FROM f WHERE i = 1
        UNION ALL SELECT recording, seq, i, CASE status WHEN 'failed' THEN NULL ELSE t END, CASE WHEN status = 'reset' THEN segment + 1 ELSE segment END,
            CASE status WHEN 'reset' THEN 0 WHEN 'tracked' THEN a - yaw ELSE a END,
            CASE status WHEN 'reset' THEN 0 WHEN 'tracked' THEN x + cos(a) * (-(cos(yaw) * tx - sin(yaw) * tz)) + sin(a) * (-(sin(yaw) * tx + cos(yaw) * tz)) ELSE x END,
            CASE status WHEN 'reset' THEN 0 WHEN 'tracked' THEN z - sin(a) * (-(cos(yaw) * tx - sin(yaw) * tz)) + cos(a) * (-(sin(yaw) * tx + cos(yaw) * tz)) ELSE z END, status
        FROM (SELECT f.recording, f.seq, f.i, f.t, f.yaw, f.tx, f.tz, w.segment, w.a, w.x, w.z,
                     CASE WHEN NOT f.has_depth THEN 'failed' WHEN w.prev IS NULL OR (f.t - w.prev) / 1e9 > 1e-1 THEN 'reset' WHEN f.ok THEN 'tracked' ELSE 'failed' END AS status
              FROM w JOIN f ON f.recording = w.recording AND f.i = w.i + 1))
    SELECT recording, seq, status, CASE WHEN status <> 'failed' THEN segment END AS segment, CASE WHEN status <> 'failed' THEN x END AS px, CASE WHEN status <> 'failed' THEN z END AS pz FROM w""", doubles="segment px pz")
def gap_segments(t):
    """WIN-03: segments opened by gaps and failures, poses chained inside each."""
    yaw = (F.col("cents") % 71) / 1e3
    rows = t.frames.select(
        "recording", "seq", (F.col("t_ns") + F.expr("(seq div 40) * 200000000")).alias("t_ns"), (F.col("cents") % 29 != 0).alias("has_depth"),
        (F.col("cents") % 17 != 0).alias("ok"), g.yaw_pose(yaw, (F.col("cents") % 97) / 1e3, F.lit(0.0), (F.col("cents") % 83) / 1e3).alias("motion"),
    )
    chained = sq.gap_segments(rows, ["recording"], "seq", "t_ns", "has_depth", "ok", "motion")
    return chained.select("recording", "seq", "status", "segment", F.col("pose")[3].alias("px"), F.col("pose")[11].alias("pz"))


@query("evenly_spaced", f"""
    WITH f AS (SELECT recording, seq, row_number() OVER (PARTITION BY recording ORDER BY seq) - 1 AS position, count(*) OVER (PARTITION BY recording) AS n FROM frames WHERE status = 'F'),
    p AS (SELECT DISTINCT recording, CAST(CASE WHEN n <= 12 THEN j ELSE round_even(j * ((n - 1) / 11), 0) END AS BIGINT) AS position FROM (SELECT DISTINCT recording, n FROM f), range(0, 12) r(j) WHERE j < n)
    SELECT recording, seq, position FROM f JOIN p USING (recording, position)""")
def evenly_spaced(t):
    """WIN-07: evenly spaced frames with the first and the last."""
    rows = t.frames.where("status = 'F'").select("recording", "seq")
    return sq.evenly_spaced(rows, ["recording"], "seq", 12)


@query("every_nth", """
    SELECT recording, seq FROM (SELECT recording, seq, row_number() OVER (PARTITION BY recording ORDER BY seq) - 1 AS i FROM frames WHERE status = 'F') WHERE i % 7 = 0""")
def every_nth(t):
    """WIN-07: every n-th frame of those that remain."""
    return sq.every_nth(t.frames.where("status = 'F'").select("recording", "seq"), ["recording"], "seq", 7)


@query("time_clip", """
    WITH s AS (SELECT recording, seq, t_ns, min(t_ns) OVER (PARTITION BY recording) AS t0 FROM frames WHERE priority <> '5-LOW'),
    k AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY seq) - 1 AS position FROM s WHERE t_ns - t0 >= 1e9 AND t_ns - t0 < 4e9),
    c AS (SELECT *, t_ns - lag(t_ns) OVER (PARTITION BY recording ORDER BY seq) AS hole FROM k WHERE position < 60),
    h AS (SELECT recording, coalesce(max(hole), 0) > 12e7 AS gap FROM c GROUP BY recording)
    SELECT recording, seq, position, gap FROM c JOIN h USING (recording)""")
def time_clip(t):
    """WIN-07: a capped time span with its holes reported."""
    rows = t.frames.where("priority <> '5-LOW'").select("recording", "seq", "t_ns")
    return sq.time_clip(rows, ["recording"], "seq", "t_ns", 1.0, 3.0, 60, 0.12).select("recording", "seq", "position", "gap")


@query("depth_layers", """
    WITH s AS (SELECT b.image, b.item, m.prow, m.pcol, m.target FROM boxes b JOIN pixel_map m ON m.frame = b.image // 4 AND pcol + 5e-1 >= x1 / 10 AND pcol + 5e-1 < x2 / 10 AND prow + 5e-1 >= y1 / 10 AND prow + 5e-1 < y2 / 10 WHERE b.half = 'O'),
    j AS (SELECT *, CASE WHEN target - lag(target) OVER (PARTITION BY image, item ORDER BY target, prow, pcol) > 5e-1 THEN 1 ELSE 0 END AS j FROM s),
    l AS (SELECT *, sum(j) OVER (PARTITION BY image, item ORDER BY target, prow, pcol) AS layer FROM j)
    SELECT image, item, CAST(layer AS BIGINT) AS layer, count(*) AS samples, min(target) AS near_m, max(target) AS far_m FROM l GROUP BY image, item, layer""", doubles="near_m far_m")
def depth_layers(t):
    """WIN-08: a box's samples split into depth layers."""
    samples = sp.points_in_boxes(t.pixel_map, small_boxes(t), ["frame"], "pcol", "prow").withColumn("at", F.struct("prow", "pcol"))
    layers = sq.depth_layers(samples, ["image", "item"], "target", "at", 0.5)
    return layers.groupBy("image", "item", "layer").agg(
        F.count("*").alias("samples"), F.min("target").alias("near_m"), F.max("target").alias("far_m")
    )


@query("mahalanobis", """
    WITH s AS (SELECT recording, x, y, z FROM points WHERE nx > 0),
    c AS (SELECT recording, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_samp(x, x) + 1e-6 AS a, covar_samp(x, y) AS b, covar_samp(x, z) AS c, covar_samp(y, y) + 1e-6 AS d, covar_samp(y, z) AS e, covar_samp(z, z) + 1e-6 AS f FROM s GROUP BY recording),
    i AS (SELECT *, d*f - e*e AS ia, c*e - b*f AS ib, b*e - c*d AS ic, a*f - c*c AS id, b*c - a*e AS ie, a*d - b*b AS if_, a*(d*f - e*e) - b*(b*f - e*c) + c*(b*e - d*c) AS det FROM c)
    SELECT p.recording, p.point, ((x-mx)**2*ia + (y-my)**2*id + (z-mz)**2*if_ + 2*((x-mx)*(y-my)*ib + (x-mx)*(z-mz)*ic + (y-my)*(z-mz)*ie)) / det AS squared FROM points p JOIN i USING (recording) WHERE nx <= 0""", doubles="squared")
def mahalanobis(t):
    """AGG-41: support covariance and squared distance of a position to it."""
    support = sq.support_summary(t.points.where("nx > 0"), ["recording"])
    rows = t.points.where("nx <= 0").select("recording", "point", "x", "y", "z").join(support, "recording")
    return rows.select("recording", "point", sq.squared_mahalanobis(F.col("x"), F.col("y"), F.col("z")).alias("squared"))


@query("frame_windows", """
    WITH f AS (SELECT recording, seq, row_number() OVER (PARTITION BY recording ORDER BY seq) - 1 AS p, count(*) OVER (PARTITION BY recording) AS n FROM frames WHERE status = 'F'),
    m AS (SELECT *, CASE WHEN n < 12 THEN 0 ELSE p // 12 * 12 END AS w, true AS kept FROM f WHERE n < 12 OR p < n // 12 * 12
          UNION ALL SELECT *, n - 12, p >= n // 12 * 12 FROM f WHERE n >= 12 AND n // 12 * 12 < n AND p >= n - 12)
    SELECT recording, seq, p AS position, w AS "window", kept FROM m""")
def frame_windows(t):
    """WIN-09: fixed-size windows; the short last one moves back; each frame is kept once."""
    return sq.frame_windows(t.frames.where("status = 'F'").select("recording", "seq"), ["recording"], "seq", 12)


@query("strided_windows", """
    WITH f AS (SELECT recording, seq, row_number() OVER (PARTITION BY recording ORDER BY seq) - 1 AS p, count(*) OVER (PARTITION BY recording) AS n FROM frames WHERE status = 'F'),
    b AS (SELECT *, CASE WHEN n >= 12 THEN 12 ELSE 4 END AS b, CASE WHEN n >= 12 THEN 3 ELSE 1 END AS s FROM f),
    m AS (SELECT *, p // b * b + (p - p // b * b) % s AS w, true AS kept, 0 AS part FROM b WHERE n < b OR p < n // b * b
          UNION ALL SELECT *, n - b + (p - (n - b)) % s, p >= n // b * b, 1 FROM b WHERE n >= b AND n // b * b < n AND p >= n - b),
    k AS (SELECT *, bool_or(kept) OVER (PARTITION BY recording, part, w) AS holds FROM m)
    SELECT recording, seq, w AS "window", kept FROM k WHERE holds""")
def strided_windows(t):
    """WIN-09: windows whose members are a stride apart."""
    rows = sq.frame_windows(t.frames.where("status = 'F'").select("recording", "seq"), ["recording"], "seq", 4, stride=3)
    return rows.select("recording", "seq", "window", "kept")


@query("newest_pending", """
    WITH f AS (SELECT recording, seq // 24 AS trigger, seq, cents, status = 'F' AS d FROM frames)
    SELECT recording, trigger, arg_max(seq, (d::INTEGER, seq)) AS seq, arg_max(cents, (d::INTEGER, seq)) AS cents, count(*) AS received FROM f GROUP BY recording, trigger""")
def newest_pending(t):
    """TOP-03: the newest pending frame per trigger, one with new depth first."""
    rows = t.frames.selectExpr("recording", "seq div 24 as trigger", "seq", "cents", "status = 'F' as has_depth")
    return sq.newest_pending(rows, ["recording", "trigger"], "seq", "has_depth", ["cents"])


@query("event_union", """
    SELECT recording, seq, 0 AS rank, 'created' AS kind, seq::DOUBLE AS anchor_id FROM frames WHERE priority = '1-URGENT'
    UNION ALL SELECT recording, seq, 1, 'updated', (seq - cents % 7)::DOUBLE FROM frames WHERE priority = '2-HIGH' UNION ALL SELECT recording, seq, 2, 'frame', NULL FROM frames""", doubles="anchor_id")
def event_union(t):
    """SET-01: anchor and frame events in one ordered stream."""
    return sq.event_stream(t.frames, anchor_tables(t))


@query("method_inputs", "SELECT doc_id, lang, n_chars FROM documents JOIN labels USING (doc_id)")
def method_inputs(t):
    """SET-02: the columns a method may see, without the evaluator's labels."""
    manifest = t.documents.join(t.labels, "doc_id")
    return sq.method_inputs(manifest, ["doc_id", "lang", "n_chars"])


@query("box_median", """
    WITH s AS (SELECT b.image, b.item, (pcol - 315e-1) * target / 5e1 AS x, (prow - 235e-1) * target / 5e1 AS y, target AS z, b.x1, b.x2, b.y1, b.y2, prow, pcol FROM boxes b JOIN pixel_map m ON m.frame = b.image // 4
        AND pcol + 5e-1 >= x1 / 10 AND pcol + 5e-1 < x2 / 10 AND prow + 5e-1 >= y1 / 10 AND prow + 5e-1 < y2 / 10 WHERE b.half = 'O')
    SELECT image, item, count(*) AS samples, quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my, quantile_cont(z, 0.5) AS mz, quantile_cont(z, 0.75) - quantile_cont(z, 0.25) AS iqr_z,
           min(z) AS near_m, max(z) AS far_m, arg_min(z, ((pcol + 5e-1 - (x1 / 10 + x2 / 10) / 2)**2 + (prow + 5e-1 - (y1 / 10 + y2 / 10) / 2)**2, prow, pcol)) AS centre_m FROM s GROUP BY image, item""", doubles="mx my mz iqr_z near_m far_m centre_m")
def box_median(t):
    """AGG-09: coordinate-wise median, spread and centre sample of the surface inside a box."""
    from .scalars import intrinsics

    rows = sp.points_in_boxes(t.pixel_map, small_boxes(t), ["frame"], "pcol", "prow")
    local = g.back_project(F.col("pcol"), F.col("prow"), F.col("target"), intrinsics())
    rows = rows.withColumns(dict(zip("xyz", local)))
    keys = ["image", "item"]
    dx, dy = F.col("pcol") + 0.5 - (F.col("x1") + F.col("x2")) / 2, F.col("prow") + 0.5 - (F.col("y1") + F.col("y2")) / 2
    # a box holds at most the pixels of its image, so its quantiles come from one aggregate
    found = rows.where("z is not null").groupBy(*keys).agg(
        F.count("*").alias("samples"), F.percentile("x", F.lit(0.5)).alias("mx"), F.percentile("y", F.lit(0.5)).alias("my"),
        F.percentile("z", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_z"),
        F.min("z").alias("near_m"), F.max("z").alias("far_m"), F.min_by("z", F.struct(dx * dx + dy * dy, F.col("prow"), F.col("pcol"))).alias("centre_m"),
    )
    return found.select(
        *keys, "samples", "mx", "my", F.col("_z")[1].alias("mz"), (F.col("_z")[2] - F.col("_z")[0]).alias("iqr_z"), "near_m", "far_m", "centre_m"
    )


@query("centre_depth", """
    WITH k AS (SELECT image, item, x1 / 10 AS x1, y1 / 10 AS y1, x2 / 10 AS x2, y2 / 10 AS y2 FROM boxes WHERE half = 'O'),
    b AS (SELECT image, item, x1 + (x2 - x1) / 4 AS x1, y1 + (y2 - y1) / 4 AS y1, x2 - (x2 - x1) / 4 AS x2, y2 - (y2 - y1) / 4 AS y2 FROM k),
    s AS (SELECT b.image, b.item, any_value((x2 - x1) * (y2 - y1)) AS area, count(m.target) AS n, quantile_cont(target, 0.5) AS median_m, quantile_cont(target, 0.25) AS q1, quantile_cont(target, 0.75) AS q3 FROM b LEFT JOIN pixel_map m ON m.frame = b.image // 4
        AND pcol + 5e-1 >= x1 AND pcol + 5e-1 < x2 AND prow + 5e-1 >= y1 AND prow + 5e-1 < y2 GROUP BY b.image, b.item)
    SELECT image, item, n AS valid_pixels, median_m, (q3 - q1) / median_m AS spread, n < 3 OR n / area < 5e-2 AS flag_sparse, coalesce((q3 - q1) / median_m > 5e-1, false) AS flag_spread FROM s""", doubles="median_m spread")
def centre_depth(t):
    """AGG-10: median depth of a box's central half with sparse and spread flags."""
    quarter_w, quarter_h = (F.col("x2") - F.col("x1")) / 4, (F.col("y2") - F.col("y1")) / 4
    inner = small_boxes(t).select(
        "image", "frame", "item", (F.col("x1") + quarter_w).alias("x1"), (F.col("y1") + quarter_h).alias("y1"),
        (F.col("x2") - quarter_w).alias("x2"), (F.col("y2") - quarter_h).alias("y2"),
    )
    rows = sp.points_in_boxes(t.pixel_map, inner, ["frame"], "pcol", "prow")
    keys = ["image", "item"]
    quartiles = F.percentile("target", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    found = rows.where("target is not null").groupBy(*keys).agg(F.count("*").alias("_n"), quartiles.alias("_q")).select(
        *keys, "_n", F.col("_q")[0].alias("_q1"), F.col("_q")[1].alias("median_m"), F.col("_q")[2].alias("_q3")
    )
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    joined = inner.select(*keys, area.alias("_area")).join(found, keys, "left")
    n, spread = F.coalesce("_n", F.lit(0)), (F.col("_q3") - F.col("_q1")) / F.col("median_m")
    return joined.select(
        *keys, n.alias("valid_pixels"), "median_m", spread.alias("spread"), ((n < 3) | (n / F.col("_area") < 0.05)).alias("flag_sparse"),
        F.coalesce(spread > 0.5, F.lit(False)).alias("flag_spread"),
    )
