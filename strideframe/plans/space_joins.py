"""Queries over spatial and image-plane joins."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import boxes as b
from ..functions import geometry as g
from ..operators import pieces as pc
from ..operators import pixels as px
from ..operators import spatial as sp
from ..operators import vote
from .registry import query
from .scalars import HEIGHT, K, PIXEL_WORLD_SQL, WIDTH, intrinsics, view_pose

DIST = "sqrt((a.x-c.x)**2 + (a.y-c.y)**2 + (a.z-c.z)**2)"


def halves(t):
    """Points split by the sign of one descriptor value: seen now, and known before."""
    return t.points.where("nx <= 0"), t.points.where("nx > 0").withColumnRenamed("point", "ref")


@query("nearest_neighbour", f"""
    WITH d AS (SELECT a.point, c.point AS ref, {DIST} AS d FROM points a, points c WHERE a.nx <= 0 AND c.nx > 0)
    SELECT point, arg_min(ref, (d, ref)) AS ref, min(d) AS distance FROM d GROUP BY point""", doubles="distance")
def nearest_neighbour(t):
    """JOIN-14: exact nearest neighbour in 3D."""
    a, c = halves(t)
    return sp.nearest_k(a, c, "point", "ref").select("point", "ref", "distance")


@query("same_class_within", f"""
    WITH d AS (SELECT a.recording, a.point, c.point AS ref, {DIST} AS d FROM points a LEFT JOIN points c ON c.recording = a.recording AND c.nx > 0 WHERE a.nx <= 0),
    n AS (SELECT recording, point, count(*) FILTER (WHERE d <= 35e-2) AS candidates, min(d) AS nearest_m FROM d GROUP BY recording, point),
    k AS (SELECT recording, point, row_number() OVER (PARTITION BY recording, point ORDER BY d, ref) AS place, ref, d AS distance FROM d WHERE d <= 35e-2)
    SELECT n.recording, n.point, candidates, nearest_m, place, ref, distance FROM n LEFT JOIN k ON k.recording = n.recording AND k.point = n.point""", doubles="nearest_m place ref distance")
def same_class_within(t):
    """JOIN-06: same-class objects within reach, nearest first, and the distance to the nearest one; a row for a point without any too."""
    a, c = halves(t)
    own = ["recording", "point"]
    near = sp.nearest_k(a, c, "point", "ref", keys=["recording"]).select(*own, F.col("distance").alias("nearest_m"))
    mine = Window.partitionBy(*own)
    pairs = sp.pairs_within(a, c, "point", "ref", 0.35, keys=["recording"]).withColumns({
        "place": F.row_number().over(mine.orderBy("distance", "ref")), "candidates": F.count("*").over(mine),
    })
    return a.select(*own).join(near, own, "left").join(pairs, own, "left").select(
        *own, F.coalesce("candidates", F.lit(0)).alias("candidates"), "nearest_m", "place", "ref", "distance"
    )


@query("support_distance", f"""
    WITH d AS (SELECT a.recording, a.point, c.point AS ref, {DIST} AS d FROM points a JOIN points c ON c.recording = a.recording AND c.nx > 0 WHERE a.nx <= 0),
    f AS (SELECT recording, quantile_cont(m, 0.5) AS v FROM (SELECT recording, point, min(d) AS m FROM d GROUP BY ALL) GROUP BY recording),
    r AS (SELECT recording, quantile_cont(m, 0.5) AS v FROM (SELECT recording, ref, min(d) AS m FROM d GROUP BY ALL) GROUP BY recording)
    SELECT recording, greatest(f.v, r.v) AS support_distance FROM f JOIN r USING (recording)""", doubles="support_distance")
def support_distance(t):
    """JOIN-15: symmetric median nearest-sample distance between two supports."""
    a, c = halves(t)
    return sp.support_distance(a, c, ["recording"], "point", "ref")


@query("sight_lines", """
    WITH l AS (SELECT point AS line, x, y, z, sqrt(x*x + y*y + z*z) AS len FROM points),
    s AS (SELECT line, x, y, z, len, unnest(range(0, greatest(CAST(ceil((len - greatest(15e-2, 5e-2 * len) - 3e-1) / 4e-2) AS BIGINT), 0))) AS i FROM l),
    p AS (SELECT line, i, (3e-1 + i * 4e-2) * x / len AS x, (3e-1 + i * 4e-2) * y / len AS y, (3e-1 + i * 4e-2) * z / len AS z FROM s),
    h AS (SELECT DISTINCT a.line, a.i FROM p a JOIN points c ON (a.x-c.x)**2 + (a.y-c.y)**2 + (a.z-c.z)**2 <= 225e-4)
    SELECT l.line, (SELECT count(*) FROM p WHERE p.line = l.line) AS samples, (SELECT count(*) FROM h WHERE h.line = l.line) AS blocked FROM l""")
def sight_lines(t):
    """JOIN-16: samples along each line of sight that meet surface before the point."""
    lines = t.points.select(F.col("point").alias("line"), "x", "y", "z", *[F.lit(0.0).alias(f"o{c}") for c in "xyz"])
    return sp.sight_line_hits(lines, t.points, "line", "point", radius=0.15)


@query("points_in_boxes", """
    SELECT b.image, b.item, count(*) AS pixels, sum(p.target) AS depth_sum FROM boxes b JOIN pixels p ON p.frame = b.image // 4
      AND pcol + 5e-1 >= x1 / 10 AND pcol + 5e-1 < x2 / 10 AND prow + 5e-1 >= y1 / 10 AND prow + 5e-1 < y2 / 10
    WHERE b.half = 'O' GROUP BY b.image, b.item""", doubles="depth_sum")
def points_in_boxes(t):
    """JOIN-17: pixels inside the boxes of their frame."""
    rows = sp.points_in_boxes(t.pixels, small_boxes(t), ["frame"], "pcol", "prow")
    return rows.groupBy("image", "item").agg(F.count("*").alias("pixels"), F.sum("target").alias("depth_sum"))


def small_boxes(t):
    """Detections on the 64 x 48 pixel grid of their frame."""
    return t.boxes.where("half = 'O'").selectExpr(
        "image", "image div 4 as frame", "item", "cls", "confidence", "x1 / 10 as x1", "y1 / 10 as y1", "x2 / 10 as x2", "y2 / 10 as y2"
    )


@query("survivors", """
    WITH d AS (SELECT a.point, c.point AS raw, c.nx > 0 AS kept, sqrt((a.x+1e-2-c.x)**2 + (a.y-c.y)**2 + (a.z-c.z)**2) AS d FROM points a, points c)
    SELECT point, arg_min(kept, (d, raw)) AS shown FROM d GROUP BY point""")
def survivors(t):
    """JOIN-18: points whose nearest raw point was kept."""
    raw = t.points.withColumnRenamed("point", "raw")
    moved = t.points.select("point", (F.col("x") + 0.01).alias("x"), "y", "z")
    return pc.survivors(moved, raw, raw.where("nx > 0"), "point", "raw").select("point", "shown")


@query("survivor_cells", """
    WITH o AS (SELECT recording, min(x) - 25e-2 AS ox, min(y) - 25e-2 AS oy, min(z) - 25e-2 AS oz FROM points GROUP BY recording)
    SELECT recording, CAST(floor((x - ox) / 5e-1) AS BIGINT) AS ix, CAST(floor((y - oy) / 5e-1) AS BIGINT) AS iy, CAST(floor((z - oz) / 5e-1) AS BIGINT) AS iz,
           count(*) AS points, count(*) FILTER (WHERE nx <= 0) AS gone, count(*) FILTER (WHERE nx <= 0) > count(*) / 2 AS removed
    FROM points JOIN o USING (recording) GROUP BY ALL""")
def survivor_cells(t):
    """JOIN-18: display cells most of whose points were removed."""
    return pc.removed_cells(t.points, "recording", 0.5, F.col("nx") <= 0)


@query("face_cameras", """
    WITH d AS (SELECT p.point, v.frame, v.tx, v.ty, p.x, p.y, p.z, p.nx, p.ny, p.nz, (p.x-v.tx)**2 + (p.y-v.ty)**2 + p.z**2 AS d FROM points p, views v),
    n AS (SELECT point, arg_min(frame, (d, frame)) AS camera FROM d GROUP BY point)
    SELECT point, camera, CASE WHEN (tx-x)*nx + (ty-y)*ny - z*nz < 0 THEN -nx ELSE nx END AS fx, CASE WHEN (tx-x)*nx + (ty-y)*ny - z*nz < 0 THEN -nz ELSE nz END AS fz
    FROM n JOIN d USING (point) WHERE d.frame = n.camera""", doubles="fx fz")
def face_cameras(t):
    """JOIN-22: normals turned to the nearest camera."""
    cameras = t.views.select(F.col("frame").alias("camera"), F.col("tx").alias("x"), F.col("ty").alias("y"), F.lit(0.0).alias("z"))
    near = sp.nearest_k(t.points, cameras, "point", "camera")
    rows = t.points.join(near, "point").join(cameras.select("camera", *[F.col(c).alias(f"c{c}") for c in "xyz"]), "camera")
    facing = g.dot(g.minus(g.columns("cx", "cy", "cz"), g.columns("x", "y", "z")), g.columns("nx", "ny", "nz"))
    turn = F.when(facing < 0, -1.0).otherwise(1.0)
    return rows.select("point", "camera", (turn * F.col("nx")).alias("fx"), (turn * F.col("nz")).alias("fz"))



@query("iou_pairs", """
    WITH p AS (SELECT a.image, a.item, c.item AS ref, (a.x2-a.x1)*(a.y2-a.y1) AS sa, (c.x2-c.x1)*(c.y2-c.y1) AS sc,
            greatest(least(a.x2, c.x2) - greatest(a.x1, c.x1), 0) * greatest(least(a.y2, c.y2) - greatest(a.y1, c.y1), 0) AS s
        FROM boxes a JOIN boxes c ON a.image = c.image AND a.cls = c.cls AND a.half = 'O' AND c.half = 'F')
    SELECT image, item, ref, s / (sa + sc - s) AS iou FROM p WHERE s / (sa + sc - s) >= 3e-1""", doubles="iou")
def iou_pairs(t):
    """JOIN-09: detections and references of one class whose boxes overlap enough."""
    found, known = t.boxes.where("half = 'O'"), t.boxes.where("half = 'F'").select("image", "cls", "item", "x1", "y1", "x2", "y2")
    pairs = sp.box_pairs(found, known, ["image", "cls"], "item")
    pairs = pairs.withColumn("iou", b.iou(b.box(), b.box("r_"))).where("iou >= 0.3")
    return pairs.select("image", "item", F.col("r_item").alias("ref"), "iou")


@query("duplicate_suspects", """
    WITH p AS (SELECT a.image, a.item, c.item AS other, abs(a.price - c.price) / 1e6 AS gap, (a.x2-a.x1)*(a.y2-a.y1) AS sa, (c.x2-c.x1)*(c.y2-c.y1) AS sc,
            greatest(least(a.x2, c.x2) - greatest(a.x1, c.x1), 0) * greatest(least(a.y2, c.y2) - greatest(a.y1, c.y1), 0) AS s
        FROM boxes a JOIN boxes c ON a.image = c.image AND a.cls = c.cls AND a.item < c.item)
    SELECT image, item, other, s / (sa + sc - s) AS iou FROM p WHERE s / (sa + sc - s) >= 6e-1 AND gap <= 2e-2""", doubles="iou")
def duplicate_suspects(t):
    """JOIN-09: two detections of one class on nearly the same box and position."""
    rows = t.boxes.select("image", "cls", "item", "x1", "y1", "x2", "y2", "price")
    pairs = sp.box_pairs(rows, rows, ["image", "cls"], "item").where("item < r_item")
    pairs = pairs.withColumn("iou", b.iou(b.box(), b.box("r_")))
    return pairs.where((F.col("iou") >= 0.6) & (F.abs(F.col("price") - F.col("r_price")) / 1e6 <= 0.02)).select(
        "image", "item", F.col("r_item").alias("other"), "iou"
    )


@query("crowd_absorbed", """
    SELECT DISTINCT a.image, a.item FROM boxes a JOIN boxes c ON a.image = c.image AND a.cls = c.cls AND a.half = 'O' AND c.half = 'F' AND c.confidence > 7e-1
    WHERE greatest(least(a.x2, c.x2) - greatest(a.x1, c.x1), 0) * greatest(least(a.y2, c.y2) - greatest(a.y1, c.y1), 0) / ((a.x2-a.x1)*(a.y2-a.y1)) >= 5e-1""")
def crowd_absorbed(t):
    """JOIN-10: detections mostly inside a same-class crowd region."""
    found = t.boxes.where("half = 'O'").select("image", "cls", "item", "x1", "y1", "x2", "y2")
    crowds = t.boxes.where("half = 'F' and confidence > 0.7").select("image", "cls", "item", "x1", "y1", "x2", "y2")
    return crowd_inside(found, crowds, 0.5).select("image", "item")


def crowd_inside(found, crowds, threshold):
    pairs = sp.box_pairs(found, crowds, ["image", "cls"], "item")
    inside = pairs.where(b.intersection(b.box(), b.box("r_")) / b.area(b.box()) >= threshold)
    return inside.select("image", "cls", "item").distinct()


SEEN_SQL = f"""{PIXEL_WORLD_SQL},
    cam AS (SELECT w.recording, w.sample AS point, w.wx AS x, w.wy AS y, w.wz AS z, v.frame, tx, ty, yaw,
                   cos(yaw) * (wx - tx) - sin(yaw) * wz AS cx, wy - ty AS cy, sin(yaw) * (wx - tx) + cos(yaw) * wz AS cz
            FROM (SELECT recording, frame * 1000000000000000 + sample AS sample, wx, wy, wz FROM world) w JOIN views v ON v.recording = w.recording),
    pix AS (SELECT *, CAST(round_even(cx / cz * 5e1 + 315e-1, 0) AS BIGINT) AS pcol, CAST(round_even(cy / cz * 5e1 + 235e-1, 0) AS BIGINT) AS prow FROM cam WHERE cz > 1e-1 AND cz <= 84e-1),
    seen AS (SELECT p.recording, p.point, p.x, p.y, p.z, p.frame, p.tx, p.ty, p.cz, m.target AS measured, greatest(8e-2, 5e-2 * m.target) AS margin
             FROM pix p JOIN pixel_map m ON m.recording = p.recording AND m.frame = p.frame AND m.prow = p.prow AND m.pcol = p.pcol WHERE m.target > 0 AND m.target < 8)"""


def point_id(frame, sample):
    """frame * 10**15 + sample in 64 bits that wrap around, where a checked product would fail from frame 9,224 on.

    A recording's frames follow one another and samples stay below 10**15, so ids stay unique in a recording.
    """
    # 10**15 is 5**15 * 2**15: the shift drops what leaves the word, the low 15 bits come from the sample alone
    high = F.shiftleft(frame * 5**15 + F.shiftright(sample, 15), 15)
    return high.bitwiseOR(sample.bitwiseAND(F.lit(2**15 - 1)))


def surface_of(t):
    """Every depth pixel as a world point with an id that is unique in its recording."""
    views = t.views.withColumn("pose", view_pose())
    world = px.world_points(t.spread(t.pixels), views, "target", intrinsics())
    return world.select(
        "recording", point_id(F.col("frame"), F.col("sample")).alias("point"),
        F.col("wx").alias("x"), F.col("wy").alias("y"), F.col("wz").alias("z"),
    )


def posed_views(t):
    return t.views.select("recording", "frame", view_pose().alias("pose"))


def seen_of(t, points):
    return vote.seen_points(points, posed_views(t), t.pixel_map, "target", K, HEIGHT, WIDTH, counted=t.pixels)


@query("pixel_lookup", f"""
    WITH {SEEN_SQL} SELECT recording, frame, count(*) AS lookups, sum(cz) AS z_sum, sum(measured) AS measured_sum FROM seen GROUP BY recording, frame""", doubles="z_sum measured_sum")
def pixel_lookup(t):
    """JOIN-11: surface points looked up in every view's depth map."""
    return seen_of(t, surface_of(t)).groupBy("recording", "frame").agg(
        F.count("*").alias("lookups"), F.sum("camera_z").alias("z_sum"), F.sum("measured").alias("measured_sum")
    )


@query("visibility_vote", f"""
    WITH {SEEN_SQL},
    v AS (SELECT recording, point, sum(CASE WHEN abs(cz - measured) <= margin THEN 1 / greatest(measured, 5e-1)**2 ELSE 0 END) AS support,
                 sum(CASE WHEN cz < measured - margin THEN 1 / greatest(measured, 5e-1)**2 ELSE 0 END) AS against FROM seen GROUP BY ALL)
    SELECT w.recording, w.frame * 1000000000000000 + w.sample AS point, coalesce(support, 0) AS support, coalesce(against, 0) AS against, coalesce(support >= against, true) AS voted
    FROM world w LEFT JOIN v ON v.recording = w.recording AND v.point = w.frame * 1000000000000000 + w.sample""", doubles="support against")
def visibility_vote(t):
    """AGG-07: weighted support and see-through opposition of every surface point."""
    points = surface_of(t)
    return vote.visibility_vote(points, vote.vote_tallies(seen_of(t, points))).select("recording", "point", "support", "against", "voted")


@query("view_evidence", f"""
    WITH {SEEN_SQL},
    g AS (SELECT *, sqrt((tx-x)**2 + (ty-y)**2 + z**2) AS n FROM seen WHERE abs(cz - measured) <= margin),
    f AS (SELECT recording, point, count(*) AS views_n, min(measured) AS nearest_m, arg_min((tx-x)/n, frame) AS fx, arg_min((ty-y)/n, frame) AS fy, arg_min(-z/n, frame) AS fz FROM g GROUP BY ALL),
    a AS (SELECT g.recording, g.point, degrees(acos(least(greatest((tx-x)/n*fx + (ty-y)/n*fy - z/n*fz, -1e0), 1e0))) AS angle FROM g JOIN f USING (recording, point)),
    r AS (SELECT *, row_number() OVER (PARTITION BY recording, point ORDER BY angle DESC) AS k FROM a)
    SELECT f.recording, f.point, f.views_n AS measuring, f.nearest_m, CASE WHEN coalesce(r.angle, 0) > 1e-4 THEN r.angle ELSE 0 END AS second_deg,
           f.nearest_m < 25e-1 OR coalesce(r.angle, 0) >= 3 AS wide FROM f LEFT JOIN r ON r.recording = f.recording AND r.point = f.point AND r.k = 2""", doubles="nearest_m second_deg")
def view_evidence(t):
    """AGG-08: views measuring a point, its nearest measured depth and second-widest viewing angle."""
    rows = vote.view_evidence(seen_of(t, surface_of(t)))
    second = F.when(F.col("second_angle_deg") > 1e-4, F.col("second_angle_deg")).otherwise(0.0)
    return rows.select(
        "recording", "point", F.col("views").alias("measuring"), "nearest_m", second.alias("second_deg"),
        vote.wide_support(F.col("nearest_m"), F.col("second_angle_deg")).alias("wide"),
    )


@query("fleet_sight_lines", """
    WITH l AS (SELECT recording, point AS line, x, y, z, sqrt(x*x + y*y + z*z) AS len FROM points),
    s AS (SELECT *, unnest(range(0, greatest(CAST(ceil((len - greatest(15e-2, 5e-2 * len) - 3e-1) / 4e-2) AS BIGINT), 0))) AS i FROM l),
    p AS (SELECT recording, line, i, (3e-1 + i * 4e-2) * x / len AS x, (3e-1 + i * 4e-2) * y / len AS y, (3e-1 + i * 4e-2) * z / len AS z FROM s),
    h AS (SELECT DISTINCT a.recording, a.line, a.i FROM p a JOIN points c ON a.recording = c.recording AND (a.x-c.x)**2 + (a.y-c.y)**2 + (a.z-c.z)**2 <= 225e-4),
    n AS (SELECT recording, line, count(*) AS samples FROM p GROUP BY ALL), m AS (SELECT recording, line, count(*) AS blocked FROM h GROUP BY ALL)
    SELECT recording, line, coalesce(samples, 0) AS samples, coalesce(blocked, 0) AS blocked FROM l LEFT JOIN n USING (recording, line) LEFT JOIN m USING (recording, line)""")
def fleet_sight_lines(t):
    """JOIN-16: sight lines of many recordings, each against the surface of its own."""
    lines = t.points.select("recording", F.col("point").alias("line"), "x", "y", "z", *[F.lit(0.0).alias(f"o{c}") for c in "xyz"])
    return sp.sight_line_hits(lines, t.points, "line", "point", radius=0.15, keys=["recording"])


@query("fleet_survivors", """
    WITH d AS (SELECT a.recording, a.point, c.point AS raw, c.nx > 0 AS kept, sqrt((a.x+1e-2-c.x)**2 + (a.y-c.y)**2 + (a.z-c.z)**2) AS d
               FROM points a JOIN points c USING (recording))
    SELECT recording, point, arg_min(kept, (d, raw)) AS shown FROM d GROUP BY recording, point""")
def fleet_survivors(t):
    """JOIN-18: points whose nearest raw point of the same recording was kept."""
    raw = t.points.withColumnRenamed("point", "raw")
    moved = t.points.select("recording", "point", (F.col("x") + 0.01).alias("x"), "y", "z")
    return pc.survivors(moved, raw, raw.where("nx > 0"), "point", "raw", ["recording"]).select("recording", "point", "shown")


@query("fleet_cameras", """
    WITH v AS (SELECT frame % 10 AS recording, frame, tx, ty FROM views), q AS (SELECT recording % 10 AS recording, point, x, y, z, nx, ny, nz FROM points),
    d AS (SELECT q.*, frame, tx, ty, (x-tx)**2 + (y-ty)**2 + z**2 AS d FROM q JOIN v USING (recording)),
    n AS (SELECT recording, point, arg_min(frame, (d, frame)) AS camera FROM d GROUP BY ALL)
    SELECT recording, point, camera, CASE WHEN (tx-x)*nx + (ty-y)*ny - z*nz < 0 THEN -nx ELSE nx END AS fx, CASE WHEN (tx-x)*nx + (ty-y)*ny - z*nz < 0 THEN -nz ELSE nz END AS fz
    FROM n JOIN d USING (recording, point) WHERE d.frame = n.camera""", doubles="fx fz")
def fleet_cameras(t):
    """JOIN-22: normals turned to the nearest camera of the same recording; views are dealt to ten recordings."""
    cameras = t.views.select((F.col("frame") % 10).alias("recording"), F.col("frame").alias("camera"), F.col("tx").alias("x"), F.col("ty").alias("y"), F.lit(0.0).alias("z"))
    points = t.points.withColumn("recording", F.col("recording") % 10)
    rows = sp.turned_to_cameras(points, cameras, "point", "camera", ["recording"])
    return rows.select("recording", "point", "camera", F.col("nx").alias("fx"), F.col("nz").alias("fz"))
