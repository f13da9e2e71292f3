"""Queries over projections, geometry scalars and predicates."""

from pyspark.sql import functions as F

from ..functions import boxes as b
from ..functions import geometry as g
from ..functions import vectors as v
from ..functions.pin import pinned
from ..operators import pixels as px
from ..operators import scale
from ..operators.timejoin import last_anchor, latest_anchor_poses
from .registry import query

# image size and camera of the pixel tables, fixed by the bindings
WIDTH, HEIGHT = 64, 48
K = (50.0, 50.0, 31.5, 23.5)
POSE = [f"r{i}{j}" if j < 3 else f"t{i}" for i in range(3) for j in range(4)]
ROTATION_SQL = """
    1 - 2 * (qy*qy + qz*qz) AS r00, 2 * (qx*qy - qz*qw) AS r01, 2 * (qx*qz + qy*qw) AS r02,
    2 * (qx*qy + qz*qw) AS r10, 1 - 2 * (qx*qx + qz*qz) AS r11, 2 * (qy*qz - qx*qw) AS r12,
    2 * (qx*qz - qy*qw) AS r20, 2 * (qy*qz + qx*qw) AS r21, 1 - 2 * (qx*qx + qy*qy) AS r22"""


def intrinsics():
    return [F.lit(c) for c in K]


def frame_pose(prefix: str = ""):
    return g.pose_from_quaternion(
        [F.col(prefix + n) for n in ("x", "y", "z")], [F.col(prefix + n) for n in ("qx", "qy", "qz", "qw")]
    )


def view_pose():
    """World-from-camera of a pixel frame's view, from the columns tx, ty and yaw."""
    return g.yaw_pose(F.col("yaw"), F.col("tx"), F.col("ty"), F.lit(0.0))


@query("quat_to_matrix", f"""
    WITH m AS (SELECT recording, seq, x, y, z, {ROTATION_SQL} FROM frames)
    SELECT recording, seq, r00, -r01 AS r01, -r02 AS r02, x AS t0, r10, -r11 AS r11, -r12 AS r12, y AS t1,
           r20, -r21 AS r21, -r22 AS r22, z AS t2 FROM m""", doubles=" ".join(POSE))
def quat_to_matrix(t):
    """GEO-01: quaternion pose to a camera-to-world matrix in OpenCV axes."""
    posed = t.frames.withColumn("p", frame_pose()).withColumn("p", g.opencv_axes(F.col("p")))
    return posed.select("recording", "seq", *[F.col("p")[i].alias(n) for i, n in enumerate(POSE)])


@query("rigid_transform", f"""
    WITH m AS (SELECT recording, seq, x, y, z, {ROTATION_SQL} FROM frames),
    n AS (SELECT recording, seq - 1 AS seq, x AS bx, y AS by_, z AS bz FROM frames)
    SELECT recording, seq, r00*1e0 + r01*2e0 + r02*3e0 + x AS wx, r10*1e0 + r11*2e0 + r12*3e0 + y AS wy,
           r20*1e0 + r21*2e0 + r22*3e0 + z AS wz,
           r00*(bx-x) + r10*(by_-y) + r20*(bz-z) AS rel_x, r01*(bx-x) + r11*(by_-y) + r21*(bz-z) AS rel_y,
           r02*(bx-x) + r12*(by_-y) + r22*(bz-z) AS rel_z, true AS proper
    FROM m JOIN n USING (recording, seq)""", doubles="wx wy wz rel_x rel_y rel_z")
def rigid_transform(t):
    """GEO-02: points moved by a pose, relative pose of the next frame, and the proper-rotation check."""
    frames = pinned(t.frames.select("recording", "seq", "x", "y", "z", "qx", "qy", "qz", "qw"), {"p": frame_pose()}).select("recording", "seq", "p")
    following = frames.select("recording", (F.col("seq") - 1).alias("seq"), F.col("p").alias("q"))
    both = pinned(frames.join(following, ["recording", "seq"]), {"back": g.inverse(F.col("p"))})
    both = pinned(both, {"rel": g.compose(F.col("back"), F.col("q"))})
    moved = g.transform(F.col("p"), [F.lit(1.0), F.lit(2.0), F.lit(3.0)])
    r = g.rotation_of(F.col("p"))
    determinant = g.dot(r[0:3], g.cross(r[3:6], r[6:9]))
    return both.select(
        "recording", "seq", *[c.alias(n) for n, c in zip(("wx", "wy", "wz"), moved)],
        *[F.col("rel")[i].alias(n) for n, i in (("rel_x", 3), ("rel_y", 7), ("rel_z", 11))],
        (F.abs(determinant - 1) <= 1e-5).alias("proper"),
    )


@query("up_to_y", """
    WITH u AS (SELECT point, x, y, z, sqrt(x*x + y*y + z*z) AS n FROM points)
    SELECT point, 1 - (x/n)*(x/n)/(1 + y/n) AS r00, -(x/n) AS r01, z/n AS r12, 1 - (z/n)*(z/n)/(1 + y/n) AS r22,
           n AS turned_y FROM u""", doubles="r00 r01 r12 r22 turned_y")
def up_to_y(t):
    """GEO-03: the rotation that brings an up axis to +y."""
    up = g.columns("x", "y", "z")
    rows = t.points.withColumn("r", F.array(*g.up_rotation(up)))
    r = [F.col("r")[i] for i in range(9)]
    return rows.select(
        "point", r[0].alias("r00"), r[1].alias("r01"), r[5].alias("r12"), r[8].alias("r22"),
        g.rotate(r, up)[1].alias("turned_y"),
    )


def anchor_tables(t):
    """Anchors of the frame bindings: urgent frames create one, high-priority frames correct an earlier one."""
    frames = t.frames
    created = frames.where("priority = '1-URGENT'").select(
        "recording", "seq", F.col("seq").alias("anchor_id"), F.lit("created").alias("kind"),
        F.array("x", "y", "z").alias("pose"),
    )
    corrected = frames.where("priority = '2-HIGH'").select(
        "recording", "seq", (F.col("seq") - F.col("cents") % 7).alias("anchor_id"), F.lit("updated").alias("kind"),
        F.array(F.col("x") + 0.5, F.col("y"), F.col("z")).alias("pose"),
    )
    return created.unionByName(corrected)


ANCHOR_SQL = """anchors AS (
        SELECT recording, seq, seq AS anchor_id, 0 AS kind, x AS ax, y AS ay, z AS az FROM frames WHERE priority = '1-URGENT'
        UNION ALL SELECT recording, seq, seq - cents % 7, 1, x + 5e-1, y, z FROM frames WHERE priority = '2-HIGH'),
    known AS (SELECT a.* FROM anchors a JOIN anchors c ON c.recording = a.recording AND c.anchor_id = a.anchor_id
              AND c.kind = 0 AND a.seq >= c.seq),
    latest AS (SELECT recording, anchor_id, arg_max(ax, seq * 2 + kind) AS ax, arg_max(ay, seq * 2 + kind) AS ay,
                      arg_max(az, seq * 2 + kind) AS az, count(*) AS events FROM known GROUP BY recording, anchor_id),
    keyed AS (SELECT f.recording, f.seq, f.x, f.y, f.z, max(c.anchor_id) AS keyframe FROM frames f
              LEFT JOIN (SELECT * FROM anchors WHERE kind = 0) c ON c.recording = f.recording AND c.seq <= f.seq
              GROUP BY f.recording, f.seq, f.x, f.y, f.z)"""


@query("corrected_pose", f"""
    WITH {ANCHOR_SQL}
    SELECT k.recording, k.seq, k.keyframe, l.ax - c.ax + k.x AS wx, l.ay - c.ay + k.y AS wy, l.az - c.az + k.z AS wz
    FROM keyed k JOIN latest l ON l.recording = k.recording AND l.anchor_id = k.keyframe
    JOIN anchors c ON c.recording = k.recording AND c.anchor_id = k.keyframe AND c.kind = 0""", doubles="wx wy wz")
def corrected_pose(t):
    """GEO-04: frame pose moved by its keyframe anchor's correction (unit rotations: translations compose)."""
    anchors = anchor_tables(t)
    unit = [F.lit(c) for c in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)]
    as_pose = lambda c: g.pose(unit, [F.col(c)[i] for i in range(3)])
    frames = t.frames.select("recording", "seq", F.array("x", "y", "z").alias("xyz"))
    keyed = last_anchor(frames, anchors, ["recording"], "seq").where("keyframe is not null")
    now = latest_anchor_poses(anchors, ["recording"], "seq")
    then = anchors.where("kind = 'created'").select("recording", "anchor_id", F.col("pose").alias("pose_then"))
    rows = keyed.withColumnRenamed("keyframe", "anchor_id").join(now, ["recording", "anchor_id"]).join(
        then, ["recording", "anchor_id"]
    )
    rows = pinned(rows, {"undo": g.inverse(as_pose("pose_then"))})
    rows = pinned(rows, {"shift": g.compose(as_pose("pose_now"), F.col("undo"))})
    rows = pinned(rows, {"w": g.compose(F.col("shift"), as_pose("xyz"))})
    return rows.select(
        "recording", "seq", F.col("anchor_id").alias("keyframe"), F.col("w")[3].alias("wx"),
        F.col("w")[7].alias("wy"), F.col("w")[11].alias("wz"),
    )


PIXEL_WORLD_SQL = """world AS (
        SELECT p.recording, p.frame, p.sample, p.prow, p.pcol, p.target, p.learned,
               cos(yaw) * ((pcol - 315e-1) * target / 5e1) + sin(yaw) * target + tx AS wx,
               (prow - 235e-1) * target / 5e1 + ty AS wy,
               -sin(yaw) * ((pcol - 315e-1) * target / 5e1) + cos(yaw) * target AS wz
        FROM pixels p JOIN views v ON v.recording = p.recording AND v.frame = p.frame)"""


@query("backproject", f"""
    WITH {PIXEL_WORLD_SQL} SELECT recording, frame, sample, wx, wy, wz FROM world""", doubles="wx wy wz")
def backproject(t):
    """GEO-06: pixels with depth to world points."""
    rows = px.world_points(t.pixels, t.views.withColumn("pose", view_pose()), "target", intrinsics())
    return rows.select("recording", "frame", "sample", "wx", "wy", "wz")


@query("project_points", f"""
    WITH {PIXEL_WORLD_SQL},
    seen AS (SELECT w.recording, w.frame, w.sample, v.frame AS view,
                    cos(yaw) * (wx - tx) - sin(yaw) * wz AS cx, wy - ty AS cy, sin(yaw) * (wx - tx) + cos(yaw) * wz AS cz
             FROM world w JOIN views v ON v.recording = w.recording AND v.frame = w.frame + 1)
    SELECT recording, frame, sample, view, 5e1 * cx / cz + 315e-1 AS u, 5e1 * cy / cz + 235e-1 AS v, cz AS z
    FROM seen WHERE cz > 0""", doubles="u v z")
def project_points(t):
    """GEO-05: world points seen from the next frame's camera."""
    views = t.views.withColumn("pose", view_pose())
    world = px.world_points(t.pixels, views, "target", intrinsics()).select(
        "recording", "frame", "sample", "wx", "wy", "wz"
    )
    later = views.select("recording", F.col("frame").alias("view"), "pose", (F.col("frame") - 1).alias("frame"))
    rows = px.project_into(world.join(later, ["recording", "frame"]), intrinsics())
    return rows.where("z > 0").select("recording", "frame", "sample", "view", "u", "v", "z")


@query("decode_depth", """
    SELECT o_orderkey AS pixel, CASE WHEN o_orderpriority <> '1-URGENT' AND o_totalprice / 1e5 > 0 THEN o_totalprice / 1e5 END AS depth_m,
           o_orderpriority <> '1-URGENT' AND o_totalprice / 1e5 > 0 AND o_totalprice / 1e5 <= 3e0 AS in_range FROM orders""",
       doubles="depth_m")
def decode_depth(t):
    """GEO-07: encoded depth to metres; zero and NaN are missing."""
    raw = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    depth = px.decode_depth(raw, 1e5)
    return t.orders.select(
        F.col("o_orderkey").alias("pixel"), depth.alias("depth_m"),
        F.coalesce(depth <= 3.0, F.lit(False)).alias("in_range"),
    )


MATCH_SQL = """matches AS (
        SELECT a.recording, a.seq, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz,
               (a.cents % 600) + 2e1 AS u1, (a.cents % 430) + 2e1 AS v1, (b.cents % 600) + 2e1 AS u2, (b.cents % 430) + 2e1 AS v2
        FROM frames a JOIN frames b ON b.recording = a.recording AND b.seq = a.seq + 3),
    rays AS (SELECT *, (u1 - 320e0) / 5e2 AS dax, (v1 - 240e0) / 5e2 AS day, (u2 - 320e0) / 5e2 AS dbx, (v2 - 240e0) / 5e2 AS dby,
                    sqrt(((u1 - 320e0) / 5e2)**2 + ((v1 - 240e0) / 5e2)**2 + 1) AS na,
                    sqrt(((u2 - 320e0) / 5e2)**2 + ((v2 - 240e0) / 5e2)**2 + 1) AS nb FROM matches),
    dirs AS (SELECT *, dax/na AS a0, day/na AS a1, 1/na AS a2, dbx/nb AS b0, dby/nb AS b1, 1/nb AS b2 FROM rays),
    dots AS (SELECT *, a0*b0 + a1*b1 + a2*b2 AS c, a0*(ax-bx) + a1*(ay-by_) + a2*(az-bz) AS ga,
                    b0*(ax-bx) + b1*(ay-by_) + b2*(az-bz) AS gb FROM dirs),
    st AS (SELECT *, (c*gb - ga) / (1 - c*c) AS s, (gb - c*ga) / (1 - c*c) AS tt FROM dots WHERE 1 - c*c > 1e-6),
    mid AS (SELECT *, 0.5*(ax + s*a0 + bx + tt*b0) AS px, 0.5*(ay + s*a1 + by_ + tt*b1) AS py, 0.5*(az + s*a2 + bz + tt*b2) AS pz FROM st),
    tri AS (SELECT *, pz - az AS depth_a, pz - bz AS depth_b,
                   acos(least(greatest(((ax-px)*(bx-px) + (ay-py)*(by_-py) + (az-pz)*(bz-pz)) /
                        (sqrt((ax-px)**2 + (ay-py)**2 + (az-pz)**2) * sqrt((bx-px)**2 + (by_-py)**2 + (bz-pz)**2)), -1e0), 1e0)) AS parallax,
                   500e0*(px-ax)/(pz-az) + 320e0 - u1 AS eu1, 500e0*(py-ay)/(pz-az) + 240e0 - v1 AS ev1,
                   500e0*(px-bx)/(pz-bz) + 320e0 - u2 AS eu2, 500e0*(py-by_)/(pz-bz) + 240e0 - v2 AS ev2,
                   (ay-by_)*1 - (az-bz)*day AS l0, (az-bz)*dax - (ax-bx)*1 AS l1, (ax-bx)*day - (ay-by_)*dax AS l2 FROM mid),
    gates AS (SELECT *, depth_a / (500e0 * sin(parallax)) AS sigma,
                     abs(l0*dbx + l1*dby + l2) / sqrt((l0/500e0)**2 + (l1/500e0)**2) AS epipolar FROM tri)"""


def matched_pairs(t):
    """Pixel matches between a frame and the third one after it, cameras with unit rotation."""
    frames = t.frames.select("recording", "seq", "x", "y", "z", "cents")
    u, w = (F.col("cents") % 600) + 20.0, (F.col("cents") % 430) + 20.0
    first = frames.select(
        "recording", "seq", u.alias("u1"), w.alias("v1"), *[F.col(n).alias(f"a_{n}") for n in "xyz"]
    )
    second = frames.select(
        "recording", (F.col("seq") - 3).alias("seq"), u.alias("u2"), w.alias("v2"),
        *[F.col(n).alias(f"b_{n}") for n in "xyz"],
    )
    unit = [F.lit(c) for c in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)]
    return first.join(second, ["recording", "seq"]).withColumns({
        "pose_a": g.pose(unit, g.columns("a_x", "a_y", "a_z")), "pose_b": g.pose(unit, g.columns("b_x", "b_y", "b_z")),
    })


CAMERA = (500.0, 500.0, 320.0, 240.0)


@query("triangulate_pairs", f"""
    WITH {MATCH_SQL} SELECT recording, seq, parallax AS parallax_rad, depth_a / 1e3 AS depth_km, epipolar / 1e3 AS epipolar_kpx
    FROM gates""", doubles="parallax_rad depth_km epipolar_kpx")
def triangulate_pairs(t):
    """GEO-08: two-view midpoints with parallax, depth error and epipolar distance."""
    rows = px.triangulate(matched_pairs(t), [F.lit(c) for c in CAMERA])
    return rows.select(
        "recording", "seq", "parallax_rad", (F.col("depth_m") / 1e3).alias("depth_km"),
        (F.col("epipolar_px") / 1e3).alias("epipolar_kpx"),
    )


@query("match_gates", f"""
    WITH {MATCH_SQL} SELECT recording, seq, depth_a AS depth_m, sigma AS sigma_m FROM gates
    WHERE epipolar <= 120 AND depth_a > 0 AND depth_b > 0 AND sqrt(eu1**2 + ev1**2) <= 60 AND sqrt(eu2**2 + ev2**2) <= 60
      AND parallax >= radians(1e0) AND sigma <= 1e-1 * depth_a""", doubles="depth_m sigma_m")
def match_gates(t):
    """GEO-09: matches the poses support (gates widened to suit synthetic matches)."""
    rows = px.triangulate(matched_pairs(t), [F.lit(c) for c in CAMERA])
    kept = px.gate_matches(rows, max_epipolar_px=120.0, max_reprojection_px=60.0)
    return kept.select("recording", "seq", "depth_m", "sigma_m")


@query("quarter_turns", f"""
    WITH m AS (SELECT recording, seq, {ROTATION_SQL} FROM frames),
    c AS (SELECT recording, seq, [r11, -r10, -r11, r10] AS s FROM m)
    SELECT recording, seq, CAST(list_position(s, list_max(s)) - 1 AS BIGINT) AS turns,
           (list_position(s, list_max(s)) - 1) % 2 = 1 AS portrait FROM c""")
def quarter_turns(t):
    """GEO-10: clockwise quarter turns that bring image down closest to world down."""
    rows = t.frames.withColumn("p", frame_pose()).withColumn("p", g.opencv_axes(F.col("p")))
    rows = rows.withColumn("turns", px.quarter_turns(F.col("p")))
    return rows.select("recording", "seq", "turns", (F.col("turns") % 2 == 1).alias("portrait"))


@query("cell_index", """
    SELECT recording, frame, least(prow * 6 // 48, 5) * 8 + least(pcol * 8 // 64, 7) AS cell, count(*) AS n
    FROM pixels GROUP BY ALL""")
def cell_index(t):
    """GEO-11: pixels counted on the 8 x 6 grid."""
    cell = g.cell_of(F.col("prow"), F.col("pcol"), HEIGHT, WIDTH)
    return t.pixels.groupBy("recording", "frame", cell.alias("cell")).agg(F.count("*").alias("n"))


@query("plane_heights", """
    SELECT point, h AS height, x - h * 48e-2 AS px, y - h * 6e-1 AS py, z - h * 64e-2 AS pz,
           sqrt(greatest(x*x + y*y + z*z - a*a, 0)) AS across, a AS along
    FROM (SELECT *, 48e-2 * x + 6e-1 * y + 64e-2 * z AS h, 6e-1 * x + 8e-1 * z AS a FROM points)""",
       doubles="height px py pz across along")
def plane_heights(t):
    """GEO-12: signed height and foot on a plane, and an offset split along and across a ray."""
    p, normal, ray = g.columns("x", "y", "z"), [F.lit(c) for c in (0.48, 0.6, 0.64)], [F.lit(c) for c in (0.6, 0.0, 0.8)]
    origin = [F.lit(0.0)] * 3
    height, foot = px.onto_plane(p, origin, normal)
    along, across = px.ray_split(p, ray)
    return t.points.select(
        "point", height.alias("height"), *[c.alias(n) for n, c in zip(("px", "py", "pz"), foot)],
        across.alias("across"), along.alias("along"),
    )


@query("box_metrics", """
    WITH j AS (SELECT image, item, x1, y1, x2, y2, p_size, (x2-x1)*(y2-y1) AS area,
                      x1 + p_size AS rx1, y1 + p_size AS ry1, x2 + p_size AS rx2, y2 + p_size AS ry2
               FROM (SELECT l_orderkey // 16 AS image, l_partkey, (((l_orderkey % 16) * 8 + l_linenumber) * 10000000 + l_partkey) * 100000 + l_suppkey AS item,
                            (l_partkey % 8) * 70 + l_linenumber * 3 + 0e0 AS x1, (l_suppkey % 6) * 60 + (l_partkey % 7) * 2 + 0e0 AS y1,
                            (l_partkey % 8) * 70 + l_linenumber * 3 + 20 + l_quantity * 2 AS x2,
                            (l_suppkey % 6) * 60 + (l_partkey % 7) * 2 + 30 + (l_suppkey % 5) * 15e0 AS y2 FROM lineitem) l
               JOIN part ON p_partkey = l_partkey),
    k AS (SELECT *, greatest(least(x2, rx2) - greatest(x1, rx1), 0) * greatest(least(y2, ry2) - greatest(y1, ry1), 0) AS shared FROM j)
    SELECT image, item, shared / (2 * area - shared) AS iou, (x1 + x2) / 2 - (rx1 + rx2) / 2 AS centre_dx,
           sqrt(2e0) * p_size / sqrt((x2-x1)**2 + (y2-y1)**2) AS centre_offset_fraction, x1 - rx1 AS edge_left,
           CASE WHEN area < 1024 THEN 'small' WHEN area < 9216 THEN 'medium' ELSE 'large' END AS band,
           x1 <= 2 OR y1 <= 2 OR x2 >= 638 OR y2 >= 478 AS edge FROM k""",
       doubles="iou centre_dx centre_offset_fraction edge_left")
def box_metrics(t):
    """GEO-13: overlap, placement errors, size band and edge contact of a box beside a shifted one."""
    shifts = t.part.select("p_partkey", "p_size")
    source = t.lineitem.selectExpr(
        "l_orderkey div 16 as image", "l_partkey",
        "(((l_orderkey % 16) * 8 + l_linenumber) * 10000000 + l_partkey) * 100000 + l_suppkey as item",
        "(l_partkey % 8) * 70 + l_linenumber * 3 + 0e0 as x1", "(l_suppkey % 6) * 60 + (l_partkey % 7) * 2 + 0e0 as y1",
        "(l_partkey % 8) * 70 + l_linenumber * 3 + 20 + l_quantity * 2 as x2",
        "(l_suppkey % 6) * 60 + (l_partkey % 7) * 2 + 30 + (l_suppkey % 5) * 15e0 as y2",
    ).join(shifts, F.col("l_partkey") == F.col("p_partkey"))
    a = b.box()
    r = [c + F.col("p_size") for c in a]
    placed = px.placement(a, r)
    return source.select(
        "image", "item", placed["iou"].alias("iou"), placed["centre_dx"].alias("centre_dx"),
        placed["centre_offset_fraction"].alias("centre_offset_fraction"), placed["edge_left"].alias("edge_left"),
        b.size_band(b.area(a)).alias("band"), b.touches_edge(a, 640, 480).alias("edge"),
    )


@query("target_weights", """
    SELECT recording, frame, sample, 1 / (25e-4 + (quantity / 1e3 / target) ** 2) AS weight FROM pixels""", doubles="weight")
def target_weights(t):
    """GEO-14: weight of a depth target from its own and the learned depth's error."""
    weight = scale.target_weight(F.col("target"), F.col("quantity") / 1e3)
    return t.pixels.select("recording", "frame", "sample", weight.alias("weight"))


@query("cosine_pairs", """
    SELECT vec_id, CASE WHEN na > 0 AND nb > 0 THEN d / (sqrt(na) * sqrt(nb)) END AS cosine FROM (
        SELECT vec_id, list_dot_product(a, b) AS d, list_dot_product(a, a) AS na, list_dot_product(b, b) AS nb FROM (
            SELECT e.vec_id, CAST(e.embedding AS DOUBLE[]) AS a, CAST(f.embedding AS DOUBLE[]) AS b
            FROM embeddings e JOIN embeddings f ON f.vec_id = e.vec_id + 1))""", doubles="cosine")
def cosine_pairs(t):
    """GEO-15: cosine similarity of neighbouring descriptors."""
    vectors = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    later = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return vectors.join(later, "vec_id").select("vec_id", v.cosine(F.col("a"), F.col("b")).alias("cosine"))


@query("patch_zncc", """
    WITH j AS (SELECT a.recording, a.frame, a.learned AS l, b.learned AS r FROM pixel_map a JOIN pixel_map b
               ON b.recording = a.recording AND b.frame = a.frame + 1 AND b.prow = a.prow AND b.pcol = a.pcol)
    SELECT recording, frame, count(*) AS support, CASE WHEN count(*) >= 16 THEN corr(l, r) END AS zncc
    FROM j GROUP BY recording, frame""", doubles="zncc")
def patch_zncc(t):
    """GEO-15: masked normalised correlation over pixels both patches hold; null below 16."""
    return px.zncc(t.pixel_map, "learned", minimum=16)


@query("angular_speed", """
    WITH s AS (SELECT recording, seq, t_ns, qx, qy, qz, qw, lag(t_ns) OVER w AS t0, lag(qx) OVER w AS ax, lag(qy) OVER w AS ay,
                      lag(qz) OVER w AS az, lag(qw) OVER w AS aw FROM frames WINDOW w AS (PARTITION BY recording ORDER BY t_ns))
    SELECT recording, seq, (t0 + t_ns) / 2e9 AS mid_s,
           2 * acos(least(abs(ax*qx + ay*qy + az*qz + aw*qw), 1e0)) / ((t_ns - t0) * 1e-9) AS speed FROM s WHERE t0 IS NOT NULL""",
       doubles="mid_s speed")
def angular_speed(t):
    """GEO-16: rotation speed between consecutive poses at the step's midpoint."""
    return px.angular_speed(t.frames, ["recording"]).select("recording", "seq", "mid_s", "speed")


@query("depth_targets", """
    SELECT recording, frame, sample, 32e1 + 5e2 * (pcol - 315e-1) / 5e1 AS u, 24e1 + 5e2 * (prow - 235e-1) / 5e1 AS v, target AS depth_m
    FROM pixels WHERE target > 0 AND confidence >= 128 AND 32e1 + 5e2 * (pcol - 315e-1) / 5e1 >= 0 AND 32e1 + 5e2 * (pcol - 315e-1) / 5e1 < 640
      AND 24e1 + 5e2 * (prow - 235e-1) / 5e1 >= 0 AND 24e1 + 5e2 * (prow - 235e-1) / 5e1 < 480""", doubles="u v depth_m")
def depth_targets(t):
    """FLT-01: confident depth reprojected to colour pixels inside the image."""
    rows = scale.depth_targets(t.pixels, "target", intrinsics(), [F.lit(c) for c in CAMERA], 640, 480)
    return rows.select("recording", "frame", "sample", "u", "v", F.col("target").alias("depth_m"))


@query("point_targets", f"""
    WITH m AS (SELECT recording, seq, priority, x, y, z, {ROTATION_SQL} FROM frames)
    SELECT m.recording, m.seq, p.point, r02 * (p.x - m.x) + r12 * (p.y - m.y) + r22 * (p.z - m.z) AS metres
    FROM m JOIN points p ON p.point = m.recording * 256 + m.seq
    WHERE priority <> '1-URGENT' AND r02 * (p.x - m.x) + r12 * (p.y - m.y) + r22 * (p.z - m.z) > 0""", doubles="metres")
def point_targets(t):
    """FLT-02: tracked points in front of the camera; frames without a pose give none."""
    frames = t.frames.select(
        (F.col("recording") * 256 + F.col("seq")).alias("point"), "recording", "seq",
        F.when(F.col("priority") != "1-URGENT", frame_pose()).alias("pose"),
    )
    rows = frames.join(t.points.select("point", "x", "y", "z"), "point")
    return scale.point_targets(rows).select("recording", "seq", "point", "metres")


@query("fresh_rows", """
    SELECT recording, seq FROM frames WHERE t_ns - (t_ns - (cents % 200) * 1000000) <= 100000000""")
def fresh_rows(t):
    """FLT-03: frames whose depth is at most 0.1 s behind the image."""
    rows = t.frames.withColumn("depth_t_ns", F.col("t_ns") - (F.col("cents") % 200) * 1_000_000)
    return rows.where(scale.is_fresh(F.col("depth_t_ns"), F.col("t_ns"))).select("recording", "seq")


@query("first_source", """
    WITH c AS (SELECT recording, frame, source, count(*) AS n, quantile_cont(target / learned, 0.5) AS scale FROM pixels
               WHERE confidence >= 64 GROUP BY recording, frame, source),
    q AS (SELECT *, CASE source WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS pri,
                 CASE source WHEN 'A' THEN 70 WHEN 'N' THEN 66 ELSE 64 END AS need FROM c),
    best AS (SELECT recording, frame, arg_min(source, pri) AS source, arg_min(scale, pri) AS scale FROM q WHERE n >= need GROUP BY recording, frame),
    f AS (SELECT v.recording, v.frame, b.source, b.scale FROM views v LEFT JOIN best b USING (recording, frame))
    SELECT recording, frame, CASE WHEN source IS NOT NULL THEN source
           WHEN last_value(scale IGNORE NULLS) OVER w IS NOT NULL THEN 'previous' ELSE 'none' END AS source,
           last_value(scale IGNORE NULLS) OVER w AS scale FROM f WINDOW w AS (PARTITION BY recording ORDER BY frame)""", doubles="scale")
def first_source(t):
    """FLT-04: the first named source with enough targets sizes a frame, else the previous size is carried."""
    targets = t.pixels.where("confidence >= 64").select("recording", "frame", "source", "learned", "target")
    return scale.first_source(
        targets, t.views.select("recording", "frame"), {"A": 70, "N": 66, "R": 64}
    )


EDGE_SQL = """
    WITH cells AS (SELECT * FROM pixel_map),
    near AS (SELECT a.recording, a.frame, a.prow, a.pcol, a.learned, max(b.learned) AS hi, min(b.learned) AS lo,
                    max(CASE WHEN abs(a.prow - b.prow) + abs(a.pcol - b.pcol) = 1
                             AND abs(a.learned - b.learned) > 3e-1 * greatest(a.learned, b.learned) THEN 1 ELSE 0 END) AS fwd
             FROM cells a JOIN cells b ON a.recording = b.recording AND a.frame = b.frame
              AND abs(a.prow - b.prow) <= 1 AND abs(a.pcol - b.pcol) <= 1 GROUP BY ALL)
    SELECT recording, frame, prow, pcol, hi - lo > 3e-1 * learned AS edge, fwd = 1 AS jump FROM near"""


@query("edge_mask", EDGE_SQL)
def edge_mask(t):
    """FLT-05: depth-edge masks by the 3 x 3 range and by forward differences."""
    return px.edge_masks(t.pixel_map, "learned", 0.3)


@query("pixel_normals", """
    WITH c AS (SELECT recording, frame, prow, pcol, learned AS z, (pcol - 315e-1) * learned / 5e1 AS x, (prow - 235e-1) * learned / 5e1 AS y FROM coarse_map),
    d AS (SELECT c.*, r.x - l.x AS ux, r.y - l.y AS uy, r.z - l.z AS uz, b.x - a.x AS vx, b.y - a.y AS vy, b.z - a.z AS vz
          FROM c JOIN c l ON l.recording = c.recording AND l.frame = c.frame AND l.prow = c.prow AND l.pcol = c.pcol - 1
                 JOIN c r ON r.recording = c.recording AND r.frame = c.frame AND r.prow = c.prow AND r.pcol = c.pcol + 1
                 JOIN c a ON a.recording = c.recording AND a.frame = c.frame AND a.prow = c.prow - 1 AND a.pcol = c.pcol
                 JOIN c b ON b.recording = c.recording AND b.frame = c.frame AND b.prow = c.prow + 1 AND b.pcol = c.pcol),
    n AS (SELECT *, uy*vz - uz*vy AS n0, uz*vx - ux*vz AS n1, ux*vy - uy*vx AS n2 FROM d),
    m AS (SELECT *, sqrt(n0*n0 + n1*n1 + n2*n2) AS s, n0*x + n1*y + n2*z AS facing FROM n)
    SELECT recording, frame, prow, pcol, CASE WHEN facing > 0 THEN -n0/s ELSE n0/s END AS nx,
           CASE WHEN facing > 0 THEN -n1/s ELSE n1/s END AS ny, CASE WHEN facing > 0 THEN -n2/s ELSE n2/s END AS nz,
           abs(facing) / (s * sqrt(x*x + y*y + z*z) + 1e-12) < cos(radians(75e0)) AS side_on FROM m WHERE s > 0""", doubles="nx ny nz")
def pixel_normals(t):
    """FLT-06: camera-facing normals from neighbour differences, and pixels seen side-on."""
    return px.normals(t.coarse_map, "learned", intrinsics(), step=1).select(
        "recording", "frame", "prow", "pcol", "nx", "ny", "nz", "side_on"
    )


@query("band_weights", """
    SELECT recording, frame, w AS weight, count(*) AS pixels FROM (SELECT recording, frame,
           CASE WHEN learned < 1 THEN 16 WHEN learned < 2 THEN 4 WHEN learned < 3 THEN 2 ELSE 1 END AS w FROM pixels WHERE learned > 0)
    GROUP BY recording, frame, w""")
def band_weights(t):
    """FLT-07: near-first depth bands as a weight column instead of repeated passes."""
    rows = px.near_first(t.pixels, "learned")
    return rows.groupBy("recording", "frame", "weight").agg(F.count("*").alias("pixels"))


@query("supported_cells", """
    WITH k AS (SELECT recording, frame, prow, pcol, sample, learned, least(prow * 6 // 48, 5) * 8 + least(pcol * 8 // 64, 7) AS cell FROM pixels),
    s AS (SELECT recording, frame, cell FROM k GROUP BY ALL HAVING count(*) >= 8)
    SELECT k.recording, k.frame, k.sample, k.learned BETWEEN 1e-1 AND 4e0 AS fusable FROM k SEMI JOIN s USING (recording, frame, cell)
    WHERE learned <= 8""")
def supported_cells(t):
    """FLT-08: pixels in cells with enough targets, inside the vote range, with the fuse range marked."""
    rows = scale.supported_pixels(t.pixels, HEIGHT, WIDTH, minimum=8).where("learned <= 8")
    return rows.select("recording", "frame", "sample", F.col("learned").between(0.1, 4.0).alias("fusable"))


@query("polygon_pixels", """
    WITH poly AS (SELECT p_partkey AS shape, p_size + 4 AS s, p_partkey % 5 AS k FROM part),
    corners AS (SELECT shape, 0 AS e, 2e0 AS x, 3e0 AS y, s + 2e0 AS x2, 3e0 + k AS y2 FROM poly
        UNION ALL SELECT shape, 1, s + 2e0, 3e0 + k, s / 2e0 + 3, s / 2e0 + 8 FROM poly
        UNION ALL SELECT shape, 2, s / 2e0 + 3, s / 2e0 + 8, 2e0, 3e0 FROM poly),
    cells AS (SELECT shape, r AS prow, c AS pcol FROM poly, range(0, 48) a(r), range(0, 64) b(c)),
    hits AS (SELECT cells.shape, prow, pcol, sum(CASE WHEN (y > prow + 5e-1) <> (y2 > prow + 5e-1)
                    AND pcol + 5e-1 < (x2 - x) * (prow + 5e-1 - y) / (CASE WHEN y2 <> y THEN y2 - y END) + x THEN 1 ELSE 0 END) AS n
             FROM cells JOIN corners USING (shape) GROUP BY ALL)
    SELECT shape, count(*) AS pixels, CAST(sum(prow) AS BIGINT) AS row_sum, CAST(sum(pcol) AS BIGINT) AS col_sum FROM hits WHERE n % 2 = 1 GROUP BY shape""")
def polygon_pixels(t):
    """FLT-09: outline to pixels by the even-odd rule at pixel centres, one scan line at a time."""
    s, k = F.col("p_size") + 4, F.col("p_partkey") % 5
    ring = F.array(
        F.struct(F.lit(2.0).alias("x"), F.lit(3.0).alias("y")),
        F.struct((s + 2.0).alias("x"), (k + 3.0).alias("y")),
        F.struct((s / 2.0 + 3).alias("x"), (s / 2.0 + 8).alias("y")),
    )
    shapes = t.part.select(F.col("p_partkey").alias("shape"), ring.alias("ring"))
    pixels = px.polygon_pixels(shapes, ["shape"], "ring", HEIGHT, WIDTH)
    return pixels.groupBy("shape").agg(
        F.count("*").alias("pixels"), F.sum("prow").alias("row_sum"), F.sum("pcol").alias("col_sum")
    )


@query("run_length_pixels", """
    WITH r AS (SELECT conv_id AS shape, turn AS k, length(text) % 40 AS n, turn % 2 = 1 AS filled FROM conversations),
    s AS (SELECT *, sum(n) OVER (PARTITION BY shape ORDER BY k) - n AS start FROM r),
    p AS (SELECT shape, unnest(range(CAST(start AS BIGINT), CAST(start + n AS BIGINT))) AS pos FROM s WHERE filled)
    SELECT shape, pos % 12 AS prow, pos // 12 AS pcol FROM p""")
def run_length_pixels(t):
    """FLT-09: column-major run lengths to pixels."""
    runs = t.conversations.select(
        F.col("conv_id").alias("shape"), F.col("turn").alias("k"), (F.length("text") % 40).cast("long").alias("n")
    )
    return px.decode_runs(runs, ["shape"], "k", "n", height=12)


@query("fault_variants", f"""
    WITH f AS (SELECT * FROM (VALUES ('clean'), ('double_depth'), ('inverse_pose')) AS x(fault)),
    s AS (SELECT p.recording, p.frame, fault, CASE WHEN fault = 'double_depth' THEN 2 * target ELSE target END AS d, pcol, prow, tx, ty, yaw
          FROM pixels p JOIN views v ON v.recording = p.recording AND v.frame = p.frame, f),
    w AS (SELECT recording, frame, fault, (pcol - 315e-1) * d / 5e1 AS cx, (prow - 235e-1) * d / 5e1 AS cy, d AS cz, tx, ty, yaw FROM s)
    SELECT recording, frame, fault, avg(CASE WHEN fault = 'inverse_pose' THEN cos(yaw) * (cx - tx) - sin(yaw) * cz ELSE cos(yaw) * cx + sin(yaw) * cz + tx END) AS mean_x,
           avg(CASE WHEN fault = 'inverse_pose' THEN sin(yaw) * (cx - tx) + cos(yaw) * cz ELSE -sin(yaw) * cx + cos(yaw) * cz END) AS mean_z,
           count(*) AS n FROM w GROUP BY recording, frame, fault""", doubles="mean_x mean_z")
def fault_variants(t):
    """FLT-10: deliberately wrong depth and pose scored beside the clean rows in one pass."""
    rows = px.fault_points(t.pixels, t.views.withColumn("pose", view_pose()), "target", intrinsics())
    return rows.groupBy("recording", "frame", "fault").agg(
        F.avg("wx").alias("mean_x"), F.avg("wz").alias("mean_z"), F.count("*").alias("n")
    )


@query("variant_matrix", """
    WITH v AS (SELECT * FROM (VALUES ('plain', 0e0, 1e9, 0), ('near', 0e0, 4e0, 0), ('sure', 0e0, 1e9, 128), ('near_sure', 1e-1, 4e0, 128)) AS x(variant, lo, hi, conf)),
    p AS (SELECT variant, recording, CAST(floor(learned / 25e-2) AS BIGINT) AS cell, learned BETWEEN lo AND hi AND confidence >= conf AS kept FROM pixels, v)
    SELECT variant, recording, count(*) AS before_n, count(*) FILTER (WHERE kept) AS after_n, count(DISTINCT cell) FILTER (WHERE kept) AS cells FROM p GROUP BY variant, recording""")
def variant_matrix(t):
    """FLT-11: one pass scores every setting of the trial; removals are counted per step."""
    variants = [("plain", 0.0, 1e9, 0), ("near", 0.0, 4.0, 0), ("sure", 0.0, 1e9, 128), ("near_sure", 0.1, 4.0, 128)]
    return px.variant_matrix(t.pixels, variants, "learned", 0.25)
