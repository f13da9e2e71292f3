"""The room query: size every frame, fuse, vote and measure, for all recordings at once."""

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import libm
from ..operators import fusion, mapping, scale, vote
from ..operators import pieces as pc
from ..operators import pixels as px
from ..session import checkpointed
from .registry import query
from .scalars import HEIGHT, K, WIDTH, intrinsics, view_pose

VOXEL_M, BAND_M, CELL_M, MIN_POINTS = 0.25, 0.3, 0.25, 50

ROOM_SQL = """
    WITH l AS (SELECT *, least(prow * 6 // 48, 5) * 8 + least(pcol * 8 // 64, 7) AS cell, ln(target / learned) AS lr FROM pixels),
    f AS (SELECT recording, frame, quantile_cont(lr, 0.5) AS fm FROM l GROUP BY ALL HAVING count(*) >= 50),
    c AS (SELECT recording, frame, cell, quantile_cont(lr, 0.5) AS cm FROM l GROUP BY ALL HAVING count(*) >= 6),
    g AS (SELECT f.recording, f.frame, i.cell, coalesce(c.cm, f.fm) AS v FROM f CROSS JOIN range(0, 48) i(cell) LEFT JOIN c ON c.recording = f.recording AND c.frame = f.frame AND c.cell = i.cell),
    gl AS (SELECT recording, frame, list(v ORDER BY cell) AS v FROM g GROUP BY ALL),
    p AS (SELECT recording, frame, pcol, prow, learned, least(greatest((pcol + 5e-1) * 8 / 64 - 5e-1, 0), 7) AS ax, least(greatest((prow + 5e-1) * 6 / 48 - 5e-1, 0), 5) AS ay FROM pixels),
    q AS (SELECT *, CAST(floor(ax) AS BIGINT) AS x0, CAST(floor(ay) AS BIGINT) AS y0, ax - floor(ax) AS wx, ay - floor(ay) AS wy FROM p),
    sized AS (SELECT q.recording, q.frame, pcol, prow, learned * exp((1 - wy) * ((1 - wx) * v[y0 * 8 + x0 + 1] + wx * v[y0 * 8 + least(x0 + 1, 7) + 1])
           + wy * ((1 - wx) * v[least(y0 + 1, 5) * 8 + x0 + 1] + wx * v[least(y0 + 1, 5) * 8 + least(x0 + 1, 7) + 1])) AS d FROM q JOIN gl ON gl.recording = q.recording AND gl.frame = q.frame),
    world AS (SELECT s.recording, cos(yaw) * ((pcol - 315e-1) * d / 5e1) + sin(yaw) * d + tx AS x, (prow - 235e-1) * d / 5e1 + ty AS y, -sin(yaw) * ((pcol - 315e-1) * d / 5e1) + cos(yaw) * d AS z
              FROM sized s JOIN views v ON v.recording = s.recording AND v.frame = s.frame WHERE d >= 1e-1 AND d < 4),
    fused AS (SELECT recording, CAST(floor(x / 25e-2) AS BIGINT) AS ix, CAST(floor(y / 25e-2) AS BIGINT) AS iy, CAST(floor(z / 25e-2) AS BIGINT) AS iz, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM world GROUP BY ALL),
    cam AS (SELECT w.recording, ix, iy, iz, v.frame, cos(yaw) * (x - tx) - sin(yaw) * z AS cx, y - ty AS cy, sin(yaw) * (x - tx) + cos(yaw) * z AS cz FROM fused w JOIN views v ON v.recording = w.recording),
    pix AS (SELECT *, CAST(round_even(cx / cz * 5e1 + 315e-1, 0) AS BIGINT) AS pcol, CAST(round_even(cy / cz * 5e1 + 235e-1, 0) AS BIGINT) AS prow FROM cam WHERE cz > 1e-1 AND cz <= 84e-1),
    seen AS (SELECT p.recording, ix, iy, iz, cz, m.target AS measured, greatest(8e-2, 5e-2 * m.target) AS margin FROM pix p JOIN pixel_map m ON m.recording = p.recording AND m.frame = p.frame AND m.prow = p.prow AND m.pcol = p.pcol WHERE m.target > 0 AND m.target < 8),
    ballots AS (SELECT recording, ix, iy, iz, sum(CASE WHEN abs(cz - measured) <= margin THEN 1 / greatest(measured, 5e-1)**2 ELSE 0 END) AS support, sum(CASE WHEN cz < measured - margin THEN 1 / greatest(measured, 5e-1)**2 ELSE 0 END) AS against FROM seen GROUP BY ALL),
    voted AS (SELECT f.* FROM fused f LEFT JOIN ballots b USING (recording, ix, iy, iz) WHERE coalesce(support >= against, true)),
    pts AS (SELECT recording, x, y, z, abs(y) <= 3e-1 AS on_plane FROM voted),
    n AS (SELECT recording, count(*) AS points_n FROM pts GROUP BY recording),
    m AS (SELECT recording, covar_pop(-z, -z) AS saa, covar_pop(-z, x) AS sab, covar_pop(x, x) AS sbb FROM pts WHERE on_plane GROUP BY recording),
    an AS (SELECT *, 5e-1 * atan2(2 * sab, saa - sbb) AS angle FROM m),
    w AS (SELECT recording, sin(angle) AS ux, -cos(angle) AS uz, cos(angle) AS wx, sin(angle) AS wz FROM an),
    s AS (SELECT recording, CASE WHEN (CASE WHEN abs(ux) >= abs(uz) THEN ux ELSE uz END) < 0 THEN -ux ELSE ux END AS ux, CASE WHEN (CASE WHEN abs(ux) >= abs(uz) THEN ux ELSE uz END) < 0 THEN -uz ELSE uz END AS uz,
                 CASE WHEN (CASE WHEN abs(wx) >= abs(wz) THEN wx ELSE wz END) < 0 THEN -wx ELSE wx END AS wx, CASE WHEN (CASE WHEN abs(wx) >= abs(wz) THEN wx ELSE wz END) < 0 THEN -wz ELSE wz END AS wz FROM w),
    co AS (SELECT p.recording, p.y AS h, on_plane, x*ux + z*uz AS a, x*wx + z*wz AS b FROM pts p JOIN s USING (recording) JOIN n USING (recording) WHERE points_n >= 50),
    lo AS (SELECT recording, min(a) AS la, min(b) AS lb, floor((max(a) - min(a)) / 25e-2) + 1 AS gr, floor((max(b) - min(b)) / 25e-2) + 1 AS gc FROM co GROUP BY recording),
    ce AS (SELECT co.recording, floor((a - la) / 25e-2) AS i, floor((b - lb) / 25e-2) AS j, max(h) AS top, max(CASE WHEN on_plane THEN 1 ELSE 0 END) AS op FROM co JOIN lo USING (recording) GROUP BY ALL),
    o AS (SELECT recording, count(*) AS oc, sum(op) AS pc, max(top) AS hi, min(top) AS low FROM ce GROUP BY recording),
    t AS (SELECT recording, count(*) AS fused_points FROM fused GROUP BY recording)
    SELECT t.recording, fused_points, points_n AS voted_points, CASE WHEN points_n < 50 THEN 'fewer than 50 surface points' END AS reason, oc * 625e-4 AS observed_area_m2, pc * 625e-4 AS plane_area_m2,
           gr * 25e-2 AS length_m, gc * 25e-2 AS width_m, hi AS highest_m, low AS lowest_m FROM t JOIN n USING (recording) LEFT JOIN lo USING (recording) LEFT JOIN o USING (recording)"""
MEASURES = "observed_area_m2 plane_area_m2 length_m width_m highest_m lowest_m"


def sized_surface(t):
    """Fused voxels of every recording from learned depth sized per pixel, fuse range 0.1 to 4 m; sized once for the vote and what it keeps."""
    sized = scale.grid_scale(t.pixels, HEIGHT, WIDTH, minimum=50, min_cell=6, log=libm.log, exp=libm.exp)
    sized = sized.withColumn("depth_m", F.col("learned") * F.col("scale"))
    near = sized.where((F.col("depth_m") >= 0.1) & (F.col("depth_m") < 4.0))
    views = t.views.select("recording", "frame", view_pose().alias("pose"))
    world = px.world_points(near, views, "depth_m", intrinsics()).select(
        "recording", F.col("wx").alias("x"), F.col("wy").alias("y"), F.col("wz").alias("z")
    )
    fused = fusion.voxel_fuse(world, ["recording"], VOXEL_M)
        # three 21-bit voxel indices in one key
    packed = ((F.col("ix") + (1 << 20)) * (1 << 21) + F.col("iy") + (1 << 20)) * (1 << 21) + F.col("iz") + (1 << 20)
    return checkpointed(fused.withColumn("point", packed))


def voted_surface(t, fused):
    views = t.views.select("recording", "frame", view_pose().alias("pose"))
    seen = vote.seen_points(fused.select("recording", "point", "x", "y", "z"), views, t.pixel_map, "target", K, HEIGHT, WIDTH)
    return vote.visibility_vote(fused, vote.vote_tallies(seen))


def measured(points):
    planes = points.select("recording").distinct().select(
        "recording", *[F.lit(v).alias(n) for n, v in (("px", 0.0), ("py", 0.0), ("pz", 0.0), ("nx", 0.0), ("ny", 1.0), ("nz", 0.0))]
    )
    return mapping.footprint(points.select("recording", "x", "y", "z"), planes, "recording", cell=CELL_M, band=BAND_M, min_points=MIN_POINTS)


@query("room_query", ROOM_SQL, doubles=MEASURES)
def room_query(t):
    """Sized, fused and voted surface of each recording with its floor measures."""
    voted = checkpointed(voted_surface(t, sized_surface(t)))
    totals = voted.groupBy("recording").agg(F.count("*").alias("fused_points"))
    floors = measured(voted.where("voted"))
    return totals.join(floors, "recording").select(
        "recording", "fused_points", F.col("points").alias("voted_points"), "reason", *MEASURES.split()
    )


@query("room_clean", doubles=MEASURES)
def room_clean(t):
    """The room query with only the largest touching pieces of the voted surface kept."""
    voted = checkpointed(voted_surface(t, sized_surface(t)).where("voted").select("recording", "point", "x", "y", "z"))
    kept = pc.largest_pieces(voted, "recording", VOXEL_M, keep=50, min_points=20).where("kept")
    return measured(checkpointed(kept.select("recording", "x", "y", "z"))).withColumnRenamed("points", "kept_points")


@query("corrected_surface", """
    WITH c AS (SELECT o_orderkey // 2048 AS recording, o_orderkey // 512 AS fragment, max(o_totalprice) / 1e7 AS shift FROM orders GROUP BY ALL)
    SELECT p.recording, p.frame // 8 AS fragment, count(*) AS points_n, avg(target + shift) AS mean_z FROM pixels p JOIN c ON c.recording = p.recording AND c.fragment = p.frame // 8 GROUP BY ALL""", doubles="mean_z")
def corrected_surface(t):
    """AGG-13: fragments placed again by their anchor's current pose, without fusing again."""
    unit = [F.lit(c) for c in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)]
    anchors = t.orders.groupBy(F.expr("o_orderkey div 2048").alias("recording"), F.expr("o_orderkey div 512").alias("fragment")).agg(
        (F.max("o_totalprice") / 1e7).alias("shift")
    ).select("recording", "fragment", g.pose(unit, [F.lit(0.0), F.lit(0.0), F.col("shift")]).alias("anchor_pose"))
    local = t.pixels.select("recording", F.expr("frame div 8").alias("fragment"), F.col("pcol").cast("double").alias("x"), F.col("prow").cast("double").alias("y"), F.col("target").alias("z"))
    moved = fusion.replaced(local, anchors, ["recording", "fragment"])
    return moved.groupBy("recording", "fragment").agg(F.count("*").alias("points_n"), F.avg("z").alias("mean_z"))
