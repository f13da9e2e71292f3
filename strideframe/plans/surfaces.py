"""Queries over fusion, planes, maps and pieces."""

from pyspark.sql import functions as F

from ..functions.lcg import mixed_sql
from ..operators import fusion, mapping
from ..operators import pieces as pc
from .registry import ORACLES, query
from .scalars import HEIGHT, K, WIDTH, view_pose

CELL = 0.5
PLAIN = "CAST(floor({c} / 5e-1) AS BIGINT) AS i{c}"
INDEX_SQL = ", ".join(PLAIN.format(c=c) for c in "xyz")


@query("voxel_fuse", f"""
    WITH v AS (SELECT recording, {INDEX_SQL}, count(*) AS samples, avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(point % 256) AS r, sum(nx) AS sx, sum(ny) AS sy, sum(nz) AS sz FROM points GROUP BY ALL)
    SELECT recording, ix, iy, iz, samples, x, y, z, r, sx / sqrt(sx*sx + sy*sy + sz*sz) AS nx, sz / sqrt(sx*sx + sy*sy + sz*sz) AS nz FROM v WHERE samples >= 2""", doubles="x y z r nx nz")
def voxel_fuse(t):
    """AGG-11: mean position, colour and unit normal per voxel with a minimum count."""
    rows = t.points.withColumn("r", F.col("point") % 256)
    return fusion.voxel_fuse(rows, ["recording"], CELL, ["r"], ["nx", "ny", "nz"], min_count=2).drop("ny")


@query("voxel_thin", """
    WITH o AS (SELECT recording, min(x) - 25e-2 AS ox, min(y) - 25e-2 AS oy, min(z) - 25e-2 AS oz FROM points GROUP BY recording)
    SELECT recording, CAST(floor((x - ox) / 5e-1) AS BIGINT) AS ix, CAST(floor((y - oy) / 5e-1) AS BIGINT) AS iy, CAST(floor((z - oz) / 5e-1) AS BIGINT) AS iz,
           count(*) AS samples, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM points JOIN o USING (recording) GROUP BY ALL""", doubles="x y z")
def voxel_thin(t):
    """AGG-11: thinning on the grid that starts half a voxel below the minimum."""
    return fusion.voxel_thin(t.points, ["recording"], CELL)


TSDF_SQL = """rays AS (SELECT p.recording, p.frame // 8 AS fragment, pcol, prow, target + s * 5e-1 AS d, tx, ty, yaw
        FROM pixel_map p JOIN views v ON v.recording = p.recording AND v.frame = p.frame, range(-4, 5) r(s) WHERE target + s * 5e-1 > 0),
    vox AS (SELECT DISTINCT recording, fragment, CAST(floor((cos(yaw) * ((pcol - 315e-1) * d / 5e1) + sin(yaw) * d + tx) / 5e-1) AS BIGINT) AS ix,
                   CAST(floor(((prow - 235e-1) * d / 5e1 + ty) / 5e-1) AS BIGINT) AS iy,
                   CAST(floor((-sin(yaw) * ((pcol - 315e-1) * d / 5e1) + cos(yaw) * d) / 5e-1) AS BIGINT) AS iz FROM rays),
    cam AS (SELECT x.*, v.frame, cos(yaw) * ((ix + 5e-1) * 5e-1 - tx) - sin(yaw) * (iz + 5e-1) * 5e-1 AS cx, (iy + 5e-1) * 5e-1 - ty AS cy,
                   sin(yaw) * ((ix + 5e-1) * 5e-1 - tx) + cos(yaw) * (iz + 5e-1) * 5e-1 AS cz FROM vox x JOIN views v ON v.recording = x.recording AND v.frame // 8 = x.fragment),
    pix AS (SELECT *, CAST(round_even(cx / cz * 5e1 + 315e-1, 0) AS BIGINT) AS pcol, CAST(round_even(cy / cz * 5e1 + 235e-1, 0) AS BIGINT) AS prow FROM cam WHERE cz > 0),
    vol AS (SELECT p.recording, p.fragment, ix, iy, iz, avg(least((m.target - cz) / 2e0, 1e0)) AS tsdf, count(*) AS weight
            FROM pix p JOIN pixel_map m ON m.recording = p.recording AND m.frame = p.frame AND m.prow = p.prow AND m.pcol = p.pcol
            WHERE m.target - cz > -2e0 GROUP BY ALL)"""


def volume_of(t):
    views = t.views.select("recording", "frame", view_pose().alias("pose"))
    pixels = t.pixel_map
    return fusion.signed_distance(
        pixels, views, pixels, F.expr("frame div 8"), "target", K, HEIGHT, WIDTH, CELL
    )


@query("signed_distance", f"WITH {TSDF_SQL} SELECT recording, fragment, ix, iy, iz, tsdf, weight FROM vol", doubles="tsdf")
def signed_distance(t):
    """AGG-12: running-average truncated distance per fragment and voxel."""
    return volume_of(t)


@query("zero_crossings", f"""
    WITH {TSDF_SQL},
    n AS (SELECT a.*, 0 AS axis, b.tsdf AS nt FROM vol a JOIN vol b ON a.recording = b.recording AND a.fragment = b.fragment AND b.ix = a.ix + 1 AND b.iy = a.iy AND b.iz = a.iz
        UNION ALL SELECT a.*, 1, b.tsdf FROM vol a JOIN vol b ON a.recording = b.recording AND a.fragment = b.fragment AND b.ix = a.ix AND b.iy = a.iy + 1 AND b.iz = a.iz
        UNION ALL SELECT a.*, 2, b.tsdf FROM vol a JOIN vol b ON a.recording = b.recording AND a.fragment = b.fragment AND b.ix = a.ix AND b.iy = a.iy AND b.iz = a.iz + 1)
    SELECT recording, fragment, ix, iy, iz, axis, (iz + 5e-1 + CASE WHEN axis = 2 THEN tsdf / (tsdf - nt) ELSE 0 END) * 5e-1 AS z
    FROM n WHERE tsdf <> 0 AND abs(tsdf) < 1 AND abs(nt) < 1 AND sign(tsdf) * sign(nt) <= 0""", doubles="z")
def zero_crossings(t):
    """AGG-13: surface points at sign changes between neighbouring voxels."""
    return fusion.zero_crossings(volume_of(t), CELL).select("recording", "fragment", "ix", "iy", "iz", "axis", "z")


@query("fragment_anchors", """
    WITH k AS (SELECT recording, seq, seq // 7 AS keyframe FROM frames WHERE status <> 'P'), f AS (SELECT recording, keyframe // 10 AS fragment, arg_min(keyframe, seq) AS seen, count(*) AS frames_n FROM k GROUP BY ALL),
    a AS (SELECT DISTINCT recording, seq // 7 AS id FROM frames WHERE status <> 'P' AND cents % 2 = 0)
    SELECT f.recording, f.fragment, CASE WHEN a.id IS NOT NULL THEN f.fragment * 10 ELSE f.seen END AS anchor_id FROM f LEFT JOIN a ON a.recording = f.recording AND a.id = f.fragment * 10""")
def fragment_anchors(t):
    """AGG-13: the anchor each fragment is placed by, fixed when it is first fused."""
    fused = t.frames.where("status <> 'P'").selectExpr("recording", "seq", "seq div 7 as keyframe", "cents")
    anchors = fused.where("cents % 2 = 0").selectExpr("recording", "keyframe as anchor_id")
    return fusion.fragment_anchor(fused, anchors)


@query("point_moments", """
    SELECT recording, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, CASE WHEN count(*) >= 3 THEN covar_pop(x, x) END AS cxx, CASE WHEN count(*) >= 3 THEN covar_pop(x, y) END AS cxy,
           CASE WHEN count(*) >= 3 THEN covar_pop(z, z) END AS czz, CASE WHEN count(*) >= 3 THEN covar_pop(x, x) + covar_pop(y, y) + covar_pop(z, z) END AS spread FROM points GROUP BY recording""",
       doubles="mx my mz cxx cxy czz spread")
def point_moments(t):
    """AGG-14: centre and covariance from mergeable sums; the axes' variances add up to the spread."""
    rows = mapping.principal_axes(mapping.moments(t.points, ["recording"]))
    axes = F.col("axes")
    return rows.select("recording", "n", "mx", "my", "mz", "cxx", "cxy", "czz", (axes[0] + axes[1] + axes[2]).alias("spread"))


@query("dominant_plane", f"""
    WITH s AS (SELECT recording, point, x, y, z, row_number() OVER (PARTITION BY recording ORDER BY {mixed_sql('point', 0)}, point) - 1 AS draw FROM points),
    n AS (SELECT recording, count(*) AS n FROM points GROUP BY recording),
    h AS (SELECT recording, h, {mixed_sql('h * 3', 1)} % n AS i0, {mixed_sql('h * 3 + 1', 1)} % n AS i1, {mixed_sql('h * 3 + 2', 1)} % n AS i2 FROM n, range(0, 500) r(h)),
    c AS (SELECT h.recording, h.h, a.x AS px, a.y AS py, a.z AS pz, (b.y-a.y)*(c.z-a.z) - (b.z-a.z)*(c.y-a.y) AS nx, (b.z-a.z)*(c.x-a.x) - (b.x-a.x)*(c.z-a.z) AS ny, (b.x-a.x)*(c.y-a.y) - (b.y-a.y)*(c.x-a.x) AS nz
          FROM h JOIN s a ON a.recording = h.recording AND a.draw = i0 JOIN s b ON b.recording = h.recording AND b.draw = i1 JOIN s c ON c.recording = h.recording AND c.draw = i2
          WHERE i0 <> i1 AND i0 <> i2 AND i1 <> i2),
    u AS (SELECT *, sqrt(nx*nx + ny*ny + nz*nz) AS len FROM c WHERE sqrt(nx*nx + ny*ny + nz*nz) >= 1e-12),
    k AS (SELECT u.recording, u.h, count(*) FILTER (WHERE abs((p.x-px)*u.nx + (p.y-py)*u.ny + (p.z-pz)*u.nz) / len <= 1e-1) AS inliers, count(*) AS points FROM u JOIN points p ON p.recording = u.recording GROUP BY ALL)
    SELECT recording, arg_min(h, (-inliers, h)) AS hypothesis, max(inliers) AS inliers, max(points) AS points_n, max(inliers) / max(points) AS inlier_share FROM k GROUP BY recording""", doubles="inlier_share")
def dominant_plane(t):
    """AGG-15: seeded hypotheses, each scored on every point, refitted on the inliers of the best."""
    rows = mapping.dominant_plane(t.points, "recording", "point", reach=0.1)
    return rows.select("recording", "hypothesis", "inliers", F.col("points").alias("points_n"), "inlier_share")


@query("footprint", """
    WITH p AS (SELECT recording, x, y, z, abs(y) <= 3e-1 AS on_plane FROM points),
    n AS (SELECT recording, count(*) AS points_n, count(*) FILTER (WHERE on_plane) AS plane_n FROM p GROUP BY recording),
    m AS (SELECT recording, covar_pop(-z, -z) AS saa, covar_pop(-z, x) AS sab, covar_pop(x, x) AS sbb FROM p WHERE on_plane GROUP BY recording),
    g AS (SELECT *, 5e-1 * atan2(2 * sab, saa - sbb) AS angle FROM m),
    ax AS (SELECT recording, -sin(angle) AS minor_a, cos(angle) AS minor_b, cos(angle) AS major_a, sin(angle) AS major_b FROM g),
    w AS (SELECT recording, major_b AS ux, -major_a AS uz, minor_b AS wx, -minor_a AS wz FROM ax),
    s AS (SELECT recording, CASE WHEN (CASE WHEN abs(ux) >= abs(uz) THEN ux ELSE uz END) < 0 THEN -ux ELSE ux END AS ux, CASE WHEN (CASE WHEN abs(ux) >= abs(uz) THEN ux ELSE uz END) < 0 THEN -uz ELSE uz END AS uz,
                 CASE WHEN (CASE WHEN abs(wx) >= abs(wz) THEN wx ELSE wz END) < 0 THEN -wx ELSE wx END AS wx, CASE WHEN (CASE WHEN abs(wx) >= abs(wz) THEN wx ELSE wz END) < 0 THEN -wz ELSE wz END AS wz FROM w),
    c AS (SELECT p.recording, p.y AS h, on_plane, x*ux + z*uz AS a, x*wx + z*wz AS b FROM p JOIN s USING (recording) JOIN n USING (recording) WHERE points_n >= 50 AND plane_n >= 3),
    lo AS (SELECT recording, min(a) AS la, min(b) AS lb, floor((max(a) - min(a)) / 25e-2) + 1 AS gr, floor((max(b) - min(b)) / 25e-2) + 1 AS gc FROM c GROUP BY recording),
    cell AS (SELECT c.recording, floor((a - la) / 25e-2) AS i, floor((b - lb) / 25e-2) AS j, max(h) AS top, max(CASE WHEN on_plane THEN 1 ELSE 0 END) AS op FROM c JOIN lo USING (recording) GROUP BY ALL),
    o AS (SELECT recording, count(*) AS oc, sum(op) AS pc, max(top) AS hi, min(top) AS low FROM cell GROUP BY recording)
    SELECT n.recording, points_n, CASE WHEN points_n < 50 THEN 'fewer than 50 surface points' WHEN plane_n < 3 THEN 'fewer than 3 points lie on the plane' END AS reason, oc * 625e-4 AS observed_area_m2, pc * 625e-4 AS plane_area_m2, gr * 25e-2 AS length_m, gc * 25e-2 AS width_m,
           (gr * gc - oc) * 625e-4 AS unknown_area_m2, hi AS highest_m, low AS lowest_m FROM n LEFT JOIN lo USING (recording) LEFT JOIN o USING (recording)""",
       doubles="observed_area_m2 plane_area_m2 length_m width_m unknown_area_m2 highest_m lowest_m")
def footprint(t):
    """AGG-16: oriented footprint grid and its measures per origin, or the reason they are missing."""
    planes = t.points.select("recording").distinct().select(
        "recording", *[F.lit(v).alias(n) for n, v in (("px", 0.0), ("py", 0.0), ("pz", 0.0), ("nx", 0.0), ("ny", 1.0), ("nz", 0.0))]
    )
    return mapping.footprint(
        t.points.select("recording", "x", "y", "z"), planes, "recording", cell=0.25, band=0.3, min_points=50
    ).withColumnRenamed("points", "points_n")


@query("top_down", """
    WITH k AS (SELECT * FROM points WHERE y BETWEEN -5e-1 AND 5e-1), o AS (SELECT recording, min(x) AS ox, min(z) AS oz FROM k GROUP BY recording)
    SELECT recording, CAST(floor((x - ox) / 25e-2) AS BIGINT) AS "column", CAST(floor((z - oz) / 25e-2) AS BIGINT) AS line, max(y) AS height, arg_max(point % 256, (y, point)) AS colour, count(*) AS samples
    FROM k JOIN o USING (recording) GROUP BY ALL""", doubles="height")
def top_down(t):
    """AGG-50: highest point per ground cell with its colour."""
    rows = t.points.withColumn("shade", F.col("point") % 256)
    return mapping.top_down(rows, ["recording"], ("x", "z"), "y", 0.25, -0.5, 0.5, "shade", "point")


CELLS_SQL = """o AS (SELECT recording, min(x) AS ox, min(y) AS oy, min(z) AS oz FROM points GROUP BY recording),
    placed AS (SELECT p.recording, p.point, CAST(floor((x - ox) / 3e-1) AS BIGINT) AS ix, CAST(floor((y - oy) / 3e-1) AS BIGINT) AS iy, CAST(floor((z - oz) / 3e-1) AS BIGINT) AS iz FROM points p JOIN o USING (recording)),
    cells AS (SELECT recording, ix, iy, iz, (ix * 1048576 + iy) * 1048576 + iz AS id, count(*) AS n FROM placed GROUP BY ALL),
    touch AS (SELECT a.recording, a.id AS a, b.id AS b FROM cells a JOIN cells b ON a.recording = b.recording AND abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND abs(a.iz - b.iz) <= 1 AND a.id <> b.id)"""


@query("piece_ranks", f"""
    WITH RECURSIVE {CELLS_SQL},
    reach AS (SELECT recording, id AS a, id AS b FROM cells UNION SELECT r.recording, r.a, t.b FROM reach r JOIN touch t ON t.recording = r.recording AND t.a = r.b),
    comp AS (SELECT recording, a AS id, min(b) AS component FROM reach GROUP BY ALL),
    sizes AS (SELECT recording, component, sum(n) AS piece_points FROM comp JOIN cells USING (recording, id) GROUP BY ALL)
    SELECT recording, component, CAST(piece_points AS BIGINT) AS piece_points, row_number() OVER (PARTITION BY recording ORDER BY piece_points DESC, component) - 1 AS rank FROM sizes""")
def piece_ranks(t):
    """AGG-17: connected pieces of occupied cells ranked by their point count."""
    _, cells = pc.occupied_cells(t.points, "recording", 0.3)
    return pc.piece_ranks(pc.piece_labels(cells, "recording"), "recording")


@query("streak_pieces", f"""
    WITH RECURSIVE {CELLS_SQL},
    around AS (SELECT recording, a AS id, count(*) AS k FROM touch GROUP BY ALL),
    kind AS (SELECT c.*, coalesce(k, 0) >= 3 AS chain FROM cells c LEFT JOIN around USING (recording, id)),
    ct AS (SELECT t.* FROM touch t JOIN kind x ON x.recording = t.recording AND x.id = t.a AND x.chain JOIN kind y ON y.recording = t.recording AND y.id = t.b AND y.chain),
    cr AS (SELECT recording, id AS a, id AS b FROM kind WHERE chain UNION SELECT r.recording, r.a, t.b FROM cr r JOIN ct t ON t.recording = r.recording AND t.a = r.b),
    cc AS (SELECT recording, a AS id, min(b) AS component FROM cr GROUP BY ALL),
    taken AS (SELECT t.recording, t.a AS id, max(cc.component) AS component FROM touch t JOIN kind k ON k.recording = t.recording AND k.id = t.a AND NOT k.chain JOIN cc ON cc.recording = t.recording AND cc.id = t.b GROUP BY ALL),
    rest AS (SELECT k.* FROM kind k ANTI JOIN taken USING (recording, id) WHERE NOT k.chain),
    rt AS (SELECT t.* FROM touch t JOIN rest x ON x.recording = t.recording AND x.id = t.a JOIN rest y ON y.recording = t.recording AND y.id = t.b),
    rr AS (SELECT recording, id AS a, id AS b FROM rest UNION SELECT r.recording, r.a, t.b FROM rr r JOIN rt t ON t.recording = r.recording AND t.a = r.b),
    every AS (SELECT recording, id, component, 'chain' AS kind FROM cc UNION ALL SELECT recording, id, component, 'chain' FROM taken
              UNION ALL SELECT recording, a, min(b), 'rest' FROM rr GROUP BY recording, a)
    SELECT recording, kind, component, count(*) AS cells_n, CAST(sum(n) AS BIGINT) AS points_n FROM every JOIN cells USING (recording, id) GROUP BY ALL""")
def streak_pieces(t):
    """AGG-17: the neighbour-count rule that splits thin streaks off."""
    _, cells = pc.occupied_cells(t.points, "recording", 0.3)
    labels = pc.piece_labels(cells, "recording", neighbours=3)
    rest = F.col("component") >= (1 << 60)
    return labels.groupBy(
        "recording", F.when(rest, "rest").otherwise("chain").alias("kind"),
        F.when(rest, F.col("component") - (1 << 60)).otherwise(F.col("component")).alias("component"),
    ).agg(F.count("*").alias("cells_n"), F.sum("points").alias("points_n"))


@query("largest_pieces", f"""
    WITH RECURSIVE {CELLS_SQL},
    reach AS (SELECT recording, id AS a, id AS b FROM cells UNION SELECT r.recording, r.a, t.b FROM reach r JOIN touch t ON t.recording = r.recording AND t.a = r.b),
    comp AS (SELECT recording, a AS id, min(b) AS component FROM reach GROUP BY ALL),
    sizes AS (SELECT recording, component, sum(n) AS piece_points FROM comp JOIN cells USING (recording, id) GROUP BY ALL),
    ranks AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY piece_points DESC, component) - 1 AS rank FROM sizes)
    SELECT p.recording, p.point, rank < 2 AND piece_points >= 5 AS kept FROM placed p JOIN comp c ON c.recording = p.recording AND c.id = (ix * 1048576 + iy) * 1048576 + iz JOIN ranks r ON r.recording = c.recording AND r.component = c.component""")
def largest_pieces(t):
    """TOP-01: points in the largest pieces that are big enough."""
    return pc.largest_pieces(t.points, "recording", 0.3, keep=2, min_points=5).select("recording", "point", "kept")


NEAR_SQL = "sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2)"


@query("radius_outliers", f"""
    SELECT a.recording, a.point, count(*) AS neighbours, count(*) > 4 AS kept FROM points a JOIN points b ON a.recording = b.recording AND {NEAR_SQL} <= 5e-1 GROUP BY ALL""")
def radius_outliers(t):
    """AGG-18: points with too few neighbours inside a radius."""
    return pc.radius_keep(t.points, "recording", "point", 0.5, 4)


@query("statistical_outliers", f"""
    WITH d AS (SELECT a.recording, a.point, {NEAR_SQL} AS d, row_number() OVER (PARTITION BY a.recording, a.point ORDER BY {NEAR_SQL}, b.point) AS k FROM points a JOIN points b ON a.recording = b.recording),
    m AS (SELECT recording, point, avg(d) AS mean_m FROM d WHERE k <= 8 GROUP BY ALL), s AS (SELECT recording, avg(mean_m) AS a, stddev_samp(mean_m) AS s FROM m WHERE mean_m > 0 GROUP BY recording)
    SELECT recording, point, mean_m, mean_m > 0 AND mean_m < a + 2 * s AS kept FROM m JOIN s USING (recording)""", doubles="mean_m")
def statistical_outliers(t):
    """AGG-18: points whose neighbours lie unusually far."""
    return pc.statistical_keep(t.points, "recording", "point", neighbours=8)


@query("density_clusters", f"""
    WITH RECURSIVE near AS (SELECT a.recording, a.point AS a, b.point AS b, {NEAR_SQL} AS d FROM points a JOIN points b ON a.recording = b.recording AND {NEAR_SQL} <= 35e-2),
    core AS (SELECT recording, a AS point FROM near GROUP BY ALL HAVING count(*) >= 3),
    e AS (SELECT n.recording, n.a, n.b FROM near n JOIN core x ON x.recording = n.recording AND x.point = n.a JOIN core y ON y.recording = n.recording AND y.point = n.b),
    reach AS (SELECT recording, point AS a, point AS b FROM core UNION SELECT r.recording, r.a, e.b FROM reach r JOIN e ON e.recording = r.recording AND e.a = r.b),
    comp AS (SELECT recording, a AS point, min(b) AS cluster FROM reach GROUP BY ALL),
    border AS (SELECT n.recording, n.a AS point, arg_min(n.b, (n.d, n.b)) AS ref FROM near n JOIN core c ON c.recording = n.recording AND c.point = n.b ANTI JOIN core z ON z.recording = n.recording AND z.point = n.a GROUP BY ALL),
    every AS (SELECT * FROM comp UNION ALL SELECT b.recording, b.point, c.cluster FROM border b JOIN comp c ON c.recording = b.recording AND c.point = b.ref)
    SELECT p.recording, p.point, e.cluster FROM points p LEFT JOIN every e ON e.recording = p.recording AND e.point = p.point""", doubles="cluster")
def density_clusters(t):
    """AGG-18: density clusters over core points; border points join their nearest core point."""
    return pc.density_clusters(t.points, "recording", "point", eps=0.35, min_points=3)


@query("piece_majority", """
    WITH RECURSIVE n AS (SELECT *, sqrt(nx*nx + ny*ny + nz*nz) AS s FROM points),
    u AS (SELECT point, recording, x, y, z, nx/s AS ux, ny/s AS uy, nz/s AS uz, k.point % 3 = 0 AS suspect FROM n k),
    e AS (SELECT a.point AS a, b.point AS b FROM u a JOIN u b ON a.recording = b.recording AND a.point <> b.point AND sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) <= 5e-1 AND abs(a.ux*b.ux + a.uy*b.uy + a.uz*b.uz) >= cos(radians(30e0))),
    reach AS (SELECT point AS a, point AS b FROM u UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
    comp AS (SELECT a AS point, min(b) AS component FROM reach GROUP BY a),
    share AS (SELECT component, avg(CASE WHEN suspect THEN 1e0 ELSE 0e0 END) AS s FROM comp JOIN u USING (point) GROUP BY component)
    SELECT point, component, s AS suspect_share, NOT suspect AND s <= 5e-1 AS kept FROM comp JOIN u USING (point) JOIN share USING (component)""", doubles="suspect_share")
def piece_majority(t):
    """AGG-19: pieces linked by nearness and aligned normals, dropped when mostly suspect."""
    size = F.sqrt("s2")
    rows = t.points.withColumn("s2", F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2).select(
        "point", "recording", "x", "y", "z", *[(F.col(c) / size).alias(c) for c in ("nx", "ny", "nz")], (F.col("point") % 3 == 0).alias("suspect")
    )
    return pc.piece_majority(rows, "recording", "point", eps=0.5).select("point", "component", "suspect_share", "kept")


@query("trial_score", """
    WITH l AS (SELECT point AS line, x, y, z, sqrt(x*x + y*y + z*z) AS len, CASE WHEN abs(z) < 5e-1 THEN 'near' ELSE 'far' END AS side FROM points WHERE nx <= 0),
    surf AS (SELECT point, x, y, z FROM points WHERE nx > 0),
    s AS (SELECT line, side, x, y, z, len, unnest(range(0, greatest(CAST(ceil((len - greatest(15e-2, 5e-2 * len) - 3e-1) / 4e-2) AS BIGINT), 0))) AS i FROM l),
    p AS (SELECT line, side, (3e-1 + i * 4e-2) * x / len AS x, (3e-1 + i * 4e-2) * y / len AS y, (3e-1 + i * 4e-2) * z / len AS z FROM s),
    h AS (SELECT side, avg(CASE WHEN EXISTS (SELECT 1 FROM surf c WHERE (p.x-c.x)**2 + (p.y-c.y)**2 + (p.z-c.z)**2 <= 4e-2) THEN 1e0 ELSE 0e0 END) AS blocked_share FROM p GROUP BY side),
    d AS (SELECT line, side, min(sqrt((l.x-c.x)**2 + (l.y-c.y)**2 + (l.z-c.z)**2)) AS d FROM l, surf c GROUP BY ALL),
    m AS (SELECT side, quantile_cont(d, 0.5) AS median_m, avg(CASE WHEN d <= 1e-1 THEN 1e0 ELSE 0e0 END) AS within_10cm FROM d GROUP BY side)
    SELECT side, blocked_share, median_m, within_10cm, (SELECT count(*) FROM surf) AS surface_points, (SELECT count(*) FROM surf WHERE y < -6e-1) AS below_floor,
           (SELECT count(*) FROM surf WHERE abs(y + 5e-1) <= 5e-2) AS near_floor, (SELECT avg(CASE WHEN EXISTS (SELECT 1 FROM surf c WHERE (p.x-c.x)**2 + (p.y-c.y)**2 + (p.z-c.z)**2 <= 25e-4) THEN 1e0 ELSE 0e0 END) FROM points p) AS covered
    FROM h JOIN m USING (side)""", doubles="blocked_share median_m within_10cm covered")
def trial_score(t):
    """AGG-52: one surface scored by sight lines, tracked points, coverage and floor counts."""
    surface = t.points.where("nx > 0")
    lines = t.points.where("nx <= 0").select(
        F.col("point").alias("line"), "x", "y", "z", *[F.lit(0.0).alias(f"o{c}") for c in "xyz"],
        F.when(F.abs("z") < 0.5, 1.0).otherwise(3.0).alias("depth"),
    )
    return pc.trial_score(surface, lines, t.points.withColumnRenamed("point", "sample"), floor_y=-0.5, radius=0.2)


@query("fleet_trial_score", """
    WITH l AS (SELECT recording, point AS line, x, y, z, sqrt(x*x + y*y + z*z) AS len, CASE WHEN abs(z) < 5e-1 THEN 'near' ELSE 'far' END AS side FROM points WHERE nx <= 0),
    surf AS (SELECT recording, point, x, y, z FROM points WHERE nx > 0),
    s AS (SELECT *, unnest(range(0, greatest(CAST(ceil((len - greatest(15e-2, 5e-2 * len) - 3e-1) / 4e-2) AS BIGINT), 0))) AS i FROM l),
    p AS (SELECT recording, side, (3e-1 + i * 4e-2) * x / len AS x, (3e-1 + i * 4e-2) * y / len AS y, (3e-1 + i * 4e-2) * z / len AS z FROM s),
    h AS (SELECT recording, side, avg(CASE WHEN EXISTS (SELECT 1 FROM surf c WHERE c.recording = p.recording AND (p.x-c.x)**2 + (p.y-c.y)**2 + (p.z-c.z)**2 <= 4e-2) THEN 1e0 ELSE 0e0 END) AS blocked_share FROM p GROUP BY ALL),
    d AS (SELECT l.recording, line, side, min(sqrt((l.x-c.x)**2 + (l.y-c.y)**2 + (l.z-c.z)**2)) AS d FROM l JOIN surf c USING (recording) GROUP BY ALL),
    m AS (SELECT recording, side, quantile_cont(d, 0.5) AS median_m, avg(CASE WHEN d <= 1e-1 THEN 1e0 ELSE 0e0 END) AS within_10cm FROM d GROUP BY ALL),
    f AS (SELECT recording, count(*) AS surface_points, count(*) FILTER (WHERE y < -6e-1) AS below_floor, count(*) FILTER (WHERE abs(y + 5e-1) <= 5e-2) AS near_floor FROM surf GROUP BY recording),
    c AS (SELECT recording, avg(CASE WHEN EXISTS (SELECT 1 FROM surf c WHERE c.recording = p.recording AND (p.x-c.x)**2 + (p.y-c.y)**2 + (p.z-c.z)**2 <= 25e-4) THEN 1e0 ELSE 0e0 END) AS covered FROM points p GROUP BY recording)
    SELECT * FROM h JOIN m USING (recording, side) JOIN f USING (recording) JOIN c USING (recording)""", doubles="blocked_share median_m within_10cm covered")
def fleet_trial_score(t):
    """AGG-52: surfaces of many recordings, each scored against its own lines and points."""
    lines = t.points.where("nx <= 0").select(
        "recording", F.col("point").alias("line"), "x", "y", "z", *[F.lit(0.0).alias(f"o{c}") for c in "xyz"],
        F.when(F.abs("z") < 0.5, 1.0).otherwise(3.0).alias("depth"),
    )
    measured = t.points.withColumnRenamed("point", "sample")
    return pc.trial_score(t.points.where("nx > 0"), lines, measured, floor_y=-0.5, radius=0.2, keys=["recording"])


def _kept_sql(kind: str, source: str) -> str:
    return f"SELECT recording, '{kind}' AS kind, count(*) FILTER (WHERE kept) AS kept_n FROM ({source}) AS k GROUP BY recording"


@query("outliers", " UNION ALL ".join([
    _kept_sql("radius", ORACLES["radius_outliers"]), _kept_sql("statistical", ORACLES["statistical_outliers"]),
    _kept_sql("clusters", f"SELECT recording, cluster IS NOT NULL AND count(*) OVER (PARTITION BY recording, cluster) >= 4 AS kept FROM ({ORACLES['density_clusters']}) AS c"),
]))
def outliers(t):
    """AGG-18: how many points each filter keeps."""
    points = t.points
    marked = {
        "radius": pc.radius_keep(points, "recording", "point", 0.5, 4),
        "statistical": pc.statistical_keep(points, "recording", "point", neighbours=8),
        "clusters": pc.cluster_keep(pc.density_clusters(points, "recording", "point", eps=0.35, min_points=3), "recording", 4),
    }
    out = None
    for kind, rows in marked.items():
        counted = rows.groupBy("recording").agg(F.lit(kind).alias("kind"), F.count(F.when(F.col("kept"), 1)).alias("kept_n"))
        out = counted if out is None else out.unionByName(counted)
    return out
