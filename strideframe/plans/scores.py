"""Queries over depth, distance, mask and ranking scores."""

from pyspark.sql import functions as F

from ..functions import boxes as b
from ..functions import vectors as v
from ..functions.lcg import mixed_sql
from ..operators import pixels as px
from ..operators import references as refs
from ..operators import scores
from ..operators import spatial as sp
from ..session import checkpointed
from .registry import query
from .scalars import PIXEL_WORLD_SQL, intrinsics, view_pose

FRAME = ["recording", "frame"]
SCORE = "abs_rel rmse_m delta1 valid_coverage"


@query("distance_totals", """
    WITH d AS (SELECT a.recording, a.point, min(sqrt((a.x-c.x)**2 + (a.y-c.y)**2 + (a.z-c.z)**2)) AS d FROM points a JOIN points c ON a.recording = c.recording AND c.nx > 0 WHERE a.nx <= 0 GROUP BY ALL)
    SELECT recording, count(*) AS samples, avg(d) AS mean_m, sqrt(avg(d * d)) AS rmse_m, max(d) AS max_m, avg(CASE WHEN d <= 35e-2 THEN 1e0 ELSE 0e0 END) AS within_share FROM d GROUP BY recording""",
       doubles="mean_m rmse_m max_m within_share")
def distance_totals(t):
    """AGG-20: distance totals and share within a threshold."""
    near = sp.nearest_k(t.points.where("nx <= 0"), t.points.where("nx > 0").withColumnRenamed("point", "ref"), "point", "ref", keys=["recording"])
    return scores.distance_totals(near, ["recording"], "distance", 0.35)


REGION_SQL = """regions AS (SELECT * FROM (VALUES ('overall', -1e0, 1e9), ('0-1m', 0e0, 1e0), ('1-2m', 1e0, 2e0), ('2-4m', 2e0, 4e0)) AS x(region, lo, hi)),
    pairs AS (SELECT recording, frame, region, target AS r, CASE WHEN confidence >= 32 THEN learned END AS p FROM pixels, regions WHERE target >= lo AND (target < hi OR (region = '2-4m' AND target <= hi))),
    frame_scores AS (SELECT recording, frame, region, count(*) AS reference_pixels, count(p) AS scored_pixels, avg(abs(p - r) / r) AS abs_rel, sqrt(avg((p - r)**2)) AS rmse_m,
                     avg(CASE WHEN p IS NULL THEN NULL WHEN greatest(p / r, r / p) < 125e-2 THEN 1e0 ELSE 0e0 END) AS delta1 FROM pairs GROUP BY recording, frame, region)"""


def frame_scores(t):
    rows = t.pixels.withColumn("learned", F.when(F.col("confidence") >= 32, F.col("learned")))
    return scores.depth_scores(rows, FRAME, "learned", "target")


@query("depth_scores", f"WITH {REGION_SQL} SELECT *, scored_pixels / reference_pixels AS valid_coverage FROM frame_scores", doubles=SCORE)
def depth_scores(t):
    """AGG-22: depth scores overall and per distance band."""
    return frame_scores(t)


@query("pooled_scores", f"""WITH {REGION_SQL}
    SELECT recording, region, CAST(sum(reference_pixels) AS BIGINT) AS reference_pixels, CAST(sum(scored_pixels) AS BIGINT) AS scored_pixels, sum(scored_pixels) / sum(reference_pixels) AS valid_coverage,
           sum(abs_rel * scored_pixels) / sum(scored_pixels) FILTER (WHERE abs_rel IS NOT NULL) AS abs_rel, sqrt(sum(rmse_m**2 * scored_pixels) / sum(scored_pixels) FILTER (WHERE rmse_m IS NOT NULL)) AS rmse_m,
           sum(delta1 * scored_pixels) / sum(scored_pixels) FILTER (WHERE delta1 IS NOT NULL) AS delta1 FROM frame_scores GROUP BY recording, region""", doubles=SCORE)
def pooled_scores(t):
    """AGG-23: frame scores pooled by scored pixels."""
    return scores.pooled_scores(frame_scores(t), ["recording", "region"])


@query("ratio_quantiles", """
    WITH r AS (SELECT recording, confidence >= 128 AS supported, CAST(floor(target) AS DOUBLE) AS from_m, learned / target AS ratio FROM pixels WHERE target < 4)
    SELECT recording, supported, from_m, count(*) AS samples, quantile_cont(ratio, 0.25) AS p25, quantile_cont(ratio, 0.5) AS median_ratio, quantile_cont(ratio, 0.75) AS p75 FROM r GROUP BY ALL""", doubles="p25 median_ratio p75")
def ratio_quantiles(t):
    """AGG-24: learned / tracked quartiles by support and distance bin."""
    rows = t.pixels.withColumn("supported", F.col("confidence") >= 128)
    return scores.ratio_quantiles(
        rows, ["recording", "supported"], F.col("learned") / F.col("target"), F.col("target"), [0.0, 1.0, 2.0, 3.0, 4.0]
    )


@query("scale_report", """
    WITH f AS (SELECT recording, frame, count(*) AS pairs, quantile_cont(learned / target, 0.5) AS scale_ratio, regr_slope(target, learned) AS factor, regr_intercept(target, learned) AS shift FROM pixels GROUP BY ALL),
    e AS (SELECT recording, frame, avg(abs(factor * learned + shift - target) / target) AS fitted_abs_rel FROM pixels JOIN f USING (recording, frame) WHERE factor * learned + shift > 0 GROUP BY ALL)
    SELECT recording, frame, pairs, scale_ratio, factor, shift, fitted_abs_rel FROM f JOIN e USING (recording, frame)""", doubles="scale_ratio factor shift fitted_abs_rel")
def scale_report(t):
    """AGG-25: how far off each frame's scale is and the error a perfect scale would leave."""
    return scores.scale_report(t.pixels, FRAME)


@query("run_scale_summary", """
    WITH f AS (SELECT recording, frame, quantile_cont(learned / target, 0.5) AS r FROM pixels GROUP BY ALL),
    c AS (SELECT *, abs(ln(r) - ln(lag(r) OVER (PARTITION BY recording ORDER BY frame))) AS c FROM f)
    SELECT recording, count(*) AS frames, min(r) AS min_ratio, max(r) AS max_ratio, quantile_cont(r, 0.5) AS median_ratio, quantile_cont(c, 0.5) AS median_frame_change FROM c GROUP BY recording""",
       doubles="min_ratio max_ratio median_ratio median_frame_change")
def run_scale_summary(t):
    """AGG-25: least, middle and greatest frame ratio of a run and its typical frame change."""
    return scores.run_scale_summary(scores.scale_report(t.pixels, FRAME), ["recording"], "frame")


@query("spearman", """
    WITH f AS (SELECT recording, seq, ln(1 + (cents % 9973) / 1e4) AS s, (cents % 31) / 1e2 AS e FROM frames WHERE status <> 'P'),
    d AS (SELECT recording, abs(s - lag(s) OVER w) AS sc, abs(e - lag(e) OVER w) AS ec FROM f WINDOW w AS (PARTITION BY recording ORDER BY seq)),
    r AS (SELECT recording, rank() OVER (PARTITION BY recording ORDER BY sc) + (count(*) OVER (PARTITION BY recording, sc) - 1) / 2 AS ra,
                 rank() OVER (PARTITION BY recording ORDER BY ec) + (count(*) OVER (PARTITION BY recording, ec) - 1) / 2 AS rb FROM d WHERE sc IS NOT NULL)
    SELECT recording, count(*) AS pairs, CASE WHEN count(*) >= 3 THEN corr(ra, rb) END AS spearman FROM r GROUP BY recording""", doubles="spearman")
def spearman(t):
    """AGG-26: rank correlation of scale changes with error changes."""
    rows = t.frames.where("status <> 'P'").select(
        "recording", "seq", (1 + (F.col("cents") % 9973) / 1e4).alias("scale"), ((F.col("cents") % 31) / 1e2).alias("error")
    )
    return scores.jump_correlation(rows, ["recording"], "seq", "scale", "error")


@query("placement_quantiles", """
    WITH p AS (SELECT a.x1, a.y1, a.x2, a.y2, c.x1 AS rx1, c.y1 AS ry1, c.x2 AS rx2, c.y2 AS ry2, (c.x2-c.x1)*(c.y2-c.y1) AS ra,
            greatest(least(a.x2, c.x2) - greatest(a.x1, c.x1), 0) * greatest(least(a.y2, c.y2) - greatest(a.y1, c.y1), 0) AS s, (a.x2-a.x1)*(a.y2-a.y1) AS sa
        FROM boxes a JOIN boxes c ON a.image = c.image AND a.cls = c.cls AND a.half = 'O' AND c.half = 'F'),
    k AS (SELECT *, s / (sa + ra - s) AS iou, sqrt(((x1+x2)/2 - (rx1+rx2)/2)**2 + ((y1+y2)/2 - (ry1+ry2)/2)**2) AS centre_offset, rx1 <= 2 OR ry1 <= 2 OR rx2 >= 638 OR ry2 >= 478 AS truncated,
                 CASE WHEN ra < 1024 THEN 'small' WHEN ra < 9216 THEN 'medium' ELSE 'large' END AS band FROM p WHERE s / (sa + ra - s) >= 3e-1),
    g AS (SELECT 'all' AS grp, * FROM k UNION ALL SELECT CASE WHEN truncated THEN 'truncated' ELSE 'not_truncated' END, * FROM k UNION ALL SELECT band, * FROM k WHERE NOT truncated),
    m AS (SELECT grp, 'iou' AS measure, iou AS v FROM g UNION ALL SELECT grp, 'centre_offset', centre_offset FROM g)
    SELECT grp AS "group", measure, count(*) AS n, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.9) AS p90 FROM m GROUP BY ALL""", doubles="median p10 p90")
def placement_quantiles(t):
    """AGG-28: placement quantiles for all, truncated and size groups."""
    found, known = t.boxes.where("half = 'O'"), t.boxes.where("half = 'F'").select("image", "cls", "item", "x1", "y1", "x2", "y2")
    pairs = sp.box_pairs(found, known, ["image", "cls"], "item")
    a, r = b.box(), b.box("r_")
    placed = px.placement(a, r)
    rows = pairs.select(
        placed["iou"].alias("iou"), placed["centre_offset"].alias("centre_offset"),
        b.touches_edge(r, 640, 480).alias("truncated"), b.size_band(b.area(r)).alias("band"),
    ).where("iou >= 0.3")
    groups = F.array_compact(F.array(
        F.lit("all"), F.when(F.col("truncated"), "truncated").otherwise("not_truncated"), F.when(~F.col("truncated"), F.col("band"))
    ))
    return scores.quantile_groups(rows, groups, [], ["iou", "centre_offset"])


@query("box_clutter", """
    SELECT c.image, c.item, count(o.item) AS overlapping_objects FROM boxes c LEFT JOIN boxes o ON o.image = c.image AND o.half = 'F' AND o.item <> c.item
      AND least(o.x2, c.x2) > greatest(o.x1, c.x1) AND least(o.y2, c.y2) > greatest(o.y1, c.y1) WHERE c.half = 'F' GROUP BY c.image, c.item""")
def box_clutter(t):
    """AGG-28: how many other objects overlap a reference box."""
    known = t.boxes.where("half = 'F'").select("image", "item", "x1", "y1", "x2", "y2")
    pairs = sp.box_pairs(known, known, ["image"], "item").where("item <> r_item").groupBy("image", "item").agg(F.count("*").alias("overlapping_objects"))
    return known.select("image", "item").join(pairs, ["image", "item"], "left").fillna(0, ["overlapping_objects"])


@query("box_background", """
    WITH o AS (SELECT l_orderkey // 16 AS image, (((l_orderkey % 16) * 8 + l_linenumber) * 10000000 + l_partkey) * 100000 + l_suppkey AS item,
                      l_partkey % 40 AS bx, l_suppkey % 30 AS by_, CAST(l_quantity AS BIGINT) % 12 + 3 AS w, l_linenumber + 3 AS h FROM lineitem WHERE l_linestatus = 'F'),
    e AS (SELECT *, bx + w AS bx2, by_ + h AS by2 FROM o)
    SELECT image, item, (w * h - greatest(w - 2, 0) * greatest(h - 1, 0)) / (w * h) - (w + 2) * h / ((w + 2) * h) * (1 - w * h / ((w + 2) * h)) AS excess_background, greatest(w - 2, 0) * greatest(h - 1, 0) / (w * h) AS outline_coverage FROM e""",
       doubles="excess_background outline_coverage")
def box_background(t):
    """AGG-28: excess background of a shifted box and the outline share it covers, from pixel counts.

    The outline is the w x h block at (bx, by); the reference box is two pixels wider; the predicted box is
    the block moved by (2, 1).
    """
    o = t.lineitem.where("l_linestatus = 'F'").selectExpr(
        "l_orderkey div 16 as image", "(((l_orderkey % 16) * 8 + l_linenumber) * 10000000 + l_partkey) * 100000 + l_suppkey as item",
        "l_partkey % 40 as bx", "l_suppkey % 30 as by_", "cast(l_quantity as bigint) % 12 + 3 as w", "l_linenumber + 3 as h",
    )
    outline = o.withColumn("pcol", F.explode(F.expr("sequence(bx, bx + w - 1)"))).withColumn("prow", F.explode(F.expr("sequence(by_, by_ + h - 1)")))
    moved = (F.col("pcol") >= F.col("bx") + 2) & (F.col("prow") >= F.col("by_") + 1)
    counted = outline.groupBy("image", "item", "w", "h").agg(F.count("*").alias("n"), F.count(F.when(moved, 1)).alias("covered"))
    size_p, size_r = F.col("w") * F.col("h"), (F.col("w") + 2) * F.col("h")
    return counted.select(
        "image", "item",
        ((size_p - F.col("covered")) / size_p - (size_r - F.col("n")) / size_r).alias("excess_background"),
        (F.col("covered") / F.col("n")).alias("outline_coverage"),
    )


@query("gallery_rank", """
    WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, vec_id // 50 AS part FROM embeddings),
    s AS (SELECT q.vec_id AS query, m.method, g.vec_id AS gallery, g.label AS identity,
                 CASE WHEN m.method = 'masked' AND (q.vec_id + g.vec_id) % 5 = 0 THEN NULL ELSE round_even(list_dot_product(q.v, g.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(g.v, g.v)) * 20, 0) END AS score
          FROM e q JOIN e g ON g.part = q.part + 1, (VALUES ('cosine'), ('masked')) m(method)),
    top AS (SELECT query, method, max(score) AS top_score, count(*) FILTER (WHERE score IS NULL) AS unavailable, count(*) AS gallery_size FROM s GROUP BY ALL),
    t AS (SELECT s.query, s.method, count(DISTINCT identity) AS ids, min(identity) AS id FROM s JOIN top USING (query, method) WHERE score >= top_score - 1e-6 GROUP BY ALL)
    SELECT query, method, top_score, unavailable, gallery_size, CASE WHEN ids = 1 THEN id END AS identity, coalesce(ids > 1, false) AS ambiguous FROM top LEFT JOIN t USING (query, method)""", doubles="top_score identity")
def gallery_rank(t):
    """AGG-31: best gallery score per query and method; ties between identities are ambiguous."""
    e = t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"), F.expr("vec_id div 50").alias("part"))
    gallery = e.select(F.col("vec_id").alias("gallery"), F.col("label").alias("identity"), F.col("v").alias("g"), (F.col("part") - 1).alias("part"))
    pairs = e.select(F.col("vec_id").alias("query"), "v", "part").join(gallery, "part").withColumn(
        "method", F.explode(F.array(F.lit("cosine"), F.lit("masked")))
    )
    score = F.rint(v.inner(F.col("v"), F.col("g")) / F.sqrt(v.squared_norm(F.col("v"))) / F.sqrt(v.squared_norm(F.col("g"))) * 20)
    hidden = (F.col("method") == "masked") & ((F.col("query") + F.col("gallery")) % 5 == 0)
    return scores.gallery_rank(pairs.withColumn("score", F.when(~hidden, score)), "query", "method")


@query("band_shares", """
    WITH p AS (SELECT recording, target AS d, confidence < 64 AS edge, quantity > 40 AS side_on FROM pixels),
    n AS (SELECT recording, count(*) FILTER (WHERE d < 4) AS fused, count(*) AS valid FROM p GROUP BY recording),
    k AS (SELECT recording, CASE WHEN d < 1 THEN 0e0 WHEN d < 25e-1 THEN 1e0 WHEN d < 4 THEN 25e-1 END AS from_m, * EXCLUDE (recording) FROM p)
    SELECT recording, from_m, count(*) AS pixels_n, count(*) / any_value(fused) AS fused_share, avg(CASE WHEN edge THEN 1e0 ELSE 0e0 END) AS edge_share, avg(CASE WHEN side_on THEN 1e0 ELSE 0e0 END) AS side_on_share,
           1 - any_value(fused) / any_value(valid) AS beyond_share FROM k JOIN n USING (recording) WHERE from_m IS NOT NULL GROUP BY recording, from_m""", doubles="fused_share edge_share side_on_share beyond_share")
def band_shares(t):
    """AGG-49: where pixels lie: distance bands, depth edges, side-on and beyond the far limit."""
    rows = t.pixels.withColumns({"edge": F.col("confidence") < 64, "side_on": F.col("quantity") > 40})
    return scores.band_shares(rows, ["recording"], "target", [0.0, 1.0, 2.5, 4.0], ["edge", "side_on"]).withColumnRenamed("pixels", "pixels_n")


@query("mask_overlap", """
    WITH a AS (SELECT recording, frame, prow, pcol FROM coarse_map WHERE learned > 5), c AS (SELECT recording, frame, prow, pcol FROM coarse_map WHERE target > 6),
    u AS (SELECT recording, frame, count(*) FILTER (WHERE p AND r) / count(*) AS iou FROM (SELECT coalesce(a.recording, c.recording) AS recording, coalesce(a.frame, c.frame) AS frame, a.prow IS NOT NULL AS p, c.prow IS NOT NULL AS r
        FROM a FULL JOIN c ON a.recording = c.recording AND a.frame = c.frame AND a.prow = c.prow AND a.pcol = c.pcol) GROUP BY ALL),
    an AS (SELECT a.*, count(n.prow) AS k FROM a LEFT JOIN a n ON n.recording = a.recording AND n.frame = a.frame AND abs(n.prow - a.prow) + abs(n.pcol - a.pcol) = 1 GROUP BY ALL),
    cn AS (SELECT c.*, count(n.prow) AS k FROM c LEFT JOIN c n ON n.recording = c.recording AND n.frame = c.frame AND abs(n.prow - c.prow) + abs(n.pcol - c.pcol) = 1 GROUP BY ALL),
    ae AS (SELECT * FROM an WHERE k < 4), ce AS (SELECT * FROM cn WHERE k < 4),
    pr AS (SELECT e.recording, e.frame, avg(CASE WHEN EXISTS (SELECT 1 FROM ce x WHERE x.recording = e.recording AND x.frame = e.frame AND abs(x.prow - e.prow) + abs(x.pcol - e.pcol) <= 1) THEN 1e0 ELSE 0e0 END) AS p FROM ae e GROUP BY ALL),
    rc AS (SELECT e.recording, e.frame, avg(CASE WHEN EXISTS (SELECT 1 FROM ae x WHERE x.recording = e.recording AND x.frame = e.frame AND abs(x.prow - e.prow) + abs(x.pcol - e.pcol) <= 1) THEN 1e0 ELSE 0e0 END) AS r FROM ce e GROUP BY ALL)
    SELECT recording, frame, iou, CASE WHEN coalesce(p, 0) + coalesce(r, 0) > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS boundary_f1 FROM u LEFT JOIN pr USING (recording, frame) LEFT JOIN rc USING (recording, frame)""", doubles="iou boundary_f1")
def mask_overlap(t):
    """AGG-51: mask overlap and one-pixel boundary F1."""
    return scores.mask_scores(t.coarse_map.where("learned > 5"), t.coarse_map.where("target > 6"), FRAME)


@query("mask_events", """
    WITH o AS (SELECT recording, frame, prow // 3 AS p, pcol // 5 AS r FROM coarse_map WHERE learned > 6 GROUP BY ALL),
    m AS (SELECT recording, frame, count(*) FILTER (WHERE k > 1) AS merges FROM (SELECT recording, frame, p, count(*) AS k FROM o GROUP BY ALL) GROUP BY ALL),
    s AS (SELECT recording, frame, count(*) FILTER (WHERE k > 1) AS splits FROM (SELECT recording, frame, r, count(*) AS k FROM o GROUP BY ALL) GROUP BY ALL)
    SELECT recording, frame, merges, splits FROM m JOIN s USING (recording, frame)""")
def mask_events(t):
    """AGG-51: masks that merge several references and references split over several masks."""
    predicted = t.coarse_map.where("learned > 5").withColumn("instance", F.expr("prow div 3"))
    reference = t.coarse_map.where("learned > 6").withColumn("instance", F.expr("pcol div 5"))
    return scores.instance_events(predicted, reference, FRAME)


@query("bootstrap_mean", f"""
    WITH r AS (SELECT recording, point, x, row_number() OVER (PARTITION BY recording ORDER BY point) - 1 AS i FROM points), n AS (SELECT recording, count(*) AS n, avg(x) AS mean FROM r GROUP BY recording),
    d AS (SELECT r.recording, b, {mixed_sql('i + n * b', 7)} % n AS i FROM r JOIN n USING (recording), range(0, 1000) z(b)),
    m AS (SELECT d.recording, b, avg(r.x) AS m FROM d JOIN r ON r.recording = d.recording AND r.i = d.i GROUP BY ALL)
    SELECT recording, any_value(mean) AS mean, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m JOIN n USING (recording) GROUP BY recording""", doubles="mean low high")
def bootstrap_mean(t):
    """AGG-40: seeded bootstrap interval of the mean."""
    from ..operators.ordered import ranked_by

    rows = ranked_by(t.points.select("recording", "point", "x"), ["recording"], "point", []).withColumn("i", F.col("ordinal") - 1)
    return scores.bootstrap_interval(rows, ["recording"], "x", "i", replicates=1000, seed=7)


@query("gap_by_lag", f"""
    WITH {PIXEL_WORLD_SQL}, lags AS (SELECT * FROM (VALUES (1), (4)) AS x(lag)),
    c AS (SELECT w.recording, v.frame, lag, cos(yaw) * (wx - tx) - sin(yaw) * wz AS cx, wy - ty AS cy, sin(yaw) * (wx - tx) + cos(yaw) * wz AS cz
          FROM world w CROSS JOIN lags JOIN views v ON v.recording = w.recording AND v.frame = w.frame - lag),
    p AS (SELECT recording, frame, lag, CAST(round_even(5e1 * cx / cz + 315e-1, 0) AS BIGINT) AS pcol, CAST(round_even(5e1 * cy / cz + 235e-1, 0) AS BIGINT) AS prow, cz FROM c WHERE cz > 5e-2),
    b AS (SELECT recording, frame, lag, prow, pcol, min(cz) AS z FROM p WHERE pcol BETWEEN 0 AND 63 AND prow BETWEEN 0 AND 47 GROUP BY ALL),
    g AS (SELECT b.recording, b.frame, b.lag, quantile_cont(abs(b.z - m.target), 0.5) AS abs_m, quantile_cont(b.z - m.target, 0.5) AS signed_m FROM b JOIN pixel_map m ON m.recording = b.recording AND m.frame = b.frame AND m.prow = b.prow AND m.pcol = b.pcol GROUP BY ALL)
    SELECT recording, CAST(lag AS INTEGER) AS lag, count(*) AS pairs, quantile_cont(abs_m, 0.5) AS median_abs_m, quantile_cont(signed_m, 0.5) AS median_signed_m FROM g GROUP BY recording, lag""", doubles="median_abs_m median_signed_m")
def gap_by_lag(t):
    """AGG-48: median surface gap per frame lag."""
    from ..operators.ordered import exact_quantiles

    views = t.views.select("recording", "frame", view_pose().alias("pose"))
    rows = refs.surface_gaps(t.spread(t.pixels), t.pixel_map, views, "target", intrinsics(), 48, 64, lags=[1, 4]).where("overlap_pixels > 0")
    keys = ["recording", "lag"]
    rows = checkpointed(rows.select(*keys, "abs_m", "signed_m"))
    return exact_quantiles(rows, keys, "abs_m", {"median_abs_m": 0.5}, count="pairs").join(
        exact_quantiles(rows, keys, "signed_m", {"median_signed_m": 0.5}), keys
    )
