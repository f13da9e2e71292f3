"""Queries over matching, counted objects, association policies and their scores."""

from pyspark.sql import functions as F

from ..functions import boxes as b
from ..functions import geometry as g
from ..operators import identity as idn
from ..operators import reports
from ..operators import scores
from ..operators import spatial as sp
from .registry import query
from .space_joins import crowd_inside

OVERLAP_SQL = """p AS (SELECT a.image, a.cls, a.item, c.item AS ref, (a.x2-a.x1)*(a.y2-a.y1) AS sa, (c.x2-c.x1)*(c.y2-c.y1) AS sc,
            greatest(least(a.x2, c.x2) - greatest(a.x1, c.x1), 0) * greatest(least(a.y2, c.y2) - greatest(a.y1, c.y1), 0) AS s
        FROM boxes a JOIN boxes c ON a.image = c.image AND a.cls = c.cls AND a.half = 'O' AND c.half = 'F'),
    e AS (SELECT image, cls, t, item, ref, s / (sa + sc - s) AS iou, row_number() OVER (PARTITION BY image, cls, t ORDER BY item, ref) AS k FROM p, (VALUES (3e-1), (5e-1)) z(t) WHERE s / (sa + sc - s) >= t),
    walk AS (SELECT DISTINCT image, cls, t, 0 AS k, CAST([] AS BIGINT[]) AS l, CAST([] AS BIGINT[]) AS r, 0e0 AS v FROM e
        UNION ALL SELECT e.image, e.cls, e.t, e.k, CASE o.take WHEN 1 THEN list_append(l, item) ELSE l END, CASE o.take WHEN 1 THEN list_append(r, ref) ELSE r END, v + o.take * iou
        FROM walk w JOIN e ON e.image = w.image AND e.cls = w.cls AND e.t = w.t AND e.k = w.k + 1, (VALUES (0), (1)) o(take) WHERE o.take = 0 OR NOT (list_contains(l, item) OR list_contains(r, ref))),
    best AS (SELECT image, cls, t, max(len(l)) AS matched, arg_max(v, (len(l), v)) AS iou_sum FROM walk GROUP BY image, cls, t)"""


def candidate_pairs(t, least=0.3):
    found, known = t.boxes.where("half = 'O'"), t.boxes.where("half = 'F'").select("image", "cls", "item", "x1", "y1", "x2", "y2")
    pairs = sp.box_pairs(found, known, ["image", "cls"], "item").withColumn("iou", b.iou(b.box(), b.box("r_")))
    return pairs.where(F.col("iou") >= least).select("image", "cls", "item", F.col("r_item").alias("ref"), "iou")


@query("optimal_pairs", f"""
    WITH RECURSIVE {OVERLAP_SQL} SELECT image, cls, t AS threshold, matched, iou_sum FROM best""", doubles="threshold iou_sum")
def optimal_pairs(t):
    """UDF-02: most matches, then most overlap, one to one per image, class and threshold."""
    levels = candidate_pairs(t).withColumn("threshold", F.explode(F.array(F.lit(0.3), F.lit(0.5)))).where("iou >= threshold")
    pairs = idn.optimal_pairs(levels, ["image", "cls", "threshold"], "item", "ref", "iou")
    return pairs.groupBy("image", "cls", "threshold").agg(F.count("*").alias("matched"), F.sum("iou").alias("iou_sum"))


@query("precision_recall", f"""
    WITH RECURSIVE {OVERLAP_SQL},
    n AS (SELECT image, cls, count(*) FILTER (WHERE half = 'O') AS detections, count(*) FILTER (WHERE half = 'F') AS refs FROM boxes GROUP BY ALL)
    SELECT n.image, n.cls, x.t AS threshold, detections, refs AS "references", coalesce(matched, 0) AS matched, refs - coalesce(matched, 0) AS missed,
           CASE WHEN n.cls <> 'R' THEN (detections - coalesce(matched, 0))::DOUBLE END AS false_detections, CASE WHEN n.cls <> 'R' AND detections > 0 THEN coalesce(matched, 0) / detections END AS precision,
           CASE WHEN n.cls <> 'R' AND refs > 0 THEN coalesce(matched, 0) / refs END AS recall
    FROM n CROSS JOIN (VALUES (3e-1), (5e-1)) x(t) LEFT JOIN best ON best.image = n.image AND best.cls = n.cls AND best.t = x.t""", doubles="threshold false_detections precision recall")
def precision_recall(t):
    """AGG-27: matched, missed and false detections per image, class and threshold."""
    found = t.boxes.where("half = 'O'").select("image", "cls", "item", "x1", "y1", "x2", "y2")
    known = t.boxes.where("half = 'F'").select("image", "cls", "item", "x1", "y1", "x2", "y2")
    nobody = found.where("false").select("image", "cls", "item")
    rows = idn.detection_counts(candidate_pairs(t), found, known, nobody, ["image", "cls"], [0.3, 0.5], F.col("cls") != "R")
    return rows.select("image", "cls", "threshold", "detections", "references", "matched", "missed", "false_detections", "precision", "recall")


@query("precision_with_crowds")
def precision_with_crowds(t):
    """AGG-27 with JOIN-10: detections inside a crowd leave the false count; totals per class and threshold."""
    found = t.boxes.where("half = 'O'").select("image", "cls", "item", "x1", "y1", "x2", "y2")
    crowds = t.boxes.where("half = 'F' and confidence > 0.7").select("image", "cls", "item", "x1", "y1", "x2", "y2")
    known = t.boxes.where("half = 'F' and confidence <= 0.7").select("image", "cls", "item", "x1", "y1", "x2", "y2")
    pairs = candidate_pairs(t).join(known.select("image", "cls", F.col("item").alias("ref")), ["image", "cls", "ref"])
    rows = idn.detection_counts(pairs, found, known, crowd_inside(found, crowds, 0.5), ["image", "cls"], [0.3, 0.5], F.lit(True))
    totals = rows.groupBy("cls", "threshold").agg(*[F.sum(c).alias(c) for c in ("references", "matched", "missed", "ignored_crowd", "false_detections")])
    return totals.withColumns({
        "precision": F.col("matched") / (F.col("matched") + F.col("false_detections")), "recall": F.col("matched") / F.col("references")
    })


def object_detections(t):
    """Detections of a walk on a lattice of places: 16 orders make a frame, open lines are detections."""
    return t.lineitem.where("l_linestatus = 'O'").selectExpr(
        "l_orderkey div 2048 as recording", "l_returnflag as cls", "l_orderkey div 16 as seq",
        "(((l_orderkey % 16) * 8 + l_linenumber) * 10000000 + l_partkey) * 100000 + l_suppkey as item", "l_orderkey div 256 as keyframe",
        "case when l_partkey % 11 <> 0 then (l_partkey % 7) * 0.6e0 + l_discount * 1.5e0 end as x",
        "case when l_partkey % 11 <> 0 then (l_suppkey % 5) * 0.6e0 + l_tax end as y",
        "case when l_partkey % 11 <> 0 then (l_partkey % 3) * 0.9e0 + l_quantity / 500e0 end as z", "5e-2 + l_discount * 9 as confidence",
    )


def object_anchors(t):
    """Keyframe anchors of those walks: created with the first frame of 16, moved 2 cm eight frames later."""
    keyframes = t.orders.selectExpr("o_orderkey div 2048 as recording", "o_orderkey div 256 as anchor_id").distinct()
    at = lambda x: F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0)], F.lit(x), *[F.lit(v) for v in (0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0)])
    made = keyframes.select("recording", (F.col("anchor_id") * 16).alias("seq"), F.lit(0).alias("rank"), "anchor_id", at(0.0).alias("pose"))
    moved = keyframes.select("recording", (F.col("anchor_id") * 16 + 8).alias("seq"), F.lit(1).alias("rank"), "anchor_id", at(0.02).alias("pose"))
    return made.unionByName(moved)


@query("object_counts")
def object_counts(t):
    """STR-04 (batch form): outcome, object id and nearest distance of every detection."""
    rows = idn.count_objects(object_detections(t), ["recording"], "cls", object_anchors(t))
    return rows.select("recording", "cls", "seq", "item", "outcome", "object_id", F.round("nearest_m", 3).alias("nearest_m"))


@query("count_report", """
    WITH r AS (SELECT user_id AS run, event_type AS label, value / 1e2 AS confidence, CASE CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 WHEN 0 THEN 'unresolved_ambiguous' WHEN 1 THEN 'new' WHEN 2 THEN 'new' ELSE 'matched' END AS outcome,
                      CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 > 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 23 END AS object_id, CASE WHEN event_id % 4 > 0 THEN value / 40 END AS near FROM events),
    s AS (SELECT run, object_id, count(*) AS n, min(label) FILTER (WHERE outcome = 'new') AS label FROM r WHERE object_id IS NOT NULL GROUP BY ALL)
    SELECT run, 'detections' AS "table", 'all' AS bucket, count(*) AS n FROM r GROUP BY run
    UNION ALL SELECT run, 'detections', 'unresolved', count(*) FROM r WHERE starts_with(outcome, 'unresolved') GROUP BY run
    UNION ALL SELECT run, 'new_by_distance', CASE WHEN near IS NULL THEN 'none' WHEN near < 7e-1 THEN '0.35-0.7 m' WHEN near < 15e-1 THEN '0.7-1.5 m' ELSE 'over 1.5 m' END, count(*) FROM r WHERE outcome = 'new' GROUP BY ALL
    UNION ALL SELECT run, 'new_by_confidence', CASE WHEN confidence < 5e-1 THEN 'under 0.5' ELSE '0.5 and over' END, count(*) FROM r WHERE outcome = 'new' GROUP BY ALL
    UNION ALL SELECT run, 'counts', label, count(*) FROM r WHERE outcome = 'new' GROUP BY ALL
    UNION ALL SELECT run, 'identities_by_sightings', CASE WHEN n >= 3 THEN '3 or more' ELSE CAST(n AS VARCHAR) END, count(*) FROM s GROUP BY ALL
    UNION ALL SELECT run, 'counts_seen_3_or_more', label, count(*) FROM s WHERE n >= 3 AND label IS NOT NULL GROUP BY ALL""")
def count_report(t):
    """AGG-29: why a run counted what it did."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = t.events.select(
        F.col("user_id").alias("run"), F.col("event_type").alias("label"), (F.col("value") / 100).alias("confidence"),
        F.when(k % 5 == 0, "unresolved_ambiguous").when((k % 5 == 1) | (k % 5 == 2), "new").otherwise("matched").alias("outcome"),
        F.when(k % 5 > 0, k % 23).alias("object_id"), F.when(F.col("event_id") % 4 > 0, F.col("value") / 40).alias("nearest_same_class_m"),
    )
    return reports.count_report(rows, "run")


@query("identity_score", """
    WITH d AS (SELECT recording, event_id, t_ns, CASE WHEN sensor <> 'error' THEN k % 7 END AS object_id, k % 6 AS instance_id, CASE WHEN k % 9 > 0 THEN value / 1e2 END AS x FROM stamps),
    p AS (SELECT recording, object_id, instance_id, count(*) AS n FROM d WHERE object_id IS NOT NULL GROUP BY ALL),
    o AS (SELECT recording, object_id, count(*) AS k, sum(n) AS n FROM p GROUP BY ALL), i AS (SELECT recording, instance_id, count(*) AS k FROM p GROUP BY ALL),
    a AS (SELECT recording, sum(n) AS matched, count(*) FILTER (WHERE k > 1) AS wrong_merges, coalesce(sum(n) FILTER (WHERE k = 1), 0) AS correct FROM o GROUP BY recording),
    w AS (SELECT recording, count(*) FILTER (WHERE k > 1) AS wrong_splits FROM i GROUP BY recording),
    s AS (SELECT recording, object_id, lag(object_id) OVER z AS po, abs(x - lag(x) OVER z) AS moved FROM d WHERE x IS NOT NULL WINDOW z AS (PARTITION BY recording, instance_id ORDER BY event_id)),
    c AS (SELECT recording, count(moved) AS comparisons, count(*) FILTER (WHERE moved IS NOT NULL AND po = object_id) AS same_object, avg(moved) AS mean_delta_m FROM s GROUP BY recording)
    SELECT recording, CAST(matched AS BIGINT) AS matched, wrong_merges, CAST(correct AS BIGINT) AS correct, wrong_splits, comparisons, same_object, mean_delta_m FROM a JOIN w USING (recording) JOIN c USING (recording)""", doubles="mean_delta_m")
def identity_score(t):
    """AGG-30: wrong merges, wrong splits, correct associations and movement between sightings."""
    rows = t.stamps.select(
        "recording", F.col("event_id").alias("observation_id"), F.when(F.col("sensor") != "error", F.col("k") % 7).alias("object_id"),
        F.when(F.col("k") % 9 > 0, F.col("value") / 100).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.col("event_id").alias("at"),
    )
    truth = t.stamps.select(F.col("event_id").alias("observation_id"), (F.col("k") % 6).alias("instance_id"))
    return scores.identity_score(rows, truth, ["recording"], "at", chunk=100_000)


@query("view_median", """
    WITH RECURSIVE f AS (SELECT device AS object, recording * 256 + seq AS pos, x * 1e-1 AS cx, z * 4 AS z, y, cents, row_number() OVER (PARTITION BY device ORDER BY recording * 256 + seq) AS i FROM frames),
    w AS (SELECT object, pos, i, [cx] AS held, true AS rep FROM f WHERE i = 1
        UNION ALL SELECT object, pos, i, CASE WHEN r THEN list_append(held, cx) ELSE held END, r FROM (SELECT f.object, f.pos, f.i, f.cx, w.held, len(list_filter(w.held, lambda h: abs(h - f.cx) <= 5e-2)) = 0 AS r FROM w JOIN f ON f.object = w.object AND f.i = w.i + 1)),
    j AS (SELECT w.object, w.pos, rep, f.y, f.z FROM w JOIN f ON f.object = w.object AND f.pos = w.pos)
    SELECT object, count(*) AS accepted, count(*) FILTER (WHERE rep) AS representatives, quantile_cont(y, 0.5) FILTER (WHERE rep) AS median_y, quantile_cont(z, 0.75) FILTER (WHERE rep) - quantile_cont(z, 0.25) FILTER (WHERE rep) AS iqr_z, arg_max(z, pos) AS last_z FROM j GROUP BY object""",
       doubles="median_y iqr_z last_z")
def view_median(t):
    """AGG-42: an object's location from independent views only."""
    unit = [F.lit(c) for c in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)]
    rows = t.frames.select(
        F.col("device").alias("object"), (F.col("recording") * 256 + F.col("seq")).alias("at"),
        g.pose(unit, [F.col("x") * 1e-1, F.lit(0.0), F.lit(0.0)]).alias("pose"), "x", "y", (F.col("z") * 4).alias("z"),
    )
    found = idn.view_locations(rows, "object", "at")
    return found.select("object", "accepted", "representatives", "median_y", "iqr_z", F.col("last.z").alias("last_z"))


@query("revised_positions", """
    WITH o AS (SELECT recording, event_id, k AS frame_id, value / 1e2 AS cx, sensor FROM stamps), v AS (SELECT DISTINCT recording, k AS frame_id FROM stamps WHERE NOT (recording % 3 = 0 AND k % 50 = 7)),
    partial AS (SELECT DISTINCT o.recording FROM o ANTI JOIN v USING (recording, frame_id))
    SELECT o.recording, event_id, CASE WHEN p.recording IS NULL THEN cx + frame_id / 1e2 END AS wx, CASE WHEN p.recording IS NOT NULL THEN 'partial revision' END AS reason FROM o LEFT JOIN partial p USING (recording)""", doubles="wx")
def revised_positions(t):
    """AGG-43: positions recomputed under a complete pose revision; a partial one is refused."""
    rows = t.stamps.select(
        "recording", F.col("k").alias("frame_id"), "event_id", (F.col("value") / 100).alias("cx"), F.lit(0.0).alias("cy"), F.lit(0.0).alias("cz")
    )
    unit = [F.lit(c) for c in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)]
    revision = t.stamps.where("not (recording % 3 = 0 and k % 50 = 7)").select("recording", F.col("k").alias("frame_id")).distinct().withColumn(
        "pose", g.pose(unit, [F.col("frame_id") / 100, F.lit(0.0), F.lit(0.0)])
    )
    return idn.revised_positions(rows, revision, ["recording"]).select("recording", "event_id", "wx", "reason")


@query("identity_policy")
def identity_policy(t):
    """UDF-03: five association policies over the same observations, decisions counted."""
    unit = [F.lit(c) for c in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)]
    vectors = t.embeddings.select(F.col("vec_id").alias("vec"), F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("appearance"))
    d = object_detections(t)
    rows = d.withColumn("vec", F.col("item") % 499).join(vectors, "vec", "left").select(
        "recording", F.expr("seq div 16").alias("segment"), "cls", "seq", F.col("item").alias("observation_id"), "x", "y", "z",
        (F.col("item") % 500).cast("double").alias("x1"), F.lit(0.0).alias("y1"), (F.col("item") % 500 + 40).cast("double").alias("x2"), F.lit(40.0).alias("y2"),
        g.pose(unit, [F.col("seq") * 0.06, F.lit(0.0), F.lit(0.0)]).alias("pose"), "appearance",
    )
    decided = idn.associate_policies(rows, ["recording", "segment"], "cls")
    return decided.groupBy("recording", "condition", "decision", "reason").agg(F.count("*").alias("n"))


@query("policy_replay")
def policy_replay(t):
    """UDF-05: decisions recomputed from the same ledger under a tighter distance; geometry stays."""
    rows = object_detections(t)
    before = idn.count_objects(rows, ["recording"], "cls").select("recording", "item", "outcome", "seq")
    after = idn.count_objects(rows, ["recording"], "cls", max_distance=0.2).select("recording", "item", "outcome", "seq")
    key = lambda df: df.withColumn("id", F.concat_ws("-", "recording", "seq", "item"))
    summary, changed = idn.replay_policy(key(before), key(after), "id", ["recording", "seq"])
    return summary.unionByName(changed.groupBy().agg(F.count("*").alias("rows")).select(
        F.lit("frozen columns").alias("before"), F.lit("changed").alias("after"), "rows"
    ))
