"""Queries over data-quality and lineage checks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import checks
from .registry import query


@query("contract_violations", """
    WITH f AS (SELECT *, status <> 'P' AS has_pose, priority <> '1-URGENT' AS tracking FROM frames)
    SELECT recording, seq, 'pose_tracking' AS rule FROM f WHERE has_pose <> tracking
    UNION ALL SELECT recording, seq, 'quaternion' FROM f WHERE has_pose AND cents % 50 = 0 AND abs(sqrt(qx*qx + qy*qy + qz*qz + 121e-2*qw*qw) - 1) > 1e-3
    UNION ALL SELECT recording, seq, 'intrinsics' FROM f WHERE cents % 37 = 0
    UNION ALL SELECT recording, seq, 'points_without_pose' FROM f WHERE cents % 5 > 0 AND NOT has_pose
    UNION ALL SELECT recording, seq, 'depth_size' FROM f WHERE cents % 23 = 0
    UNION ALL SELECT recording, seq, 'projection' FROM f WHERE (cents % 10) * 12e-2 > 5e-1""")
def contract_violations(t):
    """CHK-01: frame contract rules, one row per broken rule."""
    w = F.when(F.col("cents") % 50 == 0, F.col("qw") * 1.1).otherwise(F.col("qw"))
    rows = t.frames.withColumns({
        "has_pose": F.col("status") != "P",
        "tracking": F.when(F.col("priority") != "1-URGENT", "TRACKING").otherwise("PAUSED"),
        "fx": F.when(F.col("cents") % 37 == 0, 0.0).otherwise(500.0), "fy": F.lit(500.0),
        "point_count": F.col("cents") % 5, "width": F.lit(64), "height": F.lit(48),
        "depth_bytes": F.when(F.col("cents") % 23 == 0, 9000).otherwise(9216),
    })
    rules = checks.frame_rules([F.col("qx"), F.col("qy"), F.col("qz"), w])
    shift = (F.col("cents") % 10) * 0.12
    rules |= checks.point_rule(F.lit(100.0) + shift, F.lit(50.0), F.lit(100.0), F.lit(50.0))
    return checks.violations(rows, ["recording", "seq"], rules)


@query("sequence_gaps", """
    SELECT recording, count(*) AS frames, max(k) + 1 - count(DISTINCT k) AS missing, count(*) - count(DISTINCT k) AS repeated
    FROM stamps GROUP BY recording""")
def sequence_gaps(t):
    """CHK-02: how many numbers are missing and repeated per recording."""
    return checks.sequence_summary(t.stamps, ["recording"], "k")


@query("missing_numbers", """
    WITH top AS (SELECT recording, max(k) AS m FROM stamps GROUP BY recording),
    every AS (SELECT recording, unnest(range(0, m)) AS missing FROM top)
    SELECT recording, missing FROM every ANTI JOIN (SELECT recording, k AS missing FROM stamps) USING (recording, missing)""")
def missing_numbers(t):
    """CHK-02: the missing numbers themselves."""
    return checks.missing_numbers(t.stamps, ["recording"], "k")


@query("ack_prefix", """
    WITH RECURSIVE m AS (SELECT recording, n, n * 10 + CASE WHEN bytes % 5 = 0 THEN 17 ELSE 0 END AS arrival FROM messages
               UNION ALL SELECT recording, n, n * 10 + 25 FROM messages WHERE bytes % 3 <> 0),
    s AS (SELECT recording, n, min(arrival) AS at FROM m WHERE n = 0 GROUP BY recording, n
          UNION ALL SELECT m.recording, m.n, min(m.arrival) FROM s JOIN m ON m.recording = s.recording AND m.n = s.n + 1 AND m.arrival > s.at GROUP BY m.recording, m.n)
    SELECT m.recording, m.n, m.arrival, CASE WHEN m.arrival = s.at THEN 'stored' WHEN m.arrival > s.at THEN 'resend' ELSE 'gap' END AS state
    FROM m LEFT JOIN s ON s.recording = m.recording AND s.n = m.n""")
def ack_prefix(t):
    """CHK-03: resends ignored, gaps refused, the acknowledged run from zero."""
    late = F.when(F.col("bytes") % 5 == 0, 17).otherwise(0)
    sent = t.messages.select("recording", "n", (F.col("n") * 10 + late).alias("arrival")).unionByName(
        t.messages.where("bytes % 3 <> 0").select("recording", "n", (F.col("n") * 10 + 25).alias("arrival"))
    )
    return checks.acknowledged(sent, ["recording"], "n", "arrival")


@query("time_reversals", """
    WITH s AS (SELECT recording, sensor, event_id, t_ns - k * 3600000000000 AS t,
                      lag(t_ns - k * 3600000000000) OVER (PARTITION BY recording, sensor ORDER BY event_id) AS p FROM stamps)
    SELECT recording, sensor, event_id, 'reversal' AS rule FROM s WHERE t < p
    UNION ALL SELECT recording, sensor, event_id, 'sensor' FROM s WHERE sensor = 'error'""")
def time_reversals(t):
    """CHK-04: per-sensor times that go backwards in arrival order; unknown sensors."""
    rows = t.stamps.withColumn("t", F.col("t_ns") - F.col("k") * 3_600_000_000_000)
    return checks.time_reversals(
        rows, ["recording", "sensor"], "event_id", "t", ["click", "view", "purchase", "signup"]
    )


@query("recording_problems", """
    WITH s AS (SELECT recording, seq, seq * 33333333 + (cents % 1000) * 100000 AS t, cents, status FROM frames),
    r AS (SELECT recording, arg_min(t, seq) AS first_t FROM s GROUP BY recording),
    l AS (SELECT *, lag(t) OVER (PARTITION BY recording ORDER BY seq) AS p FROM s),
    tr AS (SELECT recording, t + CASE WHEN (cents // 7) % 2 = 0 THEN 0 ELSE 13 END AS t FROM s WHERE status = 'F')
    SELECT recording, 'no_end' AS problem, 1e0 AS amount FROM r WHERE recording % 4 = 0
    UNION ALL SELECT recording, 'camera_order', count(*)::DOUBLE FROM l WHERE t <= p GROUP BY recording
    UNION ALL SELECT recording, 'camera_clock', (recording % 3) * 7e-1 FROM r WHERE recording % 3 = 2
    UNION ALL SELECT recording, 'no_settings', count(*)::DOUBLE FROM s WHERE NOT EXISTS (
        SELECT 1 FROM s x WHERE x.recording = s.recording AND x.t = s.t AND x.status <> 'P') GROUP BY recording
    UNION ALL SELECT recording, 'tracker_match', avg(m) FROM (SELECT tr.recording, CASE WHEN EXISTS (
        SELECT 1 FROM s x WHERE x.recording = tr.recording AND x.t = tr.t) THEN 1e0 ELSE 0e0 END AS m FROM tr) GROUP BY recording HAVING avg(m) < 5e-1""",
       doubles="amount")
def recording_problems(t):
    """CHK-05: everything that keeps a recording from being used as it is."""
    s = t.frames.select(
        "recording", "seq", (F.col("seq") * 33333333 + (F.col("cents") % 1000) * 100000).alias("t_ns"), "cents", "status"
    )
    first = s.groupBy("recording").agg(F.min_by("t_ns", "seq").alias("first"))
    recordings = first.select(
        "recording", (F.col("first") - (F.col("recording") % 3) * 700_000_000).alias("start_ns"),
        F.when(F.col("recording") % 4 != 0, F.col("first")).alias("end_ns"),
    )
    stamps = s.select("recording", F.lit("camera").alias("stream"), "seq", "t_ns")
    settings = s.where("status <> 'P'").select("recording", "t_ns")
    tracked = s.where("status = 'F'").select(
        "recording", (F.col("t_ns") + F.when(F.expr("(cents div 7) % 2 = 0"), 0).otherwise(13)).alias("t_ns")
    )
    return checks.recording_problems(recordings, stamps, settings, tracked)


@query("membership_diff", """
    SELECT doc_id, 'documents' AS only_in FROM documents ANTI JOIN labels USING (doc_id)
    UNION ALL SELECT doc_id, 'labels' FROM labels ANTI JOIN documents USING (doc_id)""")
def membership_diff(t):
    """CHK-06: keys held by one side only."""
    return checks.membership_diff(t.documents, t.labels, "doc_id", ("documents", "labels"))


@query("repeated_keys", """
    SELECT l_orderkey, l_linenumber, count(*) AS "rows" FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def repeated_keys(t):
    """CHK-07: keys that are not unique."""
    return checks.repeated_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


REVISION_SQL = """rev AS (SELECT o_custkey AS origin, o_orderkey AS node, CASE
        WHEN CAST(round(o_totalprice * 100) AS BIGINT) % 11 = 0 THEN o_orderkey
        WHEN CAST(round(o_totalprice * 100) AS BIGINT) % 13 = 0 THEN o_orderkey + 1000000000
        WHEN CAST(round(o_totalprice * 100) AS BIGINT) % 17 = 0 THEN NULL
        ELSE lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS parent FROM orders)"""


@query("revision_chain", f"""
    WITH RECURSIVE {REVISION_SQL},
    grounded AS (SELECT origin, node FROM rev r WHERE parent IS NULL OR NOT EXISTS (SELECT 1 FROM rev p WHERE p.origin = r.origin AND p.node = r.parent)
                 UNION SELECT r.origin, r.node FROM rev r JOIN grounded g ON g.origin = r.origin AND g.node = r.parent)
    SELECT origin, -1e0 AS node, 'roots' AS problem FROM rev GROUP BY origin HAVING count(*) FILTER (WHERE parent IS NULL) <> 1
    UNION ALL SELECT origin, node, 'missing_parent' FROM rev r WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rev p WHERE p.origin = r.origin AND p.node = r.parent)
    UNION ALL SELECT origin, node, 'cycle' FROM rev r WHERE NOT EXISTS (SELECT 1 FROM grounded g WHERE g.origin = r.origin AND g.node = r.node)""", doubles="node")
def revision_chain(t):
    """CHK-07: pose-revision chains with several roots, missing parents or cycles."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    chain = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    parent = (
        F.when(cents % 11 == 0, F.col("o_orderkey")).when(cents % 13 == 0, F.col("o_orderkey") + 1_000_000_000)
        .when(cents % 17 == 0, F.lit(None)).otherwise(chain)
    )
    rows = t.orders.select(F.col("o_custkey").alias("origin"), F.col("o_orderkey").alias("node"), parent.alias("parent"))
    return checks.revision_problems(rows, ["origin"], "node", "parent").fillna(-1, ["node"])


@query("split_leakage", """
    SELECT sha256(text) AS source_sha, count(DISTINCT CAST(substr(source, 4) AS INTEGER) % 3) AS partitions, count(*) AS "rows"
    FROM documents GROUP BY 1 HAVING count(DISTINCT CAST(substr(source, 4) AS INTEGER) % 3) > 1""")
def split_leakage(t):
    """CHK-08: content hashes seen in more than one partition."""
    rows = t.documents.select(
        F.sha2("text", 256).alias("source_sha"), (F.substring("source", 4, 9).cast("int") % 3).alias("part")
    )
    return checks.split_leaks(rows, "source_sha", "part")


@query("derived_leakage", """
    WITH r AS (SELECT doc_id, CAST(substr(source, 4) AS INTEGER) % 3 AS part, CASE WHEN n_chars % 10 = 0 THEN doc_id - 1 WHEN n_chars % 10 = 1 THEN doc_id END AS parent FROM documents)
    SELECT r.doc_id, r.parent, CASE WHEN r.parent = r.doc_id THEN 'itself' WHEN p.doc_id IS NULL THEN 'absent' ELSE 'partition' END AS problem
    FROM r LEFT JOIN r p ON p.doc_id = r.parent WHERE r.parent IS NOT NULL AND (r.parent = r.doc_id OR p.doc_id IS NULL OR p.part <> r.part)""")
def derived_leakage(t):
    """CHK-08: derived rows whose source is in another partition."""
    parent = F.when(F.col("n_chars") % 10 == 0, F.col("doc_id") - 1).when(F.col("n_chars") % 10 == 1, F.col("doc_id"))
    rows = t.documents.select("doc_id", parent.alias("parent"), (F.substring("source", 4, 9).cast("int") % 3).alias("part"))
    return checks.derived_leaks(rows, "doc_id", "parent", "part")


@query("revisits", """
    WITH lab AS (SELECT recording, seq, cents % 5 AS instance FROM frames UNION SELECT recording, seq, (cents // 5) % 5 FROM frames),
    r AS (SELECT recording, cents % 5 AS instance, seq AS b, seq + 1 AS g, seq + 2 AS a FROM frames)
    SELECT r.recording AS session, r.instance, r.b AS before_seq, CASE WHEN fg.seq IS NULL OR fa.seq IS NULL THEN 'frames'
        WHEN NOT EXISTS (SELECT 1 FROM lab WHERE lab.recording = r.recording AND lab.seq = r.a AND lab.instance = r.instance)
             OR EXISTS (SELECT 1 FROM lab WHERE lab.recording = r.recording AND lab.seq = r.g AND lab.instance = r.instance) THEN 'labels'
        WHEN fg.status = 'P' THEN 'coverage' END AS problem
    FROM r LEFT JOIN frames fg ON fg.recording = r.recording AND fg.seq = r.g LEFT JOIN frames fa ON fa.recording = r.recording AND fa.seq = r.a""")
def revisits(t):
    """CHK-09: labelled before and after, unlabelled in a fully covered gap, ordered in one session."""
    f = t.frames.withColumnRenamed("recording", "session")
    frames = f.select("session", "seq", "t_ns", (F.col("status") != "P").alias("complete"))
    labels = f.select("session", "seq", F.explode(F.array(F.col("cents") % 5, F.expr("(cents div 5) % 5"))).alias("instance"))
    rows = f.select(
        "session", (F.col("cents") % 5).alias("instance"), F.col("seq").alias("before_seq"),
        (F.col("seq") + 1).alias("gap_seq"), (F.col("seq") + 2).alias("return_seq"),
    )
    return checks.revisit_problems(rows, frames, labels).select("session", "instance", "before_seq", "problem")


@query("hash_inventory", """
    WITH files AS (SELECT doc_id, sha256(text) AS s FROM documents),
    manifest AS (SELECT doc_id, sha256(CASE WHEN lang = 'de' THEN upper(text) || '!' ELSE text END) AS s FROM documents WHERE lang <> 'fr'
                 UNION ALL SELECT doc_id + 1000000000, 'gone' FROM labels WHERE toxic = 1)
    SELECT coalesce(f.doc_id, m.doc_id) AS doc_id, CASE WHEN f.s IS NULL THEN 'missing' WHEN m.s IS NULL THEN 'extra' ELSE 'changed' END AS problem
    FROM files f FULL JOIN manifest m ON m.doc_id = f.doc_id WHERE f.s IS NULL OR m.s IS NULL OR f.s <> m.s""")
def hash_inventory(t):
    """CHK-10: contents against a manifest of sizes and hashes."""
    described = lambda text: [F.octet_length(text).alias("bytes"), F.sha2(text, 256).alias("sha256")]
    files = t.documents.select("doc_id", *described(F.col("text")))
    altered = F.when(F.col("lang") == "de", F.concat(F.upper("text"), F.lit("!"))).otherwise(F.col("text"))
    manifest = t.documents.where("lang <> 'fr'").select("doc_id", *described(altered)).unionByName(
        t.labels.where("toxic = 1").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), F.lit(4).alias("bytes"), F.lit("gone").alias("sha256"))
    )
    return checks.inventory_diff(files, manifest, "doc_id")


@query("status_counts", """
    WITH c AS (SELECT source, CASE lang WHEN 'en' THEN 'PASS' WHEN 'de' THEN 'FAIL' WHEN 'fr' THEN 'SKIPPED' ELSE 'MAYBE' END AS status,
                      CASE WHEN n_chars % 2 = 0 THEN 'why' END AS reason FROM documents)
    SELECT source, status, count(*) AS checks, count(*) FILTER (WHERE status = 'MAYBE') AS unknown_status,
           count(*) FILTER (WHERE status IN ('FAIL', 'SKIPPED') AND reason IS NULL) AS without_reason FROM c GROUP BY source, status""")
def status_counts(t):
    """CHK-11: device-check reports counted per status, broken rows counted too."""
    status = (
        F.when(F.col("lang") == "en", "PASS").when(F.col("lang") == "de", "FAIL")
        .when(F.col("lang") == "fr", "SKIPPED").otherwise("MAYBE")
    )
    rows = t.documents.select("source", status.alias("status"), F.when(F.col("n_chars") % 2 == 0, "why").alias("reason"))
    return checks.status_report(rows, ["source"])


@query("scope_fingerprint", """
    WITH d AS (SELECT lang, CAST('0x' || substr(sha256(doc_id || ':' || text), 1, 15) AS HUGEINT) AS d FROM documents)
    SELECT lang, count(*) AS items, sha256(count(*) || ':' || CAST(sum(d) AS VARCHAR)) AS fingerprint FROM d GROUP BY lang""")
def scope_fingerprint(t):
    """CHK-12: fingerprint of the scored items in their order."""
    return checks.fingerprint(t.documents, ["lang"], "doc_id", F.col("text"))


@query("ledger_equals_store", """
    WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders),
    b AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, o_orderstatus FROM orders WHERE o_orderpriority <> '1-URGENT')
    SELECT *, 'ledger' AS only_in FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT *, 'store' FROM (FROM b EXCEPT ALL FROM a)""")
def ledger_equals_store(t):
    """CHK-12: decisions in the ledger and the store compared both ways."""
    a = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    b = t.orders.where("o_orderpriority <> '1-URGENT'").select(
        "o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("o_custkey"),
        "o_orderstatus",
    )
    return checks.table_differences(a, b, ("ledger", "store"))


@query("ledger_conflicts", """
    WITH o AS (SELECT event_id, recording, value, sensor, k % 10 AS object_id FROM stamps
               UNION ALL SELECT event_id, recording, CASE WHEN k % 10 = 0 THEN value + 1 ELSE value END, sensor, k % 10 FROM stamps WHERE sensor = 'click')
    SELECT event_id AS observation_id, 'payload' AS problem FROM o GROUP BY event_id HAVING count(DISTINCT value) > 1
    UNION ALL SELECT event_id, 'owner' FROM o WHERE sensor = 'purchase' AND NOT EXISTS (
        SELECT 1 FROM o x WHERE x.sensor = 'signup' AND x.recording = o.recording AND x.object_id = o.object_id)""")
def ledger_conflicts(t):
    """CHK-13: replays with a changed payload and matches to unknown objects."""
    base = t.stamps.select("event_id", "recording", "value", "sensor", (F.col("k") % 10).alias("object_id"))
    replay = base.where("sensor = 'click'").withColumn(
        "value", F.when(F.col("object_id") == 0, F.col("value") + 1).otherwise(F.col("value"))
    )
    rows = base.unionByName(replay).select(
        F.col("event_id").alias("observation_id"), "recording", "object_id",
        F.to_json(F.struct("recording", "value", "sensor")).alias("payload"),
        F.when(F.col("sensor") == "purchase", "matched").otherwise("new").alias("outcome"), "sensor",
    )
    owners = rows.where("sensor = 'signup'").select("recording", "object_id")
    return checks.ledger_problems(rows, owners, ["recording"])


@query("rejected_proposals", """
    SELECT image, CASE WHEN NOT (x1 >= 0 AND y1 >= 0 AND x2 <= 600 AND y2 <= 380 AND x2 > x1 AND y2 > y1) THEN 'box'
                       WHEN cls = 'R' THEN 'class' WHEN confidence > 1 - 15e-2 THEN 'score' ELSE 'kept' END AS verdict, count(*) AS proposals
    FROM boxes GROUP BY ALL""")
def rejected_proposals(t):
    """CHK-14: proposals outside the image or with a bad class or score, counted per image."""
    rows = t.boxes.withColumn("confidence", F.when(F.col("confidence") > 0.85, F.lit(1.5)).otherwise(F.col("confidence")))
    return checks.proposal_counts(rows, ["image"], 600.0, 380.0, ["A", "N"])


@query("one_camera_match", """
    WITH r AS (SELECT l_orderkey AS k, count(*) AS records, max(l_quantity * 10) AS x1, max(l_quantity * 10 + 300) AS x2 FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey)
    SELECT o_orderkey AS capture, coalesce(records, 0) AS records, CASE WHEN records IS NULL THEN 'no_record' WHEN records > 1 THEN 'many_records'
           WHEN x2 > 640 THEN 'rectangle' END AS reason FROM orders LEFT JOIN r ON k = o_orderkey""")
def one_camera_match(t):
    """CHK-15: each capture must match exactly one camera record with a nested rectangle."""
    captures = t.orders.select(F.col("o_orderkey").alias("capture"))
    records = t.lineitem.where("l_returnflag = 'A'").select(
        F.col("l_orderkey").alias("capture"), (F.col("l_quantity") * 10).alias("x1"), F.lit(0.0).alias("y1"),
        (F.col("l_quantity") * 10 + 300).alias("x2"), F.lit(480.0).alias("y2"),
    )
    return checks.camera_matches(captures, records, "capture", 640.0, 480.0).select("capture", "records", "reason")
