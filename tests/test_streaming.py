"""Every streaming operator run to the end of its input equals its batch form."""

from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from paths import SMALL
from strideframe.operators.identity import count_objects as count_batch
from strideframe.plans.bindings import Tables
from strideframe.plans.identity import object_anchors, object_detections
from strideframe.streaming import health, live


def landed(spark, df, path, files=1):
    df.repartition(files).write.mode("overwrite").parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def drained(df, name, tmp_path, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(240)
    if query.exception():
        raise query.exception()
    return df.sparkSession.table(name)


def test_tumbling_windows_equal_batch(spark, tmp_path):
    rows = Tables(spark, SMALL).stamps.select("recording", "sensor", "t_ns", F.col("event_id").alias("n"))
    stream = health.tumbling_health(landed(spark, rows, tmp_path / "in"), "1 hour", "30 days")
    got = drained(stream, "windows", tmp_path, "complete")
    assert got.exceptAll(health.tumbling_health(rows, "1 hour")).count() == 0
    assert got.count() == health.tumbling_health(rows, "1 hour").count()


def test_sessions_equal_batch(spark, tmp_path):
    rows = Tables(spark, SMALL).stamps.select("recording", "sensor", "t_ns", F.col("event_id").alias("n"))
    got = drained(health.capture_sessions(landed(spark, rows, tmp_path / "in"), "6 hours", "30 days"), "sessions", tmp_path, "complete")
    want = health.capture_sessions(rows, "6 hours")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_acknowledgement_refuses_gaps_and_resends(spark, tmp_path):
    rows = [(1, 0, "frame"), (1, 1, "imu"), (1, 1, "imu"), (1, 3, "frame"), (1, 2, "frame"), (1, 3, "end"), (1, 4, "frame"), (2, 1, "frame")]
    df = spark.createDataFrame([(r, n, k, i) for i, (r, n, k) in enumerate(rows)], "recording long, n long, kind string, arrival long").withColumn(
        "at", F.timestamp_seconds(F.col("arrival") + 1000)
    )
    got = drained(live.acknowledge(landed(spark, df, tmp_path / "in")), "acks", tmp_path).orderBy("arrival").collect()
    assert [r.state for r in got] == ["stored", "stored", "resend", "gap", "stored", "stored", "gap", "gap"]
    assert got[-2].through == 3


def test_live_update_takes_the_newest_frame_with_depth(spark, tmp_path):
    rows = [(1, 0, 5, None, True, False, 1.5), (1, 1, None, 5, True, True, None), (1, 2, None, 9, True, False, None)]
    df = spark.createDataFrame(rows, "recording long, seq long, created long, updated long, posed boolean, has_depth boolean, fitted double")
    row = drained(live.live_updates(landed(spark, df, tmp_path / "in")), "updates", tmp_path).first()
    assert (row.seq, row.received, row.corrections, row.keyframe, row.scale_source) == (1, 3, 1, 5, "none")


def test_corrections_count_until_an_update_is_taken():
    held, anchors = {}, {}
    update = live.LiveUpdate()
    update.state = SimpleNamespace(exists=lambda: "now" in held, get=lambda: held["now"], update=lambda row: held.update(now=row))
    update.anchors = SimpleNamespace(updateValue=anchors.__setitem__, containsKey=anchors.__contains__)
    names = ["seq", "created", "updated", "posed", "has_depth", "fitted"]
    triggers = [
        [(0, 5, None, True, True, 1.5)], [(1, None, 5, False, True, None), (2, None, 5, False, True, None)],
        [(3, None, 5, True, True, None)], [(4, None, None, True, True, None)],
    ]
    got = [list(update.handleInputRows((1,), iter([pd.DataFrame(rows, columns=names)]), None)) for rows in triggers]
    assert [[int(r.corrections.iloc[0]) for r in out] for out in got] == [[0], [], [3], [0]]


def test_streamed_objects_equal_batch(spark, tmp_path):
    tables = Tables(spark, SMALL)
    detections, anchors = object_detections(tables), object_anchors(tables)
    null = lambda kind: F.lit(None).cast(kind)
    events = detections.select(
        "recording", "cls", "seq", F.lit(2).alias("rank"), "item", "keyframe", "x", "y", "z", null("long").alias("anchor_id"), null("array<double>").alias("pose")
    ).unionByName(anchors.join(detections.select("recording", "cls").distinct(), "recording").select(
        "recording", "cls", "seq", "rank", F.lit(-1).cast("long").alias("item"), null("long").alias("keyframe"),
        *[null("double").alias(c) for c in "xyz"], "anchor_id", "pose"))
    # two triggers, split between whole frames
    events.where("seq < 60").coalesce(1).write.parquet(str(tmp_path / "in"))
    events.where("seq >= 60").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    got = drained(live.count_objects(stream), "objects", tmp_path)
    want = count_batch(detections, ["recording"], "cls", anchors)
    columns = ["recording", "cls", "seq", "item", "outcome", "local_id"]
    assert got.count() == want.count() > 0
    assert got.select(columns).exceptAll(want.select(columns)).count() == 0
