"""The fragment store: equal to one fusion, untouched files kept, batches taken once."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from paths import SMALL
from strideframe.operators.fusion import voxel_fuse
from strideframe.plans.bindings import Tables
from strideframe.streaming.fragments import FragmentStore


def voxels(df):
    return {(r.recording, r.fragment, r.ix, r.iy, r.iz): (r.samples, r.x) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for key, (n, x) in want.items():
        assert got[key] == (n, pytest.approx(x, abs=1e-12))


def files(path):
    return {str(f.relative_to(path)) for f in Path(path).rglob("data/**/*.parquet")}


def test_streamed_surface_equals_one_fusion(spark, tmp_path):
    points = Tables(spark, SMALL).points.select("recording", "fragment", "x", "y", "z")
    points.repartition(3).write.parquet(str(tmp_path / "in"))
    store = FragmentStore(str(tmp_path / "table"), 0.5)
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = stream.writeStream.foreachBatch(store).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(240)
    assert run.exception() is None and store.latest(spark) == 2
    same(voxels(store.surface(spark)), voxels(voxel_fuse(points, ["recording", "fragment"], 0.5)))


def table(spark, rows):
    return spark.createDataFrame(rows, "recording long, fragment long, x double, y double, z double")


def test_untouched_fragments_keep_their_files(spark, tmp_path):
    store = FragmentStore(str(tmp_path), 1.0)
    first = table(spark, [(1, 0, 0.5, 0.5, 0.5), (1, 1, 0.5, 0.5, 0.5), (2, 0, 0.5, 0.5, 0.5)])
    second = table(spark, [(1, 1, 0.7, 0.5, 0.5), (3, 0, 0.5, 0.5, 0.5)])
    store(first, 0)
    before = files(tmp_path)
    store(second, 1)
    after = files(tmp_path)
    kept = {f for f in before if "recording=1/fragment=1" not in f}
    assert kept <= after and not any("version=0/recording=1/fragment=1" in f for f in after)
    assert {tuple(r) for r in store.changed(spark).select("recording", "fragment", "samples").collect()} == {(1, 1, 2), (3, 0, 1)}
    same(voxels(store.surface(spark)), voxels(voxel_fuse(first.union(second), ["recording", "fragment"], 1.0)))
    # the same batch again, as after a failure behind its commit: nothing is counted twice, no file changes
    store(second, 1)
    assert files(tmp_path) == after
    # a batch that failed before its commit leaves files that no reader sees and the repeated batch replaces
    first.write.partitionBy("recording", "fragment").parquet(f"{tmp_path}/data/version=2")
    same(voxels(store.surface(spark)), voxels(voxel_fuse(first.union(second), ["recording", "fragment"], 1.0)))
    store(first, 2)
    same(voxels(store.surface(spark)), voxels(voxel_fuse(first.union(second).union(first), ["recording", "fragment"], 1.0)))


def test_points_without_place_or_key(spark, tmp_path):
    store = FragmentStore(str(tmp_path), 1.0)
    store(table(spark, [(1, 0, None, 0.5, 0.5), (1, 0, 0.5, 0.5, 0.5)]), 0)
    assert store.surface(spark).first().samples == 1
    store(table(spark, []), 1)
    assert store.latest(spark) == 1 and store.surface(spark).count() == 1 and store.changed(spark).count() == 0
    with pytest.raises(Exception, match="a point without fragment"):
        store(table(spark, [(1, None, 0.5, 0.5, 0.5)]), 2)
    assert store.latest(spark) == 1


def test_many_small_fragments_share_a_folder(spark, tmp_path):
    store = FragmentStore(str(tmp_path), 1.0, span=100)
    first = table(spark, [(1, f, 0.5, 0.5, 0.5) for f in range(300)])
    second = table(spark, [(1, 7, 0.7, 0.5, 0.5), (1, 299, 1.5, 0.5, 0.5)])
    store(first.coalesce(1), 0)
    before = files(tmp_path)
    assert len({Path(f).parent for f in before}) == 3
    store(second, 1)
    assert {f for f in before if "fragment=1/" in f} <= files(tmp_path)
    changed = {(r.fragment, r.ix, r.samples) for r in store.changed(spark).collect()}
    assert changed == {(7, 0, 2), (299, 0, 1), (299, 1, 1)}
    same(voxels(store.surface(spark)), voxels(voxel_fuse(first.union(second), ["recording", "fragment"], 1.0)))
