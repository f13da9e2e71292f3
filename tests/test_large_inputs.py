"""Plans whose cost was found to grow too fast on larger tables."""

import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402
from paths import SMALL
from strideframe.operators import identity, linking, scale, vote  # noqa: E402
from strideframe.plans import room, space_joins  # noqa: E402
from strideframe.plans.bindings import Tables  # noqa: E402


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["box_median", "centre_depth"])
def test_box_quantiles_come_from_one_aggregate(spark, name):
    text = plan(entry.queries()[name](spark, SMALL))
    assert "percentile_approx" not in text and "Window" not in text


def edges(spark):
    rows = [(k, a, b, 0.3 + ((a * 7 + b * 3 + k) % 11) / 20) for k in range(40) for a in range(8) for b in range(8) if (a * 5 + b + k) % 4 == 0]
    return spark.createDataFrame(rows, "image long, item long, ref long, iou double")


def test_small_keys_are_paired_without_rounds(spark, monkeypatch):
    monkeypatch.setattr(identity, "components", lambda *a: pytest.fail("rounds of joins over small keys"))
    assert identity.optimal_pairs(edges(spark), ["image"], "item", "ref", "iou").count() > 0


def test_large_keys_are_paired_alike(spark):
    totals = lambda group: {
        r.image: (r.n, round(r.s, 9)) for r in identity.optimal_pairs(edges(spark), ["image"], "item", "ref", "iou", group=group)
        .groupBy("image").agg(F.count("*").alias("n"), F.sum("iou").alias("s")).collect()
    }
    assert totals(4096) == totals(3) and len(totals(3)) == 40


def test_footprint_without_points_on_the_plane(spark, tmp_path):
    """Sixty points beside the plane, sixty with two on it, sixty on it, and too few: the query and its SQL agree."""
    rows = [(100 * r + i, r, [0.01 * i, 0.0 if i < near else 0.5, 0.02 * (i % 7), 0.1, 0.2, 0.3]) for r, near, n in ((0, 0, 60), (1, 2, 60), (2, 60, 60), (3, 9, 9)) for i in range(n)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = compare.plain(entry.queries()["footprint"](spark, str(tmp_path)).toPandas())
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert compare.differences(got, compare.plain(connection.execute(entry.oracle_sql()["footprint"]).df())) is None
    reasons = dict(zip(got["recording"], got["reason"]))
    assert reasons[0] == reasons[1] == "fewer than 3 points lie on the plane" and reasons[2] is None and reasons[3] == "fewer than 50 surface points"


def test_view_median_folds_sightings_once(spark):
    text = plan(entry.queries()["view_median"](spark, SMALL))
    assert "MapInPandas" not in text and "MapInArrow" not in text and "PythonMap" not in text


@pytest.mark.parametrize("name", ["view_evidence", "visibility_vote", "pixel_lookup"])
def test_points_and_views_are_not_paired_in_a_shuffle(spark, name):
    """Pairs of points and views met their pixel by a join, all of them shuffled; most find no measured depth there."""
    text = entry.queries()[name](spark, SMALL)._jdf.queryExecution().sparkPlan().toString()
    assert "FlatMapCoGroupsInArrow" in text and not any("Join" in line and "pcol" in line for line in text.splitlines())


def test_large_recordings_are_looked_up_alike(spark):
    """Recordings cut by cells, parts and sets of views give the rows of recordings looked up whole."""
    tables = Tables(spark, SMALL)
    points, views = space_joins.surface_of(tables), space_joins.posed_views(tables)
    rows = lambda **most: sorted(
        tuple(r) for r in vote.seen_points(points, views, tables.pixel_map, "target", space_joins.K, space_joins.HEIGHT, space_joins.WIDTH, **most)
        .select("recording", "point", "frame", "camera_z", "measured", "prow", "pcol", "ox", "oy", "oz").collect()
    )
    whole = rows()
    assert whole and rows(many_points=300) == whole and rows(many_points=300, many_pixels=4 * 48 * 64) == whole
    assert rows(many_points=5000) == whole and rows(many_pixels=20 * 48 * 64) == whole


def test_frames_of_small_keys_are_linked_without_joins(spark, monkeypatch):
    """Detections of a key pass by together; keys linked by joins give the same links and outcomes."""
    rows = [(k, "ab"[n % 2], 10 * k + n, float((n * 37 + k * 11) % 90), float((n * 53 + k * 7) % 70), 50.0 + n % 5, n % 3 > 0) for k in range(30) for n in range(9)]
    d = spark.createDataFrame(rows, "k int, label string, item long, u double, v double, diagonal double, linkable boolean")
    previous = d.where("k % 4 > 0").select("k", "label", F.col("item").alias("i"), "u", "v", "diagonal")
    current = d.select((F.col("k") - 1).alias("k"), "label", F.col("item").alias("j"), "u", "v", "linkable")
    plain = lambda tables: [sorted(map(str, df.collect())) for df in tables]
    names = lambda links, left: (links.select("k", "i", "j", "distance"), left.select("k", "i", "nearest_px", "outcome"))
    joined = plain(names(*linking.link_frames(previous, current, ["k"], most=0)))
    mixed = plain(names(*linking.link_frames(previous, current, ["k"], most=50)))
    monkeypatch.setattr(linking, "greedy_pairs", lambda *a, **k: pytest.fail("joins over small keys"))
    assert joined[0] and plain(names(*linking.link_frames(previous, current, ["k"]))) == joined == mixed


def test_policies_share_what_does_not_depend_on_them(spark, monkeypatch):
    """Duplicates of a frame and sizes of vectors were worked out once per condition, sizes once per track too."""
    rng = np.random.default_rng(6)
    rows = [{"id": n, "position": rng.normal(size=3), "box": (float(n), 0.0, n + 40.0, 40.0), "pose": np.eye(3, 4), "vector": rng.normal(size=4)} for n in range(6)]
    sizes, plain = [], identity._size
    monkeypatch.setattr(identity, "_size", lambda a: sizes.append(1) or plain(a))
    frames = [[dict(r, position=r["position"] + 0.01 * f) for r in rows] for f in range(4)]
    tracks = [identity.PolicyTracks(c) for c in identity.CONDITIONS]
    decided = [[t.frame(frame) for t in tracks] for frame in frames]
    assert len(sizes) == 24 and all(d[0] == "matched" for d in decided[-1][0]) and all(d[0] == "new" for d in decided[0][2])


def test_grid_medians_take_one_shuffle(spark):
    """Medians of frames and cells sketched, counted and ranked all pixels, four shuffles of them, and the room sized its surface twice."""
    pixels = Tables(spark, SMALL).pixels
    text = scale.grid_scale(pixels, 48, 64, minimum=50, min_cell=6)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" not in text and "Window" not in text
    made = room.sized_surface(Tables(spark, SMALL))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in made and "percentile" not in made
