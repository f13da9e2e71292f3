"""The k-d tree: bounded leaves wherever points lie, and answers equal to brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strideframe.operators import spatial

XYZ = ["x", "y", "z"]


def cloud(seed, count):
    """A dense knot, a thin wall, points on one line, repeated points and one stray point far away."""
    rng = np.random.default_rng(seed)
    parts = [
        rng.normal(0, 0.01, (count // 2, 3)), rng.uniform(-5, 5, (count // 4, 3)) * [1, 1, 0],
        np.c_[rng.uniform(0, 50, count // 8), np.full(count // 8, 2.0), np.full(count // 8, 2.0)],
    ]
    rows = np.concatenate([*parts, parts[1][:20], [[1e8, -1e8, 1e8]]])
    return pd.DataFrame(rows, columns=XYZ).assign(id=np.arange(len(rows)))


@pytest.fixture(scope="module")
def clouds(spark):
    refs = pd.concat([cloud(1, 2400).assign(key=1), cloud(2, 400).assign(key=2)])
    asks = pd.concat([cloud(3, 160).assign(key=1), cloud(4, 80).assign(key=2)])
    asks = asks.assign(id=np.arange(len(asks)) + 10_000)
    table = lambda d, name: spark.createDataFrame(d.rename(columns={"id": name}))
    return refs, asks, table(refs, "ref"), table(asks, "ask")


@pytest.mark.parametrize("bucket", [65_536, 150])
def test_leaves_stay_bounded_with_a_stray_point(spark, clouds, bucket):
    tree = spatial.KdTree(clouds[2], ["key"], "ref", leaf=8, bucket=bucket)
    sizes = tree.points.groupBy("key", "_node").count()
    assert sizes.agg(F.max("count")).first()[0] <= 8
    assert tree.points.agg(F.sum("_m")).first()[0] == len(clouds[0])
    names = [r._node for r in sizes.where("key = 1").collect()]
    assert not any(a != c and c.startswith(a) for a in names for c in names)
    assert max(map(len, names)) <= tree.depth


@pytest.mark.parametrize("bucket", [65_536, 150])
def test_answers_equal_brute_force(clouds, bucket):
    refs, asks, r, q = clouds
    first = {row.ask: row for row in spatial.nearest_k(q, r, "ask", "ref", keys=["key"], leaf=8, bucket=bucket).collect()}
    third = {row.ask: row.distance for row in spatial.nearest_k(q, r, "ask", "ref", k=3, keys=["key"], leaf=8, bucket=bucket).where("rank = 3").collect()}
    counts = {row.ask: row.neighbours for row in spatial.count_within(q, r, "ask", "ref", 0.5, keys=["key"], leaf=8, bucket=bucket).collect()}
    assert len(first) == len(third) == len(counts) == len(asks)
    for key, mine in asks.groupby("key"):
        there = refs[refs.key == key]
        for ask in mine.itertuples():
            gaps = np.sqrt(((there[XYZ].to_numpy() - [ask.x, ask.y, ask.z]) ** 2).sum(axis=1))
            best = np.sort(gaps)
            assert first[ask.id].distance == pytest.approx(best[0], abs=1e-9)
            assert third[ask.id] == pytest.approx(best[2], abs=1e-9)
            assert counts[ask.id] == (gaps <= 0.5).sum()


def test_unknown_coordinates_take_no_part(spark):
    rows = [(1, 0.0, 0.0, 0.0), (2, None, 0.0, 0.0), (3, float("nan"), 0.0, 0.0), (4, float("inf"), 0.0, 0.0)]
    refs = spark.createDataFrame(rows, "ref long, x double, y double, z double")
    asks = refs.withColumnRenamed("ref", "ask")
    assert [tuple(r) for r in spatial.nearest_k(asks, refs, "ask", "ref").collect()] == [(1, 1, 1, 0.0)]
    counts = {r.ask: r.neighbours for r in spatial.count_within(asks, refs, "ask", "ref", 1.0).collect()}
    assert counts == {1: 1, 2: 0, 3: 0, 4: 0}


def test_no_references(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "ask long, x double, y double, z double")
    refs = rows.withColumnRenamed("ask", "ref").where("ref > 1")
    assert spatial.nearest_k(rows, refs, "ask", "ref").count() == 0
    assert spatial.count_within(rows, refs, "ask", "ref", 1.0).first().neighbours == 0


def test_edges_of_the_radius_are_exact(spark):
    """Points on the edge count, the next double beyond does not; squares beyond the doubles are measured too."""
    beyond = float(np.nextafter(0.5, 1))
    rows = [(1, 0.0, 0.0, 0.0), (2, 0.5, 0.0, 0.0), (3, 0.0, beyond, 0.0), (4, 0.3, 0.4, 0.0), (5, 1e200, 0.0, 0.0)]
    refs = spark.createDataFrame(rows, "ref long, x double, y double, z double")
    counts = {r.ask: r.neighbours for r in spatial.count_within(refs.withColumnRenamed("ref", "ask"), refs, "ask", "ref", 0.5).collect()}
    gaps = np.sqrt(((np.array(rows)[:4, None, 1:] - np.array(rows)[None, :4, 1:]) ** 2).sum(2))
    assert [counts[i] for i in range(1, 6)] == [*(gaps <= 0.5).sum(1), 1]


def test_near_cells_equal_brute_force(spark, clouds):
    refs = clouds[0]
    cell = np.floor(refs[XYZ].to_numpy() / 0.2).astype(np.int64)
    table = clouds[2].withColumns(spatial.voxel(0.2))
    got = {(r.key, tuple(r.a), tuple(r.b)) for r in spatial.cells_within(table, "ref", ["ix", "iy", "iz"], 0.3, keys=["key"]).collect()}
    want = set()
    for key in (1, 2):
        at, place = cell[(refs.key == key).to_numpy()], refs[refs.key == key][XYZ].to_numpy()
        for i in range(len(at)):
            for j in np.nonzero(np.sqrt(((place - place[i]) ** 2).sum(1)) <= 0.3)[0]:
                if tuple(at[i]) != tuple(at[j]):
                    want.add((key, tuple(at[i].tolist()), tuple(at[j].tolist())))
    assert got == want
