"""Queries that once did less than the job they are named for."""

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402
from paths import SMALL
from strideframe.operators import scores, spatial  # noqa: E402


def agrees(spark, name):
    got = compare.plain(entry.queries()[name](spark, SMALL).toPandas())
    want = compare.plain(compare.duck(SMALL).execute(entry.oracle_sql()[name]).df())
    assert len(got) and compare.differences(got, want) is None
    return got


def test_bootstrap_draws_a_thousand_resamples(spark, monkeypatch):
    seen, plain = [], scores.bootstrap_interval
    monkeypatch.setattr(scores, "bootstrap_interval", lambda *a, **k: seen.append(k.get("replicates", 1000)) or plain(*a, **k))
    agrees(spark, "bootstrap_mean")
    assert seen == [1000] and "range(0, 1000)" in entry.oracle_sql()["bootstrap_mean"]


def test_candidates_are_listed_nearest_first(spark):
    got = agrees(spark, "same_class_within")
    assert {"ref", "distance", "place"} <= set(got.columns)


def test_all_references_within_reach_of_a_crowded_place(spark):
    """Copies of a place count with all their ids, blocks wholly inside the reach are opened too, and unknown places say nothing."""
    rng = np.random.default_rng(8)
    spots = [(i, int(i % 3), *map(float, rng.normal(size=3))) for i in range(240)] + [(1000 + i, 1, 0.1, 0.2, 0.3) for i in range(40)]
    spots.append((2000, 1, None, 0.0, 0.0))
    df = spark.createDataFrame(spots, "id int, k int, x double, y double, z double")
    found = spatial.pairs_within(df, df.withColumnRenamed("id", "ref"), "id", "ref", 0.8, keys=["k"], leaf=16, bucket=64).collect()
    known = [s for s in spots if s[2] is not None]
    gap = lambda a, b: float(np.sqrt(sum((np.array(a[2:]) - np.array(b[2:])) ** 2)))
    want = {(a[0], b[0]) for a in known for b in known if a[1] == b[1] and gap(a, b) <= 0.8}
    assert len(found) == len(want) and {(r.id, r.ref) for r in found} == want
