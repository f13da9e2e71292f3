"""Chunked windows and exact quantiles against plain NumPy."""

import numpy as np
from pyspark.sql import functions as F

from strideframe.operators.ordered import carried, exact_quantiles, ranked_by


def test_carried_matches_a_whole_window(spark):
    rng = np.random.default_rng(3)
    t = np.sort(rng.choice(1000, 200, replace=False))
    v = [None if rng.random() < 0.5 else float(i) for i in range(200)]
    df = spark.createDataFrame([(int(a), b) for a, b in zip(t, v)], "t int, v double").withColumn("k", F.lit("one"))
    out = carried(
        df, ["k"], ["t"], F.floor(F.col("t") / 37), lag={"lag": "v"}, lead={"lead": "t"}, before={"before": "v"}, after={"after": "v"},
        running={"n": F.lit(1)},
    ).orderBy("t").collect()
    last = None
    for i, row in enumerate(out):
        last = v[i] if v[i] is not None else last
        assert row.n == i + 1
        assert row.lag == (v[i - 1] if i else None)
        assert row.lead == (int(t[i + 1]) if i + 1 < 200 else None)
        assert row.before == last
        assert row.after == next((x for x in v[i:] if x is not None), None)


def test_exact_quantiles_bracket_large_groups(spark):
    rng = np.random.default_rng(5)
    groups = {0: rng.normal(size=3000), 1: np.repeat([1.0, 2.0, 2.0, 9.0], 500), 2: np.array([4.0]), 3: np.array([1.0, 2.0])}
    df = spark.createDataFrame([(k, float(x)) for k, xs in groups.items() for x in xs], "k int, v double")
    # a small accuracy makes the larger groups take the bracketed path
    for row in exact_quantiles(df, ["k"], "v", {"a": 0.5, "b": 0.1, "c": 0.93}, count="n", accuracy=400).collect():
        want = np.quantile(groups[row.k], [0.5, 0.1, 0.93])
        assert row.n == len(groups[row.k])
        np.testing.assert_allclose([row.a, row.b, row.c], want, rtol=0, atol=1e-12)


def test_ranked_by_orders_ties(spark):
    df = spark.createDataFrame([("k", v, i) for i, v in enumerate([3.0, 1.0, 1.0, 2.0])], "k string, v double, i int")
    ranks = {r.i: r.ordinal for r in ranked_by(df, ["k"], "v", ["i"]).collect()}
    assert ranks == {1: 1, 2: 2, 3: 3, 0: 4}


def test_large_keys_never_gather_in_a_join(spark, monkeypatch):
    """Brackets and summaries of large keys are broadcast whatever the optimizer's size checks say; rows of no key meet in one task."""
    from strideframe.operators import ordered

    rng = np.random.default_rng(3)
    values = {"big": rng.integers(0, 900, 3000) / 7, "flat": np.zeros(700), "small": rng.normal(size=9)}
    df = spark.createDataFrame([(k, i, float(v)) for k, column in values.items() for i, v in enumerate(column)] + [("small", 99, None), (None, 1, 1.0)], "k string, i long, v double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = exact_quantiles(df, ["k"], "v", {"a": 0.5, "b": 0.93}, count="n", accuracy=400, whole=500)
        plan = rows._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        for row in rows.collect():
            assert row.n == len(values[row.k]) and np.allclose((row.a, row.b), np.quantile(values[row.k], [0.5, 0.93]))
        summary = df.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
        for few, join in ((10, "BroadcastHashJoin"), (0, "SortMergeJoin")):
            monkeypatch.setattr(ordered, "FEW_KEYS", few)
            joined = ordered.beside(df, summary, ["k"], "n", whole=500)
            plan = joined._jdf.queryExecution().sparkPlan().toString()
            assert join in plan and joined.columns == ["k", "i", "v", "top"]
            assert sorted(map(tuple, joined.drop("v").collect())) == sorted(
                (k, i, float(column.max())) for k, column in values.items() for i in [*range(len(column)), *([99] if k == "small" else [])]
            )
        assert "_deal" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_quantile_keys_may_have_any_name(spark):
    """Keys called like the ranking's own columns once were; trial_score groups by `side`."""
    rows = [("near" if i % 2 else "far", i % 3, i % 5, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "side string, j int, v int, x double")
    for whole in (10, 1000):
        for keys in (["side"], ["j"], ["v"], ["side", "j", "v"]):
            got = {tuple(r[k] for k in keys): r.middle for r in exact_quantiles(df, keys, "x", {"middle": 0.5}, whole=whole).collect()}
            want = {}
            for row in rows:
                want.setdefault(tuple(dict(zip(("side", "j", "v"), row))[k] for k in keys), []).append(row[3])
            assert got == {k: float(np.median(v)) for k, v in want.items()}
