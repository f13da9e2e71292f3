"""Table functions called from SQL."""

import pytest

from strideframe.functions import tables
from strideframe.operators.spatial import sight_samples


@pytest.fixture(scope="module")
def sql(spark):
    tables.register(spark)
    return spark.sql


def test_ray_samples_equal_the_columns_form(spark, sql):
    rows = [(1, 0.0, 0.0, 2.0), (2, 1.0, -1.0, 0.5), (3, 0.0, 0.0, 0.0), (4, None, 0.0, 1.0), (5, float("nan"), 0.0, 1.0), (6, 0.1, 0.0, 0.0)]
    lines = spark.createDataFrame(rows, "line long, x double, y double, z double")
    got = sql("SELECT l.line, s.* FROM {lines} l, LATERAL ray_samples(0D, 0D, 0D, l.x, l.y, l.z, 0.3D, 0.04D) s", lines=lines).collect()
    want = sight_samples(lines.where("line not in (4, 5)").selectExpr("*", "0D ox", "0D oy", "0D oz"), "line").collect()
    assert len(got) == len(want) > 0
    there = {(r.line, r.sample.i): (r.x, r.y, r.z) for r in want}
    for r in got:
        assert there[(r.line, r.i)] == pytest.approx((r.x, r.y, r.z), abs=1e-12)


def test_lag_rows_look_back_inside_their_keys(spark, sql):
    rows = [(1, 0, "a"), (1, 1, "b"), (1, 1, "c"), (1, 3, "d"), (2, 2, "e"), (None, 3, "f"), (None, 4, "g"), (2, None, "h")]
    frames = spark.createDataFrame(rows, "recording long, seq long, name string")
    got = sql("SELECT name, lag, earlier.name AS before FROM lag_rows(TABLE({frames}), array('recording'), 'seq', array(1, 2))", frames=frames)
    found = {(r.name, r.lag, r.before) for r in got.collect()}
    assert {row for row in found if row[2]} == {("b", 1, "a"), ("c", 1, "a"), ("d", 2, "b"), ("d", 2, "c"), ("g", 1, "f")}
    assert got.count() == 17 and {row[0] for row in found} == set("abcdefgh")


def test_lag_rows_keep_only_the_longest_lag():
    look = tables.LagRows.func()
    for n in range(1000):
        list(look.eval({"seq": n}, [], "seq", [1, 10]))
        assert len(look.held) <= 11


@pytest.mark.parametrize("call, message", [
    ("lag_rows(TABLE({t}), array('recording'), 'nothing', array(1))", "no column nothing"),
    ("lag_rows(TABLE({t}), array('recording'), 'seq', array(0))", "positive whole numbers"),
    ("ray_samples(0D, 0D, 0D, 1D, 1D, 1D, 0.3D, 0D)", "positive constant"),
])
def test_bad_arguments_are_named_before_the_job(spark, sql, call, message):
    frames = spark.createDataFrame([(1, 0)], "recording long, seq long")
    with pytest.raises(Exception, match=message):
        sql(f"SELECT * FROM {call}", t=frames)
