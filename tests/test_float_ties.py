"""Values that lie just on an edge fall on the side the SQL puts them."""

import sys
from pathlib import Path

import duckdb
import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402
from strideframe.functions import libm  # noqa: E402
from strideframe.operators.ordered import exact_quantiles  # noqa: E402

WIDER = "/root/testdata/sf0.1"


def agrees(spark, name, folder):
    got = compare.plain(entry.queries()[name](spark, str(folder)).toPandas())
    return compare.differences(got, compare.plain(compare.duck(str(folder)).execute(entry.oracle_sql()[name]).df()))


def test_room_query_with_depths_on_the_margin(spark, tmp_path):
    """Recording 1643 of a copy with shifted keys: a frame with one scale puts a depth at 1.05 times the measured one."""
    connection = duckdb.connect()
    for table, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        connection.execute(f"""COPY (SELECT {key} + 3300000 AS {key}, * EXCLUDE ({key}) FROM '{WIDER}/{table}.parquet' WHERE ({key} + 3300000) // 2048 = 1643)
            TO '{tmp_path}/{table}.parquet' (FORMAT parquet)""")
    assert agrees(spark, "room_query", tmp_path) is None


def test_medians_round_like_quantile_cont(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(k, float(v)) for k in range(200) for v in rng.normal(size=2 + 2 * (k % 9))], "k int, v double")
    table = df.toPandas()  # noqa: F841 - DuckDB reads it by its name
    want = dict(duckdb.execute("SELECT k, quantile_cont(v, 0.5) FROM table GROUP BY k".replace("table", '"table"')).fetchall())
    assert {r.k: r.m for r in exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect()} == want


def test_library_functions_are_those_of_the_sql(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(float(v),) for v in rng.uniform(0.05, 20, 20_000)] + [(None,), (0.0,), (-1.0,), (800.0,)], "v double")
    values = df.toPandas()  # noqa: F841
    want = duckdb.execute("SELECT v, CASE WHEN v > 0 THEN ln(v) END, exp(v) FROM values WHERE v BETWEEN 0.01 AND 100".replace("values", '"values"')).fetchall()
    rows = [tuple(r) for r in df.select("v", libm.log("v"), libm.exp("v")).collect()]
    assert sorted(r for r in rows if r[0] and 0.01 < r[0] < 100) == sorted(want)
    assert [r for r in rows if not r[0] or r[0] < 0 or r[0] > 100] == [(None, None, None), (0.0, None, 1.0), (-1.0, None, float(np.exp(-1))), (800.0, np.log(800.0), float("inf"))]


def test_footprint_with_one_point_on_the_plane(spark, tmp_path):
    """Copies of one point on the plane have no direction; the axes are those of an angle of zero, not of rounding noise."""
    rng = np.random.default_rng(2)
    rows = []
    for r in range(20):
        spot = [float(v) for v in rng.uniform(-0.07, 0.07, 3)]
        rows += [(1000 * r + i, r, [*spot, 0.1, 0.2, 0.3]) for i in range(203)]
        rows += [(1000 * r + 300 + i, r, [float(rng.normal(0, 0.13)), 0.3, float(rng.normal(0, 0.13)), 0.1, 0.2, 0.3]) for i in range(50)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").toPandas()  # noqa: F841
    duckdb.execute(f"COPY (SELECT vec_id, label, embedding::FLOAT[] AS embedding FROM \"table\") TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    assert agrees(spark, "footprint", tmp_path) is None
