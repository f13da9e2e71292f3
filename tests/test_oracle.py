"""Registered queries against their SQL on the smallest tables; ORACLE_ALL=1 runs every one."""

import os
import sys
from pathlib import Path

import pytest

from paths import SMALL

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402

FEW = (
    "stream_stats", "sequence_gaps", "tum_text", "contract_violations", "quat_to_matrix", "edge_mask", "polygon_pixels", "interpolate_asof",
    "nearest_neighbour", "iou_pairs", "grid_scale", "visibility_vote", "signed_distance", "footprint", "depth_scores", "report_compare",
    "frame_windows", "count_report", "stream_windows",
)
NAMES = list(entry.oracle_sql()) if os.environ.get("ORACLE_ALL") else FEW


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    want = compare.duck(SMALL).execute(entry.oracle_sql()[name]).df()
    assert compare.differences(compare.plain(got), compare.plain(want)) is None


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
