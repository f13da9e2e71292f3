"""The scored surfaces against their SQL."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402
from paths import SMALL


@pytest.mark.parametrize("name", ["trial_score", "fleet_trial_score"])
def test_scores_equal_their_sql(spark, name):
    got = compare.plain(entry.queries()[name](spark, SMALL).toPandas())
    want = compare.plain(compare.duck(SMALL).execute(entry.oracle_sql()[name]).df())
    assert len(got) and compare.differences(got, want) is None
