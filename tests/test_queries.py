"""Registered queries against their check SQL on the smallest tables."""

import check_oracle
import pytest
from conftest import SF

import __spark_entry__ as entry

# Too few matches for these two to find anything; the check at a larger scale
# covers them.
SMALL = {"s3_frame_completeness", "d1_clip_overlaps"}


@pytest.fixture(scope="module")
def con():
    return check_oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_check(spark, con, name):
    status, count, _, note = check_oracle.compare(spark, con, name, SF)
    assert status == "ok", note
    assert count or name in SMALL


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
