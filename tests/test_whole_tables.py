"""Queries read all planes and hours of their tables."""

import os

import pytest

from gridloom import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_holes_of_all_planes(spark):
    assert {r["iz"] for r in queries.QUERIES["hole_label"](spark, SF).select("iz").distinct().collect()} - {0, 1, 2}


def test_random_field_over_all_hours(spark):
    rows = queries.QUERIES["hetero_apply"](spark, SF).collect()
    want = queries.hourly(spark, SF).select("kind", "ix").collect()
    assert sorted((r["kind"], r["ix"]) for r in rows) == sorted((r["kind"], r["ix"]) for r in want)
