"""Queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from gridloom import queries

SF = "/root/testdata/sf0.001"
TABLES = "customer part lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted((tuple(round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", ["series_scan_hourly", "gap_bridge_limited", "run_segments", "clobber_grid_highest_negative", "blend_pair_fill", "aggregate_pair_fill", "merge_weight_aggregate", "window_shapes", "grid_bilinear", "cube_blend", "brocher_vs", "column_linear", "infer_water_surface", "auto_axis"])
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.SQL[name])
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    assert plain(got.select(*names).collect()) == plain(want.select(*[f'"{n}"' for n in names]).fetchall())


def test_queries_without_sql_give_rows(spark):
    for name in ("resample_akima", "grid_bicubic", "hole_fill_curvature", "geotech_created_fields", "hetero_apply", "polygon_weight"):
        assert queries.QUERIES[name](spark, SF).count() > 0
