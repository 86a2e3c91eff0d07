"""The entry points, and a sample of queries against their SQL twins."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["voxel_downsample", "radius_search", "knn_search", "statistical_outlier", "dbscan", "curvature_knn", "boundary_knn", "duplicate_selected", "composite"])
def test_query_matches_sql(spark, name):
    for p in glob.glob(f"{SF}/*.parquet"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(duckdb.sql(entry.oracle_sql()[name]).df())
