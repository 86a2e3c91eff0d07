"""Queries of functions, generators, files and small operators against their SQL twins."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from pointloom import registry_formulas

SF = "/root/testdata/sf0.001"
MORE = ["normals_knn", "normals_oriented", "fpfh", "fpfh_distance", "feature_matches", "smooth_components", "curvature_filter", "box_select_visible", "pick_point", "convex_hull", "group_means", "running_mean"]


def rows(df):
    return sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", [*registry_formulas.QUERIES, *MORE])
def test_query_matches_sql(spark, name):
    for p in glob.glob(f"{SF}/*.parquet"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = entry.queries()[name](spark, SF).toPandas(), duckdb.sql(entry.oracle_sql()[name]).df()
    assert len(got) and rows(got) == rows(want)
