"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

PICK = """canonicalize filter_bbox clean_datetime clean_coordinates remove_duplicates outliers_iqr_wide validate_cleaned
summary_statistics holiday_flag time_features_helper distance_to_center grid_cell lag_features rolling_features resample_ffill
hourly_spine_sparse join_left_stats topk_values nlargest_hours heatmap_weekday_hour temporal_summary eda_numeric quality_score
geo_outliers hotspots hexbin boxplot_stats metrics_regression classification_report model_ranking encode_categorical
scale_robust train_test_split seasonal_decompose autocorrelation density_features cluster_quality""".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", PICK)
def test_query_equals_sql(spark, con, name):
    from check import compare

    msg, _ = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert msg == ""


def test_entry_and_tables(spark):
    assert entry.entry(spark).count() == 7
    assert set(entry.oracle_sql()) <= set(entry.queries())
