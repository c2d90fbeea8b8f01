"""Shape of the physical plans that matter at scale."""

import re

import pytest

from wattline.catalog import load

FOLDER = "/root/testdata/sf0.001"


def plan_of(spark, name):
    return load()[0][name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_feature_table_stays_in_the_jvm(spark):
    text = plan_of(spark, "feature_table")
    assert "Python" not in text and "Scan ExistingRDD" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BroadcastHashJoin" in text


def test_windows_are_not_partitioned_by_area_alone(spark):
    text = plan_of(spark, "feature_table")
    wide = [line for line in text.splitlines() if "Window [" in line and "demand_mw" in line]
    assert wide and all("_chunk" in line for line in wide)


@pytest.mark.parametrize("name", ["scores_by_area", "daily_summary", "pivot_fuel_daily", "validate_bounds"])
def test_aggregates_combine_before_the_shuffle(spark, name):
    assert "partial_" in plan_of(spark, name)


def test_filters_and_columns_reach_the_scan(spark):
    text = plan_of(spark, "pivot_fuel_daily")
    read = re.search(r"ReadSchema: struct<([^>]*)", text).group(1)
    assert "l_comment" not in read and "l_extendedprice" not in read


@pytest.mark.parametrize("name", ["hour_spine", "news_rollup_24h", "match_fuzzy", "articles_near_centres", "tail_event_error", "time_index"])
def test_no_cross_joins(spark, name):
    text = plan_of(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
