"""Registered queries against their SQL.

A cross-section runs by default; WATTLINE_ALL=1 runs every query. WATTLINE_SF names the data folder.
"""

import os

import pytest
from compare import compare, connect

from wattline.catalog import load

FOLDER = os.environ.get("WATTLINE_SF", "/root/testdata/sf0.01")
QUERIES, SQLS = load()
DEFAULT = (
    "feature_table pivot_demand pivot_fuel_daily fill_hours validate_bounds demand_audit keep_first_row insert_ignore refresh_some_columns asof_last_price "
    "demand_lags spike_flags news_zscores risk_zscore fill_forward_and_backward halo_chunks_on_full_grid training_samples year_over_year theme_counts "
    "news_rollup_24h risk_index dedupe_articles scores_overall diebold_mariano wilcoxon_signed_rank round_consensus cascade quantile_forecast "
    "read_region_readings read_weather stream_daily_summary"
).split()
NAMES = sorted(QUERIES) if os.environ.get("WATTLINE_ALL") else DEFAULT


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    assert compare(spark, con, FOLDER, QUERIES[name], SQLS.get(name)) is None


def test_sql_names_have_queries():
    assert set(SQLS) <= set(QUERIES)
