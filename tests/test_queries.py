"""Registered queries against their check SQL at the smallest scale.

A sample of them by default; BOOKFLOW_ALL=1 runs every one. Some run again with a row limit so
small that every sample is sliced, which must not change a value.
"""

import os

import pytest

from bookflow.plans import registry
from tests.oracle import compare

PATH = os.environ.get("BOOKFLOW_DATA", "/root/testdata/sf0.001")
ENTRIES = registry.entries()
SAMPLE = (
    "trade_flow", "order_windows", "base_features_interval", "book_buckets_fine", "early_flow_masked", "market_full", "liquidity_tails",
    "order_geography", "volatility_flow", "burst_flow", "price_paths", "imbalance_persistence", "liquidity_recovery", "asof_trades",
    "order_quote_position", "flow_persistence", "second_grid", "path_shape", "trade_sequence", "window_pack", "rolling_pack", "score_panel",
    "month_bootstrap", "shape_transforms", "group_ranks", "drift_report", "guarded_grid", "prepared_dataset", "stream_complete_samples",
)
SLICED = {"simple_ofi": 150, "vpin_clock": 12, "trade_quote_state": 40, "last_bars": 150, "group_ranks": 8}


@pytest.mark.parametrize("name", ENTRIES if os.environ.get("BOOKFLOW_ALL") else SAMPLE)
def test_query_matches_check_sql(spark, name):
    fn, sql = ENTRIES[name]
    assert compare(spark, PATH, fn, sql) is None


@pytest.mark.parametrize("name", SLICED)
def test_slicing_large_samples_changes_nothing(spark, name):
    fn, sql = ENTRIES[name]
    spark.conf.set("bookflow.rowsPerSlice", str(SLICED[name]))
    try:
        assert compare(spark, PATH, fn, sql) is None
    finally:
        spark.conf.unset("bookflow.rowsPerSlice")
