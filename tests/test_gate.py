"""Registered queries against their DuckDB twins on the smallest tables.

``FULL_GATE=1`` checks every query with a twin; otherwise one or two of each family.
"""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from gate import compare
from tallyhouse import registry
from tallyhouse.twins import registry as twin_registry

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "M-01_revenue M-19_ce_enrollment_rate M-44_tab_summary_inventory_replenishment M-45_health_check M-46_trend D-14_product_mix D-74_qty_leadtime_corr "
    "D-83_positive_detail A-01_channel_comparison A-09_correlation_bundle A-11_demand_by_hour_of_day T-01_review_listing G-04_state_transitions "
    "G-11_spike_skus F-02_journeys F-03_order_metrics F-04_inventory_events F-06_inventory_snapshots F-09_fifo_backorders F-10_workflow_rollup "
    "F-15_active_cart_items X-05_recommendations X-09_customer_snapshots X-11_engagement_summary W-04_variety_report_omnichannel W-08_composite_rank "
    "W-11_extract_overrides W-20_recommendations_report P-06_lead_time_dataset P-20_demand_forecast S-04_import_ndjson S-06_merge_insert_new S-16_next_ids "
    "R-04_parse_classifier_json R-07_update_review_result R-11_streaming_hourly_demand"
).split()

TWINS = twin_registry.statements()
QUERIES = {k: contract.queries()[k] for k in registry.QUERIES}
KEYS = sorted(TWINS) if os.environ.get("FULL_GATE") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in sorted(Path(SF).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_its_twin(spark, duck, key):
    frame = QUERIES[key](spark, SF)
    expected = duck.execute(TWINS[key])
    names = [d[0] for d in expected.description]
    assert compare(frame.columns, frame.collect(), names, expected.fetchall()) == ""


def test_every_twin_belongs_to_a_query():
    assert set(TWINS) <= set(QUERIES)
    without = {k for k in set(QUERIES) - set(TWINS)}
    assert all(k.startswith("W-17") for k in without)


def test_entry_has_a_stable_schema(spark):
    frame = contract.entry(spark)
    assert frame.columns[0] == "channel" and frame.count() == 3
