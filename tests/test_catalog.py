"""Catalogue entries against DuckDB on the smallest tables, and the driver contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.check_catalog import TABLES, compare

SAMPLE = [
    "S1_read_transactions", "V1_validate", "V2_summary_stats", "H15_build_features", "H15_build_features_tied_orders",
    "H15_build_features_hot_keys", "D4_score_transactions", "E3_device_syndicates", "E6_customer_profile", "T1_temporal_split",
    "C3_calibration_curve", "G2_roc_auc", "G4_threshold_grid", "X3_drift_report", "A4_fraud_by", "K1_list_transactions",
    "K3_insert_if_absent", "K7_summary_kpis", "O2_bucket_histogram", "O5_latency_percentiles_windowed", "Y3_sanitize",
    "Z2_route_dead_letters", "Z4_stream_customer_features", "Z6_stream_score",
]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, sf, name):
    status, text, _ = compare(spark, con, name, sf)
    assert status == "OK", text


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    out = entry.entry(spark)
    assert out.count() > 0 and "risk_score" in out.columns
