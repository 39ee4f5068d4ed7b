"""Rules, policy, privacy, validation, entities: worked numbers and invariants."""

import itertools
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from riskloom.functions import policy, privacy
from riskloom.operators import entities, store, validate
from riskloom.operators.history import COLD_START
from riskloom.plans.scoring import decide_features

BASE = {**COLD_START, "amount": 100.0, "is_unusual_hour": 0, "device_customer_count": 1, "merchant_risk_score": 0.1}


def decide(spark, p, anomaly, **changes):
    values = {**BASE, "is_new_device": 0, **changes, "calibrated_probability": p, "anomaly_score": anomaly}
    columns = [F.lit(v).alias(k) for k, v in values.items()]
    return decide_features(spark.range(1).select(*columns)).first()


def test_clean_row_is_approved(spark):
    r = decide(spark, 0.01, 0.05)
    assert r["risk_score"] < 30 and r["decision"] == "APPROVE"


def test_attack_is_blocked(spark):
    r = decide(spark, 0.92, 0.88, impossible_travel=1, travel_speed_kmh=2000.0, geo_distance_km=4000.0, txn_count_1m=3,
               txn_count_1h=6, is_new_device=1, customer_amount_zscore=6.0, amount_to_avg_ratio=9.0)
    assert r["risk_score"] >= 75 and r["decision"] == "BLOCK" and len(r["triggered_rules"]) >= 2 and r["behavior_score"] > 0.85


def test_score_stays_in_range(spark):
    for p, a, travel in itertools.product((-1.0, 0.0, 0.5, 1.0, 7.0), (-1.0, 0.3, 2.0), (0, 1)):
        assert 0.0 <= decide(spark, p, a, impossible_travel=travel)["risk_score"] <= 100.0


def test_weights_must_sum_to_one():
    with pytest.raises(ValueError):
        policy.check_weights({"ml": 0.5, "anomaly": 0.1, "behavior": 0.1, "rules": 0.1})


def test_expected_costs(spark):
    costs = policy.expected_costs(F.lit(1000.0), F.lit(0.8))
    r = spark.range(1).select(*[c.alias(n) for n, c in costs.items()]).first()
    assert (r["cost_approve"], r["cost_block"]) == (820.0, 7.0)


def test_shrinkage(spark):
    df = spark.createDataFrame([("C1", 700.0)], "customer_id string, amount double")
    people = spark.createDataFrame([("C1",), ("C2",)], "customer_id string")
    out = {r[0]: r for r in entities.shrunk_baseline(df, 5, 100.0, 30.0, people).collect()}
    assert (out["C1"]["shrunk_mean"], out["C1"]["shrunk_std"]) == (200.0, 30.0)
    assert (out["C2"]["shrunk_mean"], out["C2"]["shrunk_std"]) == (100.0, 30.0)


def test_masking(spark):
    ips = ["192.168.1.100", None, "2001:db8::1", "unknown", "", "host"]
    df = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "i int, ip string").orderBy("i")
    assert [r[0] for r in df.select(privacy.mask_ip(F.col("ip"))).collect()] == [
        "192.168.***.***", "0.0.0.0", "2001:****:****", "0.0.0.0", "0.0.0.0", "***.***.***.***"]
    tokens = spark.createDataFrame([(0, "TOKEN_4242"), (1, "123"), (2, ""), (3, None)], "i int, t string").orderBy("i")
    assert [r[0] for r in tokens.select(privacy.mask_token(F.col("t"))).collect()] == ["****-****-****-4242", "****", "TOKEN-****", "TOKEN-****"]


def test_idempotency_key(spark):
    import hashlib

    r = spark.range(1).select(privacy.idempotency_key(F.lit("C1"), F.lit(Decimal("12.5")), F.lit("2024-01-01T00:00:00"))).first()[0]
    assert r == hashlib.sha256(b"C1|12.50|2024-01-01T00:00:00|fraud-salt").hexdigest()


def test_validation_of_missing_and_empty(spark):
    df = spark.createDataFrame([("T1",)], "transaction_id string")
    report = validate.validate(df).first()
    assert not report["is_valid"] and "customer_id" in report["errors"][0]
    assert validate.validate(df.where("false")).first()["errors"] == ["Dataset is completely empty."]


def test_order_inversions_cross_slices(spark):
    stamps = [5, 4, 6, 7, 3, 8, 8, 2]
    df = spark.createDataFrame([(i, datetime(2024, 1, 1) + timedelta(seconds=s)) for i, s in enumerate(stamps)], "ingest_order long, timestamp timestamp")
    assert validate.order_inversions(df, slice_rows=2).first()[0] == 3


def test_insert_if_absent(spark):
    old = spark.createDataFrame([("T1", "k1", 0)], "transaction_id string, idempotency_key string, o int")
    new = spark.createDataFrame([("T1", "k9", 1), ("T2", "k1", 2), ("T3", "k3", 3), ("T3", "k3", 4), ("T4", "k3", 5)], old.schema)
    out = store.insert_if_absent(old, new, ["transaction_id", "idempotency_key"], ["o"]).collect()
    assert [tuple(r) for r in out] == [("T3", "k3", 3)]


def test_latest_label_wins(spark):
    rows = [("T1", "A", "LEGITIMATE", None, datetime(2024, 1, 1)), ("T1", "B", "FRAUD", None, datetime(2024, 1, 2))]
    fb = spark.createDataFrame(rows, "transaction_id string, analyst_id string, actual_label string, notes string, created_at timestamp")
    r = store.consolidate_labels(fb).first()
    assert r["is_fraud"] and r["label_source"] == "analyst:B"
