"""History features: worked examples, brute force, hot-key parity, no leakage, plan shape."""

import math
import re
import random
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from riskloom.functions.columns import haversine_km
from riskloom.operators import history
from riskloom.operators.skew import SkewPolicy
from riskloom.schemas import FEATURES

T0 = datetime(2024, 3, 5, 12, tzinfo=timezone.utc)
COLUMNS = ("transaction_id string, timestamp timestamp, customer_id string, merchant_id string, amount decimal(12,2), "
           "country string, city string, lat double, lon double, device_id string, is_fraud boolean")


def row(i, at, amount=100, customer="C1", device="D1", country="IN", city="Mumbai", lat=19.076, lon=72.8777, merchant="M1"):
    return (f"T{i:05d}", at, customer, merchant, Decimal(str(amount)), country, city, lat, lon, device, False)


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def features_of(df, skew=SkewPolicy()):
    return {r["transaction_id"]: r for r in history.build_features(df, skew=skew).collect()}


HOT = SkewPolicy(hot_rows=0, max_hot_keys=0)


@pytest.mark.parametrize("skew", [SkewPolicy(), HOT])
def test_baseline_excludes_the_current_row(spark, skew):
    out = features_of(frame(spark, [
        row(1, T0 - timedelta(hours=2), 1000), row(2, T0 - timedelta(hours=1), 2000), row(3, T0, 50000)]), skew)
    assert out["T00003"]["customer_avg_amount"] == 1500.0
    assert out["T00003"]["customer_amount_zscore"] > 50
    assert out["T00003"]["txn_count_1h"] == 1  # exactly one hour ago counts
    assert out["T00001"]["is_new_device"] == 1 and out["T00001"]["txn_count_1h"] == 0
    assert out["T00001"]["customer_avg_amount"] == 1500.0 and out["T00001"]["time_since_prev_txn"] == 86400.0


@pytest.mark.parametrize("skew", [SkewPolicy(), HOT])
def test_impossible_travel(spark, skew):
    out = features_of(frame(spark, [
        row(1, T0 - timedelta(minutes=15)), row(2, T0, country="SG", city="Singapore", lat=1.3521, lon=103.8198)]), skew)
    assert out["T00002"]["impossible_travel"] == 1
    assert out["T00002"]["travel_speed_kmh"] > 1000
    assert out["T00002"]["is_new_country"] == 1


@pytest.mark.parametrize("skew", [SkewPolicy(), HOT])
def test_device_window_is_24_hours(spark, skew):
    out = features_of(frame(spark, [
        row(1, T0 - timedelta(hours=30), customer="A"), row(2, T0 - timedelta(hours=2), customer="B"),
        row(3, T0 - timedelta(hours=1), customer="C"), row(4, T0, customer="D")]), skew)
    assert out["T00004"]["device_customer_count"] == 2


def test_distances(spark):
    pairs = spark.createDataFrame([(19.076, 72.8777, 18.5204, 73.8567), (51.5074, -0.1278, 48.8566, 2.3522)], "a double, b double, c double, d double")
    km = [r[0] for r in pairs.select(haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert 110 < km[0] < 135 and 330 < km[1] < 360


def skewed_rows(n=240):
    """One customer and one device hold more than a third of the rows; times tie often."""
    rng = random.Random(7)
    rows = []
    for i in range(n):
        hot = i % 5 < 2
        at = T0 + timedelta(minutes=rng.choice([0, 1, 4, 15, 61, 1440, 10080]) * rng.randint(0, 4), seconds=rng.choice([0, 0, 30, 60]))
        rows.append(row(
            i, at, rng.randint(100, 900000) / 100, "HOT" if hot else f"C{rng.randint(0, 9)}",
            "DHOT" if rng.random() < 0.4 else f"D{rng.randint(0, 5)}", rng.choice(["IN", "SG", "US"]), rng.choice(["a", "b", "c", "d"]),
            rng.uniform(-60, 60), rng.uniform(-170, 170), f"M{rng.randint(0, 6)}"))
    return rows


def brute(rows):
    """Plain Python reading of the definitions."""
    out = {}
    for r in rows:
        tid, at, cust, _, amount, country, city, lat, lon, device, _ = r
        past = sorted((p for p in rows if p[2] == cust and p[1] < at), key=lambda p: (p[1], p[0]))
        within = lambda s: [p for p in past if (at - p[1]).total_seconds() <= s]
        f = {}
        if past:
            values = [float(p[4]) for p in past]
            f["customer_avg_amount"] = sum(values) / len(values)
            sd = math.sqrt(sum((v - f["customer_avg_amount"]) ** 2 for v in values) / len(values)) if len(values) > 1 else 500.0
            f["customer_std_amount"] = max(sd, 1.0)
            for name, s in history.COUNT_WINDOWS.items():
                f[f"txn_count_{name}"] = len(within(s))
            for name, s in history.SUM_WINDOWS.items():
                f[f"amount_sum_{name}"] = sum(float(p[4]) for p in within(s))
            f["is_new_device"] = int(device not in {p[9] for p in past})
            f["is_new_country"] = int(country not in {p[5] for p in past})
            f["is_new_city"] = int(city not in {p[6] for p in past})
            f["unique_merchants_24h"] = len({p[3] for p in within(86400)})
            f["unique_countries_7d"] = max(1, len({p[5] for p in within(604800)}))
            f["unique_devices_30d"] = max(1, len({p[9] for p in within(2592000)}))
            f["time_since_prev_txn"] = max(0.5, (at - past[-1][1]).total_seconds())
        else:
            f.update({k: history.COLD_START[k] for k in ("customer_avg_amount", "txn_count_24h", "is_new_device", "unique_devices_30d")})
        sharing = {p[2] for p in rows if p[9] == device and p[1] < at and (at - p[1]).total_seconds() <= 86400}
        f["device_customer_count"] = max(1, len(sharing))
        out[tid] = f
    return out


@pytest.mark.parametrize("skew", [SkewPolicy(), SkewPolicy(hot_rows=40, max_hot_keys=10), HOT])
def test_against_brute_force(spark, skew):
    rows = skewed_rows()
    got, want = features_of(frame(spark, rows), skew), brute(rows)
    assert len(got) == len(rows)
    for tid, expected in want.items():
        for name, value in expected.items():
            assert got[tid][name] == pytest.approx(value, abs=0.051 if name == "time_since_prev_txn" else 0.0051), (tid, name)


def test_hot_and_ordinary_paths_agree(spark):
    df = frame(spark, skewed_rows())
    ordinary = features_of(df)
    for skew in (SkewPolicy(hot_rows=40, max_hot_keys=10), HOT):
        assert features_of(df, skew) == ordinary


def test_later_rows_do_not_change_earlier_features(spark):
    rows = sorted(skewed_rows(), key=lambda r: r[1])
    cut = rows[120][1]
    full = features_of(frame(spark, rows))
    prefix = features_of(frame(spark, [r for r in rows if r[1] <= cut]))
    assert all(full[k] == v for k, v in prefix.items())


def test_syndicate_counts_the_current_customer(spark):
    from riskloom.operators.entities import device_syndicates

    df = frame(spark, [row(i, T0 - timedelta(hours=4 - i), customer=c) for i, c in enumerate("ABCD")])
    for skew in (SkewPolicy(), HOT):
        last = {r["transaction_id"]: r for r in device_syndicates(df, skew=skew).collect()}["T00003"]
        assert last["distinct_customers"] == 4 and last["is_syndicate"] and last["risk_boost"] >= 0.3


def test_feature_table_has_every_feature(spark):
    out = history.build_features(frame(spark, skewed_rows(20)))
    assert out.columns == ["transaction_id", "timestamp", "customer_id", "merchant_id", "is_fraud", *FEATURES]
    assert out.where(" OR ".join(f"{f} IS NULL" for f in FEATURES)).count() == 0


def test_ordinary_plan_shuffles_twice(spark):
    df = history.build_features(frame(spark, skewed_rows(20)))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    physical = df._jdf.queryExecution().sparkPlan().toString()
    assert "RepartitionByExpression [customer_id" in plan
    prepared = df._jdf.queryExecution().executedPlan().toString()
    assert prepared.count("Exchange hashpartitioning") == 2
    assert "SinglePartition" not in prepared and "CartesianProduct" not in physical


@pytest.mark.parametrize("skew", [SkewPolicy(), HOT])
def test_partitions_of_keyed_steps_follow_the_rows(spark, monkeypatch, skew):
    """A task's share does not grow with the table: the session's number of partitions is no upper limit."""
    from riskloom.operators import skew as dealing

    df = frame(spark, skewed_rows())
    want = features_of(df, skew)
    monkeypatch.setattr(dealing, "TASK_ROWS", 10)
    plan = history.build_features(df, skew=skew)._jdf.queryExecution().executedPlan().toString()
    given = [int(n) for n in re.findall(r"hashpartitioning\([^\n]*, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert len(given) >= 2 and max(given) >= df.count() // 10 > 8
    assert features_of(df, skew) == want
