"""Metrics, thresholds, calibration and drift on small inputs."""

import numpy as np
import pytest

from riskloom.operators import calibration, drift, evaluate, monitor

Y = [0, 0, 0, 0, 1, 1]
P = [0.1, 0.2, 0.3, 0.8, 0.7, 0.9]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(list(zip(Y, P)), "y int, p double")


def test_confusion_matrix(pairs):
    r = evaluate.fraud_metrics(pairs, "y", "p").first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (2, 1, 3, 0)


def test_areas(pairs, spark):
    points = evaluate.score_points(pairs, "y", "p")
    assert evaluate.roc_auc(points).first()[0] == 0.875
    assert evaluate.average_precision(points).first()[0] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3, abs=1e-4)
    one_class = spark.createDataFrame([(0, 0.1), (0, 0.5)], "y int, p double")
    assert evaluate.roc_auc(evaluate.score_points(one_class, "y", "p")).first()[0] == 0.5


def test_threshold_grid_against_definition(pairs):
    grid = evaluate.threshold_grid(pairs, "y", "p").orderBy("threshold").collect()
    assert len(grid) == 99
    for t, r in zip(np.linspace(0.01, 0.99, 99), grid):
        tp = sum(y == 1 and p >= t for y, p in zip(Y, P))
        fp = sum(y == 0 and p >= t for y, p in zip(Y, P))
        assert r["threshold"] == round(float(t), 3)
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (tp, fp, 2 - tp, 4 - fp)
        assert r["total_cost"] == (2 - tp) * 1525.0 + fp * 35.0


def test_calibration_bins(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.0), (1, 0.3), (0, 0.1)], "y int, p double")
    curve = {r["bin"]: r for r in evaluate.calibration_curve(df, "y", "p").collect()}
    assert len(curve) == 10 and curve[9]["bin_count"] == 1 and curve[2]["bin_count"] == 1 and curve[1]["bin_count"] == 1


def test_isotonic_is_monotone_and_bounded(spark):
    rng = np.random.default_rng(0)
    p = rng.uniform(size=400)
    df = spark.createDataFrame([(float(x), int(rng.uniform() < x**2)) for x in p], "raw double, label int")
    out = calibration.isotonic_apply(calibration.isotonic_fit(df, "raw"), df, "raw").orderBy("raw").toPandas()
    assert out["calibrated_probability"].is_monotonic_increasing and out["calibrated_probability"].between(0, 1).all()


def test_drift(spark):
    rng = np.random.default_rng(1)
    ref, same, moved = rng.normal(100, 15, 2000), rng.normal(100, 15, 2000), rng.normal(150, 30, 2000)
    a = spark.createDataFrame([(float(x), 1) for x in ref], "amount double, flat int")
    b = spark.createDataFrame([(float(x), 1) for x in same], "amount double, flat int")
    c = spark.createDataFrame([(float(x), 1) for x in moved], "amount double, flat int")
    calm = {r["feature"]: r for r in drift.drift_report(drift.two_sides(a, b), ["amount", "flat", "absent"]).collect()}
    assert set(calm) == {"amount", "flat"} and calm["amount"]["psi"] < 0.05 and calm["flat"]["psi"] == 0.0
    loud = {r["feature"]: r for r in drift.drift_report(drift.two_sides(a, c), ["amount"]).collect()}
    assert loud["amount"]["psi"] > 0.25 and loud["amount"]["status"] == "CRITICAL_DRIFT"
    cdf = lambda v, x: np.searchsorted(np.sort(v), x, "right") / len(v)
    grid = np.concatenate([ref, moved])
    assert loud["amount"]["ks_statistic"] == pytest.approx(np.abs(cdf(ref, grid) - cdf(moved, grid)).max(), abs=1e-4)


def test_histogram_edges_are_inclusive(spark):
    df = spark.createDataFrame([(0.05,), (0.1,), (0.11,), (2.0,)], "v double")
    got = {r["upper_edge"]: r["cumulative_count"] for r in monitor.bucket_histogram(df, "v", [0.05, 0.1, 0.2]).collect()}
    assert got == {0.05: 1, 0.1: 2, 0.2: 3, float("inf"): 4}
