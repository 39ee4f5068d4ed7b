"""Exact small-sample p-values, PSI of windows, percentiles from sketches, stream counters, dead letters of scoring."""

import itertools
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import drift
from riskloom.session import scratch_path
from riskloom.streaming import counters, pipeline


@pytest.mark.parametrize("n,m", [(1, 1), (2, 5), (4, 4), (3, 7), (6, 5)])
def test_exact_p_value_is_the_share_of_all_orders(n, m):
    distances = []
    for places in itertools.combinations(range(n + m), n):
        i = j = d = 0
        for k in range(n + m):
            i, j = (i + 1, j) if k in places else (i, j + 1)
            d = max(d, abs(i * m - j * n))
        distances.append(d)
    for far in {*distances, n * m}:
        want = sum(d >= far for d in distances) / math.comb(n + m, n)
        assert drift.exact_ks_p_value(n, m, far / (n * m)) == pytest.approx(want)


def test_exact_p_value_by_counting_paths_up_to_fifty():
    rng = random.Random(3)
    for _ in range(20):
        n, m = rng.randrange(1, 51), rng.randrange(1, 51)
        far = rng.randrange(1, n * m + 1)
        paths = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n + 1):
            for j in range(m + 1):
                if abs(i * m - j * n) < far:
                    paths[i][j] = 1 if i == j == 0 else (paths[i - 1][j] if i else 0) + (paths[i][j - 1] if j else 0)
        assert drift.exact_ks_p_value(n, m, far / (n * m)) == pytest.approx(1 - paths[n][m] / math.comb(n + m, n), abs=1e-9)


def test_small_samples_use_it(spark):
    rows = [("r", float(x)) for x in (1, 2, 3, 4, 5)] + [("c", float(x)) for x in (6, 7, 8, 9)]
    out = drift.ks_test(spark.createDataFrame(rows, "side string, a double"), ["a"]).first()
    assert (out["ks_statistic"], out["p_value"]) == (1.0, round(2 / math.comb(9, 4), 4))
    alike = spark.createDataFrame([(s, float(x)) for s in "rc" for x in range(5)], "side string, a double")
    assert drift.ks_test(alike, ["a"]).first()["p_value"] == 1.0


def test_each_window_has_its_own_psi(spark):
    start = datetime(2024, 1, 1)
    rng = np.random.default_rng(1)
    rows = [(start + timedelta(days=d), float(rng.normal() + (3 if d >= 12 else 0))) for d in range(16) for _ in range(60)]
    df = spark.createDataFrame(rows, "timestamp timestamp, a double")
    got = {r["window_end"].day: r["psi"] for r in drift.sliding_psi(df, F.col("timestamp") < F.lit(start + timedelta(days=10)), ["a"], days=3).collect()}
    assert sorted(got) == list(range(1, 17)) and max(got[d] for d in range(3, 13)) < 0.25 < got[15]
    values = np.array([v for t, v in rows if t < start + timedelta(days=10)])
    edges = np.unique(np.quantile(values, np.linspace(0, 1, 11)[1:-1]))
    window = np.array([v for t, v in rows if start + timedelta(days=12) <= t < start + timedelta(days=15)])
    e, a = ((np.bincount(np.searchsorted(edges, x, "right"), minlength=10) / len(x) + 1e-4) / (1 + 1e-3) for x in (values, window))
    assert got[15] == pytest.approx(float(((a - e) * np.log(a / e)).sum()), abs=1e-3)


def test_sketched_percentiles_stay_within_their_rank_error(spark):
    rng, start = random.Random(2), datetime(2024, 1, 1)
    rows = [(start + timedelta(seconds=k % 600), "score", rng.lognormvariate(2, 1)) for k in range(40_000)]
    layout = pipeline.Layout(scratch_path(spark, "latency"))
    for part in range(2):
        spark.createDataFrame(rows[part::2], "timestamp timestamp, step string, latency_ms double").write.mode("append").parquet(layout.at("in"))
    stream = spark.readStream.schema("timestamp timestamp, step string, latency_ms double").option("maxFilesPerTrigger", "5").parquet(layout.at("in"))
    counters.latency_pane_query(stream, layout.at("panes"), layout.checkpoint("panes"), delay="1 hour").awaitTermination()
    counters.compact(spark, layout.at("panes"), layout.at("compacted"), ["pane_start", "step"])
    assert spark.read.parquet(layout.at("compacted")).count() == 10 < spark.read.parquet(layout.at("panes")).count()
    panes = counters.latest_panes(spark, layout.at("compacted"))
    for r in counters.sliding_percentiles(panes).collect():
        low = r["window_start"].replace(tzinfo=None)
        own = sorted(v for t, _, v in rows if low <= t < low + timedelta(minutes=5))
        assert r["samples"] == len(own)
        for mark, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")):
            rank = np.searchsorted(own, r[name], "right") / len(own)
            assert abs(rank - mark) < 0.03


def test_rows_without_features_become_dead_letters_of_scoring(spark):
    from riskloom.plans import catalog
    from riskloom.operators.history import all_features

    layout = pipeline.Layout(scratch_path(spark, "scoring"))
    features = all_features(catalog.txn(spark, "/root/testdata/sf0.001").limit(40)).withColumn("idempotency_key", F.col("transaction_id"))
    lost = F.substring("transaction_id", -3, 1).isin("1", "2", "3")
    broken = features.withColumn("txn_count_1h", F.when(~lost, F.col("txn_count_1h"))).persist()
    n = broken.where("txn_count_1h IS NULL").count()
    for batch in (0, 1):
        pipeline.score_and_persist(layout)(broken, batch)
    dead = spark.read.parquet(layout.at("dead_letters_scoring")).where("batch = 0").collect()
    assert len(dead) == n > 0 and {r["step"] for r in dead} == {"scoring"} and all("txn_count_1h" in r["error"] for r in dead)
    assert spark.read.parquet(layout.at("predictions")).count() == spark.read.parquet(layout.at("risk_decisions")).count() == 40 - n


def test_late_rows_are_counted(spark):
    start = datetime(2024, 1, 1)
    layout = pipeline.Layout(scratch_path(spark, "late"))
    pipeline.use_rocksdb(spark)
    for rows in ([(start + timedelta(days=9), "a"), (start + timedelta(days=9), "a"), (start + timedelta(days=8), "b")], [(start + timedelta(days=9), "d")], [(start, "c")]):
        spark.createDataFrame(rows, "timestamp timestamp, key string").coalesce(1).write.mode("append").parquet(layout.at("in"))
    stream = spark.readStream.schema("timestamp timestamp, key string").option("maxFilesPerTrigger", "1").parquet(layout.at("in"))
    once = counters.observed(counters.observed(stream, "received").withWatermark("timestamp", "1 hour").dropDuplicatesWithinWatermark(["key"]), "processed")
    listener = counters.CounterListener()
    spark.streams.addListener(listener)
    q = pipeline._run(once, layout.at("out"), layout.checkpoint("out"))
    q.awaitTermination()
    listener.wait(q)
    spark.streams.removeListener(listener)
    row = listener.table(spark).first()
    assert row["received"] == 5 and row["processed"] + row["duplicates"] + row["late"] == 5 and row["duplicates"] == 1 and row["late"] >= 1
