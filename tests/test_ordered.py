"""Prefix operators, exact percentiles and the chronological split against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators.ordered import exact_percentiles, range_prefix, strict_prefix
from riskloom.operators.split import check_no_overlap, split_boundaries, temporal_split


def test_strict_prefix_with_ties_and_slices(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.5 else f"k{i % 4}", rng.randint(0, 400), rng.randint(1, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, k string, o long, v long").withColumn("last", F.struct("o", "id"))
    out = strict_prefix(df, ["k"], "o", ["v"], ["last"], (7, 70)).collect()
    assert len(out) == len(rows)
    for r in out:
        earlier = [x for x in rows if x[1] == r["k"] and x[2] < r["o"]]
        assert r["before_v"] == sum(x[3] for x in earlier)
        want = max(((x[2], x[0]) for x in earlier), default=None)
        assert (tuple(r["before_last"]) if r["before_last"] else None) == want


def test_range_prefix_without_keys(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"), F.lit(1).cast("long").alias("n"))
    out = {r["v"]: r for r in range_prefix(df, [], ["v"], ["n"]).collect()}
    assert all(r["before_n"] == v and r["total_n"] == 1000 for v, r in out.items())


def test_exact_percentiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=501).round(2), "b": rng.integers(0, 5, size=1000).astype(float), "c": np.array([3.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    probs = {"p10": 0.1, "p50": 0.5, "p95": 0.95}
    for r in exact_percentiles(df, ["g"], "v", probs).collect():
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.percentile(groups[r["g"]], p * 100))


@pytest.mark.parametrize("tied", [False, True])
def test_temporal_split_sizes(spark, tied):
    moment = F.timestamp_seconds(F.lit(1_700_000_000) + (F.lit(0) if tied else F.col("id") * 3571 % 997))
    df = spark.range(997).select(F.format_string("T%05d", F.col("id")).alias("transaction_id"), moment.alias("timestamp"), (F.col("id") % 9 == 0).alias("is_fraud"))
    out = temporal_split(df)
    bounds = split_boundaries(out)
    sizes = {r["split"]: r["n_rows"] for r in bounds.collect()}
    assert sizes == {"train": 697, "val": 149, "test": 151}
    check_no_overlap(bounds)
    ranked = [r["split"] for r in out.orderBy("timestamp", "transaction_id").collect()]
    assert ranked == ["train"] * 697 + ["val"] * 149 + ["test"] * 151


def test_split_rejects_bad_input(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("transaction_id"), F.current_timestamp().alias("timestamp"))
    with pytest.raises(ValueError):
        temporal_split(df, 0.5, 0.1, 0.1)
    with pytest.raises(ValueError):
        temporal_split(df.where("false"))


def test_first_row_per_key_is_pruned_before_the_shuffle(spark):
    from riskloom.operators.store import first_per_key
    from riskloom.streaming.events import dedupe_events

    df = spark.range(100).select(
        F.format_string("k%d", F.col("id") % 3).alias("idempotency_key"), F.col("id").cast("string").alias("transaction_id"), F.timestamp_seconds("id").alias("timestamp"))
    for out in (dedupe_events(df), first_per_key(df, "idempotency_key", ["timestamp"])):
        assert out.count() == 3
        assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
