"""The key index: what is read for a batch, and that nothing stored is missed."""

from pyspark.sql import functions as F

from riskloom import session
from riskloom.sources.key_index import FAN_OUT, KeyIndex
from riskloom.sources.tables import append_new

KEYS = ["transaction_id", "idempotency_key"]


def batch(spark, first, n, start="2024-01-01"):
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(start), "yyyy-MM-dd") + F.col("id"))
    return spark.range(first, first + n, 1, 2).select(
        F.concat(F.lit("t"), "id").alias(KEYS[0]), F.when(F.col("id") % 7 > 0, F.concat(F.lit("k"), "id")).alias(KEYS[1]), at.alias("timestamp"))


def test_a_batch_reads_few_buckets_however_large_the_table_is(spark):
    path = session.scratch_path(spark, "test-keys")
    index = KeyIndex(spark, path, KEYS, bucket_keys=200)
    assert index.matching(batch(spark, 0, 5)).count() == 0  # no table yet
    hits = []
    for k in range(FAN_OUT + 2):
        batch(spark, 1000 * k, 1000).write.mode("append").parquet(path)
        index.refresh()
        unseen = index._hashed(batch(spark, 10**6 * (k + 1), 40).select(F.struct(*KEYS).alias("row")))
        hits.append(len(index.candidates(unseen.select("key", "h"))))
    stored = spark.read.parquet(f"{index.path}/entries").where("key = 'transaction_id'")
    assert len(index._live()) == 3 and max(g["level"] for g in index._live()) == 1 and stored.count() == 18_000
    assert max(hits) <= 8  # of up to 180 buckets a key
    asked = batch(spark, 9_950, 100).unionByName(batch(spark, 3, 1))
    got = sorted(r[0] for r in index.matching(asked).select(KEYS[0]).collect())
    assert got == sorted(["t3", *[f"t{i}" for i in range(9_950, 10_000)]])


def test_rows_match_under_any_key_and_nulls_match_nothing(spark):
    path = session.scratch_path(spark, "test-keys")
    spark.createDataFrame([("a", "1"), ("b", None), (None, "3"), (None, None), ("d", "4")], "transaction_id string, idempotency_key string").write.parquet(path)
    asked = spark.createDataFrame([("x", "1"), ("b", "9"), (None, "3"), (None, None), ("1", "a")], "transaction_id string, idempotency_key string")
    got = KeyIndex(spark, path, KEYS).matching(asked).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", "1"), ("b", None), (None, "3")], key=str)


def test_a_writer_that_dies_before_the_index_loses_nothing(spark):
    path = session.scratch_path(spark, "test-keys")
    for k in range(3):
        assert append_new(batch(spark, 100 * k, 150), path, KEYS).count() >= 100
    # An unfinished generation: entries without a row in the list of generations.
    spark.createDataFrame([("t999", "t999")], "value string, owner string").write.parquet(f"{path}_keys/entries/gen=unfinished/key=transaction_id/bucket=0")
    again = append_new(batch(spark, 0, 350, start="2024-03-01"), path, KEYS)  # two months later
    assert again.count() == 350
    rows = spark.read.parquet(path)
    assert rows.count() == 350 and rows.select(KEYS[0]).distinct().count() == 350
    assert rows.agg(F.max("timestamp")).first()[0].month == 1
