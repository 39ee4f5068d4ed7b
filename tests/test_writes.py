"""Idempotent writes, null scores and the shared folder."""

import random

import pytest
from pyspark.sql import functions as F

from riskloom import session
from riskloom.operators import evaluate, store
from riskloom.sources.tables import append_new, look_up, search_candidates, write_lookup_table, write_search_index
from riskloom.streaming import events, pipeline


def test_first_write_wins_over_several_keys(spark):
    rows = spark.createDataFrame([(1, "t1", "k1"), (2, "t2", "k1"), (3, "t2", "k2"), (4, None, "k2"), (5, None, "k3"), (6, "t9", None), (7, "t9", None), (7, "t9", None)], "n int, t string, k string")
    kept = store.first_write_wins(rows, ["t", "k"], ["n"]).collect()
    assert sorted((r["n"], r["t"], r["k"]) for r in kept) == [(1, "t1", "k1"), (3, "t2", "k2"), (5, None, "k3"), (6, "t9", None)]
    assert store.first_write_wins(rows.limit(0), ["t", "k"], ["n"]).collect() == []


def _written(rows):
    """Plain first write wins: rows (n, t, k) in order of n."""
    kept, seen = [], (set(), set())
    for row in sorted(rows, key=lambda r: r[0]):
        if not any(v in s for v, s in zip(row[1:], seen, strict=True)):
            kept.append(row)
            for v, s in zip(row[1:], seen, strict=True):
                s.update(() if v is None else (v,))
    return kept


def test_rounds_do_not_follow_the_chain(spark):
    n = 300  # each row shares a key with the one before
    rows = [(i, f"t{(i + 1) // 2}", f"k{i // 2}") for i in range(n)] + [(n + i, "t7", None) for i in range(50)]
    df = spark.createDataFrame(rows, "n int, t string, k string")
    spark.sparkContext.setJobGroup("chain", "chain")
    kept = store.first_write_wins(df, ["t", "k"], ["n"]).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setJobGroup("", "")
    assert sorted(map(tuple, kept), key=lambda r: r[0]) == _written(rows)
    assert jobs < 250  # some 150 rounds before, each with several jobs


def test_long_chains_go_by_slices(spark):
    rng = random.Random(5)
    value = lambda letter, many: None if rng.random() < 0.1 else f"{letter}{rng.randrange(many)}"
    rows = [(i, value("t", 120), value("k", 150)) for i in range(400)] + [(400 + i, f"x{(i + 1) // 2}", f"y{i // 2}") for i in range(40)]
    df = spark.createDataFrame(rows, "n int, t string, k string").repartition(5)
    for chain_rows in (7, 1000):
        kept = store.first_write_wins(df, ["t", "k"], ["n"], chain_rows).collect()
        assert sorted(map(tuple, kept), key=lambda r: r[0]) == _written(rows)


def test_a_repeat_after_thirty_days_is_one_row(spark):
    path = session.scratch_path(spark, "test-append")
    first = spark.createDataFrame([("t1", "k1", "2024-01-01 10:00:00")], "transaction_id string, idempotency_key string, timestamp string").withColumn("timestamp", F.to_timestamp("timestamp"))
    for days in (0, 30):
        append_new(first.withColumn("timestamp", F.col("timestamp") + F.expr(f"interval {days} days")), path, ["transaction_id", "idempotency_key"])
    assert spark.read.parquet(path).count() == 1


def test_null_scores_count_nowhere(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.2), (1, None), (0, None)], "y int, s double")
    assert evaluate.fraud_metrics(df, "y", "s").first()["total_samples"] == 2
    grid = evaluate.threshold_grid(df, "y", "s", thresholds=[0.5]).first()
    assert (grid["tp"], grid["fp"], grid["fn"], grid["tn"]) == (1, 0, 0, 1)
    assert evaluate.calibration_error(df, "y", "s").first()["samples"] == 2


def test_letters_without_ids_are_told_apart(spark):
    raw = spark.createDataFrame([('{"amount": "a"}',), ('{"amount": "b"}',), ('{"amount": "b"}',)], "value string")
    _, dead = events.route_dead_letters(events.parse_events(raw))
    repairs = dead.select("letter_id", F.concat(F.lit("fixed "), "payload").alias("payload"))
    got = [r["value"] for r in events.replay_dead_letters(dead, repairs.unionByName(repairs)).collect()]
    assert sorted(got) == ['fixed {"amount": "a"}', 'fixed {"amount": "b"}']


def test_raw_events_may_come_from_a_topic(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(pipeline, "read_stream", lambda spark, source, where, options: asked.update(source=source, where=where, options=options))
    pipeline.Layout("/x", "kafka", "raw-events", (("kafka.bootstrap.servers", "b:9092"),)).raw(spark, {"maxOffsetsPerTrigger": "9"})
    assert asked == {"source": "kafka", "where": "raw-events", "options": {"kafka.bootstrap.servers": "b:9092", "maxOffsetsPerTrigger": "9"}}


def test_a_point_lookup_reads_one_row_group(spark):
    path = session.scratch_path(spark, "test-lookup")
    rows = spark.range(200_000).select(F.concat(F.lit("T"), F.lpad((F.col("id") * 2).cast("string"), 9, "0")).alias("transaction_id"), F.md5(F.col("id").cast("string")).alias("body"))
    write_lookup_table(rows.orderBy("body"), path, row_group_bytes=1 << 20)

    def read(keys):
        found = look_up(spark, path, keys)
        n = len(found.collect())
        leaves = found._jdf.queryExecution().executedPlan().collectLeaves()
        return n, sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))

    there, scanned = read(["T000100000"])
    assert there == 1 and scanned <= 25_000  # of 200,000
    assert read(["T000100001"]) == (0, 0)  # within the bounds of a row group, but in no Bloom filter
    assert read([f"T{2 * k:09d}" for k in range(25)])[0] == 25 and read([])[0] == 0


def test_search_by_postings_finds_the_same_rows(spark):
    path = session.scratch_path(spark, "test-search")
    ids = [(f"TXN-{k}-é{k % 7}", None if k % 11 == 0 else f"Cust-{k * 37 % 1000}", "BLOCK") for k in range(2000)] + [("ab", "C", "BLOCK"), ("TXN-5-é5", "cust-0", "APPROVE")]
    listing = spark.createDataFrame(ids, "transaction_id string, customer_id string, decision string")
    write_search_index(listing, path, ["transaction_id", "customer_id"])
    for term in ("N-19", "-É", "é3", "CUST-77", "t-999", "nowhere", "xn-1999-é4", "ab", "b"):
        want = sorted(map(tuple, store.search(listing, term).collect()), key=str)
        candidates = search_candidates(spark, path, term)
        assert (candidates is None) == (len(term) < 3)
        assert sorted(map(tuple, store.search(listing, term, candidates=candidates).collect()), key=str) == want
        assert candidates is None or candidates.count() <= max(3 * len(want), 300)


def test_a_shared_folder_must_be_named():
    class Unset:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"getConf": staticmethod(lambda: type("C", (), {"get": staticmethod(lambda *_: None)}))})  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Unset)


def test_repeats_in_a_batch_are_dropped_before_it_is_stored(spark, monkeypatch):
    from riskloom.operators.history import all_features
    from riskloom.sources import star

    t = star.transactions(spark, "/root/testdata/sf0.001").where("event_id < 20").withColumn("idempotency_key", F.col("transaction_id"))
    scored = session.materialise(pipeline.stream_score(all_features(t)), "scored")
    stored, materialise = {}, pipeline.materialise

    def kept(df, label):
        out = materialise(df, label)
        stored[label] = out.count()
        return out

    monkeypatch.setattr(pipeline, "materialise", kept)
    layout = pipeline.Layout(session.scratch_path(spark, "test-sink"))
    pipeline.persist_decision(layout)(scored.unionByName(scored), 0)
    tables = [spark.read.parquet(layout.at(name)).count() for name in ("transactions", "predictions", "risk_decisions")]
    assert tables == [scored.count()] * 3 and stored["persist"] == scored.count()


def test_the_sink_leaves_no_intermediates_and_decides_rows_without_a_key(spark, tmp_path):
    import os

    from riskloom.operators.history import all_features
    from riskloom.sources import star

    t = star.transactions(spark, "/root/testdata/sf0.001").where("event_id < 12")
    t = t.withColumn("idempotency_key", F.when(F.col("event_id") != 3, F.concat(F.lit("K"), F.least("event_id", F.lit(9)))))
    scored = session.settled(spark, lambda: pipeline.stream_score(all_features(t)), "scored")
    root, layout = session._scratch_root(spark), pipeline.Layout(str(tmp_path))
    before = set(os.listdir(root))
    for batch_id in (0, 1):
        pipeline.persist_decision(layout)(scored, batch_id)
    assert set(os.listdir(root)) == before
    ids = [sorted(r[0] for r in spark.read.parquet(layout.at(name)).select("transaction_id").collect()) for name in ("transactions", "predictions", "risk_decisions")]
    assert ids[0] == ids[1] == ids[2] and "TXN-3-0" in ids[0] and not {"TXN-10-0", "TXN-11-0"} & set(ids[0])
