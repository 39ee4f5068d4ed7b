"""The streaming chain: events -> features -> scores -> decisions -> tables."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.functions import policy
from riskloom.operators.history import point_features
from riskloom.plans.scoring import Scorer, decide_features, decision_rows, prediction_rows
from riskloom.schemas import FEATURES
from riskloom.session import materialise, passing
from riskloom.sources.tables import append_dated, append_new
from riskloom.streaming.events import DEDUPE_HORIZON, dedupe_stream, parse_events, read_stream, route_dead_letters, route_missing, write_stream
from riskloom.streaming.state import stream_customer_features, stream_device_features

#: What makes a transaction one that was written before.
KEYS = ["transaction_id", "idempotency_key"]
#: What a row must carry to become a decision.
SCORED = ["calibrated_probability", "anomaly_score", "risk_score", "decision"]
#: What a row must carry to be scored: every feature that is never null.
NEEDED = [f for f in FEATURES if f not in ("customer_std_amount", "customer_avg_amount", "customer_amount_zscore", "amount_to_avg_ratio")]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state lives in RocksDB with changelog checkpoints: state may exceed memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


@dataclass(frozen=True)
class Layout:
    """Folders of one deployment, and where its raw events come from.

    ``source`` is "files" (a folder under the root) or "kafka" (then ``topic`` and ``source_options`` with the brokers).
    """

    root: str
    source: str = "files"
    topic: str | None = None
    source_options: tuple[tuple[str, str], ...] = ()

    def raw(self, spark: SparkSession, options=None) -> DataFrame:
        where = self.at("raw") if self.source == "files" else self.topic
        return read_stream(spark, self.source, where, {**dict(self.source_options), **(options or {})})

    def at(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def checkpoint(self, name: str) -> str:
        return self.at(f"_checkpoints/{name}")


def _run(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start(path))


def dead_letter_query(spark: SparkSession, layout: Layout, options=None) -> StreamingQuery:
    _, dead = route_dead_letters(parse_events(layout.raw(spark, options)))
    return _run(dead, layout.at("dead_letters"), layout.checkpoint("dead_letters"))


def customer_feature_query(spark: SparkSession, layout: Layout, options=None, horizon: str = DEDUPE_HORIZON) -> StreamingQuery:
    """Raw events, parsed, deduplicated, with customer features, to a parquet hop. Rows later than ``horizon`` are dropped;
    rows that late ones within it change are stored again (see ``state.latest_rows``)."""
    use_rocksdb(spark)
    good, _ = route_dead_letters(parse_events(layout.raw(spark, options)))
    features = stream_customer_features(point_features(dedupe_stream(good.drop("payload"), horizon=horizon)))
    return _run(features, layout.at("customer_features"), layout.checkpoint("customer_features"))


def _hop(spark: SparkSession, path: str, options=None) -> DataFrame:
    """Stream over a parquet hop with the schema its writer used."""
    return spark.readStream.schema(spark.read.parquet(path).schema).options(**(options or {})).parquet(path)


def device_feature_query(spark: SparkSession, layout: Layout, options=None) -> StreamingQuery:
    use_rocksdb(spark)
    hop = _hop(spark, layout.at("customer_features"), options).withWatermark("timestamp", DEDUPE_HORIZON)
    return _run(stream_device_features(hop), layout.at("features"), layout.checkpoint("features"))


def stream_score(features: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """Stateless scoring of a feature stream: the functions that score a table."""
    scored = scorer(features) if scorer is not None else policy.fallback_scores(features)
    return decide_features(scored)


def persist_decision(layout: Layout):
    """foreachBatch sink of the transaction, prediction and decision tables; repeating a batch is harmless.

    Rows that lack what an earlier step should have given go to the dead letters of the batch. The stored latency is
    that of the batch, from its start to its scored rows, shared among them. The scored rows are stored once, without repeats;
    which of them stay is decided by their keys, and only those that do not are joined to them. What is stored on the way goes at
    the end of the batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        with passing(batch.sparkSession):
            began = time.time()
            stored = materialise(_once(batch), "persist")
            scored, dead = route_missing(stored, SCORED, "decision")
            dead.write.mode("overwrite").parquet(layout.at(f"dead_letters_decision/batch={batch_id}"))
            spent = (time.time() - began) * 1000.0 / max(stored.count(), 1)
            scored = scored.withColumn("inference_latency_ms", F.lit(spent))
            fields = ["transaction_id", "timestamp", "customer_id", "merchant_id", "amount", "currency", "country", "city",
                      "device_id", "payment_method", "ip_address", "idempotency_key"]
            # Decided once: a rejected transaction has no prediction and no decision.
            kept = append_new(scored.select(*fields), layout.at("transactions"), KEYS)
            rejected = materialise(_without(scored.select(*KEYS), kept), "rejected")
            rows = _without(scored, rejected)
            append_dated(prediction_rows(rows, ["timestamp"]), layout.at("predictions"), "transaction_id")
            append_dated(decision_rows(rows, ["timestamp"]), layout.at("risk_decisions"), "transaction_id")

    return write


def _once(batch: DataFrame) -> DataFrame:
    """A batch without repeats of rows, by both keys. Rows without an id and rows that lack an output all stay."""
    lost = F.greatest(F.col("transaction_id").isNull(), *[F.col(c).isNull() for c in SCORED])
    alike = Window.partitionBy(*KEYS, "_lost").orderBy("timestamp")
    numbered = batch.withColumn("_lost", lost).withColumn("_n", F.row_number().over(alike))
    return numbered.where(F.col("_lost") | (F.col("_n") == 1)).drop("_lost", "_n")


def _without(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Rows whose keys are not those of any other row; absent ones are equal."""
    gone = others.select(*[F.col(k).alias(f"_{k}") for k in KEYS])
    return rows.join(gone, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS]), "left_anti")


def score_and_persist(layout: Layout, scorer: Scorer | None = None):
    """foreachBatch sink of the features: rows that lack what scoring needs become dead letters of the scoring step."""
    persist = persist_decision(layout)

    def write(batch: DataFrame, batch_id: int) -> None:
        ready, dead = route_missing(batch, NEEDED, "scoring")
        dead.write.mode("overwrite").parquet(layout.at(f"dead_letters_scoring/batch={batch_id}"))
        persist(stream_score(ready, scorer), batch_id)

    return write


def decision_query(spark: SparkSession, layout: Layout, scorer: Scorer | None = None, options=None) -> StreamingQuery:
    features = _hop(spark, layout.at("features"), options)
    return (features.writeStream.foreachBatch(score_and_persist(layout, scorer)).option("checkpointLocation", layout.checkpoint("decisions"))
            .trigger(availableNow=True).start())


def publish_decisions(spark: SparkSession, layout: Layout, sink: str, location: str, options=None) -> StreamingQuery:
    """Stored decisions as keyed messages: "files" under a folder or "kafka" to a topic."""
    stored = _hop(spark, layout.at("risk_decisions"))
    return write_stream(stored, sink, location, layout.checkpoint("published"), key="transaction_id", options=options)


def run_chain(spark: SparkSession, layout: Layout, scorer: Scorer | None = None, options=None) -> None:
    """Drive everything available through the chain once. ``options`` pace the raw source only; a hop takes
    whatever its writer has finished."""
    dead_letter_query(spark, layout, options).awaitTermination()
    customer_feature_query(spark, layout, options).awaitTermination()
    device_feature_query(spark, layout).awaitTermination()
    decision_query(spark, layout, scorer).awaitTermination()


def stream_kpis(decisions: DataFrame, window: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Live counts, rate and block share per tumbling window; the watermark closes windows."""
    seconds = {"1 minute": 60.0, "5 minutes": 300.0, "1 hour": 3600.0}[window]
    return (
        decisions.withWatermark("timestamp", delay).groupBy(F.window("timestamp", window).alias("w")).agg(
            F.count("*").alias("events"),
            F.count_if(F.col("decision") == "BLOCK").alias("blocked"),
            F.avg("risk_score").alias("mean_score"),
            F.percentile_approx("risk_score", 0.95).alias("p95_score"))
        .select(F.col("w.start").alias("window_start"), "events", (F.col("events") / seconds).alias("events_per_second"),
                "blocked", "mean_score", "p95_score"))


def kpi_query(decisions: DataFrame, path: str, checkpoint: str, window: str = "1 minute", delay: str = "10 minutes") -> StreamingQuery:
    """KPIs in update mode: every batch stores the windows that it changed, the open ones too."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (stream_kpis(decisions, window, delay).writeStream.outputMode("update").foreachBatch(store)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_kpis(spark: SparkSession, path: str) -> DataFrame:
    """The last stored state of every window."""
    stored = spark.read.parquet(path)
    fields = [c for c in stored.columns if c not in ("window_start", "batch")]
    return stored.groupBy("window_start").agg(F.max_by(F.struct(*fields), "batch").alias("k")).select("window_start", "k.*")
