"""Catalogue entries that run Structured Streaming over files written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.columns import rounded
from riskloom.operators.history import COLD_START, all_features
from riskloom.plans import oracles as o
from riskloom.plans.catalog import LAT_SQL, query, sel, txn
from riskloom.schemas import RAW_EVENT
from riskloom.session import materialise, scratch_path, settled
from riskloom.sources import star
from riskloom.streaming import counters, events, pipeline
from riskloom.streaming.state import latest_rows, stream_device_features

FIELDS = [f.name for f in RAW_EVENT.fields]


def as_json(df, broken: bool = False):
    """JSON messages of the raw topic; with ``broken`` some carry the faults a producer can make."""
    amount = F.col("amount").cast("string")
    customer = F.col("customer_id")
    if broken:
        amount = F.when(F.col("payment_method") != "UPI", F.lit("twelve")).otherwise(amount)
        customer = F.when(F.col("ip_address").isNotNull(), customer)
    key = F.col("idempotency_key") if "idempotency_key" in df.columns else F.col("transaction_id")
    shaped = df.withColumns({
        "amount": amount, "customer_id": customer, "idempotency_key": key,
        "timestamp": F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
        "lat": F.col("lat").cast("string"), "lon": F.col("lon").cast("string")})
    return shaped.select(F.to_json(F.struct(*FIELDS)).alias("value"))


#: The topic is written in so many parts of equal time, one after the other, each in so many files: a trigger of
#: SLICE takes one part.
PARTS, FILES = 3, 4
SLICE = {"maxFilesPerTrigger": str(FILES)}


def raw_topic(spark, sf, broken: bool = False, repeat: bool = False, change=None) -> pipeline.Layout:
    """All transactions as JSON files in event-time order."""
    layout = pipeline.Layout(scratch_path(spark, "stream"))
    t = txn(spark, sf) if change is None else change(txn(spark, sf))
    if repeat:
        t = t.unionByName(t.where("is_fraud"))
    low, high = t.select(F.unix_micros(F.min("timestamp")), F.unix_micros(F.max("timestamp"))).first()
    part = F.floor((F.unix_micros("timestamp") - low) * PARTS / (high - low + 1))
    for k in range(PARTS):
        as_json(t.where(part == k), broken).repartition(FILES).write.mode("append").text(layout.at("raw"))
    return layout


def shared_keys(t):
    """One idempotency key for all transactions of a customer in an hour."""
    return t.withColumn("idempotency_key", F.concat("customer_id", F.lit("|"), F.date_format("timestamp", "yyyy-MM-dd HH")))


def without_optional(t):
    """Some events lack their device, country and city."""
    lost = F.substring("transaction_id", -3, 1) == "7"
    return t.withColumns({c: F.when(~lost, F.col(c)) for c in ("device_id", "country", "city")})


_TYPED = 'transaction_id, customer_id, "timestamp", CAST(amount AS DOUBLE) AS amount, lat, lon, transaction_id AS idempotency_key'


@query("Z1_parse_events", sel(o.TXN, _TYPED, "txn"))
def _(spark, sf):
    return events.parse_events(as_json(txn(spark, sf))).select("transaction_id", "customer_id", "timestamp", "amount", "lat", "lon", "idempotency_key")


_BAD = ("CASE WHEN ip_address IS NULL THEN 'missing transaction_id or customer_id' WHEN payment_method <> 'UPI' THEN 'amount is not a number' END")


@query("Z2_route_dead_letters", sel(o.TXN, f"transaction_id AS key, {_BAD} AS error, 'features' AS step", "txn", f"WHERE {_BAD} IS NOT NULL"))
def _(spark, sf):
    _, dead = events.route_dead_letters(events.parse_events(as_json(txn(spark, sf), broken=True)))
    return dead.select("key", "error", "step")


_KEYED = "customer_id || '|' || strftime(\"timestamp\", '%Y-%m-%d %H')"


@query("Z3_dedupe_events", f"WITH {o.TXN} SELECT transaction_id, {_KEYED} AS idempotency_key FROM txn QUALIFY row_number() OVER (PARTITION BY {_KEYED} ORDER BY us, transaction_id) = 1")
def _(spark, sf):
    t = txn(spark, sf).withColumn("idempotency_key", F.concat("customer_id", F.lit("|"), F.date_format("timestamp", "yyyy-MM-dd HH")))
    return events.dedupe_events(t).select("transaction_id", "idempotency_key")


@query("Z3_dedupe_stream", sel(o.TXN, "transaction_id", "txn"))
def _(spark, sf):
    pipeline.use_rocksdb(spark)
    layout = raw_topic(spark, sf, repeat=True)
    good, _ = events.route_dead_letters(events.parse_events(events.read_stream(spark, "files", layout.at("raw"), SLICE)))
    q = pipeline._run(events.dedupe_stream(good).select("transaction_id"), layout.at("out"), layout.checkpoint("out"))
    q.awaitTermination()
    return spark.read.schema("transaction_id string").parquet(layout.at("out"))


@query("O1_stream_counters", f"WITH {o.TXN} SELECT count(*) + count(*) FILTER (is_fraud) AS received, count(*) AS processed, count(*) FILTER (is_fraud) AS duplicates, 0 AS late FROM txn")
def _(spark, sf):
    """Counters of the deduplicating stream, as its listener has them."""
    pipeline.use_rocksdb(spark)
    layout = raw_topic(spark, sf, repeat=True)
    good, _ = events.route_dead_letters(events.parse_events(events.read_stream(spark, "files", layout.at("raw"), SLICE)))
    once = counters.observed(events.dedupe_stream(counters.observed(good, "received")).select("transaction_id"), "processed")
    listener = counters.CounterListener()
    spark.streams.addListener(listener)
    try:
        q = pipeline._run(once, layout.at("out"), layout.checkpoint("out"))
        q.awaitTermination()
        listener.wait(q)
    finally:
        spark.streams.removeListener(listener)
    return listener.table(spark).drop("query")


_PANES = "SELECT time_bucket(INTERVAL 10 MINUTES, ts) - to_minutes(CAST(10 * k AS INTEGER)) AS window_start, step, latency_ms FROM lat_t, (SELECT unnest(range(6)) AS k)"


@query("Z7_stream_latency_percentiles", f"WITH {LAT_SQL}, w AS ({_PANES}) SELECT CAST(window_start AS TIMESTAMP) AS window_start, step, count(*) AS samples, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95 FROM w GROUP BY 1, 2")
def _(spark, sf):
    """Percentiles of one-hour windows from ten-minute panes; windows of fewer values than a sketch keeps are exact."""
    layout = pipeline.Layout(scratch_path(spark, "stream"))
    rows = star.latencies(spark, sf).select("timestamp", "step", F.col("latency_ms").cast("double").alias("latency_ms"))
    rows.write.parquet(layout.at("latencies"))
    stream = spark.readStream.schema(rows.schema).parquet(layout.at("latencies"))
    counters.latency_pane_query(stream, layout.at("panes"), layout.checkpoint("panes"), "10 minutes").awaitTermination()
    return counters.sliding_percentiles(counters.latest_panes(spark, layout.at("panes")), 600, 6, (0.5, 0.95))


_HIST = ", ".join(COLD_START)


def _plain_feat():
    """Features without a profile dimension or category, as the stream sees them."""
    return f"{o.TXN}, {o._windows('txn', profiles=False)}"


@query("Z4_stream_customer_features", sel(_plain_feat(), f"transaction_id, {_HIST}", "feat"))
def _(spark, sf):
    layout = raw_topic(spark, sf)
    pipeline.customer_feature_query(spark, layout, SLICE).awaitTermination()
    return spark.read.parquet(layout.at("customer_features")).select("transaction_id", *COLD_START)


@query("Z4_stream_late_rows", sel(_plain_feat(), f"transaction_id, {_HIST}", "feat"))
def _(spark, sf):
    """Rows that arrive in any order within the watermark: the highest versions are the features of the ordered table."""
    layout = pipeline.Layout(scratch_path(spark, "stream"))
    t = txn(spark, sf)
    low = t.agg(F.unix_micros(F.min("timestamp"))).scalar()
    day, late = F.floor((F.unix_micros("timestamp") - low) / 86_400_000_000), F.pmod(F.xxhash64("transaction_id"), F.lit(7)) == 0
    # A seventh of the rows come up to ten days late.
    part = F.floor((day + F.when(late, F.pmod(F.xxhash64("transaction_id", F.lit(1)), F.lit(10))).otherwise(0)) / 12)
    for k in range(4):
        as_json(t.where(part == k)).repartition(FILES).write.mode("append").text(layout.at("raw"))
    pipeline.customer_feature_query(spark, layout, SLICE, horizon="40 days").awaitTermination()
    return latest_rows(spark.read.parquet(layout.at("customer_features"))).select("transaction_id", *COLD_START)


@query("Z5_stream_device_features", sel(_plain_feat(), "transaction_id, device_customer_count", "feat"))
def _(spark, sf):
    layout = raw_topic(spark, sf)
    pipeline.use_rocksdb(spark)
    good, _ = events.route_dead_letters(events.parse_events(events.read_stream(spark, "files", layout.at("raw"), SLICE)))
    pipeline._run(stream_device_features(good.drop("payload").withWatermark("timestamp", events.DEDUPE_HORIZON)), layout.at("out"), layout.checkpoint("out")).awaitTermination()
    return spark.read.parquet(layout.at("out")).select("transaction_id", "device_customer_count")


_STREAM_SCORE = f"""{_plain_feat()}, sc AS (SELECT transaction_id, {o.BEHAVIOR} AS b, {o.RULE_SCORE} AS ru FROM feat),
 f AS (SELECT transaction_id, {o.r('least(100.0::DOUBLE, 100.0::DOUBLE * (0.55::DOUBLE * 0.05::DOUBLE + 0.15::DOUBLE * 0.1::DOUBLE + 0.15::DOUBLE * b + 0.15::DOUBLE * ru))', 2)} AS risk_score FROM sc)"""


@query("Z6_stream_score", f"WITH {_STREAM_SCORE} SELECT transaction_id, risk_score, {o.decision('risk_score')} AS decision FROM f")
def _(spark, sf):
    layout = raw_topic(spark, sf)
    pipeline.run_chain(spark, layout, options=SLICE)
    # A second run over the same checkpoints and a repeated batch must add nothing.
    pipeline.persist_decision(layout)(pipeline.stream_score(spark.read.parquet(layout.at("features"))), 99)
    return spark.read.parquet(layout.at("risk_decisions")).select("transaction_id", "risk_score", "decision")


def _stored(spark, layout):
    """Per table: rows, rows without a stored transaction, and what predictions carry besides the score."""
    known = spark.read.parquet(layout.at("transactions")).select("transaction_id").distinct()
    out = None
    for name in ("transactions", "predictions", "risk_decisions"):
        table = spark.read.parquet(layout.at(name))
        orphans = table.join(known, "transaction_id", "left_anti").agg(F.count("*").alias("orphans"))
        full = F.count_if(F.col("inference_latency_ms") >= 0) if name == "predictions" else F.lit(0).cast("long")
        amounts = F.sum(F.get_json_object("feature_payload", "$.amount").cast("decimal(12,2)")) if name == "predictions" else F.lit(0)
        row = table.agg(F.count("*").alias("n"), full.alias("with_latency"), amounts.cast("double").alias("payload_amount")).join(orphans).select(F.lit(name).alias("table_name"), "*")
        out = row if out is None else out.unionByName(row)
    return out


_S6 = """SELECT 'transactions' AS table_name, count(*) AS n, 0 AS with_latency, 0.0::DOUBLE AS payload_amount, 0 AS orphans FROM kept
 UNION ALL SELECT 'predictions', count(*), count(*), CAST(sum(amount) AS DOUBLE), 0 FROM kept UNION ALL SELECT 'risk_decisions', count(*), 0, 0.0::DOUBLE, 0 FROM kept"""


@query("S6_persist_decision", f"WITH {o.TXN}, kept AS (SELECT amount FROM txn) {_S6}")
def _(spark, sf):
    layout = raw_topic(spark, sf, repeat=True)
    pipeline.run_chain(spark, layout, options=SLICE)
    return _stored(spark, layout)


@query("S6_persist_decision_shared_keys", f"WITH {o.TXN}, kept AS (SELECT amount FROM txn QUALIFY row_number() OVER (PARTITION BY {_KEYED} ORDER BY us, transaction_id) = 1) {_S6}")
def _(spark, sf):
    layout = raw_topic(spark, sf)
    t = shared_keys(txn(spark, sf))
    scored = settled(spark, lambda: pipeline.stream_score(all_features(t)), "scored")  # the sink gets the same rows twice
    sink = pipeline.persist_decision(layout)
    for batch_id in (0, 1):  # the second delivery of the same rows adds nothing
        sink(scored, batch_id)
    return _stored(spark, layout)


@query("S4_read_stream", sel(o.TXN, "transaction_id, CAST(amount AS DOUBLE) AS amount", "txn"))
def _(spark, sf):
    layout = raw_topic(spark, sf)
    parsed = events.parse_events(events.read_stream(spark, "files", layout.at("raw"), SLICE))
    pipeline._run(parsed.select("transaction_id", "amount"), layout.at("out"), layout.checkpoint("out")).awaitTermination()
    return spark.read.schema("transaction_id string, amount decimal(12,2)").parquet(layout.at("out"))


@query("S5_write_stream", sel(o.TXN, "customer_id AS key, transaction_id, CAST(amount AS DOUBLE) AS amount", "txn"))
def _(spark, sf):
    layout = raw_topic(spark, sf)
    parsed = events.parse_events(events.read_stream(spark, "files", layout.at("raw"), SLICE)).drop("payload")
    events.write_stream(parsed, "files", layout.at("topic"), layout.checkpoint("topic")).awaitTermination()
    sent = spark.read.schema("key string, value string").json(layout.at("topic"))
    return sent.select("key", F.from_json("value", "transaction_id string, amount decimal(12,2)").alias("v")).select("key", "v.*")


@query("Z7_stream_kpis", f"WITH {o.STORE} SELECT CAST(date_trunc('hour', \"timestamp\") AS TIMESTAMP) AS window_start, count(*) AS events, count(*) FILTER (decision = 'BLOCK') AS blocked, {o.r('avg(CAST(risk_score AS DOUBLE))', 4)} AS mean_score FROM decisions GROUP BY 1")
def _(spark, sf):
    layout = pipeline.Layout(scratch_path(spark, "stream"))
    rows = star.decisions(txn(spark, sf)).select("transaction_id", "timestamp", F.col("risk_score").cast("double").alias("risk_score"), "decision")
    rows.write.parquet(layout.at("decisions"))
    stream = spark.readStream.schema(rows.schema).parquet(layout.at("decisions"))
    pipeline.kpi_query(stream, layout.at("out"), layout.checkpoint("out"), "1 hour").awaitTermination()
    out = pipeline.latest_kpis(spark, layout.at("out"))
    return out.select("window_start", "events", "blocked", rounded(F.col("mean_score"), 4).alias("mean_score"))


@query("Z8_replay_dead_letters", sel(o.TXN, "transaction_id, customer_id, CAST(amount AS DOUBLE) AS amount", "txn", f"WHERE {_BAD} IS NOT NULL"))
def _(spark, sf):
    t = txn(spark, sf)
    _, dead = events.route_dead_letters(events.parse_events(as_json(t, broken=True)))
    # Sent twice, and repaired by id; letters without a transaction id are told apart by their own.
    dead = materialise(dead.unionByName(dead), "dead-letters")
    right = as_json(t).select(F.get_json_object("value", "$.transaction_id").alias("id"), F.col("value").alias("fixed"))
    repaired = dead.withColumn("id", F.get_json_object("payload", "$.transaction_id")).join(right, "id").select("letter_id", F.col("fixed").alias("payload"))
    return events.parse_events(events.replay_dead_letters(dead, materialise(repaired, "repaired"))).select("transaction_id", "customer_id", "amount")


@query("Z2_route_missing", sel(o.TXN, "transaction_id AS key, 'missing calibrated_probability, anomaly_score, risk_score, decision' AS error, 'decision' AS step", "txn", "WHERE ip_address IS NULL"))
def _(spark, sf):
    layout = pipeline.Layout(scratch_path(spark, "stream"))
    t = txn(spark, sf).withColumn("idempotency_key", F.col("transaction_id"))
    scored = pipeline.stream_score(all_features(t))
    lost = F.when(F.col("ip_address").isNotNull(), F.col("risk_score"))
    pipeline.persist_decision(layout)(scored.withColumn("risk_score", lost), 0)
    return spark.read.parquet(layout.at("dead_letters_decision")).select("key", "error", "step")


_NULLS = o.TXN + """,
 full_txn AS (SELECT * FROM txn),
 gap AS (SELECT * REPLACE (CASE WHEN substr(transaction_id, -3, 1) <> '7' THEN device_id END AS device_id,
   CASE WHEN substr(transaction_id, -3, 1) <> '7' THEN country END AS country, CASE WHEN substr(transaction_id, -3, 1) <> '7' THEN city END AS city) FROM full_txn)"""


@query("Z4_stream_absent_fields", f"""WITH {_NULLS},
 f AS (SELECT transaction_id, count(*) OVER past AS n, coalesce(count(*) OVER day, 0) AS txn_count_24h,
   us <= min(us) OVER (PARTITION BY customer_id, coalesce(device_id, '')) AS d, us <= min(us) OVER (PARTITION BY customer_id, coalesce(country, '')) AS c,
   us <= min(us) OVER (PARTITION BY customer_id, coalesce(city, '')) AS t,
   len(list_distinct(list(merchant_id) OVER day)) AS m, len(list_distinct(list(country) OVER week)) AS co, len(list_distinct(list(device_id) OVER month)) AS de
  FROM gap WINDOW past AS (PARTITION BY customer_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
   day AS (PARTITION BY customer_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING),
   week AS (PARTITION BY customer_id ORDER BY us RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING),
   month AS (PARTITION BY customer_id ORDER BY us RANGE BETWEEN 2592000000000 PRECEDING AND 1 PRECEDING))
 SELECT transaction_id, txn_count_24h, CASE WHEN n > 0 THEN d::INT ELSE 1 END AS is_new_device, CASE WHEN n > 0 THEN c::INT ELSE 0 END AS is_new_country,
  CASE WHEN n > 0 THEN t::INT ELSE 0 END AS is_new_city, coalesce(m, 0) AS unique_merchants_24h, CASE WHEN n > 0 THEN greatest(1, coalesce(co, 0)) ELSE 1 END AS unique_countries_7d,
  CASE WHEN n > 0 THEN greatest(1, coalesce(de, 0)) ELSE 1 END AS unique_devices_30d FROM f""")
def _(spark, sf):
    layout = raw_topic(spark, sf, change=without_optional)
    pipeline.customer_feature_query(spark, layout, SLICE).awaitTermination()
    return spark.read.parquet(layout.at("customer_features")).select(
        "transaction_id", "txn_count_24h", "is_new_device", "is_new_country", "is_new_city", "unique_merchants_24h", "unique_countries_7d", "unique_devices_30d")
