"""Queries and idempotent writes over the relational tables."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import rounded
from riskloom.operators.ordered import range_prefix
from riskloom.operators.skew import dealt
from riskloom.session import materialise, scratch_path

#: Rows of a chain that one task goes through in order.
CHAIN_ROWS = 500_000
DRIVERS = "array<struct<feature:string,impact:double>>"
RULES = "array<struct<rule_code:string,description:string,severity_penalty:double,category:string>>"
TXN_FIELDS = [
    "transaction_id", "timestamp", "customer_id", "merchant_id", "amount", "currency", "country", "city",
    "device_id", "payment_method",
]


def _hydrate(txn: DataFrame, decisions: DataFrame, predictions: DataFrame) -> DataFrame:
    d = decisions.select("transaction_id", "decision", "risk_score", "triggered_rules")
    p = predictions.select("transaction_id", "calibrated_probability", "anomaly_score", "inference_latency_ms", "shap_positive_drivers")
    joined = txn.select(*TXN_FIELDS).join(d, "transaction_id", "left").join(p, "transaction_id", "left")
    return joined.withColumns({
        "amount": F.col("amount").cast("double"),
        "risk_score": F.col("risk_score").cast("double"),
        "decision": F.coalesce("decision", F.lit("PENDING")),
        "triggered_rules": F.coalesce(F.col("triggered_rules").cast(RULES), F.array().cast(RULES)),
        "shap_positive_drivers": F.coalesce(F.col("shap_positive_drivers").cast(DRIVERS), F.array().cast(DRIVERS)),
    })


def list_transactions(txn: DataFrame, decisions: DataFrame, predictions: DataFrame, limit: int = 50, offset: int = 0,
                      decision: str | None = None, customer_id: str | None = None) -> DataFrame:
    """Newest transactions with decision and prediction.

    The page is cut before the other tables are joined, so only ``limit`` rows meet them; a decision
    filter first reduces the transactions by a semi join.
    """
    page = txn if customer_id is None else txn.where(F.col("customer_id") == customer_id)
    if decision is not None:
        wanted = decisions.where(F.col("decision") == decision.upper()).select("transaction_id")
        page = page.join(wanted, "transaction_id", "left_semi")
    newest = [F.col("timestamp").desc(), F.col("transaction_id").desc()]
    page = page.select(*TXN_FIELDS).orderBy(*newest).offset(offset).limit(limit)
    keys = page.select("transaction_id")  # Spark picks the join by the page's size
    return _hydrate(
        page,
        decisions.join(keys, "transaction_id", "left_semi"),
        predictions.join(keys, "transaction_id", "left_semi"),
    ).orderBy(*newest)


def transaction_detail(txn: DataFrame, decisions: DataFrame, predictions: DataFrame, transaction_id: str) -> DataFrame:
    """Point lookup; the id filter reaches all three scans."""
    is_it = F.col("transaction_id") == transaction_id
    return _hydrate(txn.where(is_it), decisions.where(is_it), predictions.where(is_it))


def explanation(predictions: DataFrame, transaction_id: str, base_value: float) -> DataFrame:
    """Stored drivers of one prediction; ``base_value`` is the training label rate."""
    return predictions.where(F.col("transaction_id") == transaction_id).select(
        "transaction_id", F.lit(float(base_value)).alias("base_value"),
        F.col("calibrated_probability").alias("prediction_value"),
        F.col("shap_positive_drivers").alias("top_positive_features"),
        F.col("shap_negative_drivers").alias("top_negative_features"))


def risk_breakdown(decisions: DataFrame, transaction_id: str) -> DataFrame:
    """Rules and costs of one decision, one row per triggered rule."""
    return decisions.where(F.col("transaction_id") == transaction_id).select(
        "transaction_id", "risk_score", "decision", "cost_estimate_fn", "cost_estimate_fp",
        F.explode_outer("triggered_rules").alias("r"),
    ).select("transaction_id", "risk_score", "decision", "cost_estimate_fn", "cost_estimate_fp", "r.*")


def first_per_key(rows: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """First row per key. row_number = 1 is pruned on the map side, so copies of a hot key stay there."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_first", F.row_number().over(w)).where(F.col("_first") == 1).drop("_first")


def first_write_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], chain_rows: int = CHAIN_ROWS) -> DataFrame:
    """The rows that stay if all are written in order and a row is rejected that shares any key with one that stayed.

    A row that is first on all its keys stays, and those that share a key with it go; that decides most, and all of a hot
    key. What is left are chains of rows linked by shared keys. Rows of different chains don't touch each other, so a task
    goes through the rows of a chain in order. A chain of more than ``chain_rows`` rows goes by slices of the order: a slice
    is decided by its own rows and by the keys of rows that stayed before it. A null key is shared with nothing.
    """
    placed = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "write-order")
    marks = [f"_mark{i}" for i in range(len(keys))]
    left = _with_marks(placed.select("_row", *keys, F.struct(*order, "_row").alias("_place")), keys, marks)
    first_on_all = F.expr(" and ".join(f"coalesce({m} = _row, true)" for m in marks))
    first = left.where(first_on_all)
    rest = left.where(~first_on_all).select("_row", "_place", *marks)
    for m in marks:
        rest = rest.join(first.where(F.col(f"{m}_n") > 1).select(F.col("_row").alias(m)), m, "left_anti")
    ids = first.select("_row").unionByName(_first_in_chains(materialise(rest, "write-order"), marks, chain_rows))
    return placed.join(ids, "_row", "left_semi").select(*rows.columns)


def _with_marks(left: DataFrame, keys: Sequence[str], marks: Sequence[str]) -> DataFrame:
    """Key values become marks: the number of the first row that has the value; null for a null key. ``<mark>_n`` counts the
    value's rows. Counted in the tasks first; rows without a key join nothing and are spread by their number."""
    for key, m in zip(keys, marks, strict=True):
        firsts = left.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min("_place").alias("_first"), F.count("*").alias(f"{m}_n"))
        firsts = firsts.select("_key", F.col("_first._row").alias(m), f"{m}_n", F.lit(-1).cast("long").alias("_salt"))
        salted = left.withColumn("_own", F.when(F.col(key).isNull(), F.col("_row")).otherwise(F.lit(-1)))
        left = salted.join(firsts, (F.col("_own") == F.col("_salt")) & F.col(key).eqNullSafe(F.col("_key")), "left").drop("_own", "_salt", "_key")
    return materialise(left.drop(*keys), "write-order")


def _first_in_chains(rest: DataFrame, marks: Sequence[str], chain_rows: int) -> DataFrame:
    """Numbers of the rows that stay among linked ones."""
    total = rest.count()
    if not total:
        return rest.select("_row")
    rest = materialise(_with_chains(rest, marks), "chains")
    large = rest.groupBy("_chain").count().where(F.col("count") > chain_rows).select("_chain")
    large = materialise(large, "large-chains")
    if not large.limit(1).count():
        return _stay(rest, total, marks).select("_row")
    stayed = [materialise(_stay(rest.join(large, "_chain", "left_anti"), total, marks), "stayed")]
    numbered = range_prefix(rest.join(large, "_chain", "left_semi").withColumn("n", F.lit(1).cast("long")), ["_chain"], ["_place"], ["n"])
    sliced = numbered.select("_chain", "_row", "_place", *marks, F.expr(f"before_n div {int(chain_rows)}L").alias("slice"))
    path = scratch_path(rest.sparkSession, "slices")
    sliced.repartition("slice", F.pmod("_row", F.lit(8))).write.partitionBy("slice").parquet(path)
    sliced = rest.sparkSession.read.schema(sliced.schema).parquet(path)
    for k in range(sliced.agg(F.max("slice")).first()[0] + 1):
        part = sliced.where(F.col("slice") == k)
        before = reduce(DataFrame.unionByName, stayed)
        for m in marks:
            part = part.join(before.select(m).where(F.col(m).isNotNull()), m, "left_anti")
        stayed.append(materialise(_stay(part, chain_rows, marks), "stayed"))
    return reduce(DataFrame.unionByName, stayed).select("_row")


def _stay(rows: DataFrame, n_rows: int, marks: Sequence[str]) -> DataFrame:
    """The rows of each chain that stay, from its rows in order; a task holds the marks of one chain."""
    names = ["_row", *marks]

    def stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, taken = None, [set() for _ in marks]
        for batch in batches:
            kept = []
            columns = [batch.column(n).to_pylist() for n in ("_chain", *marks)]
            for i, (at, *own) in enumerate(zip(*columns, strict=True)):
                if at != chain:
                    chain, taken = at, [set() for _ in marks]
                if not any(mark in seen for mark, seen in zip(own, taken, strict=True)):
                    kept.append(i)
                    for mark, seen in zip(own, taken, strict=True):
                        if mark is not None:
                            seen.add(mark)
            yield batch.select(names).take(pa.array(kept, pa.int64()))

    ordered = dealt(rows, n_rows, "_chain").sortWithinPartitions("_chain", "_place").select("_chain", *names)
    return ordered.mapInArrow(stay, ", ".join(f"{n} long" for n in names))


def _with_chains(rest: DataFrame, marks: Sequence[str]) -> DataFrame:
    """Add ``_chain``, the same for all rows that are linked by shared marks.

    Labels are contracted: each becomes the least label, by a hash that changes with the turn, among those that it shares a
    mark with. Marks with one label left drop out, and of the others at least about half the labels go in a turn, so turns are as
    many as the logarithm of the longest chain and handle ever fewer rows. Labels that a hash makes equal only join chains.
    """
    own = F.xxhash64(F.lit(-1), "_row")
    rest = rest.withColumn("_chain", F.when(F.col(marks[0]).isNull(), own).otherwise(F.xxhash64(F.lit(0), marks[0])))
    named = F.array(*[F.struct(F.lit(i).alias("key"), F.col(m).alias("mark")) for i, m in enumerate(marks) if i])
    links = rest.select("_chain", F.explode(named).alias("l")).select("_chain", "l.*").where("mark is not null").distinct()
    steps: list[DataFrame] = []
    while True:
        mixed = F.xxhash64("_chain", F.lit(len(steps)))
        lows = links.groupBy("key", "mark").agg(F.min(mixed).alias("low"), F.max(mixed).alias("high")).where("low < high")
        links = materialise(links.join(lows.drop("high"), ["key", "mark"]), "links")
        if not links.limit(1).count():
            break
        steps.append(materialise(links.groupBy("_chain").agg(F.min("low").alias("_to")), "chain-step"))
        links = links.join(steps[-1], "_chain").select(F.col("_to").alias("_chain"), "key", "mark").distinct()
    if not steps:
        return rest
    ends = steps[-1]
    for step in reversed(steps[:-1]):
        after = ends.select(F.col("_chain").alias("_to"), F.col("_to").alias("_end"))
        ends = step.join(after, "_to", "left").select("_chain", F.coalesce("_end", "_to").alias("_to"))
    return rest.join(ends, "_chain", "left").withColumn("_chain", F.coalesce("_to", "_chain")).drop("_to")


def insert_if_absent(existing: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The rows to append: not present under any key in the table, and of the batch's rows those whose write wins."""
    fresh = rows
    for key in keys:
        fresh = fresh.join(existing.select(key).where(F.col(key).isNotNull()), key, "left_anti")
    return first_write_wins(fresh, keys, order).select(*rows.columns)


def consolidate_labels(feedback: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Latest analyst label per transaction, replacing an existing one."""
    latest = feedback.groupBy("transaction_id").agg(
        F.max_by(F.struct("actual_label", "analyst_id", "created_at"), F.struct("created_at", "analyst_id", "actual_label")).alias("f"))
    labels = latest.select(
        "transaction_id",
        (F.upper("f.actual_label") == "FRAUD").alias("is_fraud"),
        F.concat(F.lit("analyst:"), F.col("f.analyst_id")).alias("label_source"),
        F.col("f.created_at").alias("confirmed_at"))
    if existing is None:
        return labels
    kept = existing.join(labels.select("transaction_id"), "transaction_id", "left_anti")
    return labels.unionByName(kept.select(*labels.columns))


def register_model(registry: DataFrame, versions: DataFrame) -> DataFrame:
    return registry.unionByName(insert_if_absent(registry, versions, ["version_id"], ["trained_at"]).select(*registry.columns))


def champion_model(registry: DataFrame) -> DataFrame:
    return registry.where("is_champion").orderBy(F.col("deployed_at").desc(), "version_id").limit(1)


def model_versions(registry: DataFrame) -> DataFrame:
    return registry.select("version_id", "model_name", "algorithm", "is_champion", "pr_auc", "roc_auc", "brier_score", "parameters").orderBy("version_id")


def summary_kpis(txn: DataFrame, decisions: DataFrame) -> DataFrame:
    """One conditional aggregate per table, one row out."""
    volume = txn.agg(F.count("*").alias("total_transactions"), F.coalesce(F.sum("amount").cast("double"), F.lit(0.0)).alias("total_volume"))
    triage = decisions.agg(
        F.count_if(F.col("decision") == "APPROVE").alias("approved_count"),
        F.count_if(F.col("decision") == "REVIEW").alias("review_count"),
        F.count_if(F.col("decision") == "BLOCK").alias("blocked_count"),
        F.coalesce(rounded(F.avg("risk_score").cast("double"), 2), F.lit(0.0)).alias("average_risk_score"))
    both = volume.select(F.lit(1).alias("_one"), "*").join(triage.select(F.lit(1).alias("_one"), "*"), "_one").drop("_one")
    rate = F.col("blocked_count") / F.nullif("total_transactions", F.lit(0)) * 100.0
    return both.withColumn("block_rate_pct", F.coalesce(rounded(rate, 2), F.lit(0.0)))


def risk_distribution(decisions: DataFrame) -> DataFrame:
    """Ten zero-filled score buckets."""
    score = F.col("risk_score").cast("double")
    start = F.least(F.lit(90), (F.floor(score / 10.0) * 10).cast("int"))
    counts = decisions.where(score.isNotNull()).groupBy(start.alias("start")).agg(F.count("*").alias("n"))
    every = decisions.sparkSession.range(0, 100, 10).select(F.col("id").cast("int").alias("start"))
    return every.join(counts, "start", "left").select(
        F.concat("start", F.lit("-"), F.col("start") + 10).alias("bucket"), F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def search(listing: DataFrame, term: str, decision: str = "ALL", candidates: DataFrame | None = None) -> DataFrame:
    """Rows whose ids contain the term in any case. ``candidates`` (keys, as ``sources.tables.search_candidates`` finds them)
    narrow the rows before they are looked at."""
    needle = F.lit(term.lower())
    if candidates is not None:
        listing = listing.join(candidates.select(F.col("key").alias("transaction_id")), "transaction_id", "left_semi")
    found = listing.where(F.contains(F.lower("transaction_id"), needle) | F.contains(F.lower("customer_id"), needle))
    return found if decision == "ALL" else found.where(F.col("decision") == decision)


def merge_live(live: DataFrame, stored: DataFrame, limit: int = 30) -> DataFrame:
    """Live rows that are not stored yet, then stored rows, newest first, cut to ``limit``.

    Both sides are cut to ``limit`` stored rows and live rows before the ordering of the union.
    """
    newest = [F.col("timestamp").desc(), F.col("transaction_id").desc()]
    fresh = live.join(stored.select("transaction_id"), "transaction_id", "left_anti").select(*stored.columns)
    first = fresh.orderBy(*newest).limit(limit).withColumn("source", F.lit("live"))
    second = stored.orderBy(*newest).limit(limit).withColumn("source", F.lit("stored"))
    return first.unionByName(second).orderBy("source", *newest).limit(limit)


def training_extract(txn: DataFrame, features: DataFrame, labels: DataFrame) -> DataFrame:
    """Transactions with features and consolidated labels."""
    plain = features.drop("timestamp", "customer_id", "merchant_id", "is_fraud", "amount")
    return txn.select("transaction_id", "timestamp", "customer_id", "amount").join(plain, "transaction_id").join(
        labels.select("transaction_id", "is_fraud", "label_source"), "transaction_id")


def fraud_trends(df: DataFrame, bucket: str = "1 hour") -> DataFrame:
    return df.groupBy(F.window("timestamp", bucket).alias("w")).agg(
        F.count_if("is_fraud").alias("fraud_count"),
        F.count_if(~F.col("is_fraud")).alias("genuine_count"),
        F.coalesce(F.sum(F.when(F.col("is_fraud"), F.col("amount"))).cast("double"), F.lit(0.0)).alias("fraud_volume"),
        F.coalesce(F.sum(F.when(~F.col("is_fraud"), F.col("amount"))).cast("double"), F.lit(0.0)).alias("genuine_volume"),
    ).select(F.col("w.start").alias("bucket_start"), "fraud_count", "genuine_count", "fraud_volume", "genuine_volume")


def constraint_report(txn: DataFrame, customers: DataFrame, merchants: DataFrame, decisions: DataFrame,
                      feedback: DataFrame | None = None) -> DataFrame:
    """Violations per constraint. Foreign keys are reduced to distinct keys with counts before the anti join."""

    def orphans(name: str, child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
        used = child.groupBy(key).agg(F.count("*").alias("n"))
        lost = used.join(parent.select(key), key, "left_anti")
        return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(F.lit(name).alias("constraint_name"), "violations")

    def duplicates(name: str, df: DataFrame, key: str) -> DataFrame:
        twice = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
        return twice.agg(F.count("*").alias("violations")).select(F.lit(name).alias("constraint_name"), "violations")

    def failing(name: str, df: DataFrame, ok: Column) -> DataFrame:
        return df.agg(F.count_if(~F.coalesce(ok, F.lit(False))).alias("violations")).select(F.lit(name).alias("constraint_name"), "violations")

    parts = [
        orphans("transactions_customer_fk", txn, customers, "customer_id"),
        orphans("transactions_merchant_fk", txn, merchants, "merchant_id"),
        orphans("decisions_transaction_fk", decisions, txn, "transaction_id"),
        duplicates("transactions_pk", txn, "transaction_id"),
        duplicates("decisions_transaction_unique", decisions, "transaction_id"),
        failing("decisions_score_range", decisions, F.col("risk_score").between(0, 100)),
        failing("decisions_value", decisions, F.col("decision").isin("APPROVE", "REVIEW", "BLOCK")),
    ]
    if feedback is not None:
        parts.append(failing("feedback_label", feedback, F.col("actual_label").isin("FRAUD", "LEGITIMATE")))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def audit_rows(df: DataFrame, actor: str, action: str, target: str, details: Mapping[str, str] | None = None,
               ip_address: str | None = None) -> DataFrame:
    """Audit events for the rows of ``df``; ``target`` and ``ip_address`` name the columns with the resource id and
    the address that the action came from."""
    return df.select(
        F.lit(actor).alias("actor"), F.lit(action).alias("action"), F.col(target).alias("target_resource"),
        F.to_json(F.struct(*[F.col(c).alias(k) for k, c in (details or {}).items()])).alias("details") if details
        else F.lit(None).cast("string").alias("details"),
        (F.lit(None).cast("string") if ip_address is None else F.col(ip_address)).alias("ip_address"),
        F.current_timestamp().alias("created_at"))
