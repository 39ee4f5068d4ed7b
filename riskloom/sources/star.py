"""Adapter: the star-schema test tables seen as payment data. Deterministic, one pass, no randomness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import policy
from riskloom.functions.columns import rounded
from riskloom.functions.rules import RULES

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name == "events":
        reader = reader.schema(EVENTS)
    return reader.parquet(f"{sf_dir}/{name}.parquet")


# The category of a merchant is this list at (merchant number % 10). ------------------
CATEGORY_BY_SLOT = [
    "JEWELRY_LUXURY", "DIGITAL_WALLET_TRANSFER", "ELECTRONICS", "GAMING_CASINO", "DEPARTMENT_STORE",
    "GAS_STATION", "UTILITIES", "GROCERY", "RESTAURANT", "OTHER",
]
# ---------------------------------------------------------------------------------------------------


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event once; every fiftieth event as a burst of five, ten seconds apart."""
    events = table(spark, sf_dir, "events")
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("nk"), F.col("n_name").alias("country"))
    eid = F.col("event_id")
    rows = events.withColumn(
        "i", F.explode(F.when(eid % 50 == 0, F.sequence(F.lit(0), F.lit(4))).otherwise(F.array(F.lit(0))))
    ).withColumns({
        "nk": F.when(eid % 10 < 8, F.col("user_id") % 25).otherwise(eid % 25),
        "mk": (eid * 31) % 50,
    }).join(nations, "nk")
    utc = F.to_utc_timestamp(F.col("ts").cast("timestamp"), "UTC")
    octets = F.concat_ws(".", F.lit("10"), (eid % 250).cast("string"), (eid % 199).cast("string"), (eid % 97).cast("string"))
    return rows.select(
        F.concat(F.lit("TXN-"), eid, F.lit("-"), F.col("i")).alias("transaction_id"),
        F.timestamp_micros(F.unix_micros(utc) + F.col("i") * 10_000_000).alias("timestamp"),
        F.concat(F.lit("CUST-"), F.col("user_id")).alias("customer_id"),
        F.concat(F.lit("MERCH-"), F.col("mk")).alias("merchant_id"),
        (F.col("value") * 100).cast("decimal(12,2)").alias("amount"),
        F.lit("USD").alias("currency"),
        "country",
        F.concat(F.lit("CITY-"), F.col("nk"), F.lit("-"), eid % 3).alias("city"),
        (F.col("nk") * 5.0 - 60.0).alias("lat"),
        (F.col("nk") * 13.5 - 170.0).alias("lon"),
        F.concat(F.lit("DEV-"), F.get_json_object("props", "$.k")).alias("device_id"),
        F.when(F.col("event_type") == "purchase",
               F.concat(F.lit("TOKEN_CC_"), F.lpad((eid % 10_000).cast("string"), 4, "0")))
        .otherwise("UPI").alias("payment_method"),
        F.when(eid % 7 == 0, F.lit(None).cast("string"))
        .when(eid % 7 == 1, F.concat(F.lit("2001:db8:0:"), eid % 100, F.lit("::"), eid % 9))
        .otherwise(octets).alias("ip_address"),
        F.element_at(F.array(*[F.lit(c) for c in CATEGORY_BY_SLOT]), (F.col("mk") % 10 + 1).cast("int"))
        .alias("merchant_category"),
        ((F.col("value") > 200) | ((F.col("event_type") == "error") & (F.col("value") > 60))).alias("is_fraud"),
        F.lit(None).cast("string").alias("scenario"),
        F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("value") - 120.0) / 40.0)), 6).alias("p_raw"),
        F.least(F.lit(1.0), F.col("value") / 500.0).alias("anomaly"),
        (eid * 5 + F.col("i")).alias("ingest_order"),
        "event_id",
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer dimension: every user that has events, joined to the customer table."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    known = table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation")
    uid = F.col("user_id")
    hour = lambda base: F.when(uid % 5 != 0, (uid % 3 + base).cast("int"))
    joined = users.join(known, uid == known.c_custkey).join(nations, (uid % 25) == nations.n_nationkey)
    return joined.select(
        F.concat(F.lit("CUST-"), uid).alias("customer_id"),
        F.col("n_name").alias("home_country"),
        F.concat(F.lit("CITY-"), uid % 25, F.lit("-0")).alias("home_city"),
        F.greatest(F.lit(0), F.col("c_acctbal")).cast("decimal(12,2)").alias("average_amount"),
        F.lit(30).cast("decimal(12,2)").alias("std_amount"),
        hour(7).alias("typical_hour_start"),
        hour(21).alias("typical_hour_end"),
        F.lit("ACTIVE").alias("status"),
    )


def merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merchant dimension: the merchants of a known category that appear in the events."""
    mk = ((F.col("event_id") * 31) % 50).alias("mk")
    seen = table(spark, sf_dir, "events").select(mk).distinct()
    named = seen.select(
        F.concat(F.lit("MERCH-"), F.col("mk")).alias("merchant_id"),
        F.concat(F.lit("Merchant "), F.col("mk")).alias("name"),
        F.element_at(F.array(*[F.lit(c) for c in CATEGORY_BY_SLOT]), (F.col("mk") % 10 + 1).cast("int")).alias("category"),
        F.lit("5411").alias("mcc_code"),
        F.lit("US").alias("country"),
        F.lit("New York").alias("city"),
        F.lit("STANDARD").alias("risk_tier"),
    )
    return named.where(F.col("category") != "OTHER")


def predictions(txn: DataFrame) -> DataFrame:
    """Stored predictions: the stand-in scores of the transactions that carry a network address."""
    drivers = F.array(F.struct(F.lit("amount").alias("feature"), F.round(F.col("p_raw") - 0.5, 4).alias("impact")))
    none = F.array().cast("array<struct<feature:string,impact:double>>")
    up = F.col("p_raw") > 0.5
    return txn.where(F.col("ip_address").isNotNull()).select(
        "transaction_id", F.lit("v1.0.0").alias("model_version_id"), F.col("p_raw").alias("raw_score"),
        F.col("p_raw").alias("calibrated_probability"), F.col("anomaly").alias("anomaly_score"),
        (F.col("anomaly") * 100.0).alias("inference_latency_ms"),
        F.when(up, drivers).otherwise(none).alias("shap_positive_drivers"),
        F.when(up, none).otherwise(drivers).alias("shap_negative_drivers"))


def decisions(txn: DataFrame) -> DataFrame:
    """Stored decisions: score 100 x p for the transactions at merchants of a known category."""
    score = rounded(F.col("p_raw") * 100.0, 2)
    costs = policy.expected_costs(F.col("amount"), F.col("p_raw"))
    fired = F.when(score >= 75, F.array(rule_struct("R07_HIGH_AMOUNT_ZSCORE"))).otherwise(
        F.array().cast("array<struct<rule_code:string,description:string,severity_penalty:double,category:string>>"))
    return txn.where(F.col("merchant_category") != "OTHER").select(
        "transaction_id", "timestamp", "customer_id", score.cast("decimal(5,2)").alias("risk_score"), policy.decision(score).alias("decision"),
        fired.alias("triggered_rules"), costs["cost_approve"].cast("decimal(12,2)").alias("cost_estimate_fn"),
        costs["cost_block"].cast("decimal(12,2)").alias("cost_estimate_fp"), F.lit("FINAL").alias("status"))


def rule_struct(code: str):
    _, category, penalty, text, _ = next(r for r in RULES if r[0] == code)
    return F.struct(F.lit(code).alias("rule_code"), F.lit(text).alias("description"),
                    F.lit(penalty).alias("severity_penalty"), F.lit(category).alias("category"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyst feedback: purchases and errors are reviewed by two analysts, the second one an hour later."""
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error"))
    first = F.struct(F.lit("A1").alias("analyst_id"), (F.col("value") > 60).alias("guilty"), F.lit(1).alias("hours"))
    second = F.struct(F.lit("A2").alias("analyst_id"), (F.col("value") > 90).alias("guilty"), F.lit(2).alias("hours"))
    both = events.select("event_id", "ts", "event_type", F.explode(F.array(first, second)).alias("f"))
    return both.select(
        F.concat(F.lit("TXN-"), F.col("event_id"), F.lit("-0")).alias("transaction_id"),
        F.col("f.analyst_id").alias("analyst_id"),
        F.when(F.col("f.guilty"), "FRAUD").otherwise("LEGITIMATE").alias("actual_label"),
        F.concat(F.lit("reviewed "), F.col("event_type")).alias("notes"),
        F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("f.hours") * 3_600_000_000).alias("created_at"))


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage latencies: the event type names the step, the value is milliseconds."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("step"), F.col("value").alias("latency_ms"), F.col("ts").cast("timestamp").alias("timestamp"))


def order_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as day-grain transactions: repeated (customer, day) pairs exercise the strict precedence."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    nk = F.col("o_custkey") % 25
    return orders.select(
        F.concat(F.lit("ORD-"), key).alias("transaction_id"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("CUST-"), F.col("o_custkey")).alias("customer_id"),
        F.concat(F.lit("MERCH-"), key % 50).alias("merchant_id"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("amount"),
        F.col("o_orderpriority").alias("country"),
        F.concat(F.lit("CITY-"), key % 40).alias("city"),
        (nk * 5.0 - 60.0).alias("lat"),
        ((key % 25) * 13.5 - 170.0).alias("lon"),
        F.concat(F.lit("DEV-"), key % 500).alias("device_id"),
        (F.col("o_orderstatus") == "F").alias("is_fraud"),
    )
