"""Fixed schemas of the tables and the names of the feature vector."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
SCORE = T.DecimalType(5, 2)
COST = T.DecimalType(10, 2)


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


S, D, I, L, B, TS = (
    T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampType(),
)

TRANSACTION = _struct(
    ("transaction_id", S, False), ("timestamp", TS, False), ("customer_id", S, False),
    ("merchant_id", S, False), ("amount", MONEY, False), ("currency", S, True), ("country", S, True),
    ("city", S, True), ("lat", D, True), ("lon", D, True), ("device_id", S, True),
    ("payment_method", S, True), ("ip_address", S, True), ("merchant_category", S, True),
    ("is_fraud", B, True), ("scenario", S, True),
)

# Columns the dataset contract requires to be present and non-null.
REQUIRED_COLUMNS = [
    "transaction_id", "timestamp", "customer_id", "merchant_id", "amount", "currency", "country",
    "city", "lat", "lon", "device_id", "payment_method", "merchant_category", "is_fraud",
]

#: A raw stream event: numbers arrive as text or numbers, so they are read as strings and cast.
RAW_EVENT = _struct(
    ("transaction_id", S, True), ("timestamp", S, True), ("customer_id", S, True),
    ("merchant_id", S, True), ("amount", S, True), ("currency", S, True), ("country", S, True),
    ("city", S, True), ("lat", S, True), ("lon", S, True), ("device_id", S, True),
    ("payment_method", S, True), ("ip_address", S, True), ("merchant_category", S, True),
    ("idempotency_key", S, True),
)

CUSTOMER = _struct(
    ("customer_id", S, False), ("home_country", S, False), ("home_city", S, False),
    ("average_amount", MONEY, False), ("std_amount", MONEY, False),
    ("typical_hour_start", I, True), ("typical_hour_end", I, True), ("status", S, False),
)

MERCHANT = _struct(
    ("merchant_id", S, False), ("name", S, False), ("category", S, False), ("mcc_code", S, False),
    ("country", S, False), ("city", S, False), ("risk_tier", S, False),
)

PROFILE = _struct(
    ("customer_id", S, False), ("home_country", S, True), ("home_city", S, True),
    ("average_amount", D, True), ("std_amount", D, True),
    ("typical_hour_start", I, True), ("typical_hour_end", I, True),
    ("devices", T.ArrayType(S), True),
)

DRIVER = _struct(("feature", S, False), ("impact", D, False))
TRIGGERED_RULE = _struct(
    ("rule_code", S, False), ("description", S, False), ("severity_penalty", D, False), ("category", S, False),
)

PREDICTION = _struct(
    ("transaction_id", S, False), ("model_version_id", S, False), ("raw_score", D, False),
    ("calibrated_probability", D, False), ("anomaly_score", D, False), ("inference_latency_ms", D, True), ("feature_payload", S, True),
    ("shap_positive_drivers", T.ArrayType(DRIVER), True), ("shap_negative_drivers", T.ArrayType(DRIVER), True),
)

DECISION = _struct(
    ("transaction_id", S, False), ("risk_score", SCORE, False), ("decision", S, False),
    ("triggered_rules", T.ArrayType(TRIGGERED_RULE), True), ("cost_estimate_fn", COST, True),
    ("cost_estimate_fp", COST, True), ("status", S, False),
)

FEEDBACK = _struct(
    ("transaction_id", S, False), ("analyst_id", S, False), ("actual_label", S, False),
    ("notes", S, True), ("created_at", TS, False),
)

FRAUD_LABEL = _struct(
    ("transaction_id", S, False), ("is_fraud", B, False), ("label_source", S, False), ("confirmed_at", TS, False),
)

AUDIT_EVENT = _struct(
    ("actor", S, False), ("action", S, False), ("target_resource", S, False), ("details", S, True),
    ("ip_address", S, True), ("created_at", TS, False),
)

#: ``parameters``: the training parameters as JSON.
MODEL_VERSION = _struct(
    ("version_id", S, False), ("model_name", S, False), ("algorithm", S, False), ("is_champion", B, False),
    ("pr_auc", D, True), ("roc_auc", D, True), ("brier_score", D, True), ("parameters", S, True), ("trained_at", TS, False),
    ("deployed_at", TS, True),
)

# The feature vector in model order. -------------------------------------------------
FEATURES = [
    "amount", "log_amount", "hour_of_day", "day_of_week", "is_weekend", "is_unusual_hour",
    "txn_count_1m", "txn_count_5m", "txn_count_15m", "txn_count_1h", "txn_count_24h", "txn_count_7d",
    "amount_sum_5m", "amount_sum_1h",
    "customer_avg_amount", "customer_std_amount", "customer_amount_zscore", "amount_to_avg_ratio",
    "is_new_device", "is_new_country", "is_new_city",
    "unique_merchants_24h", "unique_countries_7d", "unique_devices_30d",
    "time_since_prev_txn", "geo_distance_km", "travel_speed_kmh", "impossible_travel",
    "device_customer_count", "merchant_risk_score",
]
BINARY_FEATURES = [
    "is_weekend", "is_unusual_hour", "is_new_device", "is_new_country", "is_new_city", "impossible_travel",
]
NUMERIC_FEATURES = [f for f in FEATURES if f not in BINARY_FEATURES]
ANOMALY_FEATURES = [
    "amount", "log_amount", "customer_amount_zscore", "amount_to_avg_ratio", "txn_count_1m", "txn_count_5m",
    "txn_count_1h", "travel_speed_kmh", "geo_distance_km", "time_since_prev_txn", "device_customer_count",
]
ID_COLUMNS = ["transaction_id", "timestamp", "customer_id", "merchant_id", "is_fraud"]
# ---------------------------------------------------------------------------------------------------
