"""Dataset validation, the request contract, defaults and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.columns import micros, rounded
from riskloom.operators.ordered import exact_percentiles, strict_prefix
from riskloom.schemas import FEATURES, REQUIRED_COLUMNS

REPORT_SCHEMA = (
    "is_valid boolean, total_records long, fraud_count long, fraud_ratio_pct double, "
    "null_values long, invalid_amounts long, invalid_lat long, invalid_lon long, order_inversions long, "
    "errors array<string>, warnings array<string>"
)


def order_inversions(df: DataFrame, order: str = "ingest_order", slice_rows: int = 1_000_000) -> DataFrame:
    """One row: how many rows are earlier than the row before them in ingest order.

    The previous row is the maximum (order, time) over smaller order values; slices of the order axis
    keep any one task to ``slice_rows`` rows.
    """
    axis = df.select(F.col(order).cast("long").alias("o"), micros(F.col("timestamp")).alias("us"))
    paired = strict_prefix(
        axis.withColumns({"k": F.lit(0), "here": F.struct("o", "us")}), ["k"], "o", (), ["here"],
        (slice_rows, slice_rows * 1000),
    )
    return paired.agg(F.count_if(F.col("us") < F.col("before_here.us")).alias("order_inversions"))


def validate(df: DataFrame, order: str | None = None) -> DataFrame:
    """One-row report; the message texts are fixed values. A missing column or a non-timestamp is found on the schema; the rest is one aggregate."""
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        row = df.agg(F.count("*").alias("total_records"))
        error = F.when(F.col("total_records") == 0, "Dataset is completely empty.").otherwise(
            "Missing required columns: " + ", ".join(missing))
        return row.select(
            F.lit(False).alias("is_valid"), "total_records",
            *[F.lit(0).cast(t).alias(n) for n, t in (
                ("fraud_count", "long"), ("fraud_ratio_pct", "double"), ("null_values", "long"),
                ("invalid_amounts", "long"), ("invalid_lat", "long"), ("invalid_lon", "long"),
                ("order_inversions", "long"))],
            F.array(error).alias("errors"), F.array().cast("array<string>").alias("warnings"),
        )
    timed = isinstance(df.schema["timestamp"].dataType, (T.TimestampType, T.TimestampNTZType))
    nulls = [F.count_if(F.col(c).isNull()) for c in REQUIRED_COLUMNS]
    total_nulls = nulls[0]
    for n in nulls[1:]:
        total_nulls = total_nulls + n
    report = df.agg(
        F.count("*").alias("total_records"),
        F.coalesce(F.sum(F.col("is_fraud").cast("long")), F.lit(0)).alias("fraud_count"),
        F.coalesce(rounded(F.avg(F.col("is_fraud").cast("double")) * 100.0, 3), F.lit(0.0)).alias("fraud_ratio_pct"),
        total_nulls.alias("null_values"),
        F.array_compact(F.array(*[
            F.when(n > 0, F.concat(F.lit(f"{c}="), n)) for c, n in zip(REQUIRED_COLUMNS, nulls)
        ])).alias("_null_list"),
        F.count_if(F.col("amount") <= 0).alias("invalid_amounts"),
        F.count_if((F.col("lat") < -90.0) | (F.col("lat") > 90.0)).alias("invalid_lat"),
        F.count_if((F.col("lon") < -180.0) | (F.col("lon") > 180.0)).alias("invalid_lon"),
    )
    if order is not None and timed:
        report = report.withColumn("order_inversions", order_inversions(df, order).scalar())
    else:
        report = report.withColumn("order_inversions", F.lit(0).cast("long"))
    empty = F.col("total_records") == 0
    problems = F.array_compact(F.array(
        F.when(F.col("null_values") > 0,
               F.concat(F.lit("Found null values in critical columns: "), F.array_join("_null_list", ", "))),
        F.when(F.col("invalid_amounts") > 0,
               F.concat(F.lit("Found "), F.col("invalid_amounts"), F.lit(" transactions with amount <= 0."))),
        F.when((F.col("invalid_lat") > 0) | (F.col("invalid_lon") > 0),
               F.concat(F.lit("Found coordinate boundary errors: lat="), F.col("invalid_lat"),
                        F.lit(", lon="), F.col("invalid_lon"))),
        F.lit(None).cast("string") if timed else F.lit("Column 'timestamp' is not datetime type."),
    ))
    notes = F.array_compact(F.array(
        F.when(F.col("order_inversions") > 0, F.lit("Dataset timestamps are not strictly monotonic increasing.")),
        F.when(F.col("fraud_ratio_pct") > 15.0, F.concat(F.lit("Fraud ratio is unusually high ("), F.col("fraud_ratio_pct").cast("string"), F.lit("%)"))),
        F.when(F.col("fraud_ratio_pct") < 0.1, F.concat(F.lit("Fraud ratio is extremely low ("), F.col("fraud_ratio_pct").cast("string"), F.lit("%)"))),
    ))
    none = F.array().cast("array<string>")
    out = report.withColumns({
        "errors": F.when(empty, F.array(F.lit("Dataset is completely empty."))).otherwise(problems),
        "warnings": F.when(empty, none).otherwise(notes),
    }).withColumn("is_valid", F.size("errors") == 0)
    return out.select(*[f.split()[0] for f in REPORT_SCHEMA.split(", ")])


def summary_stats(df: DataFrame) -> DataFrame:
    """One row of amount statistics, distinct counts and the time span."""
    amount = F.col("amount").cast("double")
    basics = df.agg(
        F.min(amount).alias("amount_min"),
        rounded(F.avg("amount").cast("double"), 2).alias("amount_mean"),
        F.max(amount).alias("amount_max"),
        F.count_distinct("customer_id").alias("unique_customers"),
        F.count_distinct("merchant_id").alias("unique_merchants"),
        F.count_distinct("device_id").alias("unique_devices"),
        F.count_distinct("country").alias("unique_countries"),
        F.min("timestamp").alias("date_start"),
        F.max("timestamp").alias("date_end"),
    )
    marks = exact_percentiles(df.select("amount"), [], "amount", {"p50": 0.5, "p95": 0.95})
    return basics.withColumns({
        "amount_median": rounded(marks.select("p50").scalar(), 2),
        "amount_p95": rounded(marks.select("p95").scalar(), 2),
    })


# -- request contract -------------------------------------------------------------------------------

MAX_AMOUNT = 10_000_000


def contract_failures(now: Column | None = None) -> Column:
    """Names of the failed request checks. Absent optional fields pass, as defaults fill them."""

    def size(name: str, low: int, high: int) -> Column:
        return ~F.length(name).between(low, high)

    checks = [
        ("transaction_id", F.col("transaction_id").isNull() | size("transaction_id", 1, 128)),
        ("customer_id", F.col("customer_id").isNull() | size("customer_id", 1, 128)),
        ("merchant_id", F.length("merchant_id") > 128),
        ("amount", F.col("amount").isNull() | (F.col("amount") <= 0) | (F.col("amount") > MAX_AMOUNT)),
        ("currency", size("currency", 3, 3)),
        ("country", size("country", 2, 2)),
        ("city", F.length("city") > 100),
        ("lat", ~F.col("lat").between(-90.0, 90.0)),
        ("lon", ~F.col("lon").between(-180.0, 180.0)),
        ("device_id", F.length("device_id") > 128),
        ("payment_method", F.length("payment_method") > 64),
        ("ip_address", F.length("ip_address") > 64),
    ]
    if now is not None:
        checks.append(("timestamp", micros(F.col("timestamp")) > micros(now) + 300 * 1_000_000))
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks]))


def split_valid_rejected(df: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    checked = df.withColumn("failed_checks", contract_failures(now))
    valid = checked.where(F.size("failed_checks") == 0).drop("failed_checks")
    return valid, checked.where(F.size("failed_checks") > 0)


# Request defaults. -------------------------------------------------------------------
DEFAULTS = {
    "merchant_id": "MERCH-4091", "currency": "USD", "country": "US", "city": "New York",
    "lat": 40.7128, "lon": -74.0060, "device_id": "DEV-MOBILE-01", "payment_method": "credit_card",
    "ip_address": "192.168.1.1",
}
# ---------------------------------------------------------------------------------------------------


def apply_defaults(df: DataFrame, ingest_time: Column | None = None) -> DataFrame:
    moment = F.current_timestamp() if ingest_time is None else ingest_time
    own_key = F.col("idempotency_key") if "idempotency_key" in df.columns else F.lit(None).cast("string")
    filled = {c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in DEFAULTS.items()}
    return df.withColumns({
        "timestamp": F.coalesce(F.col("timestamp"), moment),
        "idempotency_key": F.coalesce(own_key, F.col("transaction_id")),
        **filled,
    })


def fill_features(df: DataFrame, names: list[str] = FEATURES, keep: tuple[str, ...] = ("transaction_id",)) -> DataFrame:
    """Model input: every named feature as a double, absent or null ones 0.0, in model order."""
    return df.select(*keep, *[
        (F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in df.columns else F.lit(0.0)).alias(n) for n in names
    ])


def normalise_amount(df: DataFrame) -> DataFrame:
    """Positive amounts, two decimals."""
    return df.where(F.col("amount") > 0).withColumn(
        "amount", F.round(F.col("amount").cast("decimal(20,6)"), 2).cast("decimal(12,2)"))


def label_feedback_check(df: DataFrame) -> DataFrame:
    """Feedback rows with a ``valid`` flag."""
    ok = (
        F.coalesce(F.length("transaction_id").between(1, 128), F.lit(False))
        & F.coalesce(F.length("analyst_id").between(1, 128), F.lit(False))
        & F.coalesce(F.col("actual_label").isin("FRAUD", "LEGITIMATE"), F.lit(False))
        & F.coalesce(F.length("notes") <= 1000, F.lit(True))
    )
    return df.withColumn("valid", ok)
