"""Exploratory aggregates. All of them are map-side-combined group-bys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import rounded
from riskloom.operators.ordered import collapse, percentiles_of, range_prefix


def overview(df: DataFrame) -> DataFrame:
    base = df.agg(
        F.count("*").alias("total_transactions"),
        F.sum(F.col("is_fraud").cast("long")).alias("fraudulent_transactions"),
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
    )
    fraud, total = F.col("fraudulent_transactions"), F.col("total_transactions")
    legit = total - fraud
    span = (F.unix_micros("end_time") - F.unix_micros("start_time")) / 86_400_000_000.0
    return base.withColumns({
        "legitimate_transactions": legit,
        "fraud_rate_percentage": rounded(fraud / F.nullif(total, F.lit(0)) * 100.0, 3),
        "class_imbalance_ratio": F.concat(F.lit("1:"), F.floor(legit / F.greatest(fraud, F.lit(1)))),
        "duration_days": rounded(span, 2),
    })


def amount_by_class(df: DataFrame) -> DataFrame:
    """Three rows (overall, legitimate, fraudulent): mean, sample std, median, p75, p95, max.

    The rows are doubled into (class, overall) and collapsed to distinct amounts first, so the exact
    percentiles work on distinct values with multiplicities.
    """
    groups = F.explode(F.array(
        F.lit("overall"), F.when(F.col("is_fraud"), F.lit("fraudulent")).otherwise(F.lit("legitimate"))))
    tall = df.select(groups.alias("segment"), F.col("amount"))
    basics = tall.groupBy("segment").agg(
        F.count("*").alias("transactions"),
        rounded(F.avg("amount").cast("double"), 2).alias("mean"),
        rounded(F.stddev_samp(F.col("amount").cast("double")), 2).alias("std"),
        F.max(F.col("amount").cast("double")).alias("max"),
    )
    points = range_prefix(collapse(tall, ["segment"], "amount"), ["segment"], ["amount"], ["n"])
    marks = percentiles_of(points, ["segment"], "amount", {"median": 0.5, "p75": 0.75, "p95": 0.95})
    joined = basics.join(marks, "segment", "left")
    return joined.withColumns({c: rounded(F.col(c), 2) for c in ("median", "p75", "p95")})


def cardinality(df: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(
        count("customer_id").alias("unique_customers"),
        count("merchant_id").alias("unique_merchants"),
        count("device_id").alias("unique_devices"),
        count("country").alias("unique_countries"),
        count("city").alias("unique_cities"),
    )


def fraud_by(df: DataFrame, dimensions: tuple[str, ...] = ("hour", "merchant_category", "country")) -> DataFrame:
    """Count and fraud rate per value of each dimension, all dimensions in one grouping-sets aggregate."""
    labelled = df.select(
        F.hour("timestamp").cast("string").alias("hour"),
        *[F.col(d).cast("string").alias(d) for d in dimensions if d != "hour"],
        F.col("is_fraud").cast("double").alias("y"),
    )
    sets = [[F.col(d)] for d in dimensions]
    grouped = labelled.groupingSets(sets, *dimensions).agg(
        F.count("*").alias("transactions"),
        rounded(F.avg("y"), 6).alias("fraud_rate"),
        F.grouping_id(*dimensions).alias("_gid"),
    )
    full = (1 << len(dimensions)) - 1
    which, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, d in enumerate(dimensions):
        only = full - (1 << (len(dimensions) - 1 - i))
        which = F.when(F.col("_gid") == only, F.lit(d)).otherwise(which)
        value = F.when(F.col("_gid") == only, F.col(d)).otherwise(value)
    return grouped.select(which.alias("dimension"), value.alias("value"), "transactions", "fraud_rate")
