"""The rule table and the columns generated from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import rounded

# Code, category, penalty, description, predicate. ------------------------------------
RULES = [
    ("R01_IMPOSSIBLE_TRAVEL", "KINEMATICS", 0.90,
     "Geographic transit speed exceeds commercial flight physics (>900 km/h over >200 km)",
     "impossible_travel = 1 OR (travel_speed_kmh > 900 AND geo_distance_km > 200)"),
    ("R02_VELOCITY_BURST_1M", "VELOCITY", 0.80,
     "Transaction velocity spike (>=3 transactions within 60 seconds)",
     "txn_count_1m >= 3"),
    ("R03_NEW_DEVICE_HIGH_AMOUNT", "ACCOUNT_TAKEOVER", 0.75,
     "Account Takeover pattern: Unrecognized device combined with high spending z-score (>3.0)",
     "is_new_device = 1 AND customer_amount_zscore > 3"),
    ("R04_NEW_COUNTRY_FIRST_TIME", "GEOGRAPHY", 0.60,
     "First-time international transaction exceeding INR 5,000",
     "is_new_country = 1 AND amount > 5000"),
    ("R05_DEVICE_SHARING_ANOMALY", "DEVICE_SYNDICATE", 0.85,
     "Syndicate pattern: Device observed across >=4 distinct customer accounts in 24h",
     "device_customer_count >= 4"),
    ("R06_UNUSUAL_HOUR_LARGE_SPEND", "DIURNAL", 0.50,
     "Off-hours transaction with amount exceeding 5x customer historical average",
     "is_unusual_hour = 1 AND amount_to_avg_ratio > 5"),
    ("R07_HIGH_AMOUNT_ZSCORE", "MONETARY", 0.70,
     "Extreme monetary outlier exceeding 5 standard deviations from historical baseline",
     "customer_amount_zscore >= 5"),
    ("R08_HIGH_RISK_MERCHANT_ANOMALY", "MERCHANT", 0.65,
     "Substantial spend at high-risk merchant category (Crypto, Luxury, Gaming)",
     "merchant_risk_score >= 0.7D AND amount_to_avg_ratio > 4"),
]
# ---------------------------------------------------------------------------------------------------


def triggered_rules(rules=RULES) -> Column:
    fired = [
        F.when(
            F.expr(predicate),
            F.struct(
                F.lit(code).alias("rule_code"),
                F.lit(text).alias("description"),
                F.lit(float(penalty)).alias("severity_penalty"),
                F.lit(category).alias("category"),
            ),
        )
        for code, category, penalty, text, predicate in rules
    ]
    return F.array_compact(F.array(*fired))


def rule_score(rules=RULES) -> Column:
    """Sum of the fired penalties, at most 1. Written as a plain sum so it stays in generated code."""
    total = F.lit(0.0)
    for _, _, penalty, _, predicate in rules:
        total = total + F.when(F.expr(predicate), F.lit(float(penalty))).otherwise(0.0)
    return rounded(F.least(F.lit(1.0), total), 4)


def with_rules(df: DataFrame, rules=RULES) -> DataFrame:
    return df.withColumns({"triggered_rules": triggered_rules(rules), "rule_score": rule_score(rules)})


def rule_hits(df: DataFrame, window: str = "1 day") -> DataFrame:
    """How often each rule fired per time window. Map-side partial counts; at most rules x windows groups."""
    return (
        df.select("timestamp", F.explode("triggered_rules.rule_code").alias("rule_code"))
        .groupBy("rule_code", F.window("timestamp", window).alias("w"))
        .agg(F.count("*").alias("hits"))
        .select("rule_code", F.col("w.start").alias("window_start"), "hits")
    )
