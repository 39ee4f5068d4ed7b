"""Behavioural deviation score and its reason codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import clip, rounded

# Component weights. ------------------------------------------------------------------
WEIGHTS = {
    "amount_component": 0.35,
    "velocity_component": 0.25,
    "kinematic_component": 0.20,
    "novelty_component": 0.15,
    "diurnal_component": 0.05,
}
# ---------------------------------------------------------------------------------------------------


def amount_component() -> Column:
    z, ratio = F.col("customer_amount_zscore"), F.col("amount_to_avg_ratio")
    graded = F.when((z > 2.0) | (ratio > 3.0), clip((z - 1.5) / 3.5, 0.0, 1.0)).otherwise(0.0)
    return F.when(ratio > 8.0, F.greatest(graded, F.lit(0.85))).otherwise(graded)


def velocity_component() -> Column:
    per_minute, per_hour = F.col("txn_count_1m"), F.col("txn_count_1h")
    return F.least(F.lit(1.0), per_minute * 0.45 + F.greatest(F.lit(0), per_hour - 3) * 0.10)


def kinematic_component() -> Column:
    speed = F.col("travel_speed_kmh")
    return (
        F.when(F.col("impossible_travel") == 1, 1.0)
        .when(speed > 500.0, F.least(F.lit(1.0), speed / 900.0))
        .otherwise(0.0)
    )


def novelty_component() -> Column:
    return F.col("is_new_device") * 0.4 + F.col("is_new_country") * 0.4 + F.col("is_new_city") * 0.2


def diurnal_component() -> Column:
    return F.col("is_unusual_hour") * 0.5


def components() -> dict[str, Column]:
    return {
        "amount_component": amount_component(),
        "velocity_component": velocity_component(),
        "kinematic_component": kinematic_component(),
        "novelty_component": novelty_component(),
        "diurnal_component": diurnal_component(),
    }


def behavior_score() -> Column:
    parts = components()
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + parts[name] * weight
    return rounded(clip(total, 0.0, 1.0), 4)


def behavior_signals() -> Column:
    """Reason codes in a fixed order."""
    z, ratio = F.col("customer_amount_zscore"), F.col("amount_to_avg_ratio")
    impossible = F.col("impossible_travel") == 1
    # The signal codes and their limits.
    conditions = [
        ("AMOUNT_HIGH_ZSCORE", (z > 2.0) | (ratio > 3.0)),
        ("AMOUNT_RATIO_SURGE", ratio > 8.0),
        ("VELOCITY_BURST_1M", F.col("txn_count_1m") >= 2),
        ("VELOCITY_ELEVATED_1H", F.col("txn_count_1h") >= 5),
        ("IMPOSSIBLE_TRAVEL_SPEED", impossible),
        ("HIGH_TRANSIT_VELOCITY", ~impossible & (F.col("travel_speed_kmh") > 500.0)),
        ("NEW_DEVICE_DETECTED", F.col("is_new_device") == 1),
        ("NEW_COUNTRY_DETECTED", F.col("is_new_country") == 1),
        ("OFF_HOURS_ACTIVITY", F.col("is_unusual_hour") == 1),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in conditions]))


def with_behavior(df: DataFrame) -> DataFrame:
    return df.withColumns({"behavior_score": behavior_score(), "behavior_signals": behavior_signals()})
