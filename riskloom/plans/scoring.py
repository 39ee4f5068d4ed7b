"""Transaction table -> decision records."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import policy
from riskloom.functions.behaviour import with_behavior
from riskloom.functions.rules import with_rules
from riskloom.operators.history import all_features
from riskloom.operators.skew import SkewPolicy
from riskloom.schemas import FEATURES

Scorer = Callable[[DataFrame], DataFrame]


def decide_features(features: DataFrame, weights: Mapping[str, float] = policy.WEIGHTS) -> DataFrame:
    """Behaviour, rules, score, decision and costs for rows that carry features and model outputs.

    Column expressions only: the same function serves a table and a stream.
    """
    return policy.decide(with_rules(with_behavior(features)), weights)


def score_transactions(txn: DataFrame, scorer: Scorer | None = None, profiles: DataFrame | None = None,
                       weights: Mapping[str, float] = policy.WEIGHTS, skew: SkewPolicy = SkewPolicy()) -> DataFrame:
    """Full decision record per transaction.

    ``scorer`` adds ``calibrated_probability`` and ``anomaly_score`` (and drivers); without one the
    fallback outputs are used, unless the input already carries them.
    """
    features = all_features(txn, profiles, skew)
    if scorer is not None:
        features = scorer(features)
    elif "calibrated_probability" not in features.columns:
        features = policy.fallback_scores(features)
    return decide_features(features, weights)


def prediction_rows(scored: DataFrame, extra: Sequence[str] = (), version: str = "v1.0.0") -> DataFrame:
    """The prediction table's rows, with the feature vector that was scored and, where it was measured, the latency."""
    raw = F.col("raw_score") if "raw_score" in scored.columns else F.col("calibrated_probability")
    empty = F.array().cast("array<struct<feature:string,impact:double>>")
    pick = lambda name: F.col(name) if name in scored.columns else empty
    latency = F.col("inference_latency_ms") if "inference_latency_ms" in scored.columns else F.lit(None).cast("double")
    present = [f for f in FEATURES if f in scored.columns]
    payload = F.to_json(F.struct(*present)) if present else F.lit(None).cast("string")
    return scored.select(
        *extra, "transaction_id", F.lit(version).alias("model_version_id"), raw.alias("raw_score"),
        "calibrated_probability", "anomaly_score", latency.alias("inference_latency_ms"), payload.alias("feature_payload"),
        pick("shap_positive_drivers").alias("shap_positive_drivers"),
        pick("shap_negative_drivers").alias("shap_negative_drivers"))


def decision_rows(scored: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """False-negative cost is the expected cost of approving, false-positive cost that of blocking."""
    return scored.select(
        *extra, "transaction_id", F.col("risk_score").cast("decimal(5,2)").alias("risk_score"), "decision", "triggered_rules",
        F.col("cost_approve").cast("decimal(12,2)").alias("cost_estimate_fn"),
        F.col("cost_block").cast("decimal(12,2)").alias("cost_estimate_fp"),
        F.lit("FINAL").alias("status"))
