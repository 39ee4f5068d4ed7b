"""Risk score, decision policy and expected cost of each action."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import clip, rounded

# Score weights, thresholds, cost matrix, fallback outputs. ---------------------------
WEIGHTS = {"ml": 0.55, "anomaly": 0.15, "behavior": 0.15, "rules": 0.15}
APPROVE_BELOW = 30.0
BLOCK_FROM = 75.0
CHARGEBACK_FEE = 25.0
INSULT_COST = 35.0
REVIEW_COST = 4.0
REVIEW_FRICTION = 2.0
FALLBACK_PROBABILITY = 0.05
FALLBACK_ANOMALY = 0.1
# ---------------------------------------------------------------------------------------------------


def check_weights(weights: Mapping[str, float]) -> None:
    if set(weights) != set(WEIGHTS):
        raise ValueError(f"weights need exactly the keys {sorted(WEIGHTS)}")
    if abs(sum(weights.values()) - 1.0) > 1e-4:
        raise ValueError("risk score weights must sum to 1")


def risk_score(probability: Column, anomaly: Column, behavior: Column, rules: Column,
               weights: Mapping[str, float] = WEIGHTS) -> Column:
    check_weights(weights)
    blend = (
        clip(probability, 0.0, 1.0) * weights["ml"]
        + clip(anomaly, 0.0, 1.0) * weights["anomaly"]
        + behavior * weights["behavior"]
        + rules * weights["rules"]
    )
    return rounded(clip(blend * 100.0, 0.0, 100.0), 2)


def decision(score: Column, approve: float = APPROVE_BELOW, block: float = BLOCK_FROM) -> Column:
    return F.when(score < approve, "APPROVE").when(score < block, "REVIEW").otherwise("BLOCK")


def expected_costs(amount: Column, probability: Column) -> dict[str, Column]:
    paid = F.greatest(F.lit(0.0), amount.cast("double"))
    p = clip(probability, 0.0, 1.0)
    return {
        "cost_approve": rounded(p * (paid + CHARGEBACK_FEE), 2),
        "cost_review": rounded((F.lit(1.0) - p) * REVIEW_FRICTION + REVIEW_COST, 2),
        "cost_block": rounded((F.lit(1.0) - p) * INSULT_COST, 2),
    }


def cost_optimal_decision(approve: Column, review: Column, block: Column) -> Column:
    """The cheapest action; on equal cost the least intrusive one."""
    cheapest = F.least(approve, review, block)
    return F.when(approve == cheapest, "APPROVE").when(review == cheapest, "REVIEW").otherwise("BLOCK")


def fallback_scores(df: DataFrame) -> DataFrame:
    """Model outputs used when no model is available."""
    drivers = "array<struct<feature:string,impact:double>>"
    return df.withColumns({
        "raw_score": F.lit(FALLBACK_PROBABILITY),
        "calibrated_probability": F.lit(FALLBACK_PROBABILITY),
        "anomaly_score": F.lit(FALLBACK_ANOMALY),
        "shap_positive_drivers": F.array().cast(drivers),
        "shap_negative_drivers": F.array().cast(drivers),
    })


def decide(df: DataFrame, weights: Mapping[str, float] = WEIGHTS, approve: float = APPROVE_BELOW,
           block: float = BLOCK_FROM) -> DataFrame:
    """Add score, decision and costs to rows that carry model, behaviour and rule scores. Narrow."""
    scored = df.withColumn(
        "risk_score",
        risk_score(F.col("calibrated_probability"), F.col("anomaly_score"), F.col("behavior_score"),
                   F.col("rule_score"), weights),
    )
    return scored.withColumns({
        "decision": decision(F.col("risk_score"), approve, block),
        **expected_costs(F.col("amount"), F.col("calibrated_probability")),
    })


def degraded_policy(df: DataFrame, customers: DataFrame) -> DataFrame:
    """Rule-only policy for rows that have no model output.

    ``customers``: customer_id, home_country, amount_ceiling. Rows with a probability are only flagged.
    The customer side is joined without a hint: Spark broadcasts it when it is small, otherwise it
    sort-merges and AQE splits a hot customer.
    """
    known = customers.select("customer_id", "home_country", "amount_ceiling")
    joined = df.join(known, "customer_id", "left")
    missing = F.col("calibrated_probability").isNull()
    suspicious = (
        (F.col("amount").cast("double") > F.col("amount_ceiling").cast("double") * 3.0)
        | (F.col("country") != F.col("home_country"))
    )
    return joined.withColumns({
        "degraded": missing,
        "degraded_decision": F.when(missing & F.coalesce(suspicious, F.lit(True)), "REVIEW")
        .when(missing, "APPROVE").otherwise(F.col("decision")),
    }).drop("home_country", "amount_ceiling")
