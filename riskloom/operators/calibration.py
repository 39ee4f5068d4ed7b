"""Probability calibration, fitted on the validation split."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import clip
from riskloom.operators.models import probability


def isotonic_fit(val: DataFrame, score: str, label: str = "label"):
    """Scores are collapsed to distinct values with their label rate and count as weight first: the same
    fit on far fewer rows."""
    points = val.groupBy(F.col(score).alias("score")).agg(
        F.avg(F.col(label).cast("double")).alias("label"), F.count("*").cast("double").alias("weight"))
    return IsotonicRegression(featuresCol="score", labelCol="label", weightCol="weight").fit(points)


def isotonic_apply(model, df: DataFrame, score: str, output: str = "calibrated_probability") -> DataFrame:
    """Linear between the fitted points, constant outside, within [0, 1]."""
    scored = model.transform(df.withColumn("score", F.col(score)))
    return scored.select(*df.columns, clip(F.col("prediction"), 0.0, 1.0).alias(output))


def _assembled(df: DataFrame, score: str) -> DataFrame:
    return VectorAssembler(inputCols=[score], outputCol="score_vector").transform(df)


def platt_fit(val: DataFrame, score: str, label: str = "label", c: float = 1.0):
    n = val.count()
    fit = LogisticRegression(featuresCol="score_vector", labelCol="y", regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=1000)
    return fit.fit(_assembled(val.withColumn("y", F.col(label).cast("double")), score))


def platt_apply(model, df: DataFrame, score: str, output: str = "calibrated_probability") -> DataFrame:
    scored = model.transform(_assembled(df, score))
    return scored.select(*df.columns, clip(probability(), 0.0, 1.0).alias(output))
