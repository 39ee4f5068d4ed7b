"""Classifiers: linear and forest baselines on Spark ML, and the boosted champion of ``boosting``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import boosting
from riskloom.operators.boosting import BoostedTrees
from riskloom.schemas import FEATURES

SEED = 42
#: Training rows that a task of the forest's fit takes at most.
FOREST_ROWS = 250_000


def model_input(features: DataFrame, label: str = "is_fraud", names: Sequence[str] = FEATURES) -> DataFrame:
    """Features as doubles with nulls at 0 and the label as 0.0 / 1.0; ids kept."""
    keep = [c for c in ("transaction_id", "timestamp", "split") if c in features.columns]
    return features.select(
        *keep, F.col(label).cast("int").cast("double").alias("label"),
        *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names])


def class_totals(train: DataFrame) -> tuple[int, int]:
    row = train.agg(F.count_if(F.col("label") == 1.0), F.count_if(F.col("label") == 0.0)).first()
    return int(row[0]), int(row[1])


def _weighted(train: DataFrame, positive: float, negative: float) -> DataFrame:
    return train.withColumn("weight", F.when(F.col("label") == 1.0, positive).otherwise(negative))


def in_waves(rows: DataFrame, n: int, at_most: int = FOREST_ROWS) -> DataFrame:
    """Equal shares of about ``n`` rows for a fit of many passes: as many as the session has cores, or a multiple of that. Each
    pass then ends on all cores at once, with few shares, which each give sums of every node. A share's rows and their order
    follow from the rows alone, so a share that is made again is the same one."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    shares = cores * max(1, -(-n // (cores * at_most)))
    return rows.withColumn("_place", F.xxhash64(*rows.columns)).repartition(shares, "_place").sortWithinPartitions("_place").drop("_place")


def balanced_weights(train: DataFrame) -> tuple[DataFrame, int]:
    pos, neg = class_totals(train)
    n = pos + neg
    return _weighted(train, n / (2.0 * max(pos, 1)), n / (2.0 * max(neg, 1))), n


def prior_baseline(train: DataFrame, rows: DataFrame) -> DataFrame:
    """Score every row with the training label rate."""
    rate = train.agg(F.avg(F.col("is_fraud").cast("double"))).scalar()
    return rows.withColumn("probability_fraud", rate)


def _assembler(names: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(names), outputCol="raw_vector")


def logistic_baseline(train: DataFrame, names: Sequence[str] = FEATURES, c: float = 1.0, max_iter: int = 1000) -> PipelineModel:
    """Standardised L2 logistic regression with balanced classes; ``c`` is the inverse penalty."""
    weighted, n = balanced_weights(train)
    scaler = StandardScaler(inputCol="raw_vector", outputCol="vector", withMean=True, withStd=True)
    # Balanced weights sum to n, and Spark averages the loss: penalty 1 / (c * n).
    fit = LogisticRegression(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=max_iter,
                             regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False)
    return Pipeline(stages=[_assembler(names), scaler, fit]).fit(weighted)


def random_forest_baseline(train: DataFrame, names: Sequence[str] = FEATURES, trees: int = 100, depth: int = 12) -> PipelineModel:
    weighted, n = balanced_weights(train)
    # A row's node in each tree is kept from pass to pass, rather than found again from the root; the trees are the same.
    fit = RandomForestClassifier(featuresCol="raw_vector", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=SEED,
                                 cacheNodeIds=True, checkpointInterval=-1)
    return Pipeline(stages=[_assembler(names), fit]).fit(in_waves(weighted, n))


def boosted_champion(train: DataFrame, names: Sequence[str] = FEATURES, valid: DataFrame | None = None, **params) -> BoostedTrees:
    """Second-order boosting with penalties; positives weigh n_neg / n_pos unless given. See ``boosting.fit``."""
    return boosting.fit(train, names, valid, **params)


def probability(column: str = "probability") -> Column:
    return vector_to_array(F.col(column))[1]


def score_with(model: PipelineModel | BoostedTrees, rows: DataFrame, output: str = "raw_score") -> DataFrame:
    """Rows plus the fraud probability; intermediate vectors dropped."""
    if isinstance(model, BoostedTrees):
        return model.score(rows, output)
    out = model.transform(rows).withColumn(output, probability())
    return out.select(*rows.columns, output)


def predict(df: DataFrame, score: str, threshold: float = 0.5) -> DataFrame:
    return df.withColumn("predicted_fraud", F.col(score) >= F.lit(float(threshold)))


def feature_importance(model: PipelineModel | BoostedTrees, names: Sequence[str] = FEATURES) -> DataFrame:
    """Importance (gain, impurity or |coefficient|) per feature, largest first. One row per feature."""
    if isinstance(model, BoostedTrees):
        values = dict(model.importance())
    else:
        last = model.stages[-1]
        values = dict(zip(names, (last.coefficients if hasattr(last, "coefficients") else last.featureImportances).toArray(), strict=True))
    rows = [(n, float(v), abs(float(v))) for n, v in values.items()]
    table = SparkSession.active().createDataFrame(rows, "feature string, value double, importance double")
    return table.orderBy(F.col("importance").desc(), "feature")


def save_model(model: PipelineModel | BoostedTrees, path: str) -> None:
    if isinstance(model, BoostedTrees):
        model.save(SparkSession.active(), path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def load_champion(spark: SparkSession, path: str) -> BoostedTrees:
    return BoostedTrees.load(spark, path)
