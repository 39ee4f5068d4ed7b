"""Classifier evaluation: confusion metrics, ranking areas, thresholds, calibration curves.

Inputs carry a 0/1 (or boolean) label column and a score column. Rows are collapsed to distinct scores or
to a fixed number of bins before anything is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import edge_index, linspace, rounded
from riskloom.functions.policy import CHARGEBACK_FEE, INSULT_COST
from riskloom.operators.ordered import range_prefix


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def _label(name: str) -> Column:
    return F.col(name).cast("int")


def fraud_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """Confusion matrix, rates and Brier score in one aggregate."""
    df = df.where(F.col(score).isNotNull())
    y, flagged = _label(label) == 1, F.col(score) >= F.lit(float(threshold))
    counts = df.groupBy(*keys).agg(
        F.count_if(y & flagged).alias("tp"),
        F.count_if(~y & flagged).alias("fp"),
        F.count_if(~y & ~flagged).alias("tn"),
        F.count_if(y & ~flagged).alias("fn"),
        F.avg(F.pow(F.col(score) - _label(label), 2)).alias("_brier"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.select(
        *keys, F.lit(float(threshold)).alias("threshold"),
        rounded(ratio(tp, tp + fp), 4).alias("precision"),
        rounded(ratio(tp, tp + fn), 4).alias("recall"),
        rounded(ratio(tp * 2, tp * 2 + fp + fn), 4).alias("f1"),
        rounded(ratio(fp, fp + tn), 4).alias("false_positive_rate"),
        rounded(ratio(fn, fn + tp), 4).alias("false_negative_rate"),
        rounded(F.col("_brier"), 4).alias("brier_score"),
        "tp", "fp", "tn", "fn",
        (tp + fp + tn + fn).alias("total_samples"),
        (tp + fn).alias("fraud_samples"),
        (tn + fp).alias("legitimate_samples"),
    )


def score_points(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct scores with class counts and the class counts below them: the basis of every ranking metric."""
    collapsed = df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("score")).agg(
        F.count_if(_label(label) == 1).alias("pos"), F.count_if(_label(label) == 0).alias("neg"))
    return range_prefix(collapsed, list(keys), ["score"], ["pos", "neg"])


def _at_or_above() -> tuple[Column, Column]:
    return F.col("total_pos") - F.col("before_pos"), F.col("total_neg") - F.col("before_neg")


def roc_auc(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rank statistic with ties counted half; 0.5 when only one class is present."""
    wins = F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0)
    area = points.groupBy(*keys).agg(
        F.sum(wins.cast("double")).alias("wins"), F.max("total_pos").alias("p"), F.max("total_neg").alias("n"))
    pairs = F.col("p").cast("double") * F.col("n")
    return area.select(*keys, rounded(F.coalesce(F.col("wins") / F.nullif(pairs, F.lit(0.0)), F.lit(0.5)), 4).alias("roc_auc"))


def average_precision(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Step-wise area under precision-recall; 0 without positives."""
    tp, fp = _at_or_above()
    gain = F.col("pos") / F.nullif(F.col("total_pos"), F.lit(0)) * ratio(tp, tp + fp)
    return points.groupBy(*keys).agg(rounded(F.coalesce(F.sum(gain), F.lit(0.0)), 4).alias("pr_auc"))


def recall_at(points: DataFrame, min_precision: float | None = None, max_fpr: float | None = None,
              keys: Sequence[str] = ()) -> DataFrame:
    """Best recall among thresholds that keep precision (or the false-positive rate) within the bound."""
    tp, fp = _at_or_above()
    ok = F.lit(True)
    if min_precision is not None:
        ok = ok & (ratio(tp, tp + fp) >= F.lit(float(min_precision)))
    if max_fpr is not None:
        ok = ok & (ratio(fp, F.col("total_neg")) <= F.lit(float(max_fpr)))
    best = F.max(F.when(ok, ratio(tp, F.col("total_pos"))))
    return points.groupBy(*keys).agg(rounded(F.coalesce(best, F.lit(0.0)), 4).alias("recall"))


def ranking_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """``fraud_metrics`` plus both areas: one row."""
    points = score_points(df, label, score)
    return fraud_metrics(df, label, score, threshold).withColumns({
        "pr_auc": average_precision(points).scalar(), "roc_auc": roc_auc(points).scalar()})


# The threshold grid and the assumed amount when none is given. -----------------------
THRESHOLDS = linspace(0.01, 0.99, 99)
ASSUMED_AMOUNT = 1500.0
# ---------------------------------------------------------------------------------------------------


def threshold_grid(df: DataFrame, label: str, score: str, amount: str | None = None,
                   thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """One row per threshold with confusion counts, precision, recall, F1, F2 and losses.

    Each row is counted once, under the number of thresholds it reaches; the grid is then built from at
    most len(thresholds) + 1 bucket rows.
    """
    grid = sorted(thresholds)
    spark = df.sparkSession
    money = F.lit(ASSUMED_AMOUNT).cast("decimal(12,2)") if amount is None else F.col(amount).cast("decimal(12,2)")
    y = _label(label)
    buckets = df.where(F.col(score).isNotNull()).select(edge_index(f"`{score}`", grid).alias("reached"), y.alias("y"), money.alias("money")).groupBy("reached").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"),
        F.sum(F.when(F.col("y") == 1, F.col("money"))).alias("fraud_amount"))
    every = spark.createDataFrame(
        [(i, None if i == 0 else float(grid[i - 1])) for i in range(len(grid) + 1)], "reached int, threshold double")
    filled = every.join(buckets, "reached", "left").na.fill({"pos": 0, "neg": 0}).withColumn(
        "fraud_amount", F.coalesce("fraud_amount", F.lit(0).cast("decimal(22,2)")))
    # Not partitioned, over one row per threshold.
    below = Window.orderBy("reached").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.orderBy("reached").rowsBetween(0, Window.unboundedFollowing)
    counted = filled.select(
        "threshold",
        F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"),
        F.coalesce(F.sum("pos").over(below), F.lit(0)).alias("fn"),
        F.coalesce(F.sum("neg").over(below), F.lit(0)).alias("tn"),
        F.coalesce(F.sum("fraud_amount").over(below).cast("double"), F.lit(0.0)).alias("missed"),
    ).where(F.col("threshold").isNotNull())
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    fn_loss, fp_loss = F.col("missed") + fn * CHARGEBACK_FEE, fp * INSULT_COST
    return counted.select(
        rounded(F.col("threshold"), 3).alias("threshold"),
        rounded(ratio(tp, tp + fp), 4).alias("precision"),
        rounded(ratio(tp, tp + fn), 4).alias("recall"),
        rounded(ratio(tp * 2, tp * 2 + fp + fn), 4).alias("f1"),
        rounded(ratio(tp * 5, tp * 5 + fn * 4 + fp), 4).alias("f2"),
        "tp", "fp", "fn", "tn",
        rounded(fn_loss, 2).alias("fn_loss"), rounded(fp_loss, 2).alias("fp_loss"),
        rounded(fn_loss + fp_loss, 2).alias("total_cost"),
    )


def optimal_thresholds(grid: DataFrame) -> DataFrame:
    """Two rows, the F2-best and the cheapest threshold; ties go to the lowest threshold."""
    best_f2 = grid.orderBy(F.col("f2").desc(), "threshold").limit(1).withColumn("objective", F.lit("f2"))
    best_cost = grid.orderBy("total_cost", "threshold").limit(1).withColumn("objective", F.lit("cost"))
    return best_f2.unionByName(best_cost)


def calibration_curve(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Per bin: centre, count, actual fraction, mean score. Bins are [a, b), the last one closed."""
    edges = linspace(0.0, 1.0, bins + 1)
    spark = df.sparkSession
    inside = df.where((F.col(score) >= 0.0) & (F.col(score) <= 1.0))
    grouped = inside.groupBy(edge_index(f"`{score}`", edges[1:-1]).alias("bin")).agg(
        F.count("*").alias("bin_count"), F.avg(_label(label).cast("double")).alias("actual"), F.avg(score).alias("mean_score"))
    every = spark.createDataFrame(
        [(i, (edges[i] + edges[i + 1]) / 2.0) for i in range(bins)], "bin int, center double")
    return every.join(grouped, "bin", "left").select(
        "bin", rounded(F.col("center"), 3).alias("bin_center"),
        F.coalesce("bin_count", F.lit(0)).cast("long").alias("bin_count"),
        rounded(F.coalesce("actual", F.lit(0.0)), 4).alias("true_fraction"),
        F.col("actual"), F.col("mean_score"),
    )


def calibration_error(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Expected calibration error and Brier score, one row."""
    curve = calibration_curve(df, label, score, bins)
    base = df.where(F.col(score).isNotNull()).agg(F.count("*").alias("samples"), F.avg(F.pow(F.col(score) - _label(label), 2)).alias("b"))
    gap = F.coalesce(F.col("bin_count") * F.abs(F.col("actual") - F.col("mean_score")), F.lit(0.0))
    weighted = curve.agg(F.sum(gap).alias("g"))
    return base.withColumn("g", weighted.scalar()).select(
        "samples",
        rounded(F.col("g") / F.nullif(F.col("samples"), F.lit(0)), 4).alias("expected_calibration_error"),
        rounded(F.col("b"), 4).alias("brier_score"))
