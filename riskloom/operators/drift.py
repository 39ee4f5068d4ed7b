"""Population stability, Kolmogorov-Smirnov and the drift report.

All features go through one unpivot, one collapse to distinct values and one ordered prefix; both
statistics are then filters and sums on it, so no feature's values are gathered in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import linspace, rounded
from riskloom.operators.evaluate import average_precision
from riskloom.operators.ordered import range_prefix
from riskloom.session import materialise

# Drift limits. -----------------------------------------------------------------------
PSI_MODERATE, PSI_CRITICAL, KS_CRITICAL = 0.10, 0.25, 0.15
RETRAIN_PR_AUC = 0.75
#: Sizes of two samples multiplied, up to which the KS p-value is exact.
EXACT_CELLS = 10_000
# ---------------------------------------------------------------------------------------------------


def two_sides(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Two tables as one with a ``side``. Where both are parts of one table, give that with its ``side`` instead: it is
    then computed once."""
    shared = [c for c in reference.columns if c in current.columns]
    return reference.select(*shared, F.lit("r").alias("side")).unionByName(current.select(*shared, F.lit("c").alias("side")))


def _tall(df: DataFrame, features: Sequence[str]) -> DataFrame:
    pairs = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features
    ]))
    finite = ~F.isnan("value") & (F.abs("value") != F.lit(float("inf")))
    return df.where(F.col("side").isin("r", "c")).select("side", pairs.alias("p")).select("side", "p.*").where(F.col("value").isNotNull() & finite)


def value_points(sides: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, value) with multiplicities on both sides, prefix counts and totals. ``side`` is r, c or neither."""
    both = _tall(sides, [f for f in features if f in sides.columns])
    # 0.0 and -0.0 are one value.
    collapsed = both.groupBy("feature", (F.col("value") + F.lit(0.0)).alias("value")).agg(
        F.count_if(F.col("side") == "r").alias("r"), F.count_if(F.col("side") == "c").alias("c"))
    return range_prefix(collapsed, ["feature"], ["value"], ["r", "c"])


def _edges(points: DataFrame, buckets: int) -> DataFrame:
    """Reference quantile edges per feature (one row per feature): ends open, duplicates removed."""
    probs = linspace(0.0, 1.0, buckets + 1)[1:-1]
    picks, out = [], []
    for i, p in enumerate(probs):
        position = (F.col("total_r") - 1) * F.lit(p)
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            hit = (F.col("before_r") <= rank) & (rank < F.col("before_r") + F.col("r"))
            picks.append(F.max(F.when(hit, F.col("value"))).alias(f"{side}{i}"))
        position = (F.col("n") - 1) * F.lit(p)
        weight = position - F.floor(position)
        out.append(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * weight)
    per_feature = points.groupBy("feature").agg(*picks, F.max("total_r").alias("n"))
    return per_feature.select("feature", F.array_distinct(F.array(*out)).alias("edges"))


def psi_from(points: DataFrame, buckets: int = 10, epsilon: float = 1e-4) -> DataFrame:
    """Population stability index per feature. Bins are [a, b) between reference quantiles."""
    # One row per monitored feature: its size is the length of the feature list.
    edges = F.broadcast(_edges(points, buckets))
    inner = F.col("edges")
    binned = points.join(edges, "feature").withColumns({
        "bin": F.size(F.filter(inner, lambda e: e <= F.col("value"))),
        "bins": F.size(inner) + 1,
    })
    counts = binned.groupBy("feature", "bin").agg(
        F.sum("r").alias("r"), F.sum("c").alias("c"), F.max("total_r").alias("tr"), F.max("total_c").alias("tc"),
        F.max("bins").alias("bins"))
    # Empty bins still carry epsilon: list all bins of the feature, at most ``buckets`` of them.
    filled = counts.groupBy("feature").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", F.struct("r", "c")))).alias("m"),
        F.max("tr").alias("tr"), F.max("tc").alias("tc"), F.max("bins").alias("bins"),
    ).withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    share = filled.select(
        "feature", "bins", "tr", "tc",
        (F.coalesce(F.try_element_at("m", F.col("bin"))["r"], F.lit(0)) / F.nullif("tr", F.lit(0)) + epsilon).alias("e"),
        (F.coalesce(F.try_element_at("m", F.col("bin"))["c"], F.lit(0)) / F.nullif("tc", F.lit(0)) + epsilon).alias("a"),
    )
    # After adding epsilon both shares sum to 1 + bins * epsilon.
    scale = F.lit(1.0) + F.col("bins") * epsilon
    e, a = F.col("e") / scale, F.col("a") / scale
    total = share.groupBy("feature").agg(
        F.sum((a - e) * F.log(a / e)).alias("psi"), F.max("bins").alias("bins"), F.min("tr").alias("tr"), F.min("tc").alias("tc"))
    usable = (F.col("bins") >= 2) & (F.col("tr") > 0) & (F.col("tc") > 0)
    return total.select("feature", F.when(usable, F.greatest(F.lit(0.0), F.col("psi"))).otherwise(0.0).alias("psi"))


def exact_ks_p_value(n: int, m: int, d: float) -> float:
    """The chance of a distance of at least ``d`` between samples of n and m values without ties, by lattice paths.

    A path from (0, 0) to (n, m) is an order of all values. P(i, j) is the share of paths to (i, j) that stay nearer to
    the diagonal than d; the last step comes from (i - 1, j) with probability i / (i + j).
    """
    far = round(d * n * m)
    if far <= 0:
        return 1.0
    inside = np.zeros(m + 1)
    for i in range(n + 1):
        for j in range(m + 1):
            if abs(i * m - j * n) >= far:
                inside[j] = 0.0
            elif i + j:
                inside[j] = inside[j] * i / (i + j) + (inside[j - 1] * j / (i + j) if j else 0.0)
            else:
                inside[j] = 1.0
    return float(min(1.0, max(0.0, 1.0 - inside[m])))


def ks_from(points: DataFrame, terms: int = 100, exact_cells: int = EXACT_CELLS) -> DataFrame:
    """Two-sample KS distance (exact) and p-value per feature: by lattice paths where the samples' sizes multiply to at
    most ``exact_cells``, and by the asymptotic series above."""
    ref = (F.col("before_r") + F.col("r")) / F.nullif("total_r", F.lit(0))
    cur = (F.col("before_c") + F.col("c")) / F.nullif("total_c", F.lit(0))
    dist = points.groupBy("feature").agg(
        F.max(F.abs(ref - cur)).alias("d"), F.max("total_r").cast("double").alias("n"), F.max("total_c").cast("double").alias("m"))
    lam2 = F.col("n") * F.col("m") / F.nullif(F.col("n") + F.col("m"), F.lit(0.0)) * F.col("d") * F.col("d")
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(k * k * F.lit(-2.0) * F.col("lam2")))
    scored = dist.withColumn("lam2", lam2)
    empty = (F.col("n") == 0) | (F.col("m") == 0)
    p = F.when(empty | (F.col("lam2") < 1e-3), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))
    @F.pandas_udf("double")
    def exact(n: pd.Series, m: pd.Series, d: pd.Series) -> pd.Series:  # one row for each feature
        return pd.Series([exact_ks_p_value(int(a), int(b), float(x)) if a * b <= exact_cells else None for a, b, x in zip(n, m, d, strict=True)], dtype=float)

    small = ~empty & (F.col("n") * F.col("m") <= exact_cells)
    p = F.when(small, exact("n", "m", "d")).otherwise(p)
    return scored.select("feature", F.when(empty, 0.0).otherwise(F.col("d")).alias("ks_statistic"), p.alias("p_value"))


def psi(sides: DataFrame, features: Sequence[str], buckets: int = 10, epsilon: float = 1e-4) -> DataFrame:
    out = psi_from(value_points(sides, features), buckets, epsilon)
    return out.select("feature", rounded(F.col("psi"), 4).alias("psi"))


def ks_test(sides: DataFrame, features: Sequence[str]) -> DataFrame:
    out = ks_from(value_points(sides, features))
    return out.select("feature", rounded(F.col("ks_statistic"), 4).alias("ks_statistic"), rounded(F.col("p_value"), 4).alias("p_value"))


def drift_report(sides: DataFrame, features: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """One row per feature present on both sides: PSI, KS, p-value, status."""
    points = value_points(sides, features)
    joined = psi_from(points).join(ks_from(points), "feature")
    p, d, pv = F.col("psi"), F.col("ks_statistic"), F.col("p_value")
    status = (
        F.when((p >= PSI_CRITICAL) | ((pv < alpha) & (d > KS_CRITICAL)), "CRITICAL_DRIFT")
        .when((p >= PSI_MODERATE) | (pv < alpha), "MODERATE_DRIFT")
        .otherwise("NO_DRIFT")
    )
    return joined.select(
        "feature", rounded(p, 4).alias("psi"), rounded(d, 4).alias("ks_statistic"), rounded(pv, 4).alias("p_value"),
        status.alias("status"))


def drift_overall(report: DataFrame) -> DataFrame:
    counts = report.agg(
        F.count("*").alias("total_features_monitored"),
        F.count_if(F.col("status") != "NO_DRIFT").alias("drifted_features_count"),
        F.count_if(F.col("status") == "CRITICAL_DRIFT").alias("critical_features_count"))
    rate = F.coalesce(F.col("drifted_features_count") / F.nullif("total_features_monitored", F.lit(0)), F.lit(0.0))
    overall = (
        F.when((F.col("critical_features_count") > 0) | (rate > 0.25), "CRITICAL_DRIFT_DETECTED")
        .when(F.col("drifted_features_count") > 0, "MODERATE_DRIFT_DETECTED").otherwise("STABLE"))
    return counts.withColumn("overall_status", overall)


def sliding_average_precision(df: DataFrame, label: str, score: str, days: int = 7) -> DataFrame:
    """PR-AUC of the ``days`` days ending with each day. Days are collapsed to distinct scores before
    they are repeated into the windows that contain them."""
    daily = df.select(F.to_date("timestamp").alias("day"), F.col(score).alias("score"), F.col(label).cast("int").alias("y")).groupBy(
        "day", "score").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    last = daily.select(F.max("day")).scalar()
    ends = F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: F.date_add(F.col("day"), i)))
    spread = daily.select("*", ends.alias("window_end")).where(F.col("window_end") <= last)
    collapsed = spread.groupBy("window_end", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    points = range_prefix(collapsed, ["window_end"], ["score"], ["pos", "neg"])
    return average_precision(points, ["window_end"])


def sliding_psi(df: DataFrame, reference: Column, features: Sequence[str], days: int = 7, buckets: int = 10, epsilon: float = 1e-4) -> DataFrame:
    """(window_end, feature, psi) of the ``days`` days ending with each day, against the rows where ``reference`` holds.

    Rows are counted once, by (day, feature, bin) on the reference's quantile edges; windows are sums of those counts,
    at most ``days`` times as many, whatever the number of rows.
    """
    used = [f for f in features if f in df.columns]
    values = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in used]))
    tall = df.select(F.to_date("timestamp").alias("day"), reference.alias("ref"), values.alias("p")).select("day", "ref", "p.*")
    tall = tall.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != F.lit(float("inf"))))
    tall = tall.withColumn("value", F.col("value") + F.lit(0.0))
    counted = tall.where("ref").groupBy("feature", "value").agg(F.count("*").alias("r"))
    edges = F.broadcast(_edges(range_prefix(counted, ["feature"], ["value"], ["r"]), buckets))  # one row for each feature
    bin_ = F.size(F.filter("edges", lambda e: e <= F.col("value")))
    daily = tall.join(edges, "feature").groupBy("feature", "day", bin_.alias("bin"), (F.size("edges") + 1).alias("bins")).agg(
        F.count("*").alias("c"), F.count_if("ref").alias("r"))
    daily = materialise(daily, "daily-bins")
    last = daily.select(F.max("day")).scalar()
    ends = F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: F.date_add(F.col("day"), i)))
    windows = daily.select("feature", "bin", "bins", "c", ends.alias("window_end")).where(F.col("window_end") <= last)
    windows = windows.groupBy("window_end", "feature", "bins", "bin").agg(F.sum("c").alias("c"))
    as_map = lambda c: F.map_from_entries(F.collect_list(F.struct("bin", c)))
    current = windows.groupBy("window_end", "feature", "bins").agg(as_map("c").alias("cm"), F.sum("c").alias("tc"))
    of_reference = daily.groupBy("feature", "bin").agg(F.sum("r").alias("r")).groupBy("feature").agg(as_map("r").alias("rm"), F.sum("r").alias("tr"))
    both = current.join(of_reference, "feature")
    share = lambda m, total, k: (F.coalesce(F.try_element_at(m, k), F.lit(0)) / F.col(total) + epsilon) / (1.0 + F.col("bins") * epsilon)
    term = lambda k: (share("cm", "tc", k) - share("rm", "tr", k)) * F.log(share("cm", "tc", k) / share("rm", "tr", k))
    total = F.aggregate(F.sequence(F.lit(0), F.col("bins") - 1), F.lit(0.0), lambda acc, k: acc + term(k))
    usable = (F.col("bins") >= 2) & (F.col("tr") > 0)
    return both.select("window_end", "feature", rounded(F.when(usable, F.greatest(F.lit(0.0), total)).otherwise(0.0), 4).alias("psi"))


def retrain_trigger(df: DataFrame, label: str, score: str, windows: DataFrame, top_features: Sequence[str], days: int = 7) -> DataFrame:
    """Per window end: PR-AUC, the worst PSI of the window (``sliding_psi``) among the top features, and whether to retrain."""
    worst = windows.where(F.col("feature").isin(*top_features)).groupBy("window_end").agg(F.max("psi").alias("worst_psi"))
    areas = sliding_average_precision(df, label, score, days).join(worst, "window_end", "left")
    worst_psi = F.coalesce("worst_psi", F.lit(0.0))
    return areas.withColumn("worst_psi", worst_psi).withColumn("retrain", (F.col("pr_auc") < RETRAIN_PR_AUC) | (worst_psi > PSI_CRITICAL))
