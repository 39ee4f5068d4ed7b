"""Additive per-feature contributions and the top drivers of a score."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.columns import rounded
from riskloom.operators.boosting import BoostedTrees
from riskloom.schemas import FEATURES

#: Nodes of a model that is broadcast; about 100 bytes each.
MAX_NODES = 2_000_000
#: Features of a path up to which a leaf's impacts are kept for every set of bounds that are met; rows handled at once.
TABLED, PIECE = 8, 2048


def linear_contributions(df: DataFrame, coefficients: Mapping[str, float], means: Mapping[str, float]) -> DataFrame:
    """coef * (x - mean) per feature: exact for a linear model with independent features."""
    parts = [
        F.struct(F.lit(n).alias("feature"),
                 ((F.coalesce(F.col(n).cast("double"), F.lit(0.0)) - float(means[n])) * float(c)).alias("impact"))
        for n, c in coefficients.items()
    ]
    return df.withColumn("contributions", F.array(*parts))


def logistic_contributions(df: DataFrame, model, names: Sequence[str] = FEATURES) -> DataFrame:
    """Contributions of a fitted ``logistic_baseline`` pipeline in raw feature units."""
    scaler, logistic = model.stages[-2], model.stages[-1]
    std, mean = scaler.std.toArray(), scaler.mean.toArray()
    coef = logistic.coefficients.toArray()
    usable = {n: float(c / s) if s > 0 else 0.0 for n, c, s in zip(names, coef, std)}
    return linear_contributions(df, usable, dict(zip(names, map(float, mean))))


def saved_tree_nodes(path: str, spark: SparkSession) -> pd.DataFrame:
    """Nodes (tree, id, left, right, feature, threshold, value, cover) of a tree ensemble that Spark ML has saved."""
    data = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "metadata", "weights").select("treeID", "weights")
    inner = F.col("leftChild") >= 0
    value = F.when(inner, 0.0).otherwise(F.col("prediction") * F.coalesce("weights", F.lit(1.0)))
    nodes = data.join(weights, "treeID", "left").select(
        F.col("treeID").alias("tree"), "id", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.when(inner, F.col("split.featureIndex")).otherwise(-1).alias("feature"), F.coalesce(F.get("split.leftCategoriesOrThreshold", 0), F.lit(0.0)).alias("threshold"),
        value.alias("value"), F.col("rawCount").cast("double").alias("cover"))
    return _bounded(nodes).toPandas()


def _bounded(nodes: DataFrame) -> DataFrame:
    if nodes.count() > MAX_NODES:
        raise ValueError(f"the ensemble has more than {MAX_NODES} nodes")
    return nodes


def boosted_nodes(model: BoostedTrees) -> pd.DataFrame:
    """The same columns of boosted trees, whose nodes are numbered as in a heap."""
    if len(model.nodes) > MAX_NODES:
        raise ValueError(f"the ensemble has more than {MAX_NODES} nodes")
    return model.nodes.assign(left=2 * model.nodes["id"] + 1, right=2 * model.nodes["id"] + 2)


def expected_value(nodes: pd.DataFrame) -> float:
    """The base that contributions are measured from: each tree's value, averaged over its nodes by cover."""
    total = 0.0
    for _, part in nodes.groupby("tree"):
        value = {r.id: (r.value, r.cover) for r in part.itertuples()}
        for r in sorted(part.itertuples(), key=lambda r: -r.id):
            if r.feature >= 0:
                (a, m), (b, n) = value[r.left], value[r.right]
                value[r.id] = ((a * m + b * n) / max(m + n, 1e-300), r.cover)
        total += value[0][0]
    return total


class Leaf(NamedTuple):
    """Bounds that a leaf's path puts on its features, and their impacts for every set of bounds that a row may meet."""

    features: list[int]
    low: np.ndarray
    high: np.ndarray
    impacts: np.ndarray | None  #: 2^features rows; None of a leaf with more features than TABLED
    share: np.ndarray
    value: float


def _leaves(nodes: pd.DataFrame) -> list[Leaf]:
    leaves = []
    for _, part in nodes.groupby("tree"):
        node = {r.id: r for r in part.itertuples()}
        stack = [(0, {})]
        while stack:
            at, path = stack.pop()
            n = node[at]
            if n.feature < 0:
                if path:
                    low, high, share = (np.array(v) for v in zip(*path.values(), strict=True))
                    m = len(path)
                    met = ((np.arange(1 << m)[:, None] >> np.arange(m)) & 1).T.astype(float) if m <= TABLED else None
                    impacts = None if met is None else _impacts(met, share, n.value).T
                    leaves.append(Leaf(list(path), low, high, impacts, share, n.value))
                continue
            covers = [node[c].cover for c in (n.left, n.right)]
            for child, cover, is_left in ((n.left, covers[0], True), (n.right, covers[1], False)):
                low, high, share = path.get(n.feature, (-np.inf, np.inf, 1.0))
                low, high = (low, min(high, n.threshold)) if is_left else (max(low, n.threshold), high)
                stack.append((child, {**path, n.feature: (low, high, share * cover / max(sum(covers), 1e-300))}))
    return leaves


def _impacts(met: np.ndarray, share: np.ndarray, value: float) -> np.ndarray:
    """Shapley values of one leaf's features (features by cases), path-dependent.

    With o = 1 where a row meets a feature's bounds and z the cover share, a feature gets value * (o - z) times the
    mean over all orders of the product of the other features' o or z. That mean is the integral over t in [0, 1] of
    the product of z + (o - z) t, a polynomial, which Gauss-Legendre points give exactly.
    """
    gain, m = met - share[:, None], len(share)
    points, weights = np.polynomial.legendre.leggauss(max(1, (m + 1) // 2))
    total = np.zeros_like(met)
    for t, w in zip((points + 1) / 2, weights / 2, strict=True):
        term = share[:, None] + gain * t
        before, after = np.ones_like(term), np.ones_like(term)
        before[1:] = np.cumprod(term[:-1], axis=0)
        after[:-1] = np.cumprod(term[:0:-1], axis=0)[::-1]
        total += w * before * after
    return value * gain * total


def _add(out: np.ndarray, x: np.ndarray, leaf: Leaf) -> None:
    """Add a leaf's impacts for all rows (features by rows)."""
    if leaf.impacts is None:
        met = ((x[leaf.features] > leaf.low[:, None]) & (x[leaf.features] <= leaf.high[:, None])).astype(float)
        out[leaf.features] += _impacts(met, leaf.share, leaf.value)
        return
    case = np.zeros(x.shape[1], np.int64)
    for k, f in enumerate(leaf.features):
        if leaf.low[k] == -np.inf:
            met = x[f] <= leaf.high[k]
        elif leaf.high[k] == np.inf:
            met = x[f] > leaf.low[k]
        else:
            met = (x[f] > leaf.low[k]) & (x[f] <= leaf.high[k])
        case |= met.astype(np.int64) << k
    for k, f in enumerate(leaf.features):
        out[f] += leaf.impacts[:, k].take(case)


def tree_contributions(df: DataFrame, nodes: pd.DataFrame, names: Sequence[str] = FEATURES) -> DataFrame:
    """Tree SHAP of an ensemble (``boosted_nodes`` or ``saved_tree_nodes``), in margin units, as an array of (feature, impact).

    What is broadcast has a row for each leaf and set of bounds on its path, so its size is the model's alone; a model
    of more nodes than ``MAX_NODES`` is refused. Rows are handled in pieces of Arrow batches.
    """
    shared = df.sparkSession.sparkContext.broadcast(_leaves(nodes))
    width = len(names)

    @F.pandas_udf("array<double>")
    def shap(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            x = np.array([c.to_numpy(dtype=float) for c in columns])
            out = np.zeros((width, x.shape[1]))
            for start in range(0, x.shape[1], PIECE):
                rows = np.ascontiguousarray(x[:, start : start + PIECE])
                part = np.zeros_like(rows)
                for leaf in shared.value:
                    _add(part, rows, leaf)
                out[:, start : start + PIECE] = part
            yield pd.Series(list(out.T))

    values = shap(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names])
    zipped = F.zip_with(
        F.array(*[F.lit(n) for n in names]), F.col("_shap"),
        lambda n, v: F.struct(n.alias("feature"), v.alias("impact")))
    return df.withColumn("_shap", values).withColumn("contributions", zipped).drop("_shap")


def top_drivers(contributions: Column, k: int = 3) -> tuple[Column, Column]:
    """The k largest positive (descending) and k most negative (ascending) contributions, 4 decimals."""

    def pick(keep, descending: bool) -> Column:
        kept = F.filter(contributions, keep)
        sign = -1.0 if descending else 1.0
        keyed = F.transform(kept, lambda e: F.struct((e["impact"] * sign).alias("k"), e["feature"].alias("feature"), e["impact"].alias("impact")))
        return F.transform(
            F.slice(F.array_sort(keyed), 1, k),
            lambda e: F.struct(e["feature"].alias("feature"), rounded(e["impact"], 4).alias("impact")))

    return pick(lambda e: e["impact"] > 0, True), pick(lambda e: e["impact"] < 0, False)


def with_top_drivers(df: DataFrame, k: int = 3) -> DataFrame:
    positive, negative = top_drivers(F.col("contributions"), k)
    return df.withColumns({"shap_positive_drivers": positive, "shap_negative_drivers": negative})
