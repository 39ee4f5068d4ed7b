"""Isolation forest: trees grown in parallel on samples, scored by a vectorised column function.

Sampling is part of the published algorithm: a tree is grown on ``tree_rows`` rows, whatever the table's size, so the
forest is the same kind of model on a small table and a large one, and has at most trees * 2 * tree_rows nodes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import clip
from riskloom.operators.ordered import exact_percentiles
from riskloom.schemas import ANOMALY_FEATURES
from riskloom.session import materialise

NODES = "tree int, node int, feature int, threshold double, left_node int, right_node int, path double, n_rows long"
EULER = 0.5772156649015329
#: Draws are taken modulo this.
PRIME = 1_000_003


def expected_path(n):
    """Mean depth of an unsuccessful search among n points (vectorised)."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    deep = 2.0 * (np.log(safe - 1.0) + EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, deep))


def _grow(points: np.ndarray, tree: int, seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed + tree)
    limit = math.ceil(math.log2(max(len(points), 2)))
    nodes: list[list] = [[]]
    pending = [(0, np.arange(len(points)), 0)]
    while pending:
        slot, rows, depth = pending.pop()
        low, high = points[rows].min(axis=0), points[rows].max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(open_features) == 0:
            nodes[slot] = [-1, 0.0, -1, -1, float(depth + expected_path(len(rows))), len(rows)]
            continue
        feature = int(rng.choice(open_features))
        threshold = float(rng.uniform(low[feature], high[feature]))
        goes_left = points[rows, feature] <= threshold
        left, right = len(nodes), len(nodes) + 1
        nodes += [[], []]
        nodes[slot] = [feature, threshold, left, right, 0.0, len(rows)]
        pending += [(left, rows[goes_left], depth + 1), (right, rows[~goes_left], depth + 1)]
    return [(tree, i, *n) for i, n in enumerate(nodes)]


@dataclass(frozen=True)
class IsolationForest:
    nodes: DataFrame
    features: tuple[str, ...]
    rows_per_tree: float
    low: float = 0.0
    high: float = 1.0


def isolation_forest_fit(df: DataFrame, id_column: str = "transaction_id", features: Sequence[str] = ANOMALY_FEATURES,
                         trees: int = 120, tree_rows: int = 256, seed: int = 42) -> IsolationForest:
    """Grow the forest and record the 1st and 99th percentile of the raw training score."""
    names = [f for f in features if f in df.columns]
    points = df.select(F.col(id_column).alias("id"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in names])
    total = points.count()
    share = min(1.0, tree_rows / max(total, 1))
    # A row joins a tree by two numbers from a hash of its id: reproducible after a lost executor, no random state.
    digest = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))).cast("binary"))
    members = points.select(F.explode(_trees_of(digest, trees, int(share * PRIME))).alias("tree"), "id", *names)

    def grow(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("id")[names].to_numpy(dtype=float)
        return pd.DataFrame(_grow(ordered, int(key[0]), seed), columns=[c.split()[0] for c in NODES.split(", ")])

    nodes = materialise(members.groupBy("tree").applyInPandas(grow, NODES), "forest")
    forest = IsolationForest(nodes, tuple(names), share * total)
    raw = materialise(raw_scores(forest, points).select("raw"), "raw-scores")  # scored once: later filters would score again
    marks = exact_percentiles(raw, [], "raw", {"low": 0.01, "high": 0.99}).first()
    return IsolationForest(nodes, tuple(names), share * total, marks["low"], marks["high"])


def _trees_of(digest: Column, trees: int, most: int) -> Column:
    """Trees that a row joins. Its two numbers are taken once: within a lambda over the trees they would be for each tree."""
    number = lambda d, k: F.conv(F.substring(d, k, 7), 16, 10).cast("long")
    numbers = F.transform(F.array(digest), lambda d: F.struct(number(d, 1).alias("a"), number(d, 8).alias("b")))
    every = F.sequence(F.lit(0), F.lit(trees - 1))
    return F.flatten(F.transform(numbers, lambda n: F.filter(every, lambda t: (n["a"] + n["b"] * t) % PRIME < F.lit(most))))


def _packed(forest: IsolationForest) -> dict[str, np.ndarray]:
    """The forest as flat arrays with absolute child positions."""
    pdf = forest.nodes.toPandas().sort_values(["tree", "node"], ignore_index=True)
    start = pdf.groupby("tree").cumcount().eq(0).to_numpy().nonzero()[0]
    base = np.repeat(start, np.diff(np.append(start, len(pdf))))
    leaf = pdf["feature"].to_numpy() < 0
    own = np.arange(len(pdf))
    return {
        "roots": start,
        "feature": np.where(leaf, 0, pdf["feature"]).astype(np.intp),
        "threshold": pdf["threshold"].to_numpy(),
        # The right child, then the left one of each node.
        "children": np.column_stack([np.where(leaf, own, pdf["right_node"] + base), np.where(leaf, own, pdf["left_node"] + base)]).astype(np.intp).ravel(),
        "path": pdf["path"].to_numpy(),
        "depth": int(math.ceil(math.log2(max(pdf["n_rows"].max(), 2)))) + 1,
    }


def raw_scores(forest: IsolationForest, df: DataFrame) -> DataFrame:
    """Add ``raw``: higher is more normal, as an offset-free decision function."""
    shared = df.sparkSession.sparkContext.broadcast(_packed(forest))
    norm = float(expected_path(forest.rows_per_tree))

    @F.pandas_udf("double")
    def raw(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        f = shared.value
        for columns in batches:
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            flat, begins, total = x.ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x))
            for root in f["roots"]:
                at = np.full(len(x), root, dtype=np.intp)
                for _ in range(f["depth"]):
                    goes_left = flat.take(begins + f["feature"].take(at)) <= f["threshold"].take(at)
                    at = f["children"].take(at + at + goes_left)
                total += f["path"].take(at)
            yield pd.Series(-np.power(2.0, -(total / len(f["roots"])) / norm))

    inputs = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in forest.features]
    return df.withColumn("raw", raw(*inputs))


def isolation_forest_score(forest: IsolationForest, df: DataFrame, output: str = "anomaly_score") -> DataFrame:
    """1 - (raw - p1) / (p99 - p1), clipped to [0, 1]; higher is odder."""
    spread = max(forest.high - forest.low, 1e-5)
    scored = raw_scores(forest, df)
    return scored.withColumn(output, clip(F.lit(1.0) - (F.col("raw") - forest.low) / spread, 0.0, 1.0)).drop("raw")


def anomaly_separation(df: DataFrame, anomaly: str, behavior: str, label: str = "is_fraud") -> DataFrame:
    y = F.col(label).cast("int")
    return df.agg(
        F.avg(F.when(y == 0, F.col(anomaly))).alias("mean_legitimate"),
        F.avg(F.when(y == 1, F.col(anomaly))).alias("mean_fraud"),
        F.corr(F.col(anomaly), y.cast("double")).alias("anomaly_correlation"),
        F.corr(F.col(behavior), y.cast("double")).alias("behavior_correlation"))
