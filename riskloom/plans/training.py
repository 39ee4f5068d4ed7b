"""Features -> chronological split -> fitted models, calibrators and forest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import calibration, evaluate, forest, history, models, split
from riskloom.operators.attribution import boosted_nodes, tree_contributions, with_top_drivers
from riskloom.operators.boosting import BoostedTrees
from riskloom.session import materialise

#: Trees without a lower loss on the validation part after which the champion is done.
PATIENCE = 10


def training_table(txn: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Feature table with its split, written once because every fit reads it again. The split's passes read two columns
    of the transactions, not the features."""
    return materialise(history.build_features(split.temporal_split(txn), profiles, extra=("split",)), "training")


def part(table: DataFrame, name: str) -> DataFrame:
    return models.model_input(table.where(F.col("split") == name))


def leaderboard(scored: dict[str, DataFrame], label: str = "label", score: str = "raw_score") -> DataFrame:
    """One metrics row per model."""
    board = None
    for name, df in scored.items():
        row = evaluate.ranking_metrics(df, label, score).select(F.lit(name).alias("model"), "*")
        board = row if board is None else board.unionByName(row)
    return board


@dataclass(frozen=True)
class Scorer:
    """Fitted models as one function: features in, model outputs added."""

    champion: BoostedTrees
    calibrator: object
    anomalies: forest.IsolationForest
    explain: bool = True

    def __call__(self, features: DataFrame) -> DataFrame:
        scored = models.score_with(self.champion, features, "raw_score")
        scored = calibration.isotonic_apply(self.calibrator, scored, "raw_score")
        scored = forest.isolation_forest_score(self.anomalies, scored)
        if self.explain:
            scored = with_top_drivers(tree_contributions(scored, boosted_nodes(self.champion), self.champion.names)).drop("contributions")
        return scored


def train_scorer(table: DataFrame, explain: bool = True, **params) -> Scorer:
    """Champion on train, stopped early on val; isotonic calibration on val; isolation forest on train."""
    train, val = part(table, "train"), part(table, "val")
    champion = models.boosted_champion(train, valid=val, **{"patience": PATIENCE} | params)
    calibrator = calibration.isotonic_fit(models.score_with(champion, val), "raw_score")
    return Scorer(champion, calibrator, forest.isolation_forest_fit(train), explain)
