"""End-to-end flow scoring and training."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.config import DEFAULTS, Settings
from wirelens.operators.features import feature_array, feature_struct, flow_features
from wirelens.operators.iforest import IsolationForest, IsolationForestModel
from wirelens.operators.inspect import inspection
from wirelens.operators.models import (AttackClassifier, AttackClassifierModel,
                                       classification_report, stratified_split)
from wirelens.operators.scoring import threat_score
from wirelens.operators.sequence import sequence_score
from wirelens.schemas import FLOWS
from wirelens.session import cut_lineage


@dataclass
class Models:
    forest: IsolationForestModel
    classifier: AttackClassifierModel

    def save(self, spark: SparkSession, path: str) -> None:
        self.forest.save(spark, f"{path}/forest")
        self.classifier.save(f"{path}/classifier")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Models":
        return Models(IsolationForestModel.load(spark, f"{path}/forest"),
                      AttackClassifierModel.load(spark, f"{path}/classifier"))


def train(labelled: DataFrame, row_id: str, vector: str, label: str = "label",
          forest: IsolationForest | None = None, classifier: AttackClassifier | None = None
          ) -> Models:
    """Fit both models on rows with an array<double> ``vector``."""
    return Models((forest or IsolationForest()).fit(labelled, row_id, F.col(vector)),
                  (classifier or AttackClassifier()).fit(labelled, label, vector))


def training_report(labelled: DataFrame, row_id: str, vector: str, label: str = "label",
                    classifier: AttackClassifier | None = None, train_share: float = 0.8, seed: int = 42
                    ) -> tuple[AttackClassifierModel, DataFrame]:
    """The training job: split every class exactly, fit on the training part (class weights, label codes
    and scaling are learned from it alone), and report on the rest."""
    split = cut_lineage(stratified_split(labelled.select(row_id, vector, label), label, row_id,
                                         train_share, seed))
    model = (classifier or AttackClassifier()).fit(split.where("is_train"), label, vector)
    judged = model.transform(split.where("NOT is_train"), vector)
    return model, classification_report(judged, label, "attack_type")


def score_features(features: DataFrame, models: Models, cfg: Settings = DEFAULTS,
                   history: Sequence[str] = ("src_ip",), materialise: bool = False
                   ) -> DataFrame:
    """Flow features -> scored flows. ``history=()`` keeps one sequence history for all flows.
    Features that carry a ``sequence_score`` (those of a stream, whose history is keyed state) keep it.

    The sequence score reads the features three times, so ``materialise`` writes them once instead
    of assembling the flows again; leave it off for features that are read from a table.
    """
    if materialise:
        features = cut_lineage(features)
    sequenced = features if "sequence_score" in features.columns else sequence_score(
        features, history, cfg=cfg)
    with_vector = sequenced.withColumn("vector", feature_array())
    scored = models.classifier.transform(
        models.forest.transform(with_vector, F.col("vector")), "vector")
    return threat_score(scored, cfg=cfg).select(
        *[F.col(f) for f in FLOWS.fieldNames() if f not in ("features", "dpi_result")],
        "sequence_score", "recommended_action", "component_breakdown", "all_probabilities",
        feature_struct().alias("features"), inspection().alias("dpi_result"),
        "first_us", "last_us", "flow_no")


def score_flows(packets: DataFrame, models: Models, cfg: Settings = DEFAULTS,
                mode: str = "tumbling", history: Sequence[str] = ("src_ip",)) -> DataFrame:
    """Packets -> flows -> features -> inspection -> scores."""
    return score_features(flow_features(packets, mode, cfg=cfg), models, cfg, history,
                          materialise=True)


def suspicious(scored: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """The optional anomaly cut."""
    return scored.filter(F.col("anomaly_score") >= cfg.anomaly_threshold)
