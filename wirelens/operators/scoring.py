"""Score fusion, risk bands and class decisions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.config import DEFAULTS, Settings
from wirelens.fixed_values import (ANOMALY_WEIGHT, ATTACK_CLASS_SCALE, ATTACK_CLASSES, BENIGN,
                                   BENIGN_CLASS_SCALE, CLASS_WEIGHT, LOW_SHARE, MEDIUM_SHARE,
                                   RISK_ACTIONS, RISK_BENIGN, RISK_HIGH, RISK_LOW, RISK_MEDIUM,
                                   SEQUENCE_WEIGHT, SEVERITY_CUTS, SEVERITY_RISK_LABELS)
from wirelens.functions.numbers import clamp, round_half_up


def anomaly_score(decision: Column | None) -> Column:
    """Decision value -> 0..1, 0.5 when the model gives none."""
    if decision is None:
        return F.lit(0.5)
    return clamp(1 - (decision + 0.5), 0, 1)


def classify(df: DataFrame, probabilities: str, classes: Sequence[str] = ATTACK_CLASSES
             ) -> DataFrame:
    """Add label, confidence, class index and the class -> probability map, which leaves out
    probabilities beyond the last class."""
    probs = F.col(probabilities)
    names = F.array(*[F.lit(c) for c in classes])
    best = (F.array_position(probs, F.array_max(probs)) - 1).cast("int")
    return df.withColumns({
        "attack_type": F.get(names, best),
        "confidence": F.array_max(probs),
        "class_index": best,
        "all_probabilities": F.map_from_arrays(
            F.slice(names, 1, F.size(probs)), F.slice(probs, 1, len(classes))),
    })


def one_hot(prediction: Column | str, classes: Sequence[str] = ATTACK_CLASSES) -> Column:
    """Probabilities of a model that only predicts; an unknown label counts as the first."""
    label = F.col(prediction) if isinstance(prediction, str) else prediction
    names = F.array(*[F.lit(c) for c in classes])
    hit = F.greatest(F.coalesce(F.array_position(names, label), F.lit(0)), F.lit(1))
    return F.transform(names, lambda _, i: F.when(i + 1 == hit, 1.0).otherwise(0.0))


def class_component(attack_type: Column, confidence: Column) -> Column:
    return F.when(attack_type == BENIGN, (1 - confidence) * BENIGN_CLASS_SCALE) \
        .otherwise(confidence * ATTACK_CLASS_SCALE)


def raw_threat(anomaly: Column, class_part: Column, sequence: Column) -> Column:
    """E11 before rounding: weighted parts on a 0..100 scale."""
    return clamp(anomaly * 100 * ANOMALY_WEIGHT + class_part * CLASS_WEIGHT
                 + sequence * 100 * SEQUENCE_WEIGHT, 0, 100)


def risk_band(score: Column, threshold: float = DEFAULTS.band_threshold) -> Column:
    """Takes the unrounded score."""
    return (F.when(score >= threshold, RISK_HIGH)
            .when(score >= threshold * MEDIUM_SHARE, RISK_MEDIUM)
            .when(score >= threshold * LOW_SHARE, RISK_LOW).otherwise(RISK_BENIGN))


def recommended_action(band: Column) -> Column:
    """E13."""
    texts = F.create_map(*[F.lit(x) for kv in RISK_ACTIONS.items() for x in kv])
    return texts[band]


def severity_band(score: Column, labels: Sequence[str] = SEVERITY_RISK_LABELS) -> Column:
    """fixed cut-offs with a choice of label sets."""
    high, medium, low = SEVERITY_CUTS
    return (F.when(score >= high, labels[0]).when(score >= medium, labels[1])
            .when(score >= low, labels[2]).otherwise(labels[3]))


def threat_score(df: DataFrame, anomaly: str = "anomaly_score",
                 attack_type: str = "attack_type", confidence: str = "confidence",
                 sequence: str = "sequence_score", cfg: Settings = DEFAULTS) -> DataFrame:
    """Replace the raw scores by the rounded score record."""
    a, k, s = F.col(anomaly), F.col(confidence), F.col(sequence)
    part = class_component(F.col(attack_type), k)
    scored = df.withColumns({"_raw": raw_threat(a, part, s), "_part": part})
    band = risk_band(F.col("_raw"), cfg.band_threshold)
    scored = scored.withColumns({
        "threat_score": round_half_up(F.col("_raw"), 2),
        "risk_level": band,
        "recommended_action": recommended_action(band),
        "component_breakdown": F.struct(
            round_half_up(a * 100, 2).alias("anomaly"),
            round_half_up(F.col("_part"), 2).alias("classification"),
            round_half_up(s * 100, 2).alias("sequence")),
    })
    return scored.withColumns({
        anomaly: round_half_up(a, 4),
        "classification_confidence": round_half_up(k, 4),
        sequence: round_half_up(s, 4),
    }).drop("_raw", "_part", *([confidence] if confidence != "classification_confidence" else []))
