"""Alerts of both layers in one table (F*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.config import DEFAULTS, Settings
from wirelens.schemas import ALERTS


def as_alerts(df: DataFrame) -> DataFrame:
    """Bring rows into the alert schema: defaults for absent columns, extra columns dropped."""
    defaults = {"layer": F.lit("L3"), "acknowledged": F.lit(False)}
    out = []
    for field in ALERTS.fields:
        if field.name in df.columns:
            value: Column = F.col(field.name)
            if field.name in defaults:
                value = F.coalesce(value, defaults[field.name])
        else:
            value = defaults.get(field.name, F.lit(None))
        out.append(value.cast(field.dataType).alias(field.name))
    return df.select(*out)


def l3_alerts(scored: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """F1: flows whose rounded score reaches the live threshold."""
    hits = scored.filter(F.col("threat_score") >= cfg.threat_threshold)
    return as_alerts(hits.select(
        F.xxhash64(F.lit("L3"), "id").alias("id"), "timestamp", F.col("id").alias("flow_id"),
        "src_ip", "dst_ip", "attack_type", "threat_score", "recommended_action", "risk_level"))


def union_alerts(*parts: DataFrame) -> DataFrame:
    """one alert table; missing columns take their defaults."""
    out = as_alerts(parts[0])
    for part in parts[1:]:
        out = out.unionByName(as_alerts(part))
    return out
