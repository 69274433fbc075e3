"""The 55 flow features, their vector and their long form (C*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.config import DEFAULTS, Settings
from wirelens.fixed_values import (FEATURE_GROUP_DEFAULT, FEATURE_GROUPS, FEATURE_NAMES,
                                   MIN_DURATION_S, OTHER_HEADER_BYTES, TCP_HEADER_BYTES,
                                   TCP_INIT_WINDOW)
from wirelens.operators.flows import ENTROPY_SCALE, FLOW_NO, flow_id, flow_sums
from wirelens.schemas import FLOW_KEY, INTEGER_FEATURES


DURATION = f"greatest((last_us - first_us) / 1e6, {MIN_DURATION_S!r}d)"


def duration() -> Column:
    return F.expr(DURATION)


def _mean(total: str, n: str) -> str:
    return f"if({n} > 0, {total} / {n}, 0d)"


def _variance(total: str, squares: str, n: str) -> str:
    """Population variance from exact sums: (n * sum of squares - sum^2) / n^2."""
    big = "decimal(38,0)"
    spread = (f"cast(cast({n} as decimal(20,0)) * cast({squares} as {big}) as {big})"
              f" - cast(cast({total} as decimal(19,0)) * cast({total} as decimal(19,0)) as {big})")
    return f"if({n} > 1, greatest(double({spread}), 0d) / (double({n}) * double({n})), 0d)"


def _feature_sql() -> dict[str, str]:
    """Every feature over the columns of ``flow_sums``."""
    header = f"if(protocol = 'TCP', {TCP_HEADER_BYTES}, {OTHER_HEADER_BYTES})"
    window = f"if(protocol = 'TCP', {TCP_INIT_WINDOW}, 0)"
    variance = _variance("bytes", "bytes_sq", "n")
    out = {"flow_duration": "duration"}
    for side, d in (("fwd", "f"), ("bwd", "b")):
        n, total = f"{d}_n", f"{d}_bytes"
        gap_variance = _variance(f"{d}_gap_sum", f"{d}_gap_sq", f"{d}_gap_n")
        out |= {
            f"total_{side}_packets": n,
            f"total_{side}_bytes": total,
            f"{side}_packet_length_mean": _mean(total, n),
            f"{side}_packet_length_std": f"sqrt({_variance(total, f'{d}_bytes_sq', n)})",
            f"{side}_iat_mean": _mean(f"({d}_gap_sum / 1e6)", f"{d}_gap_n"),
            f"{side}_iat_std": f"sqrt({gap_variance}) / 1e6",
            f"{side}_psh_flags": f"{d}_psh",
            f"{side}_urg_flags": f"{d}_urg",
            f"{side}_header_length": f"{n} * {header}",
            f"avg_{side}_segment_size": _mean(total, n),
            f"subflow_{side}_packets": n,
            f"subflow_{side}_bytes": total,
        }
    return out | {
        "flow_bytes_per_sec": "bytes / duration",
        "flow_packets_per_sec": "n / duration",
        "min_packet_length": "len_min",
        "max_packet_length": "len_max",
        "packet_length_mean": _mean("bytes", "n"),
        "packet_length_std": f"sqrt({variance})",
        "packet_length_variance": variance,
        **{f"{flag}_flag_count": flag
           for flag in ("fin", "syn", "rst", "psh", "ack", "urg", "ece")},
        "down_up_ratio": "b_bytes / greatest(f_bytes, 1)",
        "avg_packet_size": _mean("bytes", "n"),
        "fwd_header_length2": f"f_n * {header}",
        "init_win_bytes_forward": window,
        "init_win_bytes_backward": window,
        "act_data_pkt_forward": "f_n",
        "min_seg_size_forward": "coalesce(f_len_min, 0)",
        **{f"active_{s}": "duration" for s in ("mean", "max", "min")}, "active_std": "0d",
        **{f"idle_{s}": "0d" for s in ("mean", "std", "max", "min")},
        "payload_entropy_mean": f"entropy / {ENTROPY_SCALE} / n",
    }


def features_of(sums: DataFrame, cfg: Settings = DEFAULTS, extra: Sequence[str] = ()) -> DataFrame:
    """Features from flow sums (``flow_sums`` or their streaming counterpart), and columns of the
    sums that are passed through."""
    value = _feature_sql()
    return sums.filter(F.col("n") >= cfg.min_flow_packets).withColumn("duration", duration()) \
        .select(
            flow_id(), F.expr("last_us / 1e6 AS timestamp"), *FLOW_KEY, FLOW_NO,
            "first_us", "last_us", F.expr("n AS packet_count"), F.expr("bytes AS total_bytes"),
            "duration",
            *[F.expr(f"cast({value[f]} as {'bigint' if f in INTEGER_FEATURES else 'double'})"
                     f" AS {f}") for f in FEATURE_NAMES], *extra)


def flow_features(packets: DataFrame, mode: str = "tumbling", bidirectional: bool = False,
                  cfg: Settings = DEFAULTS) -> DataFrame:
    """Flow records with the 55 features as flat columns, integer-valued ones as BIGINT."""
    return features_of(flow_sums(packets, mode, bidirectional, cfg), cfg)


def feature_array(missing: float = 0.0) -> Column:
    """The features as ``array<double>`` in vector order, missing ones as 0."""
    return F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(missing)) for f in FEATURE_NAMES])


def feature_struct() -> Column:
    return F.struct(*FEATURE_NAMES)


def feature_vector(df: DataFrame, out: str = "features") -> DataFrame:
    """C56 for Spark ML."""
    filled = df.na.fill(0, FEATURE_NAMES)
    return VectorAssembler(inputCols=FEATURE_NAMES, outputCol=out,
                           handleInvalid="error").transform(filled)


def feature_group(name: Column) -> Column:
    """Display group of a feature, first matching pattern wins."""
    out = F.lit(FEATURE_GROUP_DEFAULT)
    for group, pattern in reversed(FEATURE_GROUPS):
        out = F.when(name.rlike(pattern), group).otherwise(out)
    return out


def feature_label(name: Column) -> Column:
    """I8: ``fwd_iat_mean`` -> ``Fwd Iat Mean``."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def features_long(df: DataFrame, ids: list[str]) -> DataFrame:
    """One row per flow and feature with its group."""
    wide = df.select(*ids, *[F.col(f).cast("double").alias(f) for f in FEATURE_NAMES])
    return (wide.unpivot(ids, FEATURE_NAMES, "feature", "value")
            .withColumn("feature_group", feature_group(F.col("feature"))))
