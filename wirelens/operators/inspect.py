"""Application protocol, anomaly indicators and the inspection record (D*)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirelens.fixed_values import (ASYMMETRIC_RATIO, HIGH_ENTROPY_BITS, HIGH_PACKET_RATE_PPS,
                                   INDICATOR_LABELS, INDICATORS, INSPECTION_EMPTY_FIELDS,
                                   PORT_PROTOCOLS, PORT_SCAN_MAX_SECONDS, PORT_SCAN_MIN_PACKETS,
                                   SYN_FLOOD_ACK_SHARE, SYN_FLOOD_MIN_SYN, UNKNOWN_PROTOCOL)


def app_protocol(dst_port: str = "dst_port", src_port: str = "src_port") -> Column:
    """The table is tried in order against either port."""
    out = F.lit(UNKNOWN_PROTOCOL)
    for port, name in reversed(PORT_PROTOCOLS):
        out = F.when((F.col(dst_port) == port) | (F.col(src_port) == port), name).otherwise(out)
    return out


def indicator_tests() -> dict[str, Column]:
    """D2a-D2e over feature columns, in output order."""
    c = F.col
    syn, ack = c("syn_flag_count"), c("ack_flag_count")
    tests = [
        (syn > SYN_FLOOD_MIN_SYN) & (ack < syn * SYN_FLOOD_ACK_SHARE),
        c("flow_packets_per_sec") > HIGH_PACKET_RATE_PPS,
        c("payload_entropy_mean") > HIGH_ENTROPY_BITS,
        c("down_up_ratio") > ASYMMETRIC_RATIO,
        (c("total_fwd_packets") > PORT_SCAN_MIN_PACKETS)
        & (c("flow_duration") < PORT_SCAN_MAX_SECONDS),
    ]
    return dict(zip(INDICATORS, tests, strict=True))


def anomaly_indicators() -> Column:
    """Names of the indicators that hold."""
    return F.array_compact(F.array(*[F.when(t, n) for n, t in indicator_tests().items()]))


def inspection() -> Column:
    """D3: the inspection record; payload-level fields have no source and stay null."""
    return F.struct(
        app_protocol().alias("application_protocol"),
        *[F.lit(None).cast("string").alias(f) for f in INSPECTION_EMPTY_FIELDS],
        anomaly_indicators().alias("anomaly_indicators"))


def indicator_display(indicators: Column | str, shown: int = 2) -> Column:
    """Labels of the first indicators, then "+N" for the rest."""
    codes = F.col(indicators) if isinstance(indicators, str) else indicators
    labels = F.create_map(*[F.lit(x) for kv in INDICATOR_LABELS.items() for x in kv])
    head = F.transform(F.slice(codes, 1, shown), lambda x: F.coalesce(labels[x], x))
    rest = F.size(codes) - shown
    more = F.when(rest > 0, F.array(F.concat(F.lit("+"), rest.cast("string")))) \
        .otherwise(F.array().cast("array<string>"))
    return F.concat(head, more)
