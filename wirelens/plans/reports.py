"""Reports over flows, packets and alerts (H*, I*). ``now`` is always a parameter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelens.config import DEFAULTS, Settings
from wirelens.fixed_values import (BENIGN, ENTROPY_HIGHLIGHT, RISK_HIGH, RISK_LOW, RISK_MEDIUM,
                                   SEVERITY_CUTS, TREND_CUT, TREND_LABELS)
from wirelens.functions.numbers import round_half_up
from wirelens.operators.ordered import running_sum, slot_start

_US = 1_000_000
PAGE_SIZE = 20
_FLOW_TIE = ("id",)


def _within(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie in {low}..{high}")
    return value


def _contains(column: str, text: str) -> Column:
    """Case-insensitive substring match in which % and _ keep their wildcard meaning."""
    return F.col(column).ilike(f"%{text}%")


def _newest(df: DataFrame, limit: int, offset: int, ties: Sequence[str]) -> DataFrame:
    ordered = df.orderBy(F.desc("timestamp"), *[F.desc(t) for t in ties])
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def recent_flows(flows: DataFrame, limit: int = 100, offset: int = 0, src_ip: str | None = None,
                 dst_ip: str | None = None, protocol: str | None = None,
                 risk_level: str | None = None, time_from: float | None = None,
                 time_to: float | None = None, ties: Sequence[str] = _FLOW_TIE) -> DataFrame:
    """H1: empty filter values are ignored."""
    _within("limit", limit, 1, 1000)
    for column, text in (("src_ip", src_ip), ("dst_ip", dst_ip)):
        if text:
            flows = flows.filter(_contains(column, text))
    if protocol:
        flows = flows.filter(F.col("protocol") == protocol)
    if risk_level:
        flows = flows.filter(F.col("risk_level") == risk_level)
    if time_from:
        flows = flows.filter(F.col("timestamp") >= time_from)
    if time_to:
        flows = flows.filter(F.col("timestamp") <= time_to)
    return _newest(flows, limit, offset, ties)


def flow_detail(flows: DataFrame, packets: DataFrame, flow_id: int | Column) -> DataFrame:
    """H2: one flow with one row per packet, oldest first; no row when the id is unknown.

    The id filters both sides before the join, so it reaches the scan of stored packets.
    """
    fid = F.lit(flow_id) if isinstance(flow_id, int) else flow_id
    own = packets.filter(F.col("flow_id") == fid).select(
        F.col("flow_id").alias("id"), "packet_id",
        *[F.col(c).alias(f"packet_{c}") for c in ("ts_us", "length", "flags", "payload_entropy")])
    return (flows.filter(F.col("id") == fid).join(own, "id", "left")
            .orderBy("packet_ts_us", "packet_id"))


def recent_packets(packets: DataFrame, limit: int = 200, offset: int = 0,
                   src_ip: str | None = None, dst_ip: str | None = None,
                   protocol: str | None = None, flow_id: int | None = None) -> DataFrame:
    """H3: a flow id of 0 counts as no filter."""
    _within("limit", limit, 1, 2000)
    for column, text in (("src_ip", src_ip), ("dst_ip", dst_ip)):
        if text:
            packets = packets.filter(_contains(column, text))
    if protocol:
        packets = packets.filter(F.col("protocol") == protocol)
    if flow_id:
        packets = packets.filter(F.col("flow_id") == flow_id)
    return _newest(packets, limit, offset, ("packet_id",))


def recent_alerts(alerts: DataFrame, limit: int = 50, acknowledged: bool | None = None,
                  layer: str | None = None, ties: Sequence[str] = ("id",)) -> DataFrame:
    """H4."""
    _within("limit", limit, 1, 500)
    if layer not in (None, "L2", "L3"):
        raise ValueError("layer must be L2 or L3")
    if acknowledged is not None:
        alerts = alerts.filter(F.col("acknowledged") == acknowledged)
    if layer is not None:
        alerts = alerts.filter(F.col("layer") == layer)
    return _newest(alerts, limit, 0, ties)


def store_counts(flows: DataFrame, alerts: DataFrame, packets: DataFrame) -> DataFrame:
    """H5: one row per table."""
    tables = {"flows": flows, "alerts": alerts, "packets": packets}
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"),
                                                             "rows")
        out = row if out is None else out.unionByName(row)
    return out


def average_threat(flows: DataFrame) -> DataFrame:
    """H6."""
    mean = F.coalesce(F.avg("threat_score"), F.lit(0.0))
    return flows.agg(round_half_up(mean, 2).alias("avg_threat_score"))


def attack_distribution(flows: DataFrame) -> DataFrame:
    """H7: benign and unlabelled flows are left out."""
    return (flows.filter(F.col("attack_type") != BENIGN).groupBy("attack_type")
            .agg(F.count(F.lit(1)).alias("count")))


def protocol_distribution(flows: DataFrame) -> DataFrame:
    """H8."""
    return flows.groupBy("protocol").agg(F.count(F.lit(1)).alias("count"))


def recent_hour_counts(flows: DataFrame, alerts: DataFrame, now: float) -> DataFrame:
    """H9: rows strictly newer than an hour before ``now``."""
    recent = F.col("timestamp") > now - 3600
    out = None
    for name, df in (("flows", flows), ("alerts", alerts)):
        row = df.filter(recent).agg(F.count(F.lit(1)).alias("recent")) \
            .select(F.lit(name).alias("table_name"), "recent")
        out = row if out is None else out.unionByName(row)
    return out


def _since(df: DataFrame, now: float, minutes: int) -> DataFrame:
    _within("minutes", minutes, 1, 1440)
    return df.filter(F.col("timestamp") > now - minutes * 60)


def utc_minute(ts_us: Column) -> Column:
    """``yyyy-MM-dd HH:mm`` in UTC whatever the session time zone is."""
    minute = F.floor(ts_us / (60 * _US)).cast("int")
    base = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.date_format(F.timestamp_add("MINUTE", minute, base), "yyyy-MM-dd HH:mm")


def traffic_timeseries(flows: DataFrame, now: float, minutes: int = 60) -> DataFrame:
    """Per UTC minute, ascending."""
    return (_since(flows, now, minutes)
            .groupBy(utc_minute(F.col("last_us")).alias("minute"))
            .agg(F.count(F.lit(1)).alias("flow_count"), F.sum("total_bytes").alias("byte_count"),
                 F.avg("threat_score").alias("avg_threat"))
            .orderBy("minute"))


def top_sources(flows: DataFrame, now: float | None = None, minutes: int = 60, limit: int = 8
                ) -> DataFrame:
    """H11; ``now=None`` takes all flows."""
    df = flows if now is None else _since(flows, now, minutes)
    return (df.groupBy(F.col("src_ip").alias("ip"))
            .agg(F.sum("total_bytes").alias("bytes"), F.sum("packet_count").alias("packets"),
                 F.count(F.lit(1)).alias("flows"))
            .orderBy(F.desc("bytes"), "ip").limit(limit))


def top_ports(flows: DataFrame, now: float | None = None, minutes: int = 60, limit: int = 8
              ) -> DataFrame:
    """H12."""
    df = flows if now is None else _since(flows, now, minutes)
    return (df.groupBy(F.col("dst_port").alias("port"), "protocol")
            .agg(F.count(F.lit(1)).alias("flows"), F.sum("total_bytes").alias("bytes"))
            .orderBy(F.desc("flows"), "port", "protocol").limit(limit))


def avg_threat_newest(flows: DataFrame, n: int = 100, ties: Sequence[str] = _FLOW_TIE
                      ) -> DataFrame:
    """H13."""
    newest = _newest(flows, n, 0, ties)
    return newest.agg(round_half_up(F.coalesce(F.avg("threat_score"), F.lit(0.0)), 2)
                      .alias("avg_threat_score"))


def traffic_rates(packets: DataFrame, l2: DataFrame | None = None) -> DataFrame:
    """Per second packets and bytes with running totals. Layer-2 events count as packets.

    Rows are reduced to seconds first; the running total is then carried over day-long slots.
    """
    rows = packets.select("ts_us", F.lit(1).alias("n"), F.col("length").cast("long").alias("b"))
    if l2 is not None:
        rows = rows.unionByName(
            l2.select("ts_us", F.lit(1).alias("n"), F.lit(0).cast("long").alias("b")))
    seconds = rows.groupBy(slot_start("ts_us", _US).alias("second_us")).agg(
        F.sum("n").alias("packets_per_sec"), F.sum("b").alias("bytes_per_sec"))
    day = 86_400 * _US
    for rate, total in (("packets_per_sec", "total_packets"), ("bytes_per_sec", "total_bytes")):
        seconds = running_sum(seconds, [], ["second_us"], rate, total, day)
    return seconds


def flows_page(flows: DataFrame, page: int, size: int = PAGE_SIZE,
               ties: Sequence[str] = _FLOW_TIE) -> DataFrame:
    """Page 1 is the newest."""
    _within("page", page, 1, 2 ** 31)
    return _newest(flows, size, (page - 1) * size, ties)


def stats(flows: DataFrame, alerts: DataFrame, packets: DataFrame, now: float) -> DataFrame:
    """H5, H6 and H9 as one name -> value table."""
    counts = store_counts(flows, alerts, packets).select(
        F.concat(F.lit("total_"), "table_name").alias("name"),
        F.col("rows").cast("double").alias("value"))
    recent = recent_hour_counts(flows, alerts, now).select(
        F.concat(F.lit("recent_"), "table_name").alias("name"),
        F.col("recent").cast("double").alias("value"))
    threat = average_threat(flows).select(F.lit("avg_threat_score").alias("name"),
                                          F.col("avg_threat_score").alias("value"))
    return counts.unionByName(recent).unionByName(threat)


def threat_trend(score: Column) -> Column:
    """I1."""
    return F.when(score > TREND_CUT, TREND_LABELS[0]).otherwise(TREND_LABELS[1])


def alerts_by_band(alerts: DataFrame, band: str = "all") -> DataFrame:
    """Unknown bands keep every alert."""
    high, medium, low = SEVERITY_CUTS
    score = F.col("threat_score")
    ranges = {RISK_HIGH: score >= high, RISK_MEDIUM: (score >= medium) & (score < high),
              RISK_LOW: (score >= low) & (score < medium)}
    return alerts.filter(ranges[band]) if band in ranges else alerts


def share_of_max(top: DataFrame, column: str, out: str = "share") -> DataFrame:
    """Percent of the greatest value, which counts as at least 1. For top-k results only."""
    peak = F.greatest(F.max(column).over(Window.partitionBy(F.lit(0))), F.lit(1))
    return top.withColumn(out, F.col(column) / peak * 100)


def last_samples(series: DataFrame, time: str = "second_us", n: int = 60) -> DataFrame:
    """I4."""
    return series.orderBy(F.desc(time)).limit(n)


def packet_stream(packets: DataFrame, protocol: str = "", n: int = 150) -> DataFrame:
    """Newest packets with an entropy highlight."""
    if protocol:
        packets = packets.filter(F.col("protocol") == protocol)
    newest = _newest(packets, n, 0, ("packet_id",))
    return newest.withColumn(
        "high_entropy", F.coalesce(F.col("payload_entropy"), F.lit(0.0)) > ENTROPY_HIGHLIGHT)


def packet_direction(src_ip: Column, flow_src_ip: Column) -> Column:
    """I7."""
    return F.when(src_ip == flow_src_ip, "fwd").otherwise("bwd")


def live_feed(flows: DataFrame, samples: DataFrame) -> DataFrame:
    """Flow records with their bounded packet sample."""
    return flows.join(samples.select(F.col("flow_id").alias("id"), "packets_sample",
                                     "packets_sample_truncated"), "id", "left")


def scan_fanout(packets: DataFrame, window_s: int = 60, min_ports: int = 2, exact: bool = False
                ) -> DataFrame:
    """Distinct destination ports per source, target and window."""
    distinct = F.count_distinct("dst_port") if exact else F.approx_count_distinct("dst_port")
    return (packets.groupBy("src_ip", "dst_ip",
                            slot_start("ts_us", window_s * _US).alias("window_us"))
            .agg(distinct.alias("ports")).filter(F.col("ports") >= min_ports))


def flood_by_target(packets: DataFrame, window_s: int = 60, min_syn: int = 1) -> DataFrame:
    """Connection attempts per target and window."""
    syn = F.count_if(F.contains(F.coalesce("flags", F.lit("")), F.lit("S")))
    return (packets.groupBy("dst_ip", "dst_port",
                            slot_start("ts_us", window_s * _US).alias("window_us"))
            .agg(syn.alias("syn_count")).filter(F.col("syn_count") >= min_syn))
