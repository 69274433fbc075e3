"""Every operator as a runnable query over the generic test tables.

Scores that need a trained model are replaced by deterministic stand-ins where the query is compared
with SQL; the ``*_forest``, ``*_classes`` and ``score_flows`` queries run the real models.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.config import DEFAULTS
from wirelens.fixed_values import (ATTACK_CLASSES, FEATURE_NAMES, SEVERITY_FEED_LABELS,
                                   SEVERITY_GAUGE_LABELS)
from wirelens.functions.entropy import byte_entropy
from wirelens.functions.numbers import human_bytes, human_number, round_half_up
from wirelens.operators import alerts as al
from wirelens.operators import features as ft
from wirelens.operators import flows as fl
from wirelens.operators import greedy, l2, models, ordered, scoring, sequence
from wirelens.operators import inspect as ins
from wirelens.operators.iforest import IsolationForest
from wirelens.plans import reports as rp
from wirelens.plans import rollups, scoring_job
from wirelens.schemas import FLOW_KEY
from wirelens.session import cut_lineage
from wirelens.sources import readers, trace

Query = Callable[[SparkSession, str], DataFrame]
KEY = FLOW_KEY
_US = 1_000_000
# features that come out of a square root or a division by a non-integer; compared at 6 decimals
ROUNDED = {f for f in FEATURE_NAMES if f.endswith("_std") or "iat_" in f}


# --- inputs ---------------------------------------------------------------------------------------
def packets(spark: SparkSession, d: str) -> DataFrame:
    return trace.packets(spark, d)


def l2_events(spark: SparkSession, d: str) -> DataFrame:
    return trace.l2_events(spark, d)


def stand_in_scores(flows: DataFrame) -> DataFrame:
    """Deterministic raw scores for flows; test inputs, not a detector."""
    return flows.withColumns({
        "anomaly_score": F.expr("(packet_count * 37 % 101) / 100e0"),
        "confidence": F.expr("0.5e0 + (total_bytes % 50) / 100e0"),
        "sequence_score": F.expr("(total_bytes % 97) / 97e0"),
        "attack_type": F.expr(
            "CASE total_bytes % 4 WHEN 0 THEN 'BENIGN' WHEN 1 THEN 'DoS' WHEN 2 THEN 'PortScan'"
            " ELSE 'BruteForce' END")})


def stand_in_flows(spark: SparkSession, d: str) -> DataFrame:
    return stand_in_scores(fl.assemble_flows(packets(spark, d)))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return scoring.threat_score(stand_in_flows(spark, d))


def alert_table(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of both layers with enough columns to order them uniquely."""
    return al.union_alerts(al.l3_alerts(scored(spark, d)), l2.l2_alerts(l2_events(spark, d)))


def stand_in_probabilities() -> Column:
    """Eight positive weights per flow, scaled to sum to 1."""
    w = [F.expr(f"CAST((total_bytes * {i + 1}) % 13 + 1 AS DOUBLE)")
         for i in range(len(ATTACK_CLASSES))]
    total = sum(w[1:], w[0])
    return F.array(*[x / total for x in w])


def labelled_features(spark: SparkSession, d: str) -> DataFrame:
    """Flow features with the stand-in class as label, in the shape training takes. Fitting and scoring
    both read them, so they are assembled and written once."""
    feats = ft.flow_features(packets(spark, d))
    return cut_lineage(stand_in_scores(feats).select(
        "id", *KEY, "flow_no", "last_us", F.col("attack_type").alias("label"),
        ft.feature_array().alias("vector")))


_ALERT = ["timestamp", "src_ip", "dst_ip", "attack_type", "threat_score", "recommended_action",
          "layer", "category", "src_mac", "dst_mac", "risk_level"]
_RECORD = ["ts_us", "seq", "segment", "timestamp", "category", "attack_type", "threat_score",
           "risk_level", "src_mac", "dst_mac", "src_ip", "dst_ip", "recommended_action",
           "description"]
_FLOW = [*KEY, "flow_no", "timestamp", "packet_count", "total_bytes", "duration"]




# one minute after the first 300 seconds of the trace, so filters on the last two minutes cut
NOW = 1704067200.0 + 360.0


# --- sources, flows, features -----------------------------------------------------------------------
def packet_scan(s, d):
    return readers.capture_filter(packets(s, d))


def l2_event_scan(s, d):
    return l2_events(s, d).select("seq", "ts_us", "timestamp", "segment", "type", "src_mac",
                                  "dst_mac", "op", "src_ip", "root_id", "topology_change",
                                  "revision", "outer_vlan", "inner_vlan")


def ensure_columns(s, d):
    base = packets(s, d).select("packet_id", "protocol")
    return readers.ensure_columns(base, {
        "layer": ("string", "L3"), "protocol": ("string", "unused"), "flow_id": ("bigint", None)})


def parse_props_json(s, d):
    out = readers.parse_json_col(trace.events(s, d).select("event_id", "props"), "props",
                                 "k int", "parsed")
    return out.select("event_id", F.col("parsed.k").alias("k"))


def _flow_query(mode: str, bidirectional: bool = False) -> Query:
    def run(s, d):
        return fl.assemble_flows(packets(s, d), mode, bidirectional).select(*_FLOW)
    return run


def flows_bidirectional(s, d):
    feats = ft.flow_features(packets(s, d), "tumbling", bidirectional=True)
    return feats.select(*_FLOW, *_rounded_features(feats))


def flow_packet_sample(s, d):
    out = fl.sample_packets(packets(s, d))
    return out.select(*KEY, "flow_no", "flow_packets", "packets_sample_truncated",
                      F.posexplode("packets_sample").alias("pos", "p")) \
        .select(*KEY, "flow_no", "flow_packets", "packets_sample_truncated", "pos",
                F.col("p.packet_id").alias("packet_id"), F.col("p.length").alias("length"))


def live_feed(s, d):
    """The feed's records, one row per sampled packet."""
    p = packets(s, d)
    feed = rp.live_feed(fl.assemble_flows(p), fl.sample_packets(p))
    return feed.select(*_FLOW, "packets_sample_truncated", F.posexplode("packets_sample")
                       .alias("pos", "p")).select(
        *_FLOW, "packets_sample_truncated", "pos", F.col("p.packet_id").alias("packet_id"))


def flow_iat(s, d):
    return fl.packet_gaps(packets(s, d)).select("packet_id", *KEY, "ts_us", "gap_us")


def flow_packet_link(s, d):
    return fl.link_packets(packets(s, d), "session").select(
        "packet_id", *KEY, "flow_no", "flow_packets")


def flow_retention(s, d):
    return fl.newest(scored(s, d), 1000, tie=KEY).select(*_FLOW, "threat_score")


def _rounded_features(df: DataFrame) -> list[Column]:
    return [round_half_up(F.col(f), 6).alias(f) if f in ROUNDED else F.col(f)
            for f in FEATURE_NAMES]


def flow_features(s, d):
    df = ft.flow_features(packets(s, d))
    return df.select(*KEY, "flow_no", *_rounded_features(df))


def flow_features_whole(s, d):
    df = ft.flow_features(packets(s, d), "whole")
    return df.select(*KEY, *_rounded_features(df))


def flow_features_session(s, d):
    df = ft.flow_features(packets(s, d), "session")
    return df.select(*KEY, "flow_no", *_rounded_features(df))


def flow_feature_array(s, d):
    df = ft.flow_features(packets(s, d), "session")
    return df.select(*KEY, "flow_no", F.posexplode(ft.feature_array()).alias("pos", "v")) \
        .select(*KEY, "flow_no", "pos", round_half_up(F.col("v"), 4).alias("value"))


def flow_features_long(s, d):
    df = ft.features_long(ft.flow_features(packets(s, d), "session"), [*KEY, "flow_no"])
    return df.withColumn("value", round_half_up(F.col("value"), 4))


def payload_entropy(s, d):
    return trace.events(s, d).select("event_id", byte_entropy(F.col("props").cast("binary"))
                                     .alias("entropy"))


def document_entropy(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", byte_entropy(F.col("text").cast("binary")).alias("entropy"))


# --- inspection ---------------------------------------------------------------------------------------
def app_protocol(s, d):
    return packets(s, d).select("packet_id", "src_port", "dst_port",
                                ins.app_protocol().alias("application_protocol"))


def _busy_features(s, d):
    """Flows whose counts and rates reach the indicator limits at test scale."""
    df = ft.flow_features(packets(s, d), "whole")
    return df.withColumns({
        "syn_flag_count": F.col("syn_flag_count") * 8,
        "flow_packets_per_sec": F.col("flow_packets_per_sec") * 20_000,
        "payload_entropy_mean": F.col("payload_entropy_mean") * 1.9,
        "down_up_ratio": F.pmod(F.col("total_fwd_bytes"), F.lit(21)).cast("double"),
        "flow_duration": F.col("flow_duration") / 450})


def anomaly_indicators(s, d):
    return _busy_features(s, d).select(
        *KEY, F.array_join(ins.anomaly_indicators(), ",").alias("indicators"))


def indicator_display(s, d):
    return _busy_features(s, d).select(
        *KEY, F.array_join(ins.indicator_display(ins.anomaly_indicators()), "|").alias("shown"))


def inspection_record(s, d):
    r = ins.inspection()
    return _busy_features(s, d).select(*KEY, r.alias("r")).select(
        *KEY, "r.application_protocol", "r.http_host", "r.tls_sni",
        F.size("r.anomaly_indicators").alias("indicator_count"))


# --- scoring ------------------------------------------------------------------------------------------
def anomaly_clamp(s, d):
    decision = F.expr("(total_bytes % 300 - 150) / 100e0")
    return stand_in_flows(s, d).select(
        *KEY, "flow_no", decision.alias("decision"),
        round_half_up(scoring.anomaly_score(decision), 6).alias("anomaly_score"))


def classify_from_probs(s, d):
    df = fl.assemble_flows(packets(s, d)).withColumn("p", stand_in_probabilities())
    out = scoring.classify(df, "p")
    return out.select(*KEY, "flow_no", "attack_type", "class_index", "confidence",
                      F.col("all_probabilities")["Bot"].alias("p_bot"))


def proba_onehot(s, d):
    label = F.expr("CASE WHEN total_bytes % 5 = 4 THEN 'Novel' ELSE attack_type END")
    df = stand_in_flows(s, d).withColumn("predicted", label)
    hot = scoring.one_hot("predicted")
    return df.select(*KEY, "flow_no", "predicted", *[
        F.get(hot, F.lit(i)).alias(f"p{i}") for i in range(len(ATTACK_CLASSES))])


def _small_spread(s, d):
    """Flows with a per-flow variance small enough for the score to stay below its cap."""
    return fl.assemble_flows(packets(s, d)).withColumn(
        "variance", F.expr("(total_bytes % 23) / 160e0"))


def sequence_score_query(s, d):
    out = sequence.sequence_score(_small_spread(s, d), variance="variance")
    return out.select(*KEY, "flow_no", round_half_up(F.col("sequence_score"), 6)
                      .alias("sequence_score"))


def sequence_score_global(s, d):
    feats = ft.flow_features(packets(s, d))
    tie = F.concat_ws("|", *KEY).alias("k")
    spread = sequence.with_spread(feats.withColumn("k", tie), "v")
    out = sequence.sequence_score(spread, keys=(), tie="k", variance="v")
    # nearly all scores are capped at 1, so the spread itself is compared too
    return out.select(*KEY, "flow_no", round_half_up(F.col("sequence_score"), 6)
                      .alias("sequence_score"), round_half_up(F.log10(1 + F.col("v")), 6).alias("spread"))


def sequence_windows(s, d):
    df = stand_in_flows(s, d).select(
        "last_us", F.concat_ws("|", *KEY).alias("k"), "attack_type",
        F.array(F.col("packet_count").cast("double"), F.col("total_bytes").cast("double"))
        .alias("v"))
    out = sequence.sequence_windows(df, "last_us", "k", "v", "attack_type")
    flat = F.flatten("sequence")
    return out.select("start", "last_us", "target", F.size("sequence").alias("steps"),
                      F.aggregate(flat, F.lit(0.0), lambda a, x: a + x).alias("total"),
                      F.get(flat, F.lit(0)).alias("first_value"),
                      F.element_at(flat, -1).alias("last_value"))


def threat_score(s, d):
    return scored(s, d).select(*KEY, "flow_no", "threat_score")


def risk_band(s, d):
    return scored(s, d).select(*KEY, "flow_no", "risk_level", "recommended_action")


def score_breakdown(s, d):
    return scored(s, d).select(*KEY, "flow_no", "anomaly_score", "classification_confidence",
                               "sequence_score", "component_breakdown.anomaly",
                               "component_breakdown.classification",
                               "component_breakdown.sequence")


def feature_scaling_stats(s, d):
    out = models.scaling_stats(ft.flow_features(packets(s, d)))
    return out.select("feature", round_half_up(F.col("mean"), 3).alias("mean"),
                      round_half_up(F.col("std"), 3).alias("std"))


def label_index(s, d):
    df = stand_in_flows(s, d).select(*KEY, "flow_no", F.col("attack_type").alias("label"))
    return models.label_index(df)


def class_weights(s, d):
    return models.class_weights(stand_in_flows(s, d), "attack_type")


def classification_report(s, d):
    df = stand_in_flows(s, d).select(
        F.col("attack_type").alias("label"),
        F.expr("CASE WHEN packet_count % 3 = 0 THEN 'DoS' ELSE attack_type END")
        .alias("prediction"))
    out = models.classification_report(df)
    return out.select("class", "support", *[round_half_up(F.col(c), 6).alias(c)
                                            for c in ("precision", "recall", "f1")])


def isolation_forest_scores(s, d):
    df = labelled_features(s, d)
    model = IsolationForest().fit(df, "id", F.col("vector"))
    return model.transform(df, F.col("vector")).select(*KEY, "flow_no", "anomaly_score")


def rf_attack_classes(s, d):
    df = labelled_features(s, d)
    model = models.AttackClassifier().fit(df)
    return model.transform(df).select(*KEY, "flow_no", "attack_type", "confidence", "class_index")


def gbt_attack_classes(s, d):
    df = labelled_features(s, d)
    model = models.AttackClassifier(boosted=True).fit(df)
    return model.transform(df).select(*KEY, "flow_no", "attack_type", "confidence", "class_index")


def training_report(s, d):
    _, report = scoring_job.training_report(labelled_features(s, d), "id", "vector")
    return report


def sequence_classifier(s, d):
    rows = labelled_features(s, d)
    windows = sequence.sequence_windows(rows, "last_us", "id", "vector", "label",
                                        versus="window_start")
    model = models.fit_sequence_classifier(windows, width=len(FEATURE_NAMES))
    out = model.transform(models.flatten_windows(windows))
    return out.select("start", "target", F.col("predicted").cast("int").alias("predicted"))


def stratified_split(s, d):
    df = stand_in_flows(s, d)
    out = models.stratified_split(df, "attack_type", "id")
    return out.groupBy("attack_type").agg(
        F.count_if("is_train").alias("train_rows"), F.count_if(~F.col("is_train"))
        .alias("test_rows"))


def score_flows(s, d):
    df = labelled_features(s, d)
    fitted = scoring_job.train(df, "id", "vector")
    return scoring_job.score_flows(packets(s, d), fitted).select(
        *KEY, "flow_no", "packet_count", "total_bytes", "duration", "threat_score", "risk_level",
        "attack_type", "anomaly_score", "classification_confidence", "sequence_score",
        "recommended_action", "dpi_result.application_protocol")


# --- alerts -------------------------------------------------------------------------------------------
def l3_alerts(s, d):
    return al.l3_alerts(scored(s, d)).select(*_ALERT)


def alerts_union(s, d):
    return alert_table(s, d).select(*_ALERT, "acknowledged")


def severity_band(s, d):
    t = F.col("threat_score")
    return scored(s, d).select(
        *KEY, "flow_no", scoring.severity_band(t).alias("risk"),
        scoring.severity_band(t, SEVERITY_GAUGE_LABELS).alias("gauge"),
        scoring.severity_band(t, SEVERITY_FEED_LABELS).alias("feed"))


def alert_count(s, d):
    return alert_table(s, d).agg(F.count(F.lit(1)).alias("alerts"))


# --- Layer 2 ------------------------------------------------------------------------------------------
def _l2_query(rule: Callable[[DataFrame], DataFrame], **details: str) -> Query:
    def run(s, d):
        return rule(l2_events(s, d)).select(
            *_RECORD, *[F.col("details")[k].cast(t).alias(k) for k, t in details.items()])
    return run


def l2_all_alerts(s, d):
    return l2.l2_alerts(l2_events(s, d)).select(*_RECORD)


def l2_status(s, d):
    return l2.l2_status(l2_events(s, d))


def cooldown(s, d):
    ev = l2_events(s, d).select("type", "ts_us", "seq")
    return greedy.cooldown(ev, ["type"], "ts_us", "seq", 7 * _US)


def rolling_distinct(s, d):
    ev = l2_events(s, d).filter("type = 'ARP'").select("segment", "ts_us", "seq", "src_ip")
    return ordered.rolling_distinct(ev, ["segment"], "ts_us", "seq", "src_ip", 10 * _US,
                                    "distinct_ips", DEFAULTS.l2_slot_s * _US) \
        .select("segment", "ts_us", "seq", "src_ip", "distinct_ips")


def rolling_count(s, d):
    ev = l2_events(s, d).select("type", "ts_us", "seq")
    return ordered.rolling_count(ev, ["type"], "ts_us", "seq", 10 * _US, "in_window",
                                 DEFAULTS.l2_slot_s * _US)


def reset_on_fire(s, d):
    ev = l2_events(s, d).filter("type = 'CDP'").select("segment", "ts_us", "seq")
    return greedy.reset_on_fire(ev, ["segment"], "ts_us", "seq", 10 * _US, 20,
                                DEFAULTS.l2_slot_s * _US).select("segment", "ts_us", "seq")


def running_min_break(s, d):
    ev = l2_events(s, d).filter("type = 'STP'").select("segment", "ts_us", "seq", "root_id")
    return ordered.running_min_before(ev, ["segment"], "ts_us", "seq", "root_id", "previous",
                                      DEFAULTS.l2_slot_s * _US).filter("root_id < previous")


def first_seen(s, d):
    return ordered.first_seen(l2_events(s, d), ["segment", "src_mac"], "ts_us", "seq", ["type"])


# --- reports ------------------------------------------------------------------------------------------
_SCORED = [*_FLOW, "threat_score", "risk_level", "attack_type"]


def recent_flows(s, d):
    return rp.recent_flows(scored(s, d), limit=500, offset=10, src_ip="168.100.1",
                           dst_ip="10.0", protocol="TCP", risk_level="LOW RISK",
                           time_from=NOW - 400, time_to=NOW, ties=KEY).select(*_SCORED)


def flow_detail(s, d):
    p = packets(s, d)
    linked = fl.link_packets(p).select("flow_id", "packet_id", "ts_us", "length", "flags",
                                       "payload_entropy")
    wanted = F.xxhash64(F.lit("192.168.100.10"), F.lit("10.0.0.1"), F.lit(40000), F.lit(53),
                        F.lit("UDP"), F.lit(1704067200000000).cast("bigint"))
    out = rp.flow_detail(scored(s, d), linked, wanted)
    return out.select(*_SCORED, "packet_id", "packet_ts_us", "packet_length", "packet_flags")


def recent_packets(s, d):
    return rp.recent_packets(packets(s, d), limit=2000, offset=5, src_ip="192.168",
                             dst_ip="10.0.0.1", protocol="TCP")


def recent_alerts(s, d):
    table = alert_table(s, d)
    return rp.recent_alerts(table, limit=200, acknowledged=False, layer="L3",
                            ties=("src_ip", "dst_ip", "threat_score")) \
        .select(*_ALERT)


def store_counts(s, d):
    return rp.store_counts(scored(s, d), alert_table(s, d), packets(s, d))


def avg_threat(s, d):
    return rp.average_threat(scored(s, d))


def attack_distribution(s, d):
    return rp.attack_distribution(scored(s, d))


def protocol_distribution(s, d):
    return rp.protocol_distribution(scored(s, d))


def recent_hour_counts(s, d):
    return rp.recent_hour_counts(scored(s, d), alert_table(s, d), NOW + 3500)


def traffic_timeseries(s, d):
    out = rp.traffic_timeseries(scored(s, d), NOW, 2)
    return out.withColumn("avg_threat", round_half_up(F.col("avg_threat"), 6))


def top_sources(s, d):
    return rp.top_sources(scored(s, d), NOW, 2)


def top_ports(s, d):
    return rp.top_ports(scored(s, d), NOW, 2)


# the reports from rollups start within a minute, so one minute comes from the rows
_LATER = 17.0


def rollup_timeseries(s, d):
    flows = scored(s, d)
    out = rollups.traffic_timeseries(rollups.roll_up_flows(flows), flows, NOW + _LATER, 2)
    return out.withColumn("avg_threat", round_half_up(F.col("avg_threat"), 6))


def rollup_top_sources(s, d):
    flows = scored(s, d)
    return rollups.top_sources(rollups.roll_up_flows(flows), flows, NOW + _LATER, 2)


def rollup_top_ports(s, d):
    flows = scored(s, d)
    return rollups.top_ports(rollups.roll_up_flows(flows), flows, NOW + _LATER, 2)


def rollup_store_counts(s, d):
    return rollups.store_counts(rollups.roll_up(scored(s, d), alert_table(s, d), packets(s, d)))


def avg_threat_last100(s, d):
    return rp.avg_threat_newest(scored(s, d), 100, ties=KEY)


def traffic_rates(s, d):
    return rp.traffic_rates(packets(s, d), l2_events(s, d))


def flows_page(s, d):
    return rp.flows_page(scored(s, d), 3, ties=KEY).select(*_SCORED)


def store_stats(s, d):
    return rp.stats(scored(s, d), alert_table(s, d), packets(s, d), NOW)


def threat_trend(s, d):
    minutes = rp.traffic_timeseries(scored(s, d), NOW, 2)
    return minutes.select("minute", rp.threat_trend(F.col("avg_threat")).alias("trend"))


def alerts_by_band(s, d):
    return rp.alerts_by_band(scored(s, d), "MEDIUM RISK").select(*KEY, "flow_no", "threat_score")


def talker_share(s, d):
    out = rp.share_of_max(rp.top_sources(scored(s, d)), "bytes")
    return out.withColumn("share", round_half_up(F.col("share"), 6))


def rate_last60(s, d):
    return rp.last_samples(rp.traffic_rates(packets(s, d)))


def packet_stream(s, d):
    return rp.packet_stream(packets(s, d).withColumn(
        "payload_entropy", F.col("payload_entropy") * 1.2), "TCP")


def human_units(s, d):
    # the product outgrows a long on large tables: texts come from the decimal, and n, a long in the SQL
    # too, is null where no long holds it
    total, number = (F.col(c).cast("decimal(20,0)") for c in ("total_bytes", "packet_count"))
    n = total * total * number
    return fl.assemble_flows(packets(s, d), "whole").select(
        *KEY, n.try_cast("long").alias("n"), human_bytes(n).alias("bytes_text"),
        human_number(n).alias("number_text"))


def packet_direction(s, d):
    out = fl.link_packets(packets(s, d), "whole")
    return out.groupBy(*KEY).agg(
        F.count_if(rp.packet_direction(F.col("src_ip"), F.least("src_ip", "dst_ip")) == "fwd")
        .alias("fwd_packets"))


def packet_direction_pairs(s, d):
    host = F.when(F.col("src_ip").startswith("192."), F.col("src_ip")) \
        .otherwise(F.col("dst_ip"))
    return packets(s, d).select("packet_id", rp.packet_direction(F.col("src_ip"), host)
                                .alias("direction"))


def feature_labels(s, d):
    long = ft.features_long(ft.flow_features(packets(s, d), "whole"), KEY)
    return long.groupBy("feature", "feature_group").agg(F.count(F.lit(1)).alias("flows")) \
        .withColumn("label", ft.feature_label(F.col("feature")))


def scan_fanout(s, d):
    return rp.scan_fanout(packets(s, d), min_ports=2, exact=True)


def flood_by_target(s, d):
    return rp.flood_by_target(packets(s, d), min_syn=2)


QUERIES: dict[str, Query] = {
    "packet_scan": packet_scan,
    "l2_event_scan": l2_event_scan,
    "ensure_columns": ensure_columns,
    "parse_props_json": parse_props_json,
    "flows_whole": _flow_query("whole"),
    "flows_tumbling": _flow_query("tumbling"),
    "flows_session": _flow_query("session"),
    "flows_bidirectional": flows_bidirectional,
    "flow_packet_sample": flow_packet_sample,
    "live_feed": live_feed,
    "flow_iat": flow_iat,
    "flow_packet_link": flow_packet_link,
    "flow_retention": flow_retention,
    "flow_features": flow_features,
    "flow_features_whole": flow_features_whole,
    "flow_features_session": flow_features_session,
    "flow_feature_array": flow_feature_array,
    "flow_features_long": flow_features_long,
    "payload_entropy": payload_entropy,
    "document_entropy": document_entropy,
    "app_protocol": app_protocol,
    "anomaly_indicators": anomaly_indicators,
    "indicator_display": indicator_display,
    "inspection_record": inspection_record,
    "anomaly_clamp": anomaly_clamp,
    "classify_from_probs": classify_from_probs,
    "proba_onehot": proba_onehot,
    "sequence_score": sequence_score_query,
    "sequence_score_global": sequence_score_global,
    "sequence_windows": sequence_windows,
    "threat_score": threat_score,
    "risk_band": risk_band,
    "score_breakdown": score_breakdown,
    "feature_scaling_stats": feature_scaling_stats,
    "label_index": label_index,
    "class_weights": class_weights,
    "classification_report": classification_report,
    "isolation_forest_scores": isolation_forest_scores,
    "rf_attack_classes": rf_attack_classes,
    "gbt_attack_classes": gbt_attack_classes,
    "training_report": training_report,
    "sequence_classifier": sequence_classifier,
    "stratified_split": stratified_split,
    "score_flows": score_flows,
    "l3_alerts": l3_alerts,
    "alerts_union": alerts_union,
    "severity_band": severity_band,
    "alert_count": alert_count,
    "l2_arp_spoof": _l2_query(l2.arp_spoofing, ip="string", previous_mac="string",
                              new_mac="string"),
    "l2_mac_flood": _l2_query(l2.mac_flooding, distinct_macs_in_window="bigint"),
    "l2_stp_root": _l2_query(l2.stp_root_hijack, claimed_root_id="string",
                             previous_root_id="string"),
    "l2_stp_tc_flood": _l2_query(l2.stp_tc_flood, tc_count_in_window="bigint"),
    "l2_cdp_flood": _l2_query(l2.cdp_flood),
    "l2_dtp": _l2_query(l2.dtp_spoofing),
    "l2_vtp": _l2_query(l2.vtp_attack, previous_revision="int", new_revision="int"),
    "l2_vlan_hop": _l2_query(l2.vlan_hopping, outer_vlan="int", inner_vlan="int"),
    "l2_all_alerts": l2_all_alerts,
    "l2_status": l2_status,
    "cooldown": cooldown,
    "rolling_distinct": rolling_distinct,
    "rolling_count": rolling_count,
    "reset_on_fire": reset_on_fire,
    "running_min_break": running_min_break,
    "first_seen": first_seen,
    "recent_flows": recent_flows,
    "flow_detail": flow_detail,
    "recent_packets": recent_packets,
    "recent_alerts": recent_alerts,
    "store_counts": store_counts,
    "avg_threat": avg_threat,
    "attack_distribution": attack_distribution,
    "protocol_distribution": protocol_distribution,
    "recent_hour_counts": recent_hour_counts,
    "traffic_timeseries": traffic_timeseries,
    "top_sources": top_sources,
    "top_ports": top_ports,
    "rollup_timeseries": rollup_timeseries,
    "rollup_top_sources": rollup_top_sources,
    "rollup_top_ports": rollup_top_ports,
    "rollup_store_counts": rollup_store_counts,
    "avg_threat_last100": avg_threat_last100,
    "traffic_rates": traffic_rates,
    "flows_page": flows_page,
    "store_stats": store_stats,
    "threat_trend": threat_trend,
    "alerts_by_band": alerts_by_band,
    "talker_share": talker_share,
    "rate_last60": rate_last60,
    "packet_stream": packet_stream,
    "human_bytes": human_units,
    "packet_direction": packet_direction,
    "packet_direction_pairs": packet_direction_pairs,
    "feature_labels": feature_labels,
    "scan_fanout": scan_fanout,
    "flood_by_target": flood_by_target,
}
