"""Explicit schemas of the stored tables and event streams."""

from pyspark.sql import types as T

from wirelens.fixed_values import FEATURE_NAMES, INSPECTION_EMPTY_FIELDS

FLOW_KEY = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]

# features that are counts or byte totals; all others are doubles
INTEGER_FEATURES = {
    "total_fwd_packets", "total_bwd_packets", "total_fwd_bytes", "total_bwd_bytes",
    "fwd_psh_flags", "bwd_psh_flags", "fwd_urg_flags", "bwd_urg_flags",
    "fwd_header_length", "bwd_header_length", "min_packet_length", "max_packet_length",
    "fin_flag_count", "syn_flag_count", "rst_flag_count", "psh_flag_count", "ack_flag_count",
    "urg_flag_count", "ece_flag_count", "fwd_header_length2",
    "subflow_fwd_packets", "subflow_fwd_bytes", "subflow_bwd_packets", "subflow_bwd_bytes",
    "init_win_bytes_forward", "init_win_bytes_backward", "act_data_pkt_forward",
    "min_seg_size_forward",
}


def _struct(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in cols])


_S, _I, _L, _D, _B = (T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(),
                      T.BooleanType())

PACKETS = _struct(
    ("packet_id", _L), ("ts_us", _L), ("timestamp", _D),
    ("src_ip", _S), ("dst_ip", _S), ("src_port", _I), ("dst_port", _I), ("protocol", _S),
    ("length", _I), ("flags", _S), ("payload_entropy", _D))

L2_EVENTS = _struct(
    ("seq", _L), ("ts_us", _L), ("timestamp", _D), ("segment", _S), ("type", _S),
    ("src_mac", _S), ("dst_mac", _S),
    ("op", _S), ("src_ip", _S), ("src_hw", _S), ("dst_ip", _S), ("dst_hw", _S),
    ("root_id", _S), ("root_cost", _L), ("bridge_id", _S),
    ("topology_change", _B), ("topology_change_ack", _B),
    ("revision", _I), ("outer_vlan", _I), ("inner_vlan", _I))

FEATURES = T.StructType(
    [T.StructField(n, _L if n in INTEGER_FEATURES else _D) for n in FEATURE_NAMES])

INSPECTION = T.StructType(
    [T.StructField("application_protocol", _S)]
    + [T.StructField(n, _S) for n in INSPECTION_EMPTY_FIELDS]
    + [T.StructField("anomaly_indicators", T.ArrayType(_S))])

FLOWS = _struct(
    ("id", _L), ("timestamp", _D),
    ("src_ip", _S), ("dst_ip", _S), ("src_port", _I), ("dst_port", _I), ("protocol", _S),
    ("packet_count", _L), ("total_bytes", _L), ("duration", _D),
    ("threat_score", _D), ("risk_level", _S), ("attack_type", _S),
    ("anomaly_score", _D), ("classification_confidence", _D),
    ("features", FEATURES), ("dpi_result", INSPECTION))

ALERTS = _struct(
    ("id", _L), ("timestamp", _D), ("flow_id", _L), ("src_ip", _S), ("dst_ip", _S),
    ("attack_type", _S), ("threat_score", _D), ("recommended_action", _S),
    ("acknowledged", _B), ("layer", _S), ("category", _S), ("src_mac", _S), ("dst_mac", _S),
    ("details", T.MapType(_S, _S)), ("risk_level", _S), ("description", _S))
