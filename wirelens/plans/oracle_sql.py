"""The catalogue's queries as plain SQL, written from the definitions rather than from the jobs.

The SQL takes the direct route (windows over whole keys, recursion for greedy rules); it states what
the answer is and is only run at test scale.
"""

from __future__ import annotations

import re

from wirelens.fixed_values import (ATTACK_CLASSES, FEATURE_GROUP_DEFAULT, FEATURE_GROUPS,
                                   FEATURE_NAMES, INDICATOR_LABELS, L2_ALERTS, RISK_ACTIONS)
from wirelens.plans.catalog import NOW, ROUNDED
from wirelens.schemas import INTEGER_FEATURES

KEY = "src_ip, dst_ip, src_port, dst_port, protocol"
KEY_DESC = ", ".join(f"{c} DESC" for c in KEY.split(", "))


def rnd(x: str, digits: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(30,8)), {digits}) AS DOUBLE)"


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- inputs -------------------------------------------------------------------------------------------
PACKETS = """
pb AS (
  SELECT event_id, event_type, value, user_id,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events),
pc AS (
  SELECT event_id, k, value,
         1704067200000000 + event_id * 50000 + (event_id * 7919) % 50000 AS ts_us,
         '192.168.100.' || CAST(10 + user_id % 6 AS STRING) AS a,
         '10.0.0.' || CAST(k % 3 AS STRING) AS z,
         CASE event_type WHEN 'signup' THEN 'UDP' WHEN 'purchase' THEN 'ICMP' ELSE 'TCP' END
           AS protocol,
         CASE event_type WHEN 'click' THEN 80 WHEN 'view' THEN 443 WHEN 'error' THEN 22
              WHEN 'signup' THEN 53 ELSE 0 END AS dp,
         CASE WHEN event_type = 'purchase' THEN 0 ELSE 40000 + user_id % 3 END AS sp FROM pb),
p AS (
  SELECT event_id AS packet_id, ts_us, ts_us / 1e6 AS timestamp,
         CASE WHEN k % 4 = 3 THEN z ELSE a END AS src_ip,
         CASE WHEN k % 4 = 3 THEN a ELSE z END AS dst_ip,
         CAST(CASE WHEN k % 4 = 3 THEN dp ELSE sp END AS INT) AS src_port,
         CAST(CASE WHEN k % 4 = 3 THEN sp ELSE dp END AS INT) AS dst_port, protocol,
         CAST(40 + least(floor(value * 6), 1460) AS INT) AS length,
         CASE WHEN protocol <> 'TCP' THEN '' WHEN k % 5 = 0 THEN 'S' WHEN k % 5 = 1 THEN 'SA'
              WHEN k % 5 = 2 THEN 'PA' WHEN k % 5 = 3 THEN 'FA' ELSE 'R' END AS flags,
         k * 0.08e0 AS payload_entropy FROM pc)"""

L2 = """
lb AS (
  SELECT event_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events),
lc AS (
  SELECT event_id, k, (event_id * 37) % 97 AS m,
         CAST(floor(event_id / 2000) AS BIGINT) % 100 AS blk,
         1704067200000000 + event_id * 50000 + (event_id * 7919) % 50000 AS ts_us,
         CASE WHEN event_type IN ('click', 'view') THEN 'ARP' WHEN event_type = 'error' THEN 'CDP'
              WHEN event_type = 'signup' THEN 'STP' WHEN k < 40 THEN 'DTP' WHEN k < 80 THEN 'VTP'
              WHEN k < 90 THEN 'VLAN_DOUBLE_TAG' ELSE 'UDLD' END AS type FROM lb),
ev AS (
  SELECT event_id AS seq, ts_us, ts_us / 1e6 AS timestamp, type, 'seg0' AS segment,
         '02:00:00:' || lpad(CAST(blk AS STRING), 2, '0') || ':'
           || lpad(CAST(CASE WHEN type = 'ARP' THEN m ELSE event_id % 2 END AS STRING), 2, '0')
           || ':01' AS src_mac,
         'ff:ff:ff:ff:ff:ff' AS dst_mac,
         CASE WHEN type = 'ARP' THEN CASE WHEN k % 2 = 0 THEN 'reply' ELSE 'request' END END AS op,
         CASE WHEN type = 'ARP' THEN '192.168.100.' || CAST(m % 90 AS STRING) END AS src_ip,
         CAST(NULL AS STRING) AS src_hw, CAST(NULL AS STRING) AS dst_ip,
         CASE WHEN type = 'STP' THEN lpad(CAST((event_id * 7919) % 9973 AS STRING), 4, '0')
           || '.020000000001' END AS root_id,
         CASE WHEN type = 'STP' THEN k < 15 END AS topology_change,
         CASE WHEN type = 'VTP' THEN k * 2 END AS revision,
         CASE WHEN type = 'VLAN_DOUBLE_TAG' THEN 1 END AS outer_vlan,
         CASE WHEN type = 'VLAN_DOUBLE_TAG' THEN k END AS inner_vlan FROM lc)"""

_GROUP = {
    "whole": "p0 AS (SELECT *, CAST(0 AS BIGINT) AS flow_no FROM p)",
    "tumbling": "p0 AS (SELECT *, ts_us - ts_us % 60000000 AS flow_no FROM p)",
    "session": f"""
ps AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY {KEY} ORDER BY ts_us, packet_id)
                 > 60000000 THEN 1 ELSE 0 END AS is_new FROM p),
p0 AS (SELECT * EXCLUDE (is_new), CAST(sum(is_new) OVER (PARTITION BY {KEY}
         ORDER BY ts_us, packet_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS flow_no FROM ps)""",
}
DURATION = "greatest((max(ts_us) - min(ts_us)) / 1e6, 0.0001e0)"


def flows(mode: str) -> str:
    return f"""{PACKETS}, {_GROUP[mode]},
f AS (SELECT {KEY}, flow_no, max(ts_us) AS last_us, max(ts_us) / 1e6 AS timestamp,
        count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS total_bytes,
        {DURATION} AS duration
      FROM p0 GROUP BY {KEY}, flow_no HAVING count(*) >= 2)"""


FLOW_COLS = f"{KEY}, flow_no, timestamp, packet_count, total_bytes, duration"
STAND_IN = """
si AS (SELECT *, (packet_count * 37 % 101) / 100e0 AS a, 0.5e0 + (total_bytes % 50) / 100e0 AS c,
         (total_bytes % 97) / 97e0 AS s,
         CASE total_bytes % 4 WHEN 0 THEN 'BENIGN' WHEN 1 THEN 'DoS' WHEN 2 THEN 'PortScan'
              ELSE 'BruteForce' END AS attack_type FROM f)"""
_ACTION = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in RISK_ACTIONS.items())
SCORED = f"""{flows("tumbling")}, {STAND_IN},
sp1 AS (SELECT *, CASE WHEN attack_type = 'BENIGN' THEN (1 - c) * 30 ELSE c * 100 END AS part
        FROM si),
sp2 AS (SELECT *, greatest(0e0, least(100e0, a * 100 * 0.30e0 + part * 0.50e0 + s * 100 * 0.20e0))
          AS raw FROM sp1),
sp3 AS (SELECT *, CASE WHEN raw >= 75e0 THEN 'HIGH RISK / ATTACK' WHEN raw >= 75e0 * 0.6e0
          THEN 'MEDIUM RISK' WHEN raw >= 75e0 * 0.3e0 THEN 'LOW RISK' ELSE 'BENIGN' END
          AS risk_level FROM sp2),
sc AS (SELECT *, {rnd("raw", 2)} AS threat_score,
         CASE risk_level {_ACTION} END AS recommended_action FROM sp3)"""
SCORED_COLS = f"{FLOW_COLS}, threat_score, risk_level, attack_type"


# --- features -----------------------------------------------------------------------------------------
def _stats(cond: str, name: str) -> str:
    """Count, sum and exact spread of lengths over the packets that meet a condition."""
    n = f"count(*) FILTER (WHERE {cond})"
    t = f"coalesce(sum(length) FILTER (WHERE {cond}), 0)"
    q = f"coalesce(sum(CAST(length AS HUGEINT) * length) FILTER (WHERE {cond}), 0)"
    return f"{n} AS {name}_n, {t} AS {name}_t, {q} AS {name}_q"


def _var(n: str, t: str, q: str) -> str:
    return (f"CASE WHEN {n} > 1 THEN greatest(CAST(CAST({n} AS HUGEINT) * {q} - CAST({t} AS HUGEINT)"
            f" * {t} AS DOUBLE), 0e0) / (CAST({n} AS DOUBLE) * CAST({n} AS DOUBLE)) ELSE 0e0 END")


def _gaps(side: str) -> str:
    g = f"gap_{side}"
    return (f"count({g}) AS g{side}_n, coalesce(sum({g}), 0) AS g{side}_t,"
            f" coalesce(sum(CAST({g} AS HUGEINT) * {g}), 0) AS g{side}_q")


def feature_ctes(mode: str, bidirectional: bool = False) -> str:
    if bidirectional:
        group = f"""
pe AS (SELECT *, ts_us - ts_us % 60000000 AS flow_no,
         CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port) THEN src_ip || '>' || src_port || '>'
           || dst_ip || '>' || dst_port ELSE dst_ip || '>' || dst_port || '>' || src_ip || '>'
           || src_port END AS pair FROM p),
pw AS (SELECT *, first_value(struct_pack(a := src_ip, b := dst_ip, c := src_port, d := dst_port))
         OVER (PARTITION BY pair, protocol, flow_no ORDER BY ts_us, packet_id) AS ini FROM pe),
p0 AS (SELECT packet_id, ts_us, ini.a AS src_ip, ini.b AS dst_ip, ini.c AS src_port,
         ini.d AS dst_port, protocol, length, flags, payload_entropy, flow_no,
         src_ip = ini.a AND src_port = ini.c AS is_f, NOT (src_ip = ini.a AND src_port = ini.c)
         AS is_b FROM pw)"""
    else:
        group = _GROUP[mode]
    flags = "is_f, is_b" if bidirectional else "TRUE AS is_f, src_ip = dst_ip AS is_b"
    part = f"PARTITION BY {KEY}, flow_no"
    sums = ", ".join(f"count(*) FILTER (WHERE contains(flags, '{c}')) AS {n}_flag_count"
                     for n, c in (("fin", "F"), ("syn", "S"), ("rst", "R"), ("psh", "P"),
                                  ("ack", "A"), ("urg", "U"), ("ece", "E")))
    sided = ", ".join(f"count(*) FILTER (WHERE is_{s} AND contains(flags, '{c}')) AS {d}_{n}_flags"
                      for d, s in (("fwd", "f"), ("bwd", "b"))
                      for n, c in (("psh", "P"), ("urg", "U")))
    return f"""{PACKETS}, {group},
p1 AS (SELECT *, {flags if not bidirectional else '1 AS one'} FROM p0),
p2 AS (SELECT *,
  CASE WHEN is_f THEN ts_us - lag(ts_us) OVER ({part}, is_f ORDER BY ts_us, packet_id) END AS gap_f,
  CASE WHEN is_b THEN ts_us - lag(ts_us) OVER ({part}, is_b ORDER BY ts_us, packet_id) END AS gap_b
  FROM p1),
fa AS (SELECT {KEY}, flow_no, max(ts_us) / 1e6 AS timestamp, count(*) AS packet_count,
  CAST(sum(length) AS BIGINT) AS total_bytes, {DURATION} AS duration,
  {_stats("is_f", "f")}, {_stats("is_b", "b")}, {_stats("TRUE", "t")}, {_gaps("f")}, {_gaps("b")},
  min(length) AS len_min, max(length) AS len_max, min(length) FILTER (WHERE is_f) AS f_min,
  CAST(sum(CAST(floor(payload_entropy * 1e6 + 0.5e0) AS BIGINT)) AS BIGINT) AS ent,
  {sums}, {sided}
  FROM p2 GROUP BY {KEY}, flow_no HAVING count(*) >= 2),
fb AS (SELECT *, CASE WHEN protocol = 'TCP' THEN 20 ELSE 8 END AS hdr,
  CASE WHEN protocol = 'TCP' THEN 640 ELSE 0 END AS win FROM fa)"""


def _mean(t: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN CAST({t} AS DOUBLE) / CAST({n} AS DOUBLE) ELSE 0e0 END"


FEATURE_SQL = {
    "flow_duration": "duration",
    **{f"total_{d}_packets": f"{s}_n" for d, s in (("fwd", "f"), ("bwd", "b"))},
    **{f"total_{d}_bytes": f"{s}_t" for d, s in (("fwd", "f"), ("bwd", "b"))},
    **{f"{d}_packet_length_mean": _mean(f"{s}_t", f"{s}_n")
       for d, s in (("fwd", "f"), ("bwd", "b"))},
    **{f"{d}_packet_length_std": f"sqrt({_var(f'{s}_n', f'{s}_t', f'{s}_q')})"
       for d, s in (("fwd", "f"), ("bwd", "b"))},
    "flow_bytes_per_sec": "total_bytes / duration",
    "flow_packets_per_sec": "packet_count / duration",
    **{f"{d}_iat_mean": _mean(f"(g{s}_t / 1e6)", f"g{s}_n")
       for d, s in (("fwd", "f"), ("bwd", "b"))},
    **{f"{d}_iat_std": f"sqrt({_var(f'g{s}_n', f'g{s}_t', f'g{s}_q')}) / 1e6"
       for d, s in (("fwd", "f"), ("bwd", "b"))},
    **{n: n for n in ("fwd_psh_flags", "bwd_psh_flags", "fwd_urg_flags", "bwd_urg_flags")},
    "fwd_header_length": "f_n * hdr", "bwd_header_length": "b_n * hdr",
    "min_packet_length": "len_min", "max_packet_length": "len_max",
    "packet_length_mean": _mean("t_t", "t_n"),
    "packet_length_std": f"sqrt({_var('t_n', 't_t', 't_q')})",
    "packet_length_variance": _var("t_n", "t_t", "t_q"),
    **{f"{n}_flag_count": f"{n}_flag_count"
       for n in ("fin", "syn", "rst", "psh", "ack", "urg", "ece")},
    "down_up_ratio": "CAST(b_t AS DOUBLE) / CAST(greatest(f_t, 1) AS DOUBLE)",
    "avg_packet_size": _mean("t_t", "t_n"),
    "avg_fwd_segment_size": _mean("f_t", "f_n"), "avg_bwd_segment_size": _mean("b_t", "b_n"),
    "fwd_header_length2": "f_n * hdr",
    "subflow_fwd_packets": "f_n", "subflow_fwd_bytes": "f_t",
    "subflow_bwd_packets": "b_n", "subflow_bwd_bytes": "b_t",
    "init_win_bytes_forward": "win", "init_win_bytes_backward": "win",
    "act_data_pkt_forward": "f_n", "min_seg_size_forward": "coalesce(f_min, 0)",
    "active_mean": "duration", "active_std": "0e0", "active_max": "duration",
    "active_min": "duration",
    "idle_mean": "0e0", "idle_std": "0e0", "idle_max": "0e0", "idle_min": "0e0",
    "payload_entropy_mean": "ent / 1e6 / packet_count",
}


def feature(name: str, rounded: bool = True) -> str:
    kind = "BIGINT" if name in INTEGER_FEATURES else "DOUBLE"
    out = f"CAST({FEATURE_SQL[name]} AS {kind})"
    return rnd(out, 6) if rounded and name in ROUNDED else out


def features(mode: str, rounded: bool = True) -> str:
    cols = ", ".join(f"{feature(n, rounded)} AS {n}" for n in FEATURE_NAMES)
    return f"""{feature_ctes(mode)},
ft AS (SELECT {KEY}, flow_no, timestamp, packet_count, total_bytes, {cols} FROM fb)"""


_LONG = f"""lg AS (UNPIVOT (SELECT {KEY}, flow_no, {", ".join(
    f"CAST({n} AS DOUBLE) AS {n}" for n in FEATURE_NAMES)} FROM ft)
  ON {", ".join(FEATURE_NAMES)} INTO NAME feature VALUE value)"""
_GROUP_CASE = "CASE " + " ".join(
    f"WHEN regexp_matches(feature, '{p}') THEN {text(g)}" for g, p in FEATURE_GROUPS) \
    + f" ELSE {text(FEATURE_GROUP_DEFAULT)} END"
_POS_CASE = "CASE feature " + " ".join(
    f"WHEN '{n}' THEN {i}" for i, n in enumerate(FEATURE_NAMES)) + " END"

BUSY = f"""{features("whole", rounded=False)},
bf AS (SELECT {KEY}, syn_flag_count * 8 AS syn, ack_flag_count AS ack,
  flow_packets_per_sec * 20000 AS pps, payload_entropy_mean * 1.9e0 AS ent,
  CAST(total_fwd_bytes % 21 AS DOUBLE) AS dur_ratio, total_fwd_packets AS fwd,
  flow_duration / 450 AS dur FROM ft),
bi AS (SELECT *, [x FOR x IN [
  CASE WHEN syn > 50 AND ack < syn * 0.5e0 THEN 'SYN_FLOOD_PATTERN' END,
  CASE WHEN pps > 1000 THEN 'HIGH_PACKET_RATE' END,
  CASE WHEN ent > 7.5e0 THEN 'HIGH_ENTROPY_PAYLOAD' END,
  CASE WHEN dur_ratio > 10 THEN 'ASYMMETRIC_FLOW' END,
  CASE WHEN fwd > 10 AND dur < 1 THEN 'PORT_SCAN_PATTERN' END] IF x IS NOT NULL] AS ind
  FROM bf)"""
APP = ("CASE WHEN 80 IN (dst_port, src_port) THEN 'HTTP' WHEN 443 IN (dst_port, src_port) THEN"
       " 'HTTPS' WHEN 53 IN (dst_port, src_port) THEN 'DNS' WHEN 22 IN (dst_port, src_port) THEN"
       " 'SSH' WHEN 21 IN (dst_port, src_port) THEN 'FTP' WHEN 25 IN (dst_port, src_port) THEN"
       " 'SMTP' ELSE 'UNKNOWN' END")
_LABEL_CASE = "CASE x " + " ".join(
    f"WHEN {text(k)} THEN {text(v)}" for k, v in INDICATOR_LABELS.items()) + " END"


def entropy(source: str, key: str, column: str) -> str:
    """Count hex pairs per row; works on the UTF-8 bytes."""
    return f"""WITH b AS (SELECT {key}, unnest(regexp_extract_all(hex(encode({column})), '..')) AS byte
      FROM {source}),
g AS (SELECT {key}, byte, count(*) AS k FROM b GROUP BY {key}, byte),
n AS (SELECT *, sum(k) OVER (PARTITION BY {key}) AS n FROM g),
e AS (SELECT {key}, -sum((k / n) * log2(k / n)) AS x FROM n GROUP BY {key})
SELECT s.{key}, coalesce({rnd("x", 2)}, 0e0) AS entropy
FROM {source} s LEFT JOIN e ON s.{key} = e.{key}"""


# --- Layer 2 ------------------------------------------------------------------------------------------
def greedy(name: str, source: str, keys: str, pos: str, gap: int) -> str:
    """Recursive firing: the first candidate, then each next one at least ``gap`` further on."""
    on = " AND ".join(f"c.{k} = f.{k}" for k in keys.split(", "))
    fk = ", ".join(f"f.{k}" for k in keys.split(", "))
    return f"""{name} AS (
  SELECT {keys}, min({pos}) AS {pos} FROM {source} GROUP BY {keys}
  UNION ALL
  SELECT {fk}, min(c.{pos}) FROM {name} f JOIN {source} c ON {on} AND c.{pos} >= f.{pos} + {gap}
  GROUP BY {fk}, f.{pos})"""


FLOOD = f"""{L2},
mv AS (SELECT *, row_number() OVER (PARTITION BY segment, src_mac ORDER BY ts_us, seq) AS nth,
         count(DISTINCT src_mac) OVER (PARTITION BY segment ORDER BY ts_us
           RANGE BETWEEN 10000000 PRECEDING AND CURRENT ROW) AS macs
       FROM ev WHERE type IN ('ARP', 'CDP')),
mc AS MATERIALIZED (SELECT * FROM mv WHERE nth = 1 AND macs >= 40),
{greedy("mf", "mc", "segment", "ts_us", 10_000_000)},
flood AS MATERIALIZED (SELECT mc.* FROM mc JOIN mf USING (segment, ts_us)),
q AS MATERIALIZED (SELECT * FROM ev WHERE seq NOT IN (SELECT seq FROM flood))"""

STP = f"""{L2},
st AS (SELECT *, min(root_id) OVER (PARTITION BY segment ORDER BY ts_us, seq
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM ev WHERE type = 'STP'),
hij AS (SELECT * FROM st WHERE root_id < prev),
tc AS (SELECT *, count(*) OVER (PARTITION BY segment ORDER BY ts_us RANGE BETWEEN 10000000
         PRECEDING AND CURRENT ROW) AS n FROM ev WHERE type = 'STP' AND topology_change)"""

CDP = f"""{FLOOD},
cn AS (SELECT *, row_number() OVER w AS rn, ts_us - lag(ts_us, 19) OVER w AS span
       FROM q WHERE type = 'CDP' WINDOW w AS (PARTITION BY segment, src_mac ORDER BY ts_us, seq)),
cg AS MATERIALIZED (SELECT * FROM cn WHERE span <= 10000000),
{greedy("cf", "cg", "segment, src_mac", "rn", 20)},
cdp AS (SELECT cg.* FROM cg JOIN cf USING (segment, src_mac, rn))"""

DTP = f"""{L2}, dt AS MATERIALIZED (SELECT * FROM ev WHERE type = 'DTP'),
{greedy("df", "dt", "segment, src_mac", "ts_us", 30_000_000)},
dtp AS (SELECT dt.* FROM dt JOIN df USING (segment, src_mac, ts_us))"""

ARP = f"""{FLOOD},
ar AS (SELECT *, src_mac AS mac, lag(src_mac) OVER (PARTITION BY segment, src_ip
         ORDER BY ts_us, seq) AS prev FROM q WHERE type = 'ARP' AND op = 'reply')"""

VTP = f"""{L2},
vt AS (SELECT *, lag(revision) OVER (PARTITION BY segment ORDER BY ts_us, seq) AS prev
       FROM ev WHERE type = 'VTP' AND revision IS NOT NULL)"""


def record(category: str, values: dict[str, str], details: str = "") -> str:
    fixed = L2_ALERTS[category]
    parts = re.split(r"\{(\w+)\}", fixed["description"])
    desc = " || ".join(
        f"coalesce(CAST({values.get(p, p)} AS STRING), 'None')" if i % 2 else text(p)
        for i, p in enumerate(parts) if p)
    sev = fixed["severity"]
    band = "HIGH RISK / ATTACK" if sev >= 75 else "MEDIUM RISK"
    return f"""ts_us, seq, segment, timestamp, {text(category)} AS category,
  {text(fixed["title"])} AS attack_type, CAST({sev} AS DOUBLE) AS threat_score,
  {text(band)} AS risk_level, src_mac, dst_mac, src_ip, dst_ip,
  {text(fixed["action"])} AS recommended_action, {desc} AS description{details}"""


RULES = {
    "ARP_SPOOFING": (ARP, {"ip": "src_ip", "previous_mac": "prev", "new_mac": "mac"},
                     ", src_ip AS ip, prev AS previous_mac, mac AS new_mac",
                     "ar WHERE prev <> mac"),
    "MAC_FLOODING": (FLOOD, {"distinct_macs_in_window": "macs", "window_seconds": "10"},
                     ", macs AS distinct_macs_in_window", "flood"),
    "STP_ROOT_HIJACK": (STP, {"claimed_root_id": "root_id", "previous_root_id": "prev"},
                        ", root_id AS claimed_root_id, prev AS previous_root_id", "hij"),
    "STP_TC_FLOOD": (STP, {"tc_count_in_window": "n", "window_seconds": "10"},
                     ", n AS tc_count_in_window",
                     "tc WHERE n >= 5 AND seq NOT IN (SELECT seq FROM hij)"),
    "CDP_FLOOD": (CDP, {}, "", "cdp"),
    "DTP_SWITCH_SPOOFING": (DTP, {}, "", "dtp"),
    "VTP_ATTACK": (VTP, {"previous_revision": "prev", "new_revision": "revision"},
                   ", prev AS previous_revision, revision AS new_revision",
                   "vt WHERE revision > prev + 50"),
    "VLAN_DOUBLE_TAGGING": (L2, {}, ", outer_vlan, inner_vlan",
                            "ev WHERE type = 'VLAN_DOUBLE_TAG'"),
}


def rule(category: str) -> str:
    ctes, values, details, source = RULES[category]
    return f"WITH RECURSIVE {ctes} SELECT {record(category, values, details)} FROM {source}"


_RULE_CTES = CDP + ARP.removeprefix(FLOOD) + "".join(
    c.removeprefix(L2).removeprefix(FLOOD) for c in (STP, DTP, VTP))


def _all_rules() -> str:
    return f"WITH RECURSIVE {_RULE_CTES} " + " UNION ALL ".join(
        f"SELECT {record(c, v)} FROM {s}" for c, (_, v, _, s) in RULES.items())


ALERT = ("timestamp, src_ip, dst_ip, attack_type, threat_score, recommended_action, layer,"
         " category, src_mac, dst_mac, risk_level")
_L3 = """SELECT timestamp, src_ip, dst_ip, attack_type, threat_score, recommended_action,
  'L3' AS layer, CAST(NULL AS STRING) AS category, CAST(NULL AS STRING) AS src_mac,
  CAST(NULL AS STRING) AS dst_mac, risk_level FROM sc WHERE threat_score >= 75"""


def _l2_alert(category: str) -> str:
    _, values, _, source = RULES[category]
    return f"""SELECT {ALERT.replace("layer", "'L2' AS layer")}
  FROM (SELECT {record(category, values)} FROM {source})"""


ALERTS = f"""RECURSIVE {SCORED}, {_RULE_CTES},
al AS ({" UNION ALL ".join([_L3, *map(_l2_alert, RULES)])})"""

RATES = """
rr AS (SELECT ts_us, length AS b FROM p UNION ALL SELECT ts_us, 0 FROM ev),
rs AS (SELECT ts_us - ts_us % 1000000 AS second_us, count(*) AS packets_per_sec,
         CAST(sum(b) AS BIGINT) AS bytes_per_sec FROM rr GROUP BY 1),
rt AS (SELECT *, CAST(sum(packets_per_sec) OVER (ORDER BY second_us) AS BIGINT) AS total_packets,
         CAST(sum(bytes_per_sec) OVER (ORDER BY second_us) AS BIGINT) AS total_bytes FROM rs)"""


def series(seconds: int) -> str:
    return f"""{SCORED},
ts AS (SELECT strftime(make_timestamp(last_us), '%Y-%m-%d %H:%M') AS minute,
         count(*) AS flow_count, CAST(sum(total_bytes) AS BIGINT) AS byte_count,
         avg(threat_score) AS avg_threat FROM sc WHERE timestamp > {NOW} - {seconds} GROUP BY 1)"""


_SOURCES = """SELECT src_ip AS ip, CAST(sum(total_bytes) AS BIGINT) AS bytes,
  CAST(sum(packet_count) AS BIGINT) AS packets, count(*) AS flows FROM sc"""
NEWEST = f"ORDER BY timestamp DESC, {KEY_DESC}"

PROBS = ", ".join(f"CAST((total_bytes * {i + 1}) % 13 + 1 AS DOUBLE)"
                  for i in range(len(ATTACK_CLASSES)))
_CLASS_LIST = "[" + ", ".join(text(c) for c in ATTACK_CLASSES) + "]"
BAND = "CASE WHEN threat_score >= 75 THEN {} WHEN threat_score >= 45 THEN {} WHEN" \
       " threat_score >= 20 THEN {} ELSE {} END"


def band(*labels: str) -> str:
    return BAND.format(*[text(x) for x in labels])


def _spread() -> str:
    cols = [f"CAST({n} AS DOUBLE)" for n in FEATURE_NAMES]
    mean = "(" + " + ".join(cols) + ") / 55"
    return mean, "(" + " + ".join(f"({c} - m) * ({c} - m)" for c in cols) + ") / 55"


_MEAN, _VAR = _spread()


def seq_score(var: str, part: str, order: str) -> str:
    w = f"({part} ORDER BY {order} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    score = f"least(1e0, avg({var}) OVER {w} * 10e0)"
    return (f"CASE WHEN row_number() OVER ({part} ORDER BY {order}) = 1 THEN 0e0 ELSE "
            f"{rnd(score, 6)} END")


UNITS = """n < 1024 THEN CAST(n AS STRING) || ' B'
  WHEN n < 1048576 THEN {kb} || ' KB' WHEN n < 1073741824 THEN {mb} || ' MB' ELSE {gb} || ' GB'"""


def _one_decimal(div: int, trim: bool) -> str:
    out = f"CAST(CAST(round(CAST(n AS DECIMAL(30,8)) / {div}, 1) AS DECIMAL(30,1)) AS STRING)"
    return f"regexp_replace({out}, '\\.0$', '')" if trim else out


REPORT = """
rp AS (SELECT attack_type AS label, CASE WHEN packet_count % 3 = 0 THEN 'DoS' ELSE attack_type END
         AS prediction FROM si),
ra AS (SELECT label AS class, count(*) AS support, count(*) FILTER (WHERE label = prediction)
         AS hits FROM rp GROUP BY 1),
rc AS (SELECT prediction AS class, count(*) AS claimed FROM rp GROUP BY 1),
rj AS (SELECT coalesce(ra.class, rc.class) AS class, coalesce(support, 0) AS support,
         coalesce(hits, 0) AS hits, coalesce(claimed, 0) AS claimed
       FROM ra FULL JOIN rc ON ra.class = rc.class),
rk AS (SELECT *, CASE WHEN claimed > 0 THEN hits / claimed ELSE 0e0 END AS precision,
         CASE WHEN support > 0 THEN hits / support ELSE 0e0 END AS recall FROM rj),
rm AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall
         / (precision + recall) ELSE 0e0 END AS f1 FROM rk),
ru AS (SELECT class, precision, recall, f1, support FROM rm
  UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support),
    sum(hits) / sum(support), sum(support) FROM rm
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM rm
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
    sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM rm)"""

_RANKED = f"""
sr AS (SELECT *, row_number() OVER (PARTITION BY {KEY}, flow_no ORDER BY ts_us, packet_id) AS rn,
         count(*) OVER (PARTITION BY {KEY}, flow_no) AS flow_packets FROM p0)"""
_SAMPLE = f"""{PACKETS}, {_GROUP["tumbling"]},{_RANKED}"""
_GREEDY_ALL = greedy("gf", "gc", "type", "ts_us", 7_000_000)

ORACLES: dict[str, str] = {
    "packet_scan": f"WITH {PACKETS} SELECT * FROM p WHERE protocol IN ('TCP', 'UDP', 'ICMP')",
    "l2_event_scan": f"""WITH {L2} SELECT seq, ts_us, timestamp, segment, type, src_mac, dst_mac, op,
  src_ip, root_id, topology_change, revision, outer_vlan, inner_vlan FROM ev""",
    "ensure_columns": f"""WITH {PACKETS} SELECT packet_id, protocol, 'L3' AS layer,
  CAST(NULL AS BIGINT) AS flow_id FROM p""",
    "parse_props_json": """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k
FROM events""",
    **{f"flows_{m}": f"WITH {flows(m)} SELECT {FLOW_COLS} FROM f"
       for m in ("whole", "tumbling", "session")},
    "flows_bidirectional": f"""WITH {feature_ctes("tumbling", True)} SELECT {FLOW_COLS}, {", ".join(
        f"{feature(n)} AS {n}" for n in FEATURE_NAMES)} FROM fb""",
    "flow_packet_sample": f"""WITH {_SAMPLE} SELECT {KEY}, flow_no, flow_packets,
  flow_packets > 15 AS packets_sample_truncated, CAST(rn - 1 AS INT) AS pos, packet_id, length
FROM sr WHERE flow_packets >= 2 AND rn <= 15""",
    "live_feed": f"""WITH {flows("tumbling")},{_RANKED} SELECT {FLOW_COLS},
  packet_count > 15 AS packets_sample_truncated, CAST(rn - 1 AS INT) AS pos, packet_id
FROM f JOIN (SELECT {KEY}, flow_no, rn, packet_id FROM sr WHERE rn <= 15) USING ({KEY}, flow_no)""",
    "flow_iat": f"""WITH {PACKETS} SELECT packet_id, {KEY}, ts_us, ts_us - lag(ts_us) OVER
  (PARTITION BY {KEY} ORDER BY ts_us, packet_id) AS gap_us FROM p""",
    "flow_packet_link": f"""WITH {PACKETS}, {_GROUP["session"]},
c AS (SELECT *, count(*) OVER (PARTITION BY {KEY}, flow_no) AS flow_packets FROM p0)
SELECT packet_id, {KEY}, flow_no, flow_packets FROM c WHERE flow_packets >= 2""",
    "flow_retention": f"""WITH {SCORED} SELECT {FLOW_COLS}, threat_score FROM sc
{NEWEST} LIMIT 1000""",
    "flow_features": f"WITH {features('tumbling')} SELECT * EXCLUDE (timestamp, packet_count,"
                     " total_bytes) FROM ft",
    "flow_features_whole": f"WITH {features('whole')} SELECT * EXCLUDE (timestamp, packet_count,"
                           " total_bytes, flow_no) FROM ft",
    "flow_features_session": f"WITH {features('session')} SELECT * EXCLUDE (timestamp,"
                             " packet_count, total_bytes) FROM ft",
    "flow_feature_array": f"""WITH {features("session", False)}, {_LONG}
SELECT {KEY}, flow_no, {_POS_CASE} AS pos, {rnd("value", 4)} AS value FROM lg""",
    "flow_features_long": f"""WITH {features("session", False)}, {_LONG}
SELECT {KEY}, flow_no, feature, {rnd("value", 4)} AS value, {_GROUP_CASE} AS feature_group
FROM lg""",
    "payload_entropy": entropy("events", "event_id", "props"),
    "document_entropy": entropy("documents", "doc_id", "text"),
    "app_protocol": f"WITH {PACKETS} SELECT packet_id, src_port, dst_port, {APP} AS"
                    " application_protocol FROM p",
    "anomaly_indicators": f"""WITH {BUSY} SELECT {KEY},
  coalesce(array_to_string(ind, ','), '') AS indicators FROM bi""",
    "indicator_display": f"""WITH {BUSY} SELECT {KEY}, coalesce(array_to_string(list_concat(
  [{_LABEL_CASE} FOR x IN ind[1:2]], CASE WHEN len(ind) > 2 THEN
  ['+' || CAST(len(ind) - 2 AS STRING)] ELSE CAST([] AS VARCHAR[]) END), '|'), '') AS shown
FROM bi""",
    "inspection_record": f"""WITH {BUSY} SELECT {KEY}, {APP} AS application_protocol,
  CAST(NULL AS STRING) AS http_host, CAST(NULL AS STRING) AS tls_sni,
  CAST(len(ind) AS INT) AS indicator_count FROM bi""",
    "anomaly_clamp": f"""WITH {flows("tumbling")},
d AS (SELECT *, (total_bytes % 300 - 150) / 100e0 AS decision FROM f)
SELECT {KEY}, flow_no, decision, {rnd("greatest(0e0, least(1e0, 1 - (decision + 0.5e0)))", 6)}
  AS anomaly_score FROM d""",
    "classify_from_probs": f"""WITH {flows("tumbling")},
w AS (SELECT *, [{PROBS}] AS w FROM f),
v AS (SELECT *, [x / list_sum(w) FOR x IN w] AS p FROM w),
b AS (SELECT *, list_position(p, list_max(p)) AS best FROM v)
SELECT {KEY}, flow_no, {_CLASS_LIST}[best] AS attack_type, CAST(best - 1 AS INT) AS class_index,
  list_max(p) AS confidence, p[7] AS p_bot FROM b""",
    "proba_onehot": f"""WITH {flows("tumbling")}, {STAND_IN},
pr AS (SELECT *, CASE WHEN total_bytes % 5 = 4 THEN 'Novel' ELSE attack_type END AS predicted
       FROM si),
ix AS (SELECT *, greatest(coalesce(list_position({_CLASS_LIST}, predicted), 0), 1) AS hit FROM pr)
SELECT {KEY}, flow_no, predicted, {", ".join(
    f"CASE WHEN hit = {i + 1} THEN 1e0 ELSE 0e0 END AS p{i}"
    for i in range(len(ATTACK_CLASSES)))} FROM ix""",
    "sequence_score": None,  # filled below: needs the tie order of the job
    "sequence_score_global": f"""WITH {features("tumbling", False)},
tk AS (SELECT *, concat_ws('|', {KEY}) AS k, CAST(timestamp * 1e6 AS BIGINT) AS t FROM ft),
vm AS (SELECT *, {_MEAN} AS m FROM tk), vv AS (SELECT *, {_VAR} AS v FROM vm)
SELECT {KEY}, flow_no, {seq_score("v", "", "t, k")} AS sequence_score,
  {rnd("log10(1 + v)", 6)} AS spread FROM vv""",
    "sequence_windows": f"""WITH {flows("tumbling")}, {STAND_IN},
o AS (SELECT *, row_number() OVER (ORDER BY last_us, concat_ws('|', {KEY})) - 1 AS start FROM si),
w AS (SELECT start, last_us,
  CAST(sum(CAST(packet_count AS DOUBLE) + total_bytes) OVER r AS DOUBLE) AS total,
  CAST(packet_count AS DOUBLE) AS first_value,
  CAST(last_value(total_bytes) OVER r AS DOUBLE) AS last_value,
  max(CASE WHEN attack_type <> (SELECT attack_type FROM o WHERE start = 0) THEN 1 ELSE 0 END)
    OVER r AS target,
  count(*) OVER (ORDER BY start ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING) AS n
  FROM o WINDOW r AS (ORDER BY start ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
SELECT start, last_us, target, 10 AS steps, total, first_value, last_value FROM w WHERE n = 11""",
    "threat_score": f"WITH {SCORED} SELECT {KEY}, flow_no, threat_score FROM sc",
    "risk_band": f"WITH {SCORED} SELECT {KEY}, flow_no, risk_level, recommended_action FROM sc",
    "score_breakdown": f"""WITH {SCORED} SELECT {KEY}, flow_no, {rnd("a", 4)} AS anomaly_score,
  {rnd("c", 4)} AS classification_confidence, {rnd("s", 4)} AS sequence_score,
  {rnd("a * 100", 2)} AS anomaly, {rnd("part", 2)} AS classification,
  {rnd("s * 100", 2)} AS sequence FROM sc""",
    "feature_scaling_stats": f"""WITH {features("tumbling", False)}, {_LONG}
SELECT feature, {rnd("avg(value)", 3)} AS mean, {rnd("stddev_pop(value)", 3)} AS std
FROM lg GROUP BY feature""",
    "label_index": f"""WITH {flows("tumbling")}, {STAND_IN}
SELECT {KEY}, flow_no, attack_type AS label,
  CAST(dense_rank() OVER (ORDER BY attack_type) - 1 AS INT) AS label_index FROM si""",
    "class_weights": f"""WITH {flows("tumbling")}, {STAND_IN},
k AS (SELECT attack_type, count(*) AS class_count FROM si GROUP BY 1)
SELECT attack_type, class_count, CAST((SELECT sum(class_count) FROM k) AS DOUBLE)
  / CAST((SELECT count(*) FROM k) * class_count AS DOUBLE) AS weight FROM k""",
    "classification_report": f"""WITH {flows("tumbling")}, {STAND_IN}, {REPORT}
SELECT class, CAST(support AS BIGINT) AS support, {rnd("precision", 6)} AS precision,
  {rnd("recall", 6)} AS recall, {rnd("f1", 6)} AS f1 FROM ru""",
    "stratified_split": f"""WITH {flows("tumbling")}, {STAND_IN},
k AS (SELECT attack_type, count(*) AS n FROM si GROUP BY 1)
SELECT attack_type, CAST(floor(n * 0.8e0 + 0.5e0) AS BIGINT) AS train_rows,
  n - CAST(floor(n * 0.8e0 + 0.5e0) AS BIGINT) AS test_rows FROM k""",
    "l3_alerts": f"WITH {SCORED} {_L3}",
    "alerts_union": f"WITH {ALERTS} SELECT {ALERT}, FALSE AS acknowledged FROM al",
    "severity_band": f"""WITH {SCORED} SELECT {KEY}, flow_no,
  {band("HIGH RISK / ATTACK", "MEDIUM RISK", "LOW RISK", "BENIGN")} AS risk,
  {band("HIGH RISK", "MEDIUM RISK", "LOW RISK", "BENIGN")} AS gauge,
  {band("CRITICAL", "MEDIUM", "LOW", "BENIGN")} AS feed FROM sc""",
    "alert_count": f"WITH {ALERTS} SELECT count(*) AS alerts FROM al",
    "l2_arp_spoof": rule("ARP_SPOOFING"),
    "l2_mac_flood": rule("MAC_FLOODING"),
    "l2_stp_root": rule("STP_ROOT_HIJACK"),
    "l2_stp_tc_flood": rule("STP_TC_FLOOD"),
    "l2_cdp_flood": rule("CDP_FLOOD"),
    "l2_dtp": rule("DTP_SWITCH_SPOOFING"),
    "l2_vtp": rule("VTP_ATTACK"),
    "l2_vlan_hop": rule("VLAN_DOUBLE_TAGGING"),
    "l2_all_alerts": _all_rules(),
    "l2_status": f"""WITH RECURSIVE {FLOOD} SELECT segment,
  (SELECT count(DISTINCT src_ip) FROM q WHERE type = 'ARP' AND op = 'reply') AS arp_table_size,
  (SELECT count(DISTINCT src_mac) FROM ev WHERE type IN ('ARP', 'CDP')) AS known_mac_count,
  (SELECT min(root_id) FROM ev) AS stp_root_id,
  (SELECT src_mac FROM ev WHERE root_id IS NOT NULL ORDER BY root_id, ts_us, seq LIMIT 1)
    AS stp_root_mac,
  (SELECT revision FROM ev WHERE revision IS NOT NULL ORDER BY ts_us DESC, seq DESC LIMIT 1)
    AS vtp_last_revision FROM (SELECT DISTINCT segment FROM ev)""",
    "cooldown": f"""WITH RECURSIVE {L2}, gc AS MATERIALIZED (SELECT type, ts_us, seq FROM ev),
{_GREEDY_ALL} SELECT gc.type, gc.ts_us, gc.seq FROM gc JOIN gf USING (type, ts_us)""",
    "rolling_distinct": f"""WITH {L2} SELECT segment, ts_us, seq, src_ip,
  count(DISTINCT src_ip) OVER (PARTITION BY segment ORDER BY ts_us RANGE BETWEEN 10000000
  PRECEDING AND CURRENT ROW) AS distinct_ips FROM ev WHERE type = 'ARP'""",
    "rolling_count": f"""WITH {L2} SELECT type, ts_us, seq, count(*) OVER (PARTITION BY type
  ORDER BY ts_us RANGE BETWEEN 10000000 PRECEDING AND CURRENT ROW) AS in_window FROM ev""",
    "reset_on_fire": f"""WITH RECURSIVE {L2},
rn0 AS (SELECT segment, ts_us, seq, row_number() OVER w AS rn, ts_us - lag(ts_us, 19) OVER w
  AS span FROM ev WHERE type = 'CDP' WINDOW w AS (PARTITION BY segment ORDER BY ts_us, seq)),
rg AS MATERIALIZED (SELECT * FROM rn0 WHERE span <= 10000000),
{greedy("rf", "rg", "segment", "rn", 20)}
SELECT rg.segment, rg.ts_us, rg.seq FROM rg JOIN rf USING (segment, rn)""",
    "running_min_break": f"""WITH {STP} SELECT segment, ts_us, seq, root_id, prev AS previous
FROM hij""",
    "first_seen": f"""WITH {L2}, n AS (SELECT *, row_number() OVER (PARTITION BY segment, src_mac
  ORDER BY ts_us, seq) AS nth FROM ev) SELECT segment, src_mac, ts_us, seq, type FROM n
WHERE nth = 1""",
    "recent_flows": f"""WITH {SCORED} SELECT {SCORED_COLS} FROM sc WHERE src_ip ILIKE '%168.100.1%'
  AND dst_ip ILIKE '%10.0%' AND protocol = 'TCP' AND risk_level = 'LOW RISK'
  AND timestamp >= {NOW - 400} AND timestamp <= {NOW} {NEWEST} LIMIT 500 OFFSET 10""",
    "flow_detail": f"""WITH {SCORED} SELECT {", ".join("sc." + c for c in SCORED_COLS.split(", "))},
  packet_id, p0.ts_us AS packet_ts_us, length AS packet_length, flags AS packet_flags
FROM sc LEFT JOIN p0 USING ({KEY}, flow_no) WHERE src_ip = '192.168.100.10'
  AND dst_ip = '10.0.0.1' AND dst_port = 53 AND src_port = 40000
  AND flow_no = 1704067200000000""",
    "recent_packets": f"""WITH {PACKETS} SELECT * FROM p WHERE src_ip ILIKE '%192.168%'
  AND dst_ip ILIKE '%10.0.0.1%' AND protocol = 'TCP'
ORDER BY timestamp DESC, packet_id DESC LIMIT 2000 OFFSET 5""",
    "recent_alerts": f"""WITH {ALERTS} SELECT {ALERT} FROM al WHERE layer = 'L3'
ORDER BY timestamp DESC, src_ip DESC, dst_ip DESC, threat_score DESC LIMIT 200""",
    "store_counts": f"""WITH {ALERTS} SELECT 'flows' AS table_name, count(*) AS rows FROM sc
UNION ALL SELECT 'alerts', count(*) FROM al UNION ALL SELECT 'packets', count(*) FROM p""",
    "avg_threat": f"""WITH {SCORED} SELECT {rnd("coalesce(avg(threat_score), 0)", 2)}
  AS avg_threat_score FROM sc""",
    "attack_distribution": f"""WITH {SCORED} SELECT attack_type, count(*) AS count FROM sc
WHERE attack_type <> 'BENIGN' GROUP BY 1""",
    "protocol_distribution": f"""WITH {SCORED} SELECT protocol, count(*) AS count FROM sc
GROUP BY 1""",
    "recent_hour_counts": f"""WITH {ALERTS} SELECT 'flows' AS table_name, count(*) AS recent FROM sc
WHERE timestamp > {NOW + 3500} - 3600 UNION ALL SELECT 'alerts', count(*) FROM al
WHERE timestamp > {NOW + 3500} - 3600""",
    "traffic_timeseries": f"""WITH {series(120)} SELECT minute, flow_count, byte_count,
  {rnd("avg_threat", 6)} AS avg_threat FROM ts""",
    "top_sources": f"""WITH {SCORED} {_SOURCES} WHERE timestamp > {NOW} - 120
GROUP BY 1 ORDER BY bytes DESC, ip LIMIT 8""",
    "top_ports": f"""WITH {SCORED} SELECT dst_port AS port, protocol, count(*) AS flows,
  CAST(sum(total_bytes) AS BIGINT) AS bytes FROM sc WHERE timestamp > {NOW} - 120
GROUP BY 1, 2 ORDER BY flows DESC, port, protocol LIMIT 8""",
    "rollup_timeseries": f"""WITH {series(103)} SELECT minute, flow_count, byte_count,
  {rnd("avg_threat", 6)} AS avg_threat FROM ts""",
    "rollup_top_sources": f"""WITH {SCORED} {_SOURCES} WHERE timestamp > {NOW} - 103
GROUP BY 1 ORDER BY bytes DESC, ip LIMIT 8""",
    "rollup_top_ports": f"""WITH {SCORED} SELECT dst_port AS port, protocol, count(*) AS flows,
  CAST(sum(total_bytes) AS BIGINT) AS bytes FROM sc WHERE timestamp > {NOW} - 103
GROUP BY 1, 2 ORDER BY flows DESC, port, protocol LIMIT 8""",
    "rollup_store_counts": f"""WITH {ALERTS} SELECT 'flows' AS table_name, count(*) AS rows FROM sc
UNION ALL SELECT 'alerts', count(*) FROM al UNION ALL SELECT 'packets', count(*) FROM p""",
    "avg_threat_last100": f"""WITH {SCORED}, n AS (SELECT * FROM sc {NEWEST} LIMIT 100)
SELECT {rnd("coalesce(avg(threat_score), 0)", 2)} AS avg_threat_score FROM n""",
    "traffic_rates": f"WITH {PACKETS}, {L2}, {RATES} SELECT * FROM rt",
    "flows_page": f"WITH {SCORED} SELECT {SCORED_COLS} FROM sc {NEWEST} LIMIT 20 OFFSET 40",
    "store_stats": f"""WITH {ALERTS}
SELECT 'total_flows' AS name, CAST(count(*) AS DOUBLE) AS value FROM sc
UNION ALL SELECT 'total_alerts', CAST(count(*) AS DOUBLE) FROM al
UNION ALL SELECT 'total_packets', CAST(count(*) AS DOUBLE) FROM p
UNION ALL SELECT 'recent_flows', CAST(count(*) AS DOUBLE) FROM sc WHERE timestamp > {NOW} - 3600
UNION ALL SELECT 'recent_alerts', CAST(count(*) AS DOUBLE) FROM al WHERE timestamp > {NOW} - 3600
UNION ALL SELECT 'avg_threat_score', {rnd("coalesce(avg(threat_score), 0)", 2)} FROM sc""",
    "threat_trend": f"""WITH {series(120)} SELECT minute, CASE WHEN avg_threat > 50
  THEN 'Elevated' ELSE 'Baseline' END AS trend FROM ts""",
    "alerts_by_band": f"""WITH {SCORED} SELECT {KEY}, flow_no, threat_score FROM sc
WHERE threat_score >= 45 AND threat_score < 75""",
    "talker_share": f"""WITH {SCORED}, t AS ({_SOURCES} GROUP BY 1 ORDER BY bytes DESC, ip LIMIT 8)
SELECT *, {rnd("bytes / greatest((SELECT max(bytes) FROM t), 1) * 100", 6)} AS share FROM t""",
    "rate_last60": f"""WITH {PACKETS}, rs AS (SELECT ts_us - ts_us % 1000000 AS second_us,
  count(*) AS packets_per_sec, CAST(sum(length) AS BIGINT) AS bytes_per_sec FROM p GROUP BY 1)
SELECT *, CAST(sum(packets_per_sec) OVER (ORDER BY second_us) AS BIGINT) AS total_packets,
  CAST(sum(bytes_per_sec) OVER (ORDER BY second_us) AS BIGINT) AS total_bytes FROM rs
ORDER BY second_us DESC LIMIT 60""",
    "packet_stream": f"""WITH {PACKETS} SELECT * EXCLUDE (payload_entropy),
  payload_entropy * 1.2e0 AS payload_entropy, payload_entropy * 1.2e0 > 7 AS high_entropy
FROM p WHERE protocol = 'TCP' ORDER BY timestamp DESC, packet_id DESC LIMIT 150""",
    "human_bytes": f"""WITH {flows("whole")},
h AS (SELECT {KEY}, total_bytes * total_bytes * packet_count AS n FROM f)
SELECT *, CASE WHEN {UNITS.format(kb=_one_decimal(1024, True), mb=_one_decimal(1048576, True),
                                  gb=_one_decimal(1073741824, True))} END AS bytes_text,
  CASE WHEN n >= 1000000000 THEN {_one_decimal(10**9, False)} || 'B'
       WHEN n >= 1000000 THEN {_one_decimal(10**6, False)} || 'M'
       WHEN n >= 1000 THEN {_one_decimal(10**3, False)} || 'K'
       ELSE CAST(n AS STRING) END AS number_text FROM h""",
    "packet_direction": f"""WITH {flows("whole")} SELECT {KEY},
  CASE WHEN src_ip <= dst_ip THEN packet_count ELSE 0 END AS fwd_packets FROM f""",
    "packet_direction_pairs": f"""WITH {PACKETS} SELECT packet_id, CASE WHEN src_ip LIKE '192.%'
  THEN 'fwd' ELSE 'bwd' END AS direction FROM p""",
    "feature_labels": f"""WITH {features("whole", False)}, {_LONG}
SELECT feature, {_GROUP_CASE} AS feature_group, count(*) AS flows,
  array_to_string([upper(x[1]) || x[2:] FOR x IN string_split(feature, '_')], ' ')
  AS label FROM lg GROUP BY feature""",
    "scan_fanout": f"""WITH {PACKETS} SELECT src_ip, dst_ip, ts_us - ts_us % 60000000 AS window_us,
  count(DISTINCT dst_port) AS ports FROM p GROUP BY 1, 2, 3 HAVING ports >= 2""",
    "flood_by_target": f"""WITH {PACKETS} SELECT dst_ip, dst_port, ts_us - ts_us % 60000000
  AS window_us, count(*) FILTER (WHERE contains(flags, 'S')) AS syn_count FROM p
GROUP BY 1, 2, 3 HAVING syn_count >= 2""",
}
ORACLES["sequence_score"] = f"""WITH {flows("tumbling")},
v AS (SELECT *, (total_bytes % 23) / 160e0 AS variance FROM f)
SELECT {KEY}, flow_no, {seq_score("variance", "PARTITION BY src_ip", f"last_us, {KEY}")}
  AS sequence_score FROM v"""
