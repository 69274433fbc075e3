"""Packet and Layer-2 traces derived from the generic ``events`` table (fixture adapters)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k"
_TS = "1704067200000000 + event_id * 50000 + (event_id * 7919) % 50000 AS ts_us"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def packets_from_events(df: DataFrame) -> DataFrame:
    """One packet per event; a map-only projection, so pruning and pushdown pass through."""
    base = df.selectExpr(
        "event_id", "value", _K, _TS,
        "'192.168.100.' || CAST(10 + user_id % 6 AS STRING) AS a",
        "CASE event_type WHEN 'signup' THEN 'UDP' WHEN 'purchase' THEN 'ICMP' ELSE 'TCP' END"
        " AS protocol",
        "CASE event_type WHEN 'click' THEN 80 WHEN 'view' THEN 443 WHEN 'error' THEN 22"
        " WHEN 'signup' THEN 53 ELSE 0 END AS dp",
        "CASE WHEN event_type = 'purchase' THEN 0 ELSE 40000 + user_id % 3 END AS sp")
    base = base.withColumn("z", F.expr("'10.0.0.' || CAST(k % 3 AS STRING)"))
    return base.selectExpr(
        "event_id AS packet_id", "ts_us", "ts_us / 1e6 AS timestamp",
        "CASE WHEN k % 4 = 3 THEN z ELSE a END AS src_ip",
        "CASE WHEN k % 4 = 3 THEN a ELSE z END AS dst_ip",
        "CAST(CASE WHEN k % 4 = 3 THEN dp ELSE sp END AS INT) AS src_port",
        "CAST(CASE WHEN k % 4 = 3 THEN sp ELSE dp END AS INT) AS dst_port",
        "protocol",
        "CAST(40 + least(floor(value * 6), 1460) AS INT) AS length",
        "CASE WHEN protocol <> 'TCP' THEN '' WHEN k % 5 = 0 THEN 'S' WHEN k % 5 = 1 THEN 'SA'"
        " WHEN k % 5 = 2 THEN 'PA' WHEN k % 5 = 3 THEN 'FA' ELSE 'R' END AS flags",
        "k * 0.08e0 AS payload_entropy")


def l2_events_from_events(df: DataFrame) -> DataFrame:
    """One Layer-2 event per row of ``events``, in the full wide schema."""
    base = df.selectExpr(
        "event_id", _K, _TS,
        "(event_id * 37) % 97 AS m",
        "CAST(floor(event_id / 2000) AS BIGINT) % 100 AS blk",
        "event_type")
    base = base.withColumn("type", F.expr(
        "CASE WHEN event_type IN ('click', 'view') THEN 'ARP' WHEN event_type = 'error' THEN 'CDP'"
        " WHEN event_type = 'signup' THEN 'STP' WHEN k < 40 THEN 'DTP' WHEN k < 80 THEN 'VTP'"
        " WHEN k < 90 THEN 'VLAN_DOUBLE_TAG' ELSE 'UDLD' END"))
    return base.selectExpr(
        "event_id AS seq", "ts_us", "ts_us / 1e6 AS timestamp", "'seg0' AS segment", "type",
        "'02:00:00:' || lpad(CAST(blk AS STRING), 2, '0') || ':' || lpad(CAST(CASE WHEN type ="
        " 'ARP' THEN m ELSE event_id % 2 END AS STRING), 2, '0') || ':01' AS src_mac",
        "'ff:ff:ff:ff:ff:ff' AS dst_mac",
        "CASE WHEN type = 'ARP' THEN CASE WHEN k % 2 = 0 THEN 'reply' ELSE 'request' END END AS op",
        "CASE WHEN type = 'ARP' THEN '192.168.100.' || CAST(m % 90 AS STRING) END AS src_ip",
        "CAST(NULL AS STRING) AS src_hw", "CAST(NULL AS STRING) AS dst_ip",
        "CAST(NULL AS STRING) AS dst_hw",
        "CASE WHEN type = 'STP' THEN lpad(CAST((event_id * 7919) % 9973 AS STRING), 4, '0')"
        " || '.020000000001' END AS root_id",
        "CAST(NULL AS BIGINT) AS root_cost", "CAST(NULL AS STRING) AS bridge_id",
        "CASE WHEN type = 'STP' THEN k < 15 END AS topology_change",
        "CAST(NULL AS BOOLEAN) AS topology_change_ack",
        "CASE WHEN type = 'VTP' THEN k * 2 END AS revision",
        "CASE WHEN type = 'VLAN_DOUBLE_TAG' THEN 1 END AS outer_vlan",
        "CASE WHEN type = 'VLAN_DOUBLE_TAG' THEN k END AS inner_vlan")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from_events(events(spark, sf_dir))


def l2_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l2_events_from_events(events(spark, sf_dir))
