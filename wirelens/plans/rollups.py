"""Reports from per-minute rollups instead of stored rows.

A batch of rows is reduced once to sums per minute: overall, per source, per port and protocol, per
attack type and per protocol, as grouping sets of one aggregation. All sums simply add up, so the rollups
of different batches are merged by adding, in any order, and every report is exact, top lists included.
Each batch has its own folder and replaces it when repeated. A report reads the rollup rows of its days;
where it starts within a minute, that one minute is taken from the stored rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.fixed_values import BENIGN
from wirelens.functions.numbers import round_half_up
from wirelens.operators.ordered import slot_start
from wirelens.plans.reports import _within, utc_minute
from wirelens.sources.sinks import append_table

_US = 1_000_000
_MINUTE = 60 * _US
ALL, SOURCE, PORT, ATTACK, PROTOCOL = "all", "source", "port", "attack", "protocol"
_SETS = {ALL: (), SOURCE: ("src_ip",), PORT: ("dst_port", "protocol"), ATTACK: ("attack_type",),
         PROTOCOL: ("protocol",)}
_KEYS = ("src_ip", "dst_port", "protocol", "attack_type")
_SUMS = ("rows", "bytes", "packets", "threat", "scored")
SCHEMA = ("table_name string, kind string, minute_us long, timestamp double, src_ip string, "
          "dst_port int, protocol string, attack_type string, rows long, bytes long, packets long, "
          "threat decimal(38,8), scored long")


def _shaped(df: DataFrame) -> DataFrame:
    columns = [c.split()[:2] for c in SCHEMA.replace("38,8", "38;8").split(",")]
    return df.withColumn("timestamp", F.col("minute_us") / _US).select(
        *[F.col(name).cast(kind.replace(";", ",")).alias(name) for name, kind in columns])


def roll_up_flows(flows: DataFrame) -> DataFrame:
    """Sums of scored flows per minute of their last packet, for every kind of report. Null keys are
    keys of their own; a null score is not counted as scored."""
    keyed = flows.select(slot_start("last_us", _MINUTE).alias("minute_us"), *_KEYS, "total_bytes",
                         "packet_count", F.col("threat_score").cast("decimal(20,8)").alias("score"))
    sets = ", ".join(f"({', '.join(('minute_us', *keys))})" for keys in _SETS.values())
    # bits of the columns left out tell the sets apart; nulls of the data do not
    order = ("minute_us", *_KEYS)
    codes = {sum(1 << i for i, c in enumerate(reversed(order)) if c not in ("minute_us", *keys)): kind
             for kind, keys in _SETS.items()}
    kind = " ".join(f"WHEN {code} THEN '{name}'" for code, name in codes.items())
    return _shaped(keyed.sparkSession.sql(
        f"""SELECT 'flows' AS table_name, CASE grouping_id({', '.join(order)}) {kind} END AS kind,
              {', '.join(order)}, count(1) AS rows, sum(total_bytes) AS bytes,
              sum(packet_count) AS packets, sum(score) AS threat, count(score) AS scored
            FROM {{keyed}} GROUP BY {', '.join(order)} GROUPING SETS ({sets})""", keyed=keyed))


def roll_up_rows(df: DataFrame, table_name: str) -> DataFrame:
    """Rows per minute of a table with ``timestamp``: alerts and packets."""
    minute = (F.floor(F.col("timestamp") / 60) * _MINUTE).alias("minute_us")
    return _shaped(df.groupBy(minute).agg(F.count(F.lit(1)).alias("rows")).withColumns(
        {"table_name": F.lit(table_name), "kind": F.lit(ALL),
         **{c: F.lit(None) for c in (*_KEYS, *_SUMS[1:])}}))


def roll_up(flows: DataFrame, alerts: DataFrame | None = None, packets: DataFrame | None = None
            ) -> DataFrame:
    out = roll_up_flows(flows)
    for name, df in (("alerts", alerts), ("packets", packets)):
        if df is not None:
            out = out.unionByName(roll_up_rows(df, name))
    return out


def store_rollup(rollup: DataFrame, root: str, batch_id: int) -> None:
    """The rollup of one batch; a repeated batch replaces its own."""
    append_table(rollup, f"{root}/rollup/batch={batch_id}", "overwrite")


def read_rollup(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(SCHEMA + ", batch long, dt date").parquet(f"{root}/rollup")


def _part(rollup: DataFrame, kind: str, table_name: str = "flows") -> DataFrame:
    return rollup.filter((F.col("table_name") == table_name) & (F.col("kind") == kind))


def since(rollup: DataFrame, rows: DataFrame, now: float, seconds: float, table_name: str = "flows"
          ) -> DataFrame:
    """The rollup of a table's rows strictly newer than ``seconds`` before ``now``: whole minutes from
    ``rollup``, the minute in which that time lies from the stored ``rows``."""
    start = now - seconds
    edge = math.floor(start / 60) * 60
    whole = rollup.filter((F.col("table_name") == table_name) & (F.col("timestamp") >= edge + 60))
    if "dt" in rollup.columns:  # prunes the folders of earlier days
        whole = whole.filter(F.col("dt") >= F.date_from_unix_date(F.lit((edge + 60) // 86_400)))
    part = rows.filter((F.col("timestamp") > start) & (F.col("timestamp") < edge + 60))
    part = roll_up_flows(part) if table_name == "flows" else roll_up_rows(part, table_name)
    return whole.select(*part.columns).unionByName(part)


def _mean_threat():
    return F.sum("threat").cast("double") / F.sum("scored")


def store_counts(rollup: DataFrame) -> DataFrame:
    """H5: one row per table that has rows."""
    return rollup.filter(F.col("kind") == ALL).groupBy("table_name").agg(F.sum("rows").alias("rows"))


def average_threat(rollup: DataFrame) -> DataFrame:
    """H6."""
    return _part(rollup, ALL).agg(
        round_half_up(F.coalesce(_mean_threat(), F.lit(0.0)), 2).alias("avg_threat_score"))


def attack_distribution(rollup: DataFrame) -> DataFrame:
    """H7."""
    return (_part(rollup, ATTACK).filter(F.col("attack_type") != BENIGN).groupBy("attack_type")
            .agg(F.sum("rows").alias("count")))


def protocol_distribution(rollup: DataFrame) -> DataFrame:
    """H8."""
    return _part(rollup, PROTOCOL).groupBy("protocol").agg(F.sum("rows").alias("count"))


def recent_hour_counts(rollup: DataFrame, flows: DataFrame, alerts: DataFrame, now: float) -> DataFrame:
    """H9."""
    out = None
    for name, rows in (("flows", flows), ("alerts", alerts)):
        row = _part(since(rollup, rows, now, 3600, name), ALL, name).agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("recent")).select(
            F.lit(name).alias("table_name"), "recent")
        out = row if out is None else out.unionByName(row)
    return out


def traffic_timeseries(rollup: DataFrame, flows: DataFrame, now: float, minutes: int = 60) -> DataFrame:
    """H10."""
    _within("minutes", minutes, 1, 1440)
    return (_part(since(rollup, flows, now, minutes * 60), ALL)
            .groupBy(utc_minute(F.col("minute_us")).alias("minute"))
            .agg(F.sum("rows").alias("flow_count"), F.sum("bytes").alias("byte_count"),
                 _mean_threat().alias("avg_threat")).orderBy("minute"))


def top_sources(rollup: DataFrame, flows: DataFrame, now: float, minutes: int = 60, limit: int = 8
                ) -> DataFrame:
    """H11."""
    _within("minutes", minutes, 1, 1440)
    return (_part(since(rollup, flows, now, minutes * 60), SOURCE).groupBy(F.col("src_ip").alias("ip"))
            .agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"),
                 F.sum("rows").alias("flows"))
            .orderBy(F.desc("bytes"), "ip").limit(limit))


def top_ports(rollup: DataFrame, flows: DataFrame, now: float, minutes: int = 60, limit: int = 8
              ) -> DataFrame:
    """H12."""
    _within("minutes", minutes, 1, 1440)
    return (_part(since(rollup, flows, now, minutes * 60), PORT)
            .groupBy(F.col("dst_port").alias("port"), "protocol")
            .agg(F.sum("rows").alias("flows"), F.sum("bytes").alias("bytes"))
            .orderBy(F.desc("flows"), "port", "protocol").limit(limit))
