"""Tables of scored flows, packets and alerts, exports and the live feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.operators.alerts import as_alerts

EXPORT_LIMIT = 10_000


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("dt", F.date_from_unix_date(
        F.floor(F.col("timestamp") / 86_400).cast("int")))


def append_table(df: DataFrame, path: str, mode: str = "append") -> None:
    """A5: day-partitioned parquet. Inside files packets are ordered by flow and all else by time,
    so lookups by flow or time skip row groups."""
    order = ["flow_id", "timestamp"] if {"flow_id", "packet_id"} <= set(df.columns) \
        else ["timestamp"]
    (_dated(df).sortWithinPartitions("dt", *order)
     .write.mode(mode).partitionBy("dt").parquet(path))


def store(root: str, flows: DataFrame | None = None, packets: DataFrame | None = None,
          alerts: DataFrame | None = None, batch_id: int | None = None) -> None:
    """A5: append the given parts. With ``batch_id`` each part goes to its own batch folder and a
    repeated batch replaces itself, so a restarted stream stores nothing twice."""
    for name, df in (("flows", flows), ("packets", packets), ("alerts", alerts)):
        if df is None:
            continue
        path, mode = f"{root}/{name}", "append"
        if batch_id is not None:
            path, mode = f"{path}/batch={batch_id}", "overwrite"
        append_table(df, path, mode)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Older files may lack newer columns."""
    return spark.read.option("mergeSchema", "true").parquet(f"{root}/{name}")


def export_alerts(alerts: DataFrame, path: str, fmt: str = "json", limit: int = EXPORT_LIMIT
                  ) -> None:
    """Newest alerts as one JSON-lines or CSV folder; no alerts give an empty CSV."""
    newest = as_alerts(alerts).orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)
    if fmt == "json":
        newest.write.mode("overwrite").json(path)
    elif fmt == "csv":
        newest.withColumn("details", F.to_json("details")).write.mode("overwrite") \
            .option("header", True).option("escape", '"').csv(path)
    else:
        raise ValueError("fmt must be json or csv")
