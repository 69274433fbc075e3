"""Session helpers: local builder for tests and benches, reliable lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: int | str = 8, name: str = "wirelens", **conf: str) -> SparkSession:
    """Session for one machine. On a cluster the caller brings its own session."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(name)
               .config("spark.sql.shuffle.partitions", str(cpus))
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.driver.memory", os.environ.get("WIRELENS_DRIVER_MEMORY", "8g"))
               .config("spark.ui.enabled", "false"))
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names. Without one only a local master gets a default; on a
    cluster executors could not read each other's files, so that is an error."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="wirelens-checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back, so lost executors lose no work."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# rows of a few narrow columns that are cheap to send to every executor
BROADCAST_ROWS = 1_000_000
