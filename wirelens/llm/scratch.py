"""Intermediate tables in the folder all executors share, and values a Python worker keeps."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``.

    Only a local master may leave the setting out (tests); a cluster without a shared folder is an
    error, since executors could not read each other's files.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_CONF)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="wirelens-llm-")
        spark.conf.set(CHECKPOINT_CONF, named)
    return f"{named.rstrip('/')}/wirelens-llm/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, lost
    executors lose nothing, and the next step sees real sizes."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results that still read them must be stored
    before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def kept(key: tuple, build: Callable[[], Any]) -> Any:
    """``build()``, once per Python worker: functions travel by value, so a module's own globals
    live for one task only."""
    store = sys.__dict__.setdefault("_wirelens_kept", {})
    if key not in store:
        store[key] = build()
    return store[key]
