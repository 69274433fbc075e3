"""A table of one row per key that grows by micro-batches, for state that foreachBatch jobs look up.

Every batch writes the rows of the keys it changed and nothing else (a run). Runs are merged like
the digits of a counter: FANOUT runs of one level become one run of the next, in which each key has
its latest row only, so a row is rewritten once per level and a reader sees a few runs per level. Which
runs stand for a batch depends on its number alone, so a repeated batch reads what it read before and
replaces what it wrote. Runs that neither the last batch nor the one before it needs are deleted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FANOUT = 8
_BATCH = "_batch"


def runs(batches: int, fanout: int = FANOUT) -> list[tuple[int, int]]:
    """(level, number) of the runs that hold the first ``batches`` batches, oldest first. Run n of level
    k holds batches n * fanout^k up to the next run's first."""
    out, at, level = [], 0, 0
    while fanout ** (level + 1) <= batches:
        level += 1
    while at < batches:
        size = fanout ** level
        if at + size <= batches and at % size == 0:
            out.append((level, at // size))
            at += size
        else:
            level -= 1
    return out


class KeyedTable:
    """Rows of ``schema`` under ``path``, the latest batch's row per ``keys``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str],
                 fanout: int = FANOUT) -> None:
        self.spark, self.path, self.keys, self.fanout = spark, path, list(keys), fanout
        self.schema = T.StructType([*schema.fields, T.StructField(_BATCH, T.LongType())])
        self.columns = schema.fieldNames()

    def _place(self, run: tuple[int, int]) -> str:
        return f"{self.path}/level={run[0]}/run={run[1]}"

    def _latest(self, places: Sequence[tuple[int, int]]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*map(self._place, places))
        return (rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rows.columns), _BATCH).alias("_r"))
                .select("_r.*"))

    def read(self, batches: int) -> DataFrame:
        """All keys after the first ``batches`` batches."""
        return self._latest(runs(batches, self.fanout)).select(*self.columns)

    def write(self, batch_id: int, rows: DataFrame) -> None:
        """The rows that batch ``batch_id`` changed: one per key. Batches are numbered without gaps."""
        rows.select(*self.columns, F.lit(batch_id).cast("long").alias(_BATCH)).write.mode(
            "overwrite").parquet(self._place((0, batch_id)))
        now = runs(batch_id + 1, self.fanout)
        written = {(0, batch_id)}
        for level in range(now[-1][0]):  # the last run of each of these levels ends with this batch
            number = (batch_id + 1) // self.fanout ** (level + 1) - 1
            parts = [(level, number * self.fanout + i) for i in range(self.fanout)]
            self._latest(parts).write.mode("overwrite").parquet(self._place((level + 1, number)))
            written.add((level + 1, number))
        before = runs(batch_id, self.fanout)
        old = written | set(before) | set(runs(max(0, batch_id - 1), self.fanout))
        self._forget(old - {*now, *before})

    def _forget(self, old: set[tuple[int, int]]) -> None:
        for run in old:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(self._place(run))
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
