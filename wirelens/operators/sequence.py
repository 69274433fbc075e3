"""Sequence score and sequence windows over ordered feature rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelens.config import DEFAULTS, Settings
from wirelens.fixed_values import FEATURE_NAMES
from wirelens.operators.ordered import SLOT, neighbour_chunks, null_safe_join, row_index

RECENT = 5          # vectors averaged by the sequence score
SCALE = 10.0
_US = 1_000_000


def with_spread(df: DataFrame, out: str, columns: Sequence[str] = FEATURE_NAMES) -> DataFrame:
    """Add the population variance across the values of each row, in generated code.

    The mean is a step of its own; inlined it would be repeated once per column.
    """
    values = [f"coalesce(double({c}), 0d)" for c in columns]
    mean = " + ".join(values)
    squares = " + ".join(f"({v} - _mean) * ({v} - _mean)" for v in values)
    return (df.withColumn("_mean", F.expr(f"({mean}) / {len(values)}"))
            .withColumn(out, F.expr(f"({squares}) / {len(values)}")).drop("_mean"))


def sequence_score(df: DataFrame, keys: Sequence[str] = ("src_ip",), ts: str = "last_us",
                   tie: str = "id", columns: Sequence[str] = FEATURE_NAMES,
                   variance: str | None = None, cfg: Settings = DEFAULTS) -> DataFrame:
    """Add ``sequence_score``, the capped mean spread of the last five rows of the key.

    ``keys=()`` keeps one history for all rows. The first row of a key scores 0. A precomputed
    per-row variance can be named by ``variance``.
    """
    keys = list(keys)
    spread = df.withColumn("_var", F.col(variance)) if variance else with_spread(
        df, "_var", columns)
    # only order, key and spread travel through the ordering shuffles
    slim = spread.select(*keys, ts, tie, "_var")
    numbered = row_index(slim, keys, ts, tie, "_index", cfg.slot_s * _US)
    chunks = neighbour_chunks(numbered, "_index", before=RECENT - 1, after=0)
    recent = (Window.partitionBy(*keys, SLOT).orderBy("_index")
              .rowsBetween(-(RECENT - 1), Window.currentRow))
    score = F.least(F.lit(1.0), F.avg("_var").over(recent) * SCALE)
    scored = (chunks.withColumn("_score", score).filter("_own")
              .select(*keys, ts, tie,
                      F.when(F.col("_index") == 0, 0.0).otherwise(F.col("_score"))
                      .alias("sequence_score")))
    return null_safe_join(df, scored, [*keys, ts, tie])


def sequence_windows(df: DataFrame, ts: str, tie: str, vector: str, label: str,
                     length: int = 10, versus: str = "first_row",
                     cfg: Settings = DEFAULTS) -> DataFrame:
    """Overlapping windows of ``length`` consecutive rows over the whole table.

    Output: ``start`` (row position), ``sequence`` (array of vectors), ``target`` (1 when any class
    in the window differs from that of row 0, or of the window's first row). As in the original
    definition, the window ending at the last row is left out.
    """
    if versus not in ("first_row", "window_start"):
        raise ValueError("versus must be 'first_row' or 'window_start'")
    slim = df.select(ts, tie, vector, label)
    numbered = row_index(slim, [], ts, tie, "start", cfg.slot_s * _US)
    chunks = neighbour_chunks(numbered, "start", before=0, after=length, size=20_000)
    order = Window.partitionBy(SLOT).orderBy("start")
    ahead = order.rowsBetween(Window.currentRow, length - 1)
    if versus == "first_row":
        base = df.agg(F.min_by(label, F.struct(ts, tie))).scalar()
    else:
        base = F.first(label).over(ahead)
    windows = chunks.select(
        "start", "_own", ts, tie,
        F.collect_list(vector).over(ahead).alias("sequence"),
        F.collect_list(label).over(ahead).alias("_labels"),
        F.count(F.lit(1)).over(order.rowsBetween(Window.currentRow, length)).alias("_size"),
        base.alias("_base"))
    return windows.filter(F.col("_own") & (F.col("_size") == length + 1)).select(
        "start", ts, tie, "sequence",
        F.exists("_labels", lambda x: x != F.col("_base")).cast("int").alias("target"))
