"""Sequence scores on a stream of flows: each source's last variances are keyed state.

The batch job takes the mean spread of the last five flows of a source; a micro-batch alone would
forget the four before it. Here they are state of the source: at most four numbers and a count, read
and written for the sources of a micro-batch only, and dropped after ``idle_s`` seconds without a flow
of the source.

Flow windows leave the flow stream in order of time, so a source's rows of one micro-batch come after
all of its earlier ones; inside a micro-batch they are ordered by time and id. They meet in one task:
choose the trigger (or the source's rows per trigger) so that the busiest source fits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wirelens.fixed_values import FEATURE_NAMES
from wirelens.operators.sequence import RECENT, SCALE, with_spread
from wirelens.streaming.flows import EVENT_TIME

IDLE_S = 86_400
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# state operators hand rows over as named tuples, which rename columns that begin with an underscore
_KEY, _TS, _TIE, _VAR, _ROW, _SCORE = "key", "at", "tie", "spread", "row", "score"


def recent_means(earlier: Sequence[float], spreads: np.ndarray) -> np.ndarray:
    """Mean of each spread and the up to four before it, ``earlier`` ones included."""
    every = np.concatenate([np.asarray(earlier, float), spreads])
    at = np.arange(len(earlier), len(every))
    first = np.maximum(at - (RECENT - 1), 0)
    # added one after the other, as the batch window does, so that scores are equal to the last bit
    total = np.zeros(len(at))
    for back in range(RECENT - 1, -1, -1):
        held = at - back >= 0
        total[held] += every[at[held] - back]
    return total / (at - first + 1)


class SequenceHistory(StatefulProcessor):
    """Rows (key, time, tie, variance, row) -> (row, score) in the order of time and tie."""

    def __init__(self, idle_s: int) -> None:
        self.idle_s = idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getValueState("recent", "variances array<double>, expiry long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues
                        ) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values([_TS, _TIE], kind="stable")
        held = self.recent.get()
        earlier = list(held[0]) if held is not None else []
        spreads = frame[_VAR].to_numpy(float)
        scores = np.minimum(1.0, recent_means(earlier, spreads) * SCALE)
        if not earlier:
            scores[0] = 0.0
        # the source is forgotten once event time has passed its last flow by the idle time
        expiry = int(frame[_TS].iloc[-1]) // 1000 + self.idle_s * 1000
        if held is not None:
            self.handle.deleteTimer(held[1])
        self.handle.registerTimer(expiry)
        self.recent.update(([*earlier, *spreads.tolist()][-(RECENT - 1):], expiry))
        yield pd.DataFrame({_ROW: frame[_ROW].to_numpy(), _SCORE: scores})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_sequence_scores(flows: DataFrame, key: str = "src_ip", ts: str = "last_us",
                           tie: str = "id", columns: Sequence[str] = FEATURE_NAMES,
                           variance: str | None = None, event_time: str = EVENT_TIME,
                           idle_s: int = IDLE_S) -> DataFrame:
    """E8 on a stream: ``flows`` with ``sequence_score``, equal to the batch operator's.

    The rows travel through the state operator as one JSON string next to the four values it needs,
    so their types survive. ``event_time`` is the column that carries the watermark. A null key is a
    key of its own. The session needs the RocksDB state store
    (``use_keyed_state``).
    """
    spread = flows.withColumn("_var", F.col(variance)) if variance else with_spread(
        flows, "_var", columns)
    slim = spread.select(
        F.to_json(F.struct(F.col(key).cast("string").alias("k"))).alias(_KEY),
        F.col(ts).cast("long").alias(_TS), F.col(tie).cast("long").alias(_TIE),
        F.col("_var").alias(_VAR),
        F.to_json(F.struct(*flows.columns)).alias(_ROW),
        event_time)
    scored = slim.groupBy(_KEY).transformWithStateInPandas(
        SequenceHistory(idle_s), f"{_ROW} string, {_SCORE} double", "Append", "EventTime")
    return scored.select(F.from_json(_ROW, flows.schema).alias("r"), _SCORE).select(
        "r.*", F.col(_SCORE).alias("sequence_score"))


def use_keyed_state(spark) -> None:
    """State operators of this package need the RocksDB store; set before a stream starts."""
    spark.conf.set(STATE_STORE, ROCKS_DB)
